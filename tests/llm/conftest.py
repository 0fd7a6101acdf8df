import os
import random

import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, tied, repeated and very long texts; null ids, languages and sources."""
    draw = random.Random(4)
    words = ["lorem", "ipsum", "Dolor", "sit", "amet,", "été", "grün", "niño"]

    def prose(n):
        return " ".join(draw.choice(words) for _ in range(n))

    long = prose(30_000)
    same = prose(40)
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", None),
        (3, " \t\n ", None, "a"),
        (4, same, "en", "b"),
        (5, same.replace(" ", "\n\t"), "en", "b"),
        (6, same, None, "b"),
        (6, same, None, "b"),
        (7, long, "fr", "c"),
        (8, long + " end", "fr", "c"),
        (None, prose(20), "de", "c"),
        (None, same, "de", "c"),
        (9, "x", "de", "Z"),
        (10, "1234 %% !!", "de", "é"),
        (-5, prose(12), "en", "a"),
        (2**62, prose(12), "en", "a"),
    ]
    return [(i, t, lang, s, 0) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with more columns, named like those that operators make."""
    docs = spark.createDataFrame(odd_rows, COLUMNS)
    more = "key size norm digest shard label rep n row_id cell start taken host template".split()
    more += "repeated stays _own mixed_copy".split()
    return docs.selectExpr("*", *[f"'x' AS {name}" for name in more])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def prose_rows(odd_rows):
    """Documents with groups of copies and near copies."""
    draw = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    passage = [draw.choice(words) for _ in range(60)]
    rows, number = [], 0
    for group in range(25):
        text = [draw.choice(words) for _ in range(draw.choice([3, 5, 30, 120, 400]))]
        if group % 3 == 0:
            text += passage
        for _ in range(draw.choice([1, 1, 2, 6])):
            near = list(text)
            for _ in range(draw.choice([0, 0, 1, 2, 5])):
                near[draw.randrange(len(near))] = draw.choice(words)
            rows.append((number, " ".join(near), "en", f"s{group % 4}", 0))
            number += 1
    return rows
