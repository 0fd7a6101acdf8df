"""Look-ups in id ranges, CSV by byte ranges, and exact search with pruning."""

import random

import numpy as np
import pytest
from test_search import rankings, table
from test_index import clusters

from citespark.operators import ann, pruned, search
from citespark.operators.rerank import fetch_documents, score_pairs
from citespark.sources import raw_csv, ranged, split_csv

FIELDS = ["Id", "Title", "Body"]
CORPUS = "doc_id bigint, title string, question_body string, answer string"


def files_read(found):
    """Files that the scans of a query opened, from their metrics."""
    found.collect()
    total, todo = 0, [found._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        metrics = node.metrics()
        if metrics.contains("numFiles"):
            total += metrics.apply("numFiles").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


@pytest.fixture
def plain_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.fixture
def corpus(spark):
    rows = [(3 * i, f"Title {i}", f"<b>body</b> {i}", f"answer {i}") for i in range(400)]
    return spark.createDataFrame(rows, CORPUS)


def test_look_up_prunes_ranges(spark, corpus, tmp_path, plain_plans):
    stored = ranged.write_ranged(corpus, str(tmp_path / "c"), rows_per_range=20)
    assert len(stored.first) == 20
    few = spark.createDataFrame([(0,), (3,), (3,), (4,), (-1,), (10**9,), (None,)], "doc_id bigint")
    found = stored.look_up(few)
    assert {r.doc_id for r in found.collect()} == {0, 3}
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    assert files_read(stored.look_up(few)) == 1
    more = spark.range(0, 1_200, 120).withColumnRenamed("id", "doc_id")
    assert files_read(stored.look_up(more)) == 10
    assert files_read(stored.look_up(corpus.select("doc_id"))) == 20
    by_shuffle = stored.look_up(more, broadcast_ids=0)
    assert {r.doc_id for r in by_shuffle.collect()} == set(range(0, 1_200, 120))


def test_fetch_from_ranges_equals_fetch_from_corpus(spark, corpus, tmp_path):
    stored = ranged.write_ranged(corpus, str(tmp_path / "c"), rows_per_range=30)
    results = spark.createDataFrame(
        [(q, d, "title body") for q in range(20) for d in (3 * q, 300)],
        "query_id bigint, doc_id bigint, query string",
    )
    left = fetch_documents(results, corpus)
    right = fetch_documents(results, stored, with_words=True)
    scored = score_pairs(right)
    assert scored.columns == score_pairs(left).columns
    assert sorted(scored.collect()) == sorted(score_pairs(left).collect())
    lost = results.unionByName(results.limit(1).selectExpr("query_id", "1 AS doc_id", "query"))
    with pytest.raises(Exception, match="no document with id 1"):
        fetch_documents(lost, stored).collect()


def test_ranges_keep_repeated_ids_together(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, str(i)) for i in range(90)], "doc_id bigint, text string")
    stored = ranged.write_ranged(rows, str(tmp_path / "c"), rows_per_range=10)
    ids = spark.createDataFrame([(1,)], "doc_id bigint")
    assert stored.look_up(ids).count() == 30
    with pytest.raises(ValueError):
        ranged.write_ranged(spark.createDataFrame([(None, "")], rows.schema), str(tmp_path / "d"))
    none = ranged.write_ranged(rows.limit(0), str(tmp_path / "e"))
    assert none.look_up(ids).count() == 0


def csv_text(draw, records):
    def field():
        kind = draw.randrange(6)
        if kind == 0:
            return ""
        if kind == 1:
            return '""'
        plain = "".join(draw.choice("abé 1;") for _ in range(draw.randrange(1, 9)))
        if kind == 2:
            return plain.strip() or "x"
        inside = "".join(draw.choice(['""', ",", "\n", "\r\n", "z", "ü"]) for _ in range(draw.randrange(9)))
        return f'"{inside}"'

    lines = ["Id,Title,Body"]
    for _ in range(records):
        lines.append(",".join(field() for _ in range(draw.choice([3, 3, 3, 3, 2, 4]))))
    return "\n".join(lines)


def rows(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_byte_ranges_equal_the_whole_read(spark, tmp_path, seed):
    draw = random.Random(seed)
    path = str(tmp_path / "a.csv")
    text = csv_text(draw, 60) + draw.choice(["", "\n", "\n\n"])
    with open(path, "w", newline="", encoding="utf-8") as file:
        file.write(text)
    want = rows(raw_csv.read_text_csv(spark, path, FIELDS))
    assert len(want) > 10
    for range_bytes in (1 << 20, 97, 13):
        found = split_csv.read_split_csv(spark, path, FIELDS, range_bytes)
        assert rows(found) == want
    assert split_csv.read_split_csv(spark, path, FIELDS, 97).rdd.getNumPartitions() > 3


def test_folders_headers_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfId,Title,Body\n1,a,b\n")
    (tmp_path / "b.csv").write_bytes(b"")
    (tmp_path / "c.csv").write_bytes(b"Id,Title,Body")
    (tmp_path / "d.csv").write_bytes(b'Id,Title,"Bo\ndy"\r\n2,"x\r\ny",\r\n3,\xff,z')
    (tmp_path / "_SUCCESS").write_bytes(b'"')
    found = rows(split_csv.read_split_csv(spark, str(tmp_path), FIELDS, 5))
    assert found == [("1", "a", "b"), ("2", "x\r\ny", None), ("3", "�", "z")]
    with pytest.raises(FileNotFoundError):
        split_csv.read_split_csv(spark, str(tmp_path / "none"), FIELDS)


def test_stray_quotes_fail(spark, tmp_path):
    for line in (b'1,a"b,c', b'1,"a"b,c'):
        (tmp_path / "a.csv").write_bytes(b"Id,Title,Body\n" + line + b"\n2,x,y\n")
        with pytest.raises(Exception, match="quote inside a plain field"):
            split_csv.read_split_csv(spark, str(tmp_path / "a.csv"), FIELDS).collect()


@pytest.mark.parametrize("settings", [{}, {"broadcast_bytes": 2_000}])
def test_pruned_search_equals_the_full_one(spark, settings):
    documents = clusters(900, 12)
    documents[::3] = documents[0]
    docs, queries = table(spark, documents), table(spark, documents[:60], "query_id")
    pivots = ann.sampled_pivots(docs, 15)
    index = ann.assign_cells(docs, pivots).cache()
    found, counts = pruned.pruned_topk(queries, index, pivots, 7, **settings)
    assert rankings(found) == rankings(search.exact_topk(queries, docs, 7, 12))
    counts = counts.first()
    assert counts.all_pairs == 60 * 900
    assert 0 < counts.scored_pairs < 0.8 * counts.all_pairs


def test_pruned_search_with_small_cells(spark):
    documents = clusters(40, 6)
    docs, queries = table(spark, documents), table(spark, documents[:9], "query_id")
    pivots = ann.sampled_pivots(docs, 12)
    index = ann.assign_cells(docs, pivots).cache()
    for k in (1, 10, 60):
        found, _ = pruned.pruned_topk(queries, index, pivots, k)
        assert rankings(found) == rankings(search.exact_topk(queries, docs, k, 6))


def test_bound_is_never_below_a_score():
    draw = np.random.default_rng(2)
    queries, documents, pivot = clusters(50, 5, 1), clusters(200, 5, 2), clusters(1, 5, 3)
    a, r = pruned.angles(queries, pivot)[:, 0], pruned.angles(documents, pivot)[:, 0]
    scores = queries.astype(np.float64) @ documents.astype(np.float64).T
    for _ in range(100):
        some = draw.choice(200, 10, replace=False)
        most = pruned.best_possible(a, r[some].min(), r[some].max())
        assert (scores[:, some].max(axis=1) <= most).all()
