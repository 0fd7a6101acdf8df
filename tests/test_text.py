import html

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citespark.functions import text as tx
from citespark.functions.citations import citation_coverage, citation_validity, needs_fallback
from citespark.functions.scoring import final_score, shared_word_score
from citespark.operators.encode import HashedWordEncoder


def one(spark, value, expression, kind="string"):
    row = spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y"))
    return row.first().y


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("<p>First <b>question</b></p>", "First question"),
        ("<a\nhref='x'>one</a>\x0btwo", "one two"),
        ("  a  <br/>  b ", "a b"),
        ("keep: spaces, a c e p s", "keep: spaces, a c e p s"),
        ("1 < 2", "1 < 2"),
        ("a b", "a b"),
        (None, ""),
    ],
)
def test_strip_html(spark, raw, expected):
    assert one(spark, raw, tx.strip_html) == expected


@pytest.mark.parametrize(
    "raw",
    ["a &amp; b", "&amp;lt;", "&#39;q&#39;", "x  y\x1cz", "&nbsp;a&nbsp;", "&eacute;&copy", "", None],
)
def test_clean_text_equals_python(spark, raw):
    assert one(spark, raw, tx.clean_text) == " ".join(html.unescape(raw or "").split())


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("7", 7), (" 7 ", 7), ("12.6", 13), ("-2.5", -3), ("1e3", 1000), (".5", 1),
        ("x", 0), ("", 0), (None, 0), ("1d", 0), ("99999999999", 0), ("-4", -4),
    ],
)
def test_score_from_text(spark, raw, expected):
    assert one(spark, raw, tx.score_from_text) == expected


def test_first_words(spark):
    assert one(spark, "a b  c", lambda c: tx.first_words(c, 3)) == "a b c"
    assert one(spark, "a b c d", lambda c: tx.first_words(c, 3)) == "a b c ..."
    assert one(spark, "", lambda c: tx.first_words(c, 3)) == ""


@pytest.mark.parametrize(
    "answer, coverage, validity",
    [
        ("Use the implementation. [1]", 1.0, 1.0),
        ("This answer has no citation.", 0.0, 0.0),
        ("A paragraph that cites. [1][4]", 1.0, 0.5),
        ("A paragraph that cites. [0]", 1.0, 0.0),
        ("A paragraph that cites. [1234567890123456789012345]", 1.0, 0.0),
        ("First paragraph [1]\r\nSecond paragraph here", 0.5, 1.0),
        ("fourteen chars", 0.0, 0.0),
        ("fifteen chars [", 0.0, 0.0),
        ("short [1]\nA longer paragraph. [2]", 1.0, 1.0),
        ("One paragraph. [1] Another one here.", 0.5, 1.0),
        ("", 0.0, 0.0),
    ],
)
def test_citations(spark, answer, coverage, validity):
    row = (
        spark.createDataFrame([(answer,)], "a string")
        .select(
            citation_coverage(F.col("a")).alias("c"),
            citation_validity(F.col("a"), F.lit(3)).alias("v"),
        )
        .first()
    )
    assert (row.c, row.v) == (coverage, validity)


def test_fallback_rule(spark):
    rows = spark.createDataFrame([(0.5, 1.0), (0.4, 1.0), (1.0, 0.9)], "c double, v double")
    found = [r.f for r in rows.select(needs_fallback(F.col("c"), F.col("v")).alias("f")).collect()]
    assert found == [False, True, True]


def test_shared_words(spark):
    rows = spark.createDataFrame(
        [("Sort a list", "how to SORT the list"), ("", "x"), ("été", "L'été!")], "q string, d string"
    )
    found = [r.s for r in rows.select(shared_word_score(F.col("q"), F.col("d")).alias("s")).collect()]
    assert found == [pytest.approx(2 / 3), 0.0, 1.0]


def test_final_score_of_odd_values(spark):
    rows = spark.createDataFrame(
        [(1.0, -5), (1.0, 0), (float("nan"), 3)], "s double, a int"
    )
    found = [r.f for r in rows.select(final_score(F.col("s"), F.col("a")).alias("f")).collect()]
    assert found == [1.0, 1.0, None]


def test_entities_are_decoded_a_few_texts_at_a_time():
    class Batch:
        """An Arrow array that must not become Python strings as a whole."""

        def __init__(self, rows):
            self.rows, self.slices = pa.array(rows, pa.string()), []

        def __len__(self):
            return len(self.rows)

        def slice(self, at, size):
            self.slices.append(size)
            return self.rows.slice(at, size)

    batch = Batch([None] * 300 + ["a &amp; b", None] * 400)
    found = tx._decode_entities.func(batch)
    assert found.to_pylist() == [None] * 300 + ["a & b", None] * 400
    assert max(batch.slices) <= 256


def test_an_encoder_remembers_a_bounded_number_of_words():
    encoder = HashedWordEncoder(16)
    for at in range(0, 200_000, 1_000):
        encoder.slots(" ".join(f"w{i}" for i in range(at, at + 1_000)))
    assert len(encoder._known) <= 140_000
