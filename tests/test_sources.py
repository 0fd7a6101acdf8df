import os
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from citespark.operators import corpus
from citespark.operators.encode import (
    HashedWordEncoder,
    encode_texts,
    encode_tfidf,
    pending_rows,
    tfidf_model,
)
from citespark.plans.encode_table import encode_pending
from citespark.plans.make_corpus import corpus_from_csv
from citespark.sources import matrix, raw_csv, tables
from citespark.streaming.encode_stream import encode_new_files
from tests_support import table, unit

# The fake models below are sent to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUESTIONS = '''Id,Score,Title,Body
1,5,First <b>question</b>,<p>Body one</p>
2,x,Second,"<p>Body, ""two""
with a line</p>"
3,1e1,Third,<p>Body three</p>
4,7,Fourth,<p>Body four</p>
bad,1,No id,<p>dropped</p>
6,1,Unanswered,<p>dropped</p>
7,1
8,1,Too,many,fields
'''
ANSWERS = '''Id,ParentId,Score,Body
11,1,1,<p>First answer</p>
12,1,9,<p>Best answer</p>
21,2,3,<p>Tie high id</p>
20,2,3,<p>Tie low id</p>
31,3,,<p>No score</p>
41,4,2,<p>Fourth</p>
51
99,8,1,<p>Parent was malformed</p>
'''


@pytest.fixture
def raw(tmp_path):
    (tmp_path / "questions.csv").write_text(QUESTIONS)
    (tmp_path / "Answers.csv").write_text(ANSWERS)
    return str(tmp_path)


def test_csv_drops_malformed_rows_even_when_pruned(spark, raw):
    questions = raw_csv.read_questions(spark, raw)
    assert [r.Id for r in questions.select("Id").collect()] == ["1", "2", "3", "4", "bad", "6"]
    assert questions.filter("Id = 2").first().Body == '<p>Body, "two"\nwith a line</p>'
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        raw_csv.read_raw_table(spark, raw, "Tags.csv", ["Id"])
    with pytest.raises(ValueError, match="lacks columns"):
        raw_csv.read_raw_table(spark, raw, "Answers.csv", ["Id", "Tag"])


def test_corpus_from_csv(spark, raw, tmp_path):
    output = str(tmp_path / "corpus")
    rows = {r.question_id: r for r in corpus_from_csv(spark, raw, output).collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    assert sorted(r.doc_id for r in rows.values()) == [0, 1, 2, 3]
    assert (rows[1].title, rows[1].answer, rows[1].answer_id) == (
        "First question", "Best answer", 12)
    assert rows[1].url.endswith("/1")
    assert rows[2].answer_id == 20 and rows[2].question_score == 0
    assert (rows[3].question_score, rows[3].answer_score) == (10, 0)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        corpus_from_csv(spark, raw, output)
    assert corpus_from_csv(spark, raw, output, n=2, overwrite=True).count() == 2
    manifest = spark.read.json(output + ".manifest").first()
    assert (manifest.statistics.objects, manifest.target_objects) == (2, 2)
    with pytest.raises(ValueError, match="only 4"):
        corpus_from_csv(spark, raw, output, n=5, overwrite=True)


def test_sampled_corpus_is_the_head_of_the_whole(spark):
    questions = spark.range(200).select(
        F.col("id").cast("string").alias("Id"), F.lit("1").alias("Score"),
        F.lit("t").alias("Title"), F.lit("b").alias("Body"))
    given = spark.range(600).select(
        F.col("id").cast("string").alias("Id"), (F.col("id") % 150).cast("string").alias("ParentId"),
        (F.col("id") % 7).cast("string").alias("Score"), F.lit("a").alias("Body"))
    whole = corpus.build_corpus(questions, given).filter("doc_id < 40")
    part = corpus.build_corpus(questions, given, n=40)
    assert sorted(part.collect()) == sorted(whole.collect())


def test_best_answer_of_a_hot_question(spark):
    """One question has most of the answers."""
    given = spark.range(5000).select(
        F.col("id").alias("answer_id"), F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id")).alias("question_id"),
        (F.col("id") % 1000).cast("int").alias("answer_score"), F.lit("x").alias("answer_html"))
    hot = corpus.best_answers(given).filter("question_id = 1").collect()
    assert [(r.answer_score, r.answer_id) for r in hot] == [(998, 998)]
    plan = corpus.best_answers(given)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_duplicate_questions_multiply(spark):
    questions = spark.createDataFrame(
        [("1", "1", "a", "x"), ("1", "2", "b", "y")], "Id string, Score string, Title string, Body string")
    given = spark.createDataFrame([("5", "1", "0", "z")], "Id string, ParentId string, Score string, Body string")
    found = corpus.build_corpus(questions, given).collect()
    assert sorted((r.doc_id in (0, 1), r.title) for r in found) == [(True, "a"), (True, "b")]


def test_matrix_round_trip(spark, tmp_path):
    vectors = unit(np.random.default_rng(0).normal(size=(100, 5)))
    path = str(tmp_path / "parts")
    matrix.write_matrix(table(spark, vectors).repartition(6), path, 5)
    assert matrix.matrix_rows(spark, path, 5) == 100
    found = matrix.read_matrix(spark, path, 5).orderBy("doc_id").collect()
    assert [r.doc_id for r in found] == list(range(100))
    assert np.array_equal(np.array([r.embedding for r in found], dtype=np.float32), vectors)
    with pytest.raises(FileExistsError):
        matrix.write_matrix(table(spark, vectors), path, 5)


def test_half_written_matrix_is_refused(spark, tmp_path):
    path = tmp_path / "parts"
    matrix.write_matrix(table(spark, unit([[1, 0], [0, 1]])), str(path), 2)
    (path / "_SUCCESS").rename(path / "other")
    with pytest.raises(ValueError, match="not written to its end"):
        matrix.read_matrix(spark, str(path), 2)


def test_matrix_paths_resolve_like_spark_paths(spark):
    assert matrix.qualified(spark, "/a/b") == "file:/a/b"
    assert matrix._open("file:/a/b")[1] == "/a/b"
    conf = spark._jsc.hadoopConfiguration()
    usual = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.other.link./a", "file:///tmp")
    conf.set("fs.defaultFS", "viewfs://other/")
    try:
        assert matrix.qualified(spark, "/a/b") == "viewfs://other/a/b"
    finally:
        conf.set("fs.defaultFS", usual)


def test_single_matrix_file_is_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(matrix, "ROWS_PER_TASK", 3)
    vectors = unit([[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 0]])
    path = str(tmp_path / "vectors.f32")
    vectors.tofile(path)
    found = matrix.read_matrix(spark, path, 3).orderBy("doc_id").collect()
    assert np.array_equal(np.array([r.embedding for r in found], dtype=np.float32), vectors)
    for dimension in (5, 0):
        with pytest.raises(ValueError):
            matrix.matrix_rows(spark, path, dimension)
    (tmp_path / "empty.f32").write_bytes(b"")
    with pytest.raises(ValueError, match="no vectors"):
        matrix.matrix_rows(spark, str(tmp_path / "empty.f32"), 3)


def test_table_schema_check_and_sinks(spark, tmp_path):
    rows = spark.range(3).withColumnRenamed("id", "doc_id")
    tables.write_corpus(rows, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="question_body"):
        tables.read_columns(spark, str(tmp_path / "t"), ["doc_id", "question_body"])
    tables.write_corpus(rows.limit(0), str(tmp_path / "none"))
    with pytest.raises(ValueError, match="no rows"):
        tables.read_columns(spark, str(tmp_path / "none"), ["doc_id"])
    tables.write_metrics_csv(rows, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 3
    tables.write_run_json(rows.limit(1), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().doc_id == 0


def fake_encoder():
    """Four features of a text, of unit length."""
    def encode(texts):
        rows = np.array([[len(t) + 1, sum(map(ord, t)) % 17 + 1, t.count("a") + 1, t.count("e") + 1] for t in texts], dtype=float)
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)
    return encode


def test_encode_with_a_plugged_encoder(spark):
    rows = spark.createDataFrame([(i, f"Question body {i}") for i in range(4)] + [(4, None)], "doc_id bigint, t string")
    found = encode_texts(rows, "t", fake_encoder, 4, batch_size=2).orderBy("doc_id").collect()
    assert np.allclose(np.linalg.norm([r.embedding for r in found], axis=1), 1)
    assert np.allclose(found[4].embedding, fake_encoder()([""])[0])
    with pytest.raises(Exception, match="the encoder returned"):
        encode_texts(rows, "t", fake_encoder, 5).collect()
    with pytest.raises(Exception, match="unit length"):
        encode_texts(rows, "t", lambda: (lambda texts: np.ones((len(texts), 4))), 4).collect()


def test_encoder_runs_once_per_row(spark):
    rows = spark.createDataFrame([(0, "a b")], "doc_id bigint, t string")
    vectors = encode_texts(rows, "t", lambda: HashedWordEncoder(8), 8)
    plan = vectors.select(F.explode("embedding"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_tfidf(spark):
    rows = spark.createDataFrame([(0, "red apple"), (1, "green apple"), (2, "!!")], "doc_id bigint, t string")
    model = tfidf_model(rows, "t", 64)
    found = {r.doc_id: np.array(r.embedding) for r in encode_tfidf(rows, model).collect()}
    assert sorted(found) == [0, 1, 2]
    assert all(np.linalg.norm(v) == pytest.approx(1, abs=1e-6) for v in found.values())
    assert 0 < found[0] @ found[1] < 1
    assert found[2].tolist() == [1.0] + [0.0] * 63


def test_tfidf_gives_every_row_a_vector(spark):
    """A word of all documents weighs nothing, and a null text has no words."""
    rows = spark.createDataFrame([(0, "same"), (1, "same"), (2, None)], "doc_id bigint, t string")
    model = tfidf_model(rows.filter("doc_id < 2"), "t", 16)
    assert encode_tfidf(rows, model).filter("embedding[0] = 1").count() == 3


def test_pending(spark):
    done = spark.createDataFrame([(1,), (1,), (7,)], "doc_id bigint")
    assert sorted(r.doc_id for r in pending_rows(spark.range(4).withColumnRenamed("id", "doc_id"), done, "doc_id").collect()) == [0, 2, 3]


def test_encoding_in_runs(spark, tmp_path):
    rows = spark.range(6).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    output = str(tmp_path / "out")
    make = lambda: HashedWordEncoder(8)
    assert encode_pending(rows.filter("doc_id < 4"), output, make, "m", 8).count() == 4
    found = encode_pending(rows, output, make, "m", 8)
    assert sorted(r.doc_id for r in found.collect()) == list(range(6))
    with pytest.raises(ValueError, match="was encoded with"):
        encode_pending(rows, output, make, "m", 16)


def test_encoding_goes_on_after_a_failed_first_run(spark, tmp_path):
    rows = spark.range(6).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    output, flag = str(tmp_path / "out"), tmp_path / "fail"
    flag.touch()

    def make():
        if flag.exists():
            raise RuntimeError("no model")
        return HashedWordEncoder(8)

    with pytest.raises(Exception, match="no model"):
        encode_pending(rows, output, make, "m", 8, source="a")
    flag.unlink()
    found = encode_pending(rows, output, make, "m", 8, source="a")
    assert sorted(r.doc_id for r in found.collect()) == list(range(6))
    with pytest.raises(ValueError, match="was encoded with"):
        encode_pending(rows, output, make, "m", 8, source="b")


def test_settings_folder_left_empty(spark, tmp_path):
    (tmp_path / "out" / "settings").mkdir(parents=True)
    (tmp_path / "out" / "vectors").mkdir()
    rows = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    assert encode_pending(rows, str(tmp_path / "out"), lambda: HashedWordEncoder(8), "m", 8).count() == 1


def test_stream_without_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = spark.createDataFrame([], "doc_id bigint, text string").schema
    found = encode_new_files(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), lambda: HashedWordEncoder(8), "m", 8)
    assert found.count() == 0 and found.columns == ["doc_id", "embedding"]


def test_stream_takes_up_only_new_files(spark, tmp_path):
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    counted = tmp_path / "seen"
    counted.mkdir()

    def make():
        inner = HashedWordEncoder(8)
        def encode(texts):
            for t in texts:
                (counted / f"{t}-{os.urandom(4).hex()}").touch()
            return inner(texts)
        return encode

    def add(ids):
        spark.createDataFrame([(i, f"text{i}") for i in ids], "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(source)

    def run(name="m"):
        schema = spark.read.parquet(source).schema
        return encode_new_files(spark, source, schema, output, make, name, 8)

    add([0, 1])
    assert run().count() == 2
    add([2])
    assert sorted(r.doc_id for r in run().collect()) == [0, 1, 2]
    assert len(list(counted.iterdir())) == 3
    assert run().count() == 3
    with pytest.raises(ValueError, match="was encoded with"):
        run("other")


def test_stream_resumes_after_a_failure(spark, tmp_path):
    source, output, flag = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "fail"
    spark.createDataFrame([(i, f"t{i}") for i in range(6)], "doc_id bigint, text string").repartition(3).write.parquet(source)
    flag.touch()

    def make():
        if flag.exists():
            raise RuntimeError("no model")
        return HashedWordEncoder(8)

    def run():
        return encode_new_files(spark, source, spark.read.parquet(source).schema, output, make, "m", 8, files_per_trigger=1)

    with pytest.raises(Exception):
        run()
    flag.unlink()
    assert sorted(r.doc_id for r in run().collect()) == list(range(6))
