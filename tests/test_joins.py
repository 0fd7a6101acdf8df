from pyspark.sql import functions as F

from citespark.operators import corpus, joins, rerank


def test_hot_key_is_dealt_over_copies(spark):
    many = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.lit("x").alias("x")
    )
    one = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for how in ("inner", "left"):
            plain = many.join(one, "k", how).groupBy("k", "v").count()
            found = joins.join_to_unique(many, one, "k", how, rows_per_copy=100)
            assert sorted(map(str, found.groupBy("k", "v").count().collect())) == sorted(
                map(str, plain.collect())
            )
        tasks = found.filter("k = 7").select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_fetch_of_a_hot_document(spark):
    results = spark.range(600).select(
        F.col("id").alias("query_id"), F.lit(1).alias("rank"),
        F.when(F.col("id") % 3 == 0, 2).otherwise(F.col("id") % 5).alias("doc_id"),
    )
    docs = spark.range(5).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("title"),
        F.concat(F.lit("b&amp;"), F.col("id")).alias("question_body"), F.lit("a").alias("answer"))
    found = rerank.fetch_documents(results, docs, rows_per_copy=10).collect()
    assert sorted(r.query_id for r in found) == list(range(600))
    assert all(r.question_body == f"b&{r.doc_id}" for r in found)


def test_corpus_with_a_hot_question_id(spark, monkeypatch):
    """A third of the question rows are copies under one id; all are kept."""
    monkeypatch.setattr(joins.join_to_unique, "__defaults__", ("inner", 20, None))
    questions = spark.range(300).select(
        F.when(F.col("id") < 100, 5).otherwise(F.col("id")).cast("string").alias("Id"),
        F.lit("1").alias("Score"), F.lit("t").alias("Title"), F.lit("b").alias("Body"))
    given = spark.range(300).select(
        F.col("id").cast("string").alias("Id"), F.col("id").cast("string").alias("ParentId"),
        F.lit("1").alias("Score"), F.lit("a").alias("Body"))
    found = corpus.build_corpus(questions, given)
    assert sorted(r.doc_id for r in found.collect()) == list(range(300))
    assert found.filter("question_id = 5").count() == 100
