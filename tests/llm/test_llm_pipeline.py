import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citespark.llm import exact_dedup, ngram_join, queries, source_mix

pytest.importorskip("public_tokenizers")

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_stages_in_order(spark, documents):
    columns = documents.columns
    docs = documents
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF_DIR)
        if name != "BPE":
            assert docs.columns == columns
        docs = docs.cache()
        kept.append((name, before, docs))
    language, exact, near, mix, bpe = [after for _, _, after in kept]
    assert language.count() == documents.count()  # every document has letters here
    assert exact.count() == exact_dedup.exact_dedup(language).filter("kept").count()
    components = ngram_join.jaccard_components(exact)
    assert near.count() == components.select("component_id").distinct().count()
    assert bpe.count() == mix.count()
    words = mix.groupBy("source").agg(F.sum(source_mix.word_count(F.col("text"))).alias("words"))
    total = near.agg(F.sum(source_mix.word_count(F.col("text")))).first()[0]
    assert words.agg(F.sum("words")).first()[0] == pytest.approx(total, rel=0.2)


def test_pipeline_of_odd_rows(spark, odd, odd_rows, none):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF_DIR).cache()
        assert docs.columns == odd.columns
    texts = [r.text for r in docs.collect()]
    assert None not in texts and "" not in texts
    # The long pair and the copies have come down to one each.
    assert len(texts) == 6
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.count() == 0


def test_a_query_for_each_operator():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]
    assert set(queries.oracle_sql()) <= set(names)


def test_repeats_of_each_source_meet_its_target(spark):
    """Few long documents hold most words; ids repeat, and some are null."""
    draw = random.Random(6)
    rows = []
    for n, source in enumerate(["a", "b", "c", "d", None]):
        for i in range(250):
            size = draw.choice([3_000, 6_000]) if i % 50 == 0 else draw.randrange(1, 120)
            doc_id = None if i % 40 == 7 else 1000 * n + i - (i % 30 == 11)
            rows.append((doc_id, " ".join(["w", f"x{i}"] * size)[: 3 * size], "en", source, 0))
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, columns).selectExpr("*", "1 AS times").repartition(5)
    words = source_mix.word_count(F.col("text"))
    mixed = source_mix.mixed_documents(docs)
    assert mixed.columns == docs.columns
    given = {r.source: r.words for r in mixed.groupBy("source").agg(F.sum(words).alias("words")).collect()}
    sizes = {r.source: r.words for r in docs.groupBy("source").agg(F.sum(words).alias("words")).collect()}
    order = ["a", "b", "c", "d", None]
    turns = [source_mix.WEIGHTS[i % 3] for i in range(5)]
    targets = source_mix.water_fill([sizes[s] for s in order], turns)
    for source, target in zip(order, targets, strict=True):
        assert given[source] == pytest.approx(target, rel=0.03), source
    most = mixed.groupBy("doc_id", "source", "text").count().agg(F.max("count")).first()[0]
    assert most <= source_mix.MAX_REPEATS


def test_stages_keep_columns_of_any_name(odd):
    """Repeated ids, and columns named like those that the stages make."""
    from citespark.llm import exact_dedup, source_mix

    assert exact_dedup.drop_exact_copies(odd).columns == odd.columns
    assert exact_dedup.drop_exact_copies(odd).count() > 0
    mixed = source_mix.mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert {r.mixed_copy for r in mixed.collect()} == {"x"}
