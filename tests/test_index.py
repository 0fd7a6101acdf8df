"""Stored quantised index, sign tables, and tables published in versions."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_search import rankings, table, unit

from citespark.operators import lsh, quantized, search
from citespark.sources import snapshot

SF_DIR = os.environ.get("TEST_INDEX_SF_DIR", "/root/testdata/sf0.1")


@pytest.fixture(scope="module")
def vectors(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("doc_id"), "embedding").cache()


@pytest.fixture(scope="module")
def asked(vectors):
    return vectors.filter("doc_id % 4 = 0").withColumnRenamed("doc_id", "query_id")


@pytest.fixture(scope="module")
def exact(vectors, asked):
    return search.exact_topk(asked, vectors, 10, 64).toPandas()


def pairs(found):
    return set(zip(found.query_id, found.doc_id))


def clusters(n, dimension, seed=3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(20, dimension))
    return unit(centres[draw.integers(0, 20, n)] + 0.3 * draw.normal(size=(n, dimension)))


def test_quantized_recall(spark, vectors, asked, exact, tmp_path):
    written = quantized.write_index(vectors, str(tmp_path / "index"))
    assert written.about["recall"] >= 0.95
    del written
    index = quantized.open_index(spark, str(tmp_path / "index"), rows=2_000, dimension=64)
    found = quantized.quantized_topk(asked, index, 10).toPandas()
    assert len(found) == len(exact)
    assert len(pairs(found) & pairs(exact)) >= 0.9 * len(exact)
    curve = [share for _, share in index.about["curve"]]
    assert curve == sorted(curve) and curve[-1] == 1.0
    assert index.about["rows"] == 2_000 and abs(index.about["norm_mean"] - 1) < 1e-6


def test_quantized_over_all_cells_is_exact(spark, tmp_path):
    # A third of the documents are copies of one vector.
    documents = clusters(300, 16)
    documents[::3] = documents[0]
    docs, queries = table(spark, documents), table(spark, documents[:40], "query_id")
    index = quantized.write_index(docs, str(tmp_path / "index"), cells=7, pieces=4)
    want = rankings(search.exact_topk(queries, docs, 5, 16))
    for settings in ({}, {"broadcast_bytes": 40_000}):
        found = quantized.quantized_topk(queries, index, 5, 7, 60, **settings)
        assert rankings(found) == want


def test_codes_alone_rank_well(spark, tmp_path):
    documents = clusters(2_000, 32)
    docs, queries = table(spark, documents), table(spark, documents[:50], "query_id")
    index = quantized.write_index(docs, str(tmp_path / "index"), cells=20, pieces=8)
    assert index.probes < 20
    found = quantized.quantized_topk(queries, index, 10).toPandas()
    want = search.exact_topk(queries, docs, 10, 32).toPandas()
    assert len(pairs(found) & pairs(want)) >= 0.9 * len(want)
    stored = index.rows.select(F.max(F.length("code")), F.max(F.length("vector"))).first()
    assert tuple(stored) == (8, 128)


def test_index_is_refused_when_it_is_not_what_is_expected(spark, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        quantized.open_index(spark, path)
    docs = table(spark, clusters(60, 8))
    quantized.write_index(docs, path, cells=4, pieces=2)
    quantized.open_index(spark, path, rows=60, dimension=8)
    with pytest.raises(ValueError, match="rows"):
        quantized.open_index(spark, path, rows=61)
    with pytest.raises(ValueError, match="dimensions"):
        quantized.open_index(spark, path, dimension=16)
    version, about = snapshot.current(spark, path)
    for wrong in ({"format": 0}, {"metric": "l1"}, {"rows": 59}, {"cells": 5}, {"pieces": 4}):
        snapshot.publish(spark, path, version, {**about, **wrong})
        with pytest.raises(ValueError):
            quantized.open_index(spark, path)
    snapshot.publish(spark, path, version, about)
    assert quantized.open_index(spark, path).about == about


def test_bad_index_settings(spark, tmp_path):
    docs = table(spark, clusters(60, 8))
    with pytest.raises(ValueError):
        quantized.write_index(docs, str(tmp_path / "a"), cells=61)
    with pytest.raises(ValueError):
        quantized.write_index(docs, str(tmp_path / "b"), pieces=3)
    with pytest.raises(ValueError):
        quantized.write_index(docs.limit(0), str(tmp_path / "c"))
    one = quantized.write_index(docs.limit(1), str(tmp_path / "d"))
    found = quantized.quantized_topk(docs.limit(1).withColumnRenamed("doc_id", "query_id"), one, 3)
    assert found.count() == 1


def test_sign_tables_recall(vectors, asked, exact):
    plan, choices = lsh.fit_tables(vectors, 64)
    found = lsh.lsh_tables_topk(asked, vectors, plan, 10).toPandas()
    assert len(pairs(found) & pairs(exact)) >= 0.9 * len(exact)
    # These vectors have no clusters, so most buckets are needed; the least work is chosen.
    assert plan.probes / (1 << plan.planes.shape[1]) == min(c[2] for c in choices)
    read = lsh.rows_read(asked, vectors, plan).toPandas()
    assert (read.buckets == plan.probes).all() and read.rows_read.mean() > 10


def test_sign_tables_read_little_of_clustered_vectors(spark):
    documents = clusters(3_000, 32)
    docs, queries = table(spark, documents), table(spark, documents[:60], "query_id")
    plan, choices = lsh.fit_tables(docs, 32, recall=0.9)
    # More tables need fewer rows for one recall.
    assert min(c[2] for c in choices) < choices[0][2]
    found = lsh.lsh_tables_topk(queries, docs, plan, 10).toPandas()
    want = search.exact_topk(queries, docs, 10, 32).toPandas()
    assert len(pairs(found) & pairs(want)) >= 0.85 * len(want)
    assert lsh.rows_read(queries, docs, plan).toPandas().rows_read.mean() < 1_000


def test_all_buckets_are_exact(spark):
    documents = clusters(200, 8)
    documents[::3] = documents[0]
    docs, queries = table(spark, documents), table(spark, documents[:30], "query_id")
    plan = lsh.sign_tables(3, 4, 8, probes=48)
    want = rankings(search.exact_topk(queries, docs, 5, 8))
    for settings in ({}, {"broadcast_bytes": 5_000}):
        assert rankings(lsh.lsh_tables_topk(queries, docs, plan, 5, **settings)) == want


def test_buckets_come_in_the_order_of_their_margins():
    plan = lsh.sign_tables(2, 3, 6, probes=16)
    vectors = clusters(20, 6)
    margins = np.einsum("tbd,qd->qtb", plan.planes, vectors.astype(np.float64))
    for q, order in enumerate(plan.order(vectors, 16)):
        cost = {}
        for t in range(2):
            for flips in range(8):
                bits = [(margins[q, t, b] >= 0) ^ (flips >> b & 1) for b in range(3)]
                bucket = 8 * t + sum(1 << b for b in range(3) if bits[b])
                cost[bucket] = sum(margins[q, t, b] ** 2 for b in range(3) if flips >> b & 1)
        assert sorted(order) == list(range(16))
        costs = [cost[b] for b in order]
        assert costs == sorted(costs)
        assert set(order[:2]) == set(plan.codes(vectors[q : q + 1])[0])


def test_bad_tables_are_rejected():
    for bad in ((0, 4, 8, 1), (17, 4, 8, 1), (2, 13, 8, 1), (2, 4, 8, 0)):
        with pytest.raises(ValueError):
            lsh.sign_tables(*bad)


def test_snapshot_is_whole_after_a_stop_at_any_step(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    first = spark.range(5)
    with pytest.raises(FileNotFoundError):
        snapshot.read_snapshot(spark, path)
    snapshot.write_snapshot(first, path, {"n": 5})
    # Data written, pointer not.
    spark.range(9).write.parquet(snapshot.new_version(path))
    assert snapshot.read_snapshot(spark, path).count() == 5
    # Data half written.
    os.makedirs(snapshot.new_version(path) + "/_temporary")
    assert snapshot.read_snapshot(spark, path).count() == 5
    # Pointer drafted, not in place.
    (tmp_path / "table" / ".CURRENT-x").write_text(json.dumps({"version": "gone"}))
    assert snapshot.read_snapshot(spark, path).count() == 5
    snapshot.write_snapshot(spark.range(7), path)
    assert snapshot.read_snapshot(spark, path).count() == 7
    assert snapshot.current(spark, path)[1] == {}
    assert snapshot.drop_old(spark, path) == 3
    assert snapshot.read_snapshot(spark, path).count() == 7


def test_no_shortlist_passes_through_the_driver(spark, tmp_path, monkeypatch):
    documents = clusters(300, 16)
    docs, queries = table(spark, documents), table(spark, documents[:40], "query_id")
    index = quantized.write_index(docs, str(tmp_path / "index"), cells=7, pieces=4)
    collect, collected = type(docs).toArrow, []

    def recorded(frame):
        collected.append(collect(frame))
        return collected[-1]

    monkeypatch.setattr(type(docs), "toArrow", recorded)
    want = rankings(search.exact_topk(queries, docs, 5, 16))
    for probes, shortlist in ((7, 60), (7, 40), (4, 12)):
        collected.clear()
        found = rankings(quantized.quantized_topk(queries, index, 5, probes, shortlist))
        assert max(t.num_rows for t in collected) <= 40
        assert len(found) == len(want)
        assert probes < 7 or found == want


def test_buckets_of_documents_lie_together(spark):
    documents = clusters(600, 16)
    docs, queries = table(spark, documents), table(spark, documents[:50], "query_id")
    plan = lsh.sign_tables(3, 4, 16, probes=5)
    # The bits of a query are the buckets of the order, ties included.
    assert all(
        set(np.flatnonzero(np.unpackbits(bits, bitorder="little"))) == set(order)
        for bits, order in zip(plan.probed_bits(documents, 5), plan.order(documents, 5))
    )
    rows = lsh._by_bucket(docs, plan).withColumn("task", F.spark_partition_id())
    spread = rows.groupBy("_bucket").agg(F.countDistinct("task").alias("n")).toPandas()
    assert spread.n.mean() < 2 and rows.count() == 3 * 600
    for settings in ({}, {"broadcast_bytes": 5_000}):
        found = lsh.lsh_tables_topk(queries, docs, plan, 5, **settings).toPandas()
        own = plan.codes(documents)
        for q in range(50):
            probed = np.isin(own, plan.order(documents[q : q + 1], 5)[0]).any(axis=1)
            scores = np.round(documents.astype(float) @ documents[q].astype(float), 9)
            want = sorted(np.flatnonzero(probed), key=lambda d: (-scores[d], d))[:5]
            assert list(found[found.query_id == q].sort_values("rank").doc_id) == want


def test_parts_of_many_queries_meet_each_document_once(spark, monkeypatch):
    documents = clusters(900, 16, seed=8)
    documents[::7] = documents[0]
    docs, queries = table(spark, documents), table(spark, documents[:300], "query_id")
    own_buckets = lsh._by_bucket

    def laid_out(*_):
        raise AssertionError("documents are laid out once per table")

    for tables, bits, probes in ((3, 4, 7), (8, 3, 5), (1, 2, 3)):
        plan = lsh.sign_tables(tables, bits, 16, probes=probes)
        want = rankings(lsh.lsh_tables_topk(queries, docs, plan, 5))
        monkeypatch.setattr(lsh, "_by_bucket", laid_out)
        found = lsh.lsh_tables_topk(queries, docs, plan, 5, broadcast_bytes=5_000)
        assert rankings(found) == want
        monkeypatch.setattr(lsh, "_by_bucket", own_buckets)
    # The edge of the probes is that of a stable sort of all buckets, ties included.
    plan = lsh.sign_tables(3, 4, 16, probes=9)
    margins = np.round(plan.margins(documents), 1)
    flips = np.arange(16)[:, None] >> np.arange(4) & 1
    for row, cut, last in zip(margins, *plan.edges(margins, 9)):
        costs = [sum((m[b] for b in range(4) if f[b]), 0.0) for m in row for f in flips]
        assert last == np.argsort(costs, kind="stable")[8] and cut == costs[last]


def test_parts_of_many_queries_know_their_cuts_where_they_use_them(spark, tmp_path, monkeypatch):
    documents = clusters(500, 16, seed=9)
    documents[::9] = documents[0]
    docs, queries = table(spark, documents), table(spark, documents[:200], "query_id")
    index = quantized.write_index(docs, str(tmp_path / "index"), cells=9, pieces=4)
    for probes, shortlist in ((9, 100), (9, 6), (3, 2), (1, 1)):
        want = rankings(quantized.quantized_topk(queries, index, 5, probes, shortlist))
        with monkeypatch.context() as patched:
            # No list of sums is sent to be merged.
            patched.setattr(quantized, "_cuts", None)
            found = quantized.quantized_topk(queries, index, 5, probes, shortlist, 5_000)
            assert rankings(found) == want
            patched.setattr(quantized, "whole_parts", lambda *_: 3)
            found = quantized.quantized_topk(queries, index, 5, probes, shortlist, 5_000)
            assert rankings(found) == want


def test_cuts_are_those_of_sorting_all_sums():
    draw = np.random.default_rng(2)
    sums = draw.normal(size=(30, 6_000)).astype(np.float32)
    sums[:, ::5] = sums[:, :1]
    sums[3, 40:] = -np.inf
    for count in (1, 50, 700):
        cuts = quantized._Cuts(30, count)
        for low in range(0, 6_000, 1_500):
            rows = draw.permutation(30)
            cuts.add(rows, sums[rows, low : low + 1_500])
        held = cuts.best()
        want = -np.sort(-sums, axis=1)[:, :count]
        assert np.array_equal(-np.sort(-held, axis=1), want)
        assert np.array_equal(cuts.least, want[:, -1])
