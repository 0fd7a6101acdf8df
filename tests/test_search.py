import numpy as np
import pytest
from pyspark.sql import functions as F

from citespark.functions.vectors import l2_normalize
from citespark.operators import ann, project, search
from citespark.operators.checks import vector_report


def unit(rows):
    rows = np.asarray(rows, dtype=np.float64)
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


def table(spark, vectors, name="doc_id", ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame(
        [(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)],
        f"{name} bigint, embedding array<float>",
    )


def brute(queries, documents, k, allowed=None):
    scores = np.round(queries.astype(np.float64) @ documents.astype(np.float64).T, 9)
    found = {}
    for q in range(len(queries)):
        docs = [d for d in range(len(documents)) if allowed is None or allowed[q, d]]
        best = sorted(docs, key=lambda d: (-scores[q, d], d))[:k]
        found[q] = [(d, pytest.approx(scores[q, d])) for d in best]
    return found


def rankings(found):
    result = {}
    for r in found.orderBy("query_id", "rank").collect():
        result.setdefault(r.query_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(result[r.query_id])
    return result


GRID = {"broadcast_bytes": 0, "query_part_rows": 7, "document_part_rows": 11}


@pytest.mark.parametrize("settings", [{}, GRID])
def test_small_example(spark, settings):
    documents = unit([[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 0]])
    found = rankings(
        search.exact_topk(
            table(spark, unit([[1, 0, 0]]), "query_id"), table(spark, documents), 3, 3, **settings
        )
    )
    assert found[0][0] == (0, pytest.approx(1.0, abs=1e-6))
    assert [d for d, _ in found[0]] == [0, 3, 1]


@pytest.mark.parametrize("settings", [{}, GRID])
def test_equals_brute_force_with_copies(spark, settings):
    """A third of the documents are copies of one vector, so ties are many."""
    rng = np.random.default_rng(1)
    documents = unit(rng.normal(size=(90, 6)))
    documents[::3] = documents[0]
    queries = np.concatenate([unit(rng.normal(size=(20, 6))), documents[:5]])
    found = rankings(
        search.exact_topk(
            table(spark, queries, "query_id"), table(spark, documents), 8, 6, **settings
        )
    )
    assert found == brute(queries, documents, 8)


def test_tiles_and_floor_keep_everything(monkeypatch):
    """The running best-k of one task, over many small tiles in random order."""
    monkeypatch.setattr(search, "TILE_VALUES", 64)
    rng = np.random.default_rng(2)
    queries, documents = unit(rng.normal(size=(30, 4))), unit(rng.normal(size=(400, 4)))
    documents[100:250] = documents[7]
    ids = rng.permutation(400)
    best = search._BestK(np.arange(30), queries, 10)
    for start in range(0, 400, 37):
        part = ids[start : start + 37]
        best.add(part, documents[part], np.arange(30))
    found = {}
    for q, d, s in sorted(zip(*best.result()), key=lambda r: (r[0], -r[2], r[1])):
        found.setdefault(q, []).append((d, s))
    assert found == brute(queries, documents, 10)


def test_k_above_table_size_returns_all(spark):
    documents = unit(np.eye(3))
    found = rankings(
        search.exact_topk(table(spark, documents, "query_id"), table(spark, documents), 9, 3)
    )
    assert all(len(r) == 3 for r in found.values())


def test_bad_queries_are_rejected(spark):
    documents = table(spark, unit(np.eye(3)))
    for bad in ([[1.0, 0.0]], [[2.0, 0.0, 0.0]], [[float("nan"), 0.0, 1.0]]):
        with pytest.raises(Exception, match="unit length"):
            search.exact_topk(table(spark, bad, "query_id"), documents, 1, 3).collect()
    with pytest.raises(ValueError):
        search.exact_topk(table(spark, unit(np.eye(3)), "query_id"), documents, 0, 3)


@pytest.mark.parametrize("settings", [{}, GRID])
def test_bad_documents_are_rejected(spark, settings):
    queries = table(spark, unit(np.eye(2)), "query_id")
    for bad in ([[2.0, 0.0], [0.0, 3.0]], [[float("inf"), 0.0]], [[1.0, 0.0, 0.0]]):
        with pytest.raises(Exception, match="vectors"):
            search.exact_topk(queries, table(spark, bad), 1, 2, **settings).collect()


@pytest.mark.parametrize("settings", [{}, GRID])
def test_cells_equal_brute_force(spark, settings):
    """Most documents fall into one cell; every probed cell is searched whole."""
    rng = np.random.default_rng(4)
    documents = unit(np.concatenate([rng.normal(size=(40, 5)), [1, 0, 0, 0, 0] + 0.1 * rng.normal(size=(80, 5))]))
    queries = unit(rng.normal(size=(15, 5)))
    docs, asked = table(spark, documents), table(spark, queries, "query_id")
    pivots = ann.sampled_pivots(docs, 6)
    index = ann.assign_cells(docs, pivots)
    cell = np.argmax(np.round(documents.astype(np.float64) @ pivots.T, 9), axis=1)
    order = np.argsort(-np.round(queries.astype(np.float64) @ pivots.T, 9), axis=1, kind="stable")
    for nprobe in (1, 3, 6):
        allowed = np.array([np.isin(cell, order[q, :nprobe]) for q in range(len(queries))])
        found = rankings(ann.cell_topk(asked, index, pivots, 5, nprobe, **settings))
        expected = {q: r for q, r in brute(queries, documents, 5, allowed).items() if r}
        assert found == expected
    assert found == brute(queries, documents, 5)


def test_kmeans_over_all_cells_is_exact(spark):
    rng = np.random.default_rng(6)
    documents = unit(rng.normal(size=(60, 4)))
    docs, asked = table(spark, documents), table(spark, documents[:10], "query_id")
    pivots = ann.kmeans_pivots(docs, 4)
    found = rankings(ann.cell_topk(asked, ann.assign_cells(docs, pivots), pivots, 5, 4))
    assert found == brute(documents[:10], documents, 5)


def test_stored_index_keeps_all_rows(spark, tmp_path):
    rng = np.random.default_rng(8)
    docs = table(spark, unit(rng.normal(size=(200, 4))))
    index = ann.assign_cells(docs, ann.sampled_pivots(docs, 3))
    ann.write_cells(index, str(tmp_path / "cells"), rows_per_file=20)
    stored = spark.read.parquet(str(tmp_path / "cells"))
    assert sorted(stored.select("_cell", "doc_id").collect()) == sorted(
        index.select("_cell", "doc_id").collect()
    )


@pytest.mark.parametrize("settings", [{}, GRID])
def test_lsh_equals_brute_force(spark, settings):
    rng = np.random.default_rng(9)
    documents, queries = unit(rng.normal(size=(100, 6))), unit(rng.normal(size=(12, 6)))
    planes = ann.sign_planes(4, 6)
    code = lambda v: (np.round(v.astype(np.float64) @ planes.T, 9) >= 0)
    distance = (code(queries)[:, None, :] != code(documents)[None]).sum(axis=2)
    found = rankings(
        ann.lsh_topk(table(spark, queries, "query_id"), table(spark, documents), planes, 5, **settings)
    )
    assert found == {q: r for q, r in brute(queries, documents, 5, distance <= 1).items() if r}


def test_projection_equals_svd(spark):
    rng = np.random.default_rng(7)
    vectors = unit(rng.normal(size=(30, 6)) + 0.5)
    docs = table(spark, vectors)
    model = project.fit_projection(docs, "doc_id", 6, 3)
    centred = vectors.astype(np.float64) - vectors.mean(axis=0, dtype=np.float64)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert model.explained_variance == pytest.approx((s[:3] ** 2).sum() / (s**2).sum(), abs=1e-6)
    reduced = unit(centred @ vt[:3].T).astype(np.float64)
    found = np.array([r.embedding for r in project.project(docs, model).orderBy("doc_id").collect()])
    assert found.shape == (30, 3)
    assert np.allclose(np.linalg.norm(found, axis=1), 1, atol=1e-6)
    # Component signs are arbitrary; inner products are not.
    assert np.allclose(found @ found.T, reduced @ reduced.T, atol=1e-5)
    top = rankings(search.exact_topk(
        project.project(docs, model).withColumnRenamed("doc_id", "query_id"),
        project.project(docs, model), 1, 3))
    assert top[0][0] == (0, pytest.approx(1.0, abs=1e-5))


def test_projection_on_a_sample_and_from_disk(spark, tmp_path):
    rng = np.random.default_rng(7)
    docs = table(spark, unit(rng.normal(size=(40, 5))))
    model = project.fit_projection(docs, "doc_id", 5, 2, fit_rows=20)
    project.save_projection(spark, model, str(tmp_path / "model"))
    again = project.load_projection(spark, str(tmp_path / "model"))
    assert np.array_equal(model.components, again.components)
    assert np.array_equal(model.mean, again.mean)
    queries = table(spark, unit(rng.normal(size=(4, 5))), "query_id")
    found = project.project(queries, again).collect()
    assert [len(r.embedding) for r in found] == [2] * 4


def test_bad_projections_are_rejected(spark):
    docs = table(spark, unit(np.random.default_rng(0).normal(size=(10, 4))))
    for bad in ((4, 4), (4, 0)):
        with pytest.raises(ValueError):
            project.fit_projection(docs, "doc_id", *bad)
    with pytest.raises(ValueError):
        project.fit_projection(docs, "doc_id", 4, 3, fit_rows=2)
    with pytest.raises(ValueError):
        project.fit_projection(docs, "doc_id", 5, 2)


def test_normalize_and_report(spark):
    rows = table(spark, [[3.0, 4.0], [0.0, 2.0]]).withColumn(
        "embedding", l2_normalize(F.col("embedding"))
    )
    assert [[round(x, 6) for x in r.embedding] for r in rows.collect()] == [[0.6, 0.8], [0.0, 1.0]]
    with pytest.raises(Exception, match="zero-length"):
        table(spark, [[0.0, 0.0]]).select(l2_normalize(F.col("embedding"))).collect()
    bad = table(spark, [[1.0, 0.0], [1.0009, 0.0], [1.002, 0.0], [float("inf"), 0.0], [1.0]])
    report = vector_report(bad, 2).first()
    assert (report.n_vectors, report.n_wrong_dimension, report.n_not_finite, report.n_not_unit) == (
        5, 1, 1, 2)


def test_grid_of_a_large_cell_has_few_parts(spark):
    rng = np.random.default_rng(3)
    documents = unit(rng.standard_normal((400, 8)))
    docs = table(spark, documents).withColumn("_cell", F.lit(0))
    asked = table(spark, documents[:90], "query_id").withColumn("_cells", F.array(F.lit(0)))
    partial = search._on_grid(asked, docs, 1, 8, 2, 2)
    # One row per query and document part; 200 parts of two rows would be 200 copies of a query.
    assert partial.count() <= 90 * search.MOST_PARTS
    found = search.topk_in_cells(
        asked, docs, 3, 8, broadcast_bytes=0, query_part_rows=2, document_part_rows=2
    )
    want = search.topk_in_cells(asked, docs, 3, 8)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_a_task_keeps_few_of_its_candidates():
    rng = np.random.default_rng(4)
    queries, documents = unit(rng.standard_normal((4_000, 16))), unit(rng.standard_normal((3_000, 16)))
    best = search._BestK(np.arange(4_000), queries, 40)
    most = 0
    for at in range(0, 3_000, 100):
        best.add(np.arange(at, at + 100), documents[at : at + 100], np.arange(4_000))
        most = max(most, best.n_waiting)
    assert most <= 4_000 * 40
    rows, docs, _ = best.result()
    want = np.argsort(-(queries[7] @ documents.T), kind="stable")[:40]
    assert set(docs[rows == 7]) == set(want)


def test_each_pair_of_parts_is_a_task(spark, monkeypatch):
    """adaptive execution put the grid's quadratic work into a few tasks."""
    monkeypatch.setattr(search, "TASK_PAIRS", 1, raising=False)
    documents = unit(np.random.default_rng(5).standard_normal((60, 4)))
    docs = table(spark, documents).withColumn("_cell", F.lit(0))
    asked = table(spark, documents, "query_id").withColumn("_cells", F.array(F.lit(0)))
    partial = search._on_grid(asked, docs, 2, 4, 15, 12)
    tasks = partial.withColumn("task", F.spark_partition_id())
    assert tasks.select("task").distinct().count() == 4 * 5
    # Blocks that are not worth a task share one, and none is lost.
    monkeypatch.setattr(search, "TASK_PAIRS", 1 << 26, raising=False)
    shared = search._on_grid(asked, docs, 2, 4, 5, 4)
    assert shared.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    found = search.best_per_query(shared, 2)
    assert sorted(map(tuple, found.collect())) == sorted(
        map(tuple, search.best_per_query(partial, 2).collect())
    )


@pytest.mark.parametrize("settings", [{}, GRID])
def test_floors_leave_out_what_is_below(spark, settings):
    """a known k-th score keeps ties, and no task lists documents below it."""
    rng = np.random.default_rng(6)
    documents = unit(rng.standard_normal((90, 6)))
    documents[::3] = documents[0]
    queries = table(spark, np.concatenate([documents[:4], unit(rng.standard_normal((9, 6)))]), "query_id")
    docs = table(spark, documents)
    want = search.exact_topk(queries, docs, 5, 6)
    known = queries.join(search.kth_scores(want, 5), "query_id")
    assert rankings(search.exact_topk(known, docs, 5, 6, **settings)) == rankings(want)
    partial = search.partial_topk(
        known.withColumn("_cells", F.array(F.lit(0))), docs.withColumn("_cell", F.lit(0)), 5, 6, **settings
    )
    below = partial.join(search.kth_scores(want, 5), "query_id").filter("score < _floor - 1e-8")
    assert below.count() == 0


@pytest.mark.parametrize("settings", [{}, GRID])
def test_probes_score_a_pair_once(spark, monkeypatch, settings):
    """settings that share cells searched them once each: 1 + 2 + 5 cells instead of 5."""
    rng = np.random.default_rng(7)
    documents = unit(rng.standard_normal((80, 5)))
    documents[::4] = documents[1]
    docs, queries = table(spark, documents), table(spark, documents[:30], "query_id")
    pivots = ann.sampled_pivots(docs, 9)
    index = ann.assign_cells(docs, pivots)
    cells = []

    def counted(search_cells):
        def run(asked, *args, **kwargs):
            cells.append(asked.agg(F.sum(F.size("_cells"))).first()[0])
            return search_cells(asked, *args, **kwargs)

        return run

    want = {
        p: rankings(ann.cell_topk(queries, index, pivots, 6, p, **settings)) for p in (1, 2, 5)
    }
    for name in ("partial_topk", "topk_in_cells"):
        monkeypatch.setattr(ann, name, counted(getattr(ann, name, None)), raising=False)
    found = ann.cell_topk_for_probes(queries, index, pivots, 6, (5, 1, 2), **settings)
    assert sum(cells) == 30 * 5
    for p, expected in want.items():
        assert rankings(found.filter(F.col("nprobe") == p).drop("nprobe")) == expected
    # More probes than cells search them all.
    every = ann.cell_topk_for_probes(queries, index, pivots, 6, (3, 20), **settings)
    assert rankings(every.filter("nprobe = 20")) == brute(documents[:30], documents, 6)
