import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from citespark.operators import sampling
from citespark.operators.running import running_totals
from citespark.operators.evaluate import quantile_summary


def key(i, seed=sampling.DEFAULT_SEED):
    return int(np.fmod(i * 1103515245 + seed, 2147483647))


def test_key_keeps_the_sign(spark):
    ids = [-5, 0, 1, 12345, 8_000_000_000]
    rows = spark.createDataFrame([(i,) for i in ids], "id bigint")
    found = [r.k for r in rows.select(sampling.sampling_key(F.col("id")).alias("k")).collect()]
    assert found == [(abs(i * 1103515245 + sampling.DEFAULT_SEED) % 2147483647)
                     * (1 if i * 1103515245 + sampling.DEFAULT_SEED >= 0 else -1) for i in ids]


@pytest.mark.parametrize("n", [1, 37, 999, 1000])
def test_sample_is_the_smallest_keys(spark, n):
    rows = spark.range(1000)
    found = sorted(r.id for r in sampling.sample_by_key(rows, "id", n, 7).collect())
    assert found == sorted(sorted(range(1000), key=lambda i: (key(i, 7), i))[:n])


def test_sample_larger_than_table_fails(spark):
    with pytest.raises(ValueError):
        sampling.sample_by_key(spark.range(5), "id", 6)
    with pytest.raises(ValueError):
        sampling.sample_by_key(spark.range(5), "id", 0)


def test_sample_splits_a_group_of_equal_ids(spark):
    rows = spark.range(300).select(F.when(F.col("id") < 100, 7).otherwise(F.col("id")).alias("id"))
    for n in (50, 150, 250):
        assert sampling.sample_by_key(rows, "id", n).count() == n


def test_dense_ids_follow_key_order(spark):
    rows = spark.range(5000).repartition(7)
    found = {r.id: r.doc_id for r in sampling.dense_row_id(rows, "id").collect()}
    expected = {i: n for n, i in enumerate(sorted(range(5000), key=lambda i: (key(i), i)))}
    assert found == expected


def test_dense_ids_of_copies_are_complete_and_spread(spark):
    """A third of all rows are exact copies of one row."""
    rows = spark.range(9000).select(
        F.when(F.col("id") < 3000, 42).otherwise(F.col("id")).alias("id"), F.lit("t").alias("t")
    )
    # Otherwise AQE puts so small a table into one partition.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = sampling.dense_row_id(rows, "id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = numbered.orderBy("doc_id").collect()
    assert [r.doc_id for r in found] == list(range(9000))
    keys = [(key(r.id), r.id) for r in found]
    assert keys == sorted(keys)
    parts = numbered.filter("id = 42").select(F.spark_partition_id().alias("p")).distinct()
    assert parts.count() > 1


def test_keys_of_huge_and_negative_ids(spark):
    ids = [0, 7, -1, -7, 2**31, 10**10, 10**12 + 3, 2**63 - 1, -(10**10), -(2**63)]
    rows = spark.createDataFrame([(i,) for i in ids], "id bigint")
    for seed in (sampling.DEFAULT_SEED, 0):
        found = {r.id: r.k for r in rows.select("id", sampling.sampling_key(F.col("id"), seed).alias("k")).collect()}
        for i in ids:
            exact = i * sampling.KEY_MULTIPLIER + seed
            assert found[i] == int(math.copysign(abs(exact) % sampling.KEY_MODULUS, exact))


def test_half_of_a_large_table_without_a_large_last_bucket(spark):
    rows = spark.range(0, 400_000).select((F.col("id") + 10**11).alias("id"))
    cut = sampling.find_cut(rows, "id", 200_000)
    edge = rows.filter(sampling.sampling_key(F.col("id")) == cut.key)
    assert edge.count() <= 2
    assert sampling.sample_by_key(rows, "id", 200_000).distinct().count() == 200_000


@pytest.mark.parametrize("n, m", [(10, 3), (1000, 7), (1000, 999), (12_345, 1000), (5, 9), (50, 1)])
def test_linspace_equals_numpy(spark, n, m):
    found = sorted(r.id for r in sampling.linspace_rows(spark.range(n), "id", n, m).collect())
    expected = sorted(set(np.linspace(0, n - 1, min(n, m), dtype=np.int64).tolist()))
    assert found == expected


@pytest.mark.parametrize(
    "ids, fine", [([0, 1, 2], True), ([1, 2, 3], False), ([0, 1, 1], False), ([0, 2, 3], False)]
)
def test_contiguity(spark, ids, fine):
    rows = spark.createDataFrame([(i,) for i in ids], "id bigint")
    assert sampling.contiguity(rows, "id").first().contiguous is fine


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_with_a_hot_group(spark, descending):
    rng = np.random.default_rng(3)
    data = [("hot", float(v), int(n)) for v, n in zip(rng.permutation(2000), rng.integers(1, 9, 2000))]
    data += [(None, float(v), 1) for v in range(50)] + [("one", 3.0, 4)]
    rows = spark.createDataFrame(data, "g string, v double, n int")
    found = {(r.g, r.v): r.cum_n for r in
             running_totals(rows, "v", ["n"], ["g"], descending, buckets=16).collect()}
    expected = {}
    for group in ("hot", None, "one"):
        total = 0
        for g, v, n in sorted((d for d in data if d[0] == group), key=lambda d: d[1], reverse=descending):
            total += n
            expected[g, v] = total
    assert found == expected


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    values = {"a": rng.exponential(50, 1001), "b": np.array([4.0]), "c": np.repeat([1.0, 2.0], 50)}
    rows = spark.createDataFrame(
        [(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None)], "g string, v double"
    )
    for r in quantile_summary(rows, "v", by=("g",), decimals=6).collect():
        assert r.n == len(values[r.g])
        assert r.mean == pytest.approx(values[r.g].mean(), abs=1e-6)
        assert r.p50 == pytest.approx(np.quantile(values[r.g], 0.5), abs=1e-6)
        assert r.p95 == pytest.approx(np.quantile(values[r.g], 0.95), abs=1e-6)
    whole = quantile_summary(rows, "v").first()
    everything = np.concatenate(list(values.values()))
    assert whole.p95 == pytest.approx(np.quantile(everything, 0.95), abs=1e-3)
