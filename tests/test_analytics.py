"""Analytics on a log small enough to compute by hand, and all queries against their SQL."""

import math
import statistics
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestar.functions.scalar import log2_label
from lodestar.plans import analytics as A
from lodestar.plans import queries as Q
from lodestar.plans.runner import bench_grid, feasible

SF = "/root/testdata/sf0.001"
P, T = ["algorithm", "k"], ["block"]


@pytest.fixture
def log(spark):
    rows = [("a", 1, 64, 4.0), ("a", 1, 64, 2.0), ("a", 1, 128, 2.0), ("a", 2, 64, 5.0), ("a", 2, 128, 10.0), ("a", 2, None, 1.0), ("b", 1, 64, 6.0)]
    return spark.createDataFrame(rows, "algorithm string, k int, block int, time double")


def test_means_and_optima(log):
    means = A.mean_time(log, P, T)
    assert means.count() == 6 and A.mean_time(log, P, T, drop_null_keys=True).count() == 5
    best = {(r.algorithm, r.k): (r.block, r.time) for r in A.optima(means, P, T).collect()}
    assert best == {("a", 1): (128, 2.0), ("a", 2): (None, 1.0), ("b", 1): (64, 6.0)}
    worst = {(r.algorithm, r.k): r.time for r in A.optima(means, P, T, smallest=False).collect()}
    assert worst[("a", 2)] == 10.0


def test_slowdown_and_fixed(log):
    means = A.mean_time(log.where("block is not null"), P, T)
    slow = A.slowdown(means, A.optima(means, P, T), P)
    assert sorted((r.k, r.block, r.slowdown) for r in slow.where("algorithm = 'a'").collect()) == [(1, 64, 1.5), (1, 128, 1.0), (2, 64, 1.0), (2, 128, 2.0)]
    fixed = {r.algorithm: (r.block, r.min_slowdown, r.max_slowdown, r.total_count) for r in A.fixed_optima(slow, ["algorithm"], T).collect()}
    assert fixed == {"a": (64, 1.0, 1.5, 2), "b": (64, 1.0, 1.0, 1)}


def test_coverage_excludes_partial_configurations(spark):
    slow = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.4), ("a", 2, 1.3)], "algorithm string, block int, slowdown double")
    assert A.fixed_optima(slow, ["algorithm"], T).first().block == 2


def test_harmonic(spark):
    x = [1.0, 2.0, 4.0]
    r = spark.createDataFrame([(v,) for v in x], "x double").agg(A.harmonic_mean(F.col("x")).alias("m"), A.harmonic_std(F.col("x")).alias("s")).first()
    inv = [1 / v for v in x]
    assert math.isclose(r.m, statistics.harmonic_mean(x))
    assert math.isclose(r.s, math.sqrt(statistics.pvariance(inv) / statistics.mean(inv) ** 4 / 3))


def test_baseline(log):
    means = A.mean_time(log.where("block = 64"), P, T)
    got = {(r.algorithm, r.k): r.speedup for r in A.baseline_speedup(means, F.col("algorithm") == "b", ["k"]).collect()}
    assert got == {("a", 1): 2.0, ("b", 1): 1.0, ("a", 2): None}


def lookup(spark, rows, **request):
    names = "line int, hostname string, algorithm string, query_count int, k int, dim int, block_size int, deg int"
    return tuple(A.lookup_config(spark.createDataFrame(rows, names), "x", "line", **request).first())


def plain_lookup(rows, query_count, k, dim):
    """The fold, row by row."""
    now, last, score, slack = [256, 1], [256, 1], 0, 0.0
    for _, _, algorithm, *sizes, block, deg in sorted(rows):
        if algorithm != "x":
            continue
        last = [block if block is not None else last[0], deg if deg is not None else last[1]]
        new_score, new_slack = 0, 1.0
        for have, want in zip(sizes, (query_count, k, dim)):
            if have is None:
                continue
            new_score += have >= want
            new_slack *= max(have / want, want / have)
        if new_score >= score and (slack == 0 or new_slack < slack):
            score, slack, now = new_score, new_slack, list(last)
    return tuple(now)


def test_lookup_is_an_ordered_fold(spark):
    rows = [
        (1, "h", "x", 64, 32, 4, 128, None),
        (2, "h", "x", 256, 64, 8, None, 2),
        (3, "h", "y", 100, 50, 8, 999, 9),
        (4, "h", "x", 128, 64, 8, 512, None),
        (5, "h", "x", 4096, 2048, 8, 64, 4),
    ]
    for q, k, d in ((100, 50, 8), (4000, 2000, 8), (64, 32, 4), (1, 1, 1)):
        assert lookup(spark, rows, query_count=q, k=k, dim=d)[:2] == plain_lookup(rows, q, k, d)
    assert lookup(spark, rows[2:3], query_count=1, k=1, dim=1) == (256, 1, 1, 1, 1)


def test_situations(spark):
    rows = [("h", 1, 32, 64, 100, 10.0, 20.0), ("h", 1, 64, 64, 100, 10.0, 5.0), ("h", 1, 32, 128, 100, 10.0, 20.0)]
    speed = spark.createDataFrame(rows, "hostname string, dim int, k int, query_count int, point_count int, sota double, proposed double").withColumn("speedup", F.col("proposed") / F.col("sota"))
    got = {(r.situation, r.query_count): (r.k, r.speedup) for r in A.statistics(speed, ["hostname", "dim"], ["query_count", "point_count"], F.lit(40.0)).collect()}
    assert got[("max_speedup", 64)] == (32, 2.0) and got[("min_speedup", 64)] == (64, 0.5) and got[("avg_speedup", 64)] == (0, 1.25)
    assert got[("global_max_speedup", 64)] == (32, 2.0) and got[("global_avg_relative_throughput", 0)] == (0, 0.375)
    assert len(got) == 18


def test_small_helpers(spark):
    one = spark.createDataFrame([("uniform", "identity", 8), ("uniform", "identity", 1000)], "generator string, preprocessor string, n int")
    assert A.single_dataset(one) == "uniform-identity"
    assert [r.x for r in one.select(log2_label(F.col("n")).alias("x")).collect()] == [3, 10]
    with pytest.raises(ValueError):
        A.single_dataset(one.withColumn("generator", F.col("n").cast("string")))
    queue = spark.createDataFrame([(32, 4, 2.0, 1), (32, 2, 2.0, 2), (64, 8, 3.0, 3)], "k int, queue int, time double, line int")
    assert {(r.k, r.queue) for r in A.first_best(queue, ["k"], "line").collect()} == {(32, 4), (64, 8)}
    log = bench_grid(spark, ["bits", "serial"], [(100, 2, 3, 5), (4, 2, 3, 5)])
    assert log.select("algorithm").distinct().count() == 2 and log.count() == 14
    assert not feasible(1 << 20, 1 << 13, 8) and feasible(1 << 20, 1 << 12, 8)


@pytest.fixture(scope="module")
def views():
    duckdb = pytest.importorskip("duckdb")
    if not Path(SF).is_dir():
        pytest.skip("no test data")
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    return repr(value) if isinstance(value, float) else str([plain(v) for v in value]) if isinstance(value, list | tuple) else str(value)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_against_sql(spark, views, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in Q.ORACLE:
        assert rows
        return
    found = views.sql(Q.ORACLE[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
