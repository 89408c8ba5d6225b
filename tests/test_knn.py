"""Search and selection against numpy, over the shapes and edges that matter."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import metrics as M
from lodestar.model import KnnSpec
from lodestar.operators import kernel
from lodestar.operators.distance import distances
from lodestar.operators.knn import checksum, knn_join, radius_filter, total_checksum
from lodestar.operators.topk import STRATEGIES, top_k
from lodestar.operators.verify import mismatches, verify
from lodestar.plans.algorithms import ALGORITHMS, run
from lodestar.sources.vectors import stub_distances


def frames(spark, points, queries):
    p = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(points)], "point_id long, p array<double>")
    q = spark.createDataFrame([(i * 3 + 1, [float(x) for x in v]) for i, v in enumerate(queries)], "query_id long, q array<double>")
    return p, q


def random_frames(spark, n, q, d, seed=42):
    rng = np.random.default_rng(seed)
    points, queries = rng.random((n, d)), rng.random((q, d))
    return points, queries, *frames(spark, points, queries)


def expected(points, queries, k, partial=False):
    out = {}
    for i, q in enumerate(queries):
        dist = ((points - q) ** 2).sum(axis=1) - ((q**2).sum() if partial else 0)
        order = np.lexsort((np.arange(len(points)), dist))[:k]
        out[i * 3 + 1] = [(int(j), dist[j]) for j in order]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.point_id, r.dist))
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for key in a:
        assert [x[0] for x in a[key]] == [x[0] for x in b[key]]
        assert np.allclose([x[1] for x in a[key]], [x[1] for x in b[key]], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("n,q,d,k", [(199, 1, 10, 32), (199, 13, 10, 32), (128, 1, 10, 128), (997, 43, 37, 32), (25, 7, 9, 16), (64, 32, 16, 64), (10, 3, 1, 1)])
@pytest.mark.parametrize("strategy", ["fused", "group_limit"])
def test_shapes(spark, n, q, d, k, strategy):
    points, queries, p, qs = random_frames(spark, n, q, d)
    same(got(knn_join(p, qs, KnnSpec(k, strategy=strategy))), expected(points, queries, k))


def test_all_algorithms_agree(spark):
    points, queries, p, q = random_frames(spark, 300, 5, 8)
    for name, a in ALGORITHMS.items():
        found = run(name, p, q, 7, deg=7)
        if not a.selects:
            assert found.count() == 1500
        elif a.precision == "double":
            same(got(found), expected(points, queries, 7, a.metric == "l2_partial"))
        else:
            near = expected(kernel.quantise(points, a.precision), kernel.quantise(queries, a.precision), 7)
            same(got(found), near)


def test_partial_metric_ranks_alike_and_slices_agree(spark):
    points, queries, p, q = random_frames(spark, 200, 9, 6)
    for strategy in ("fused", "sort"):
        same(got(knn_join(p, q, KnnSpec(5, "l2_partial", strategy))), expected(points, queries, 5, True))
        same(got(knn_join(p, q, KnnSpec(5, strategy=strategy), most_bytes=150)), expected(points, queries, 5))
    assert distances(p, q, most_bytes=150).count() == 1800


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("unique", [0, 1, 7, 50])
def test_ties(spark, strategy, unique):
    dist = stub_distances(spark, 13, 199, unique)
    rows = {}
    for r in dist.collect():
        rows.setdefault(r.query_id, []).append((r.dist, r.point_id))
    assert len({d for d, _ in rows[0]}) == (199 if unique == 0 else math.ceil(199 / math.ceil(199 / unique)))
    found = got(top_k(dist, ["query_id"], "dist", ["point_id"], 32, strategy=strategy, deg=7))
    assert found == {q: [(p, d) for d, p in sorted(v)[:32]] for q, v in rows.items()}


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_largest_and_nulls(spark, strategy):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", None, 2), ("a", 5.0, 3), ("a", 5.0, 0), (None, 2.0, 4)], "g string, v double, id int")
    big = top_k(df, ["g"], "v", ["id"], 3, largest=True, strategy=strategy)
    assert sorted((r.g or "", r["rank"], r.id) for r in big.collect()) == [("", 1, 4), ("a", 1, 0), ("a", 2, 3), ("a", 3, 1)]
    small = top_k(df, ["g"], "v", ["id"], 4, strategy=strategy)
    assert [r.id for r in sorted(small.where("g = 'a'").collect(), key=lambda r: r["rank"])] == [1, 0, 3, 2]


def test_more_than_there_are(spark):
    _, _, p, q = random_frames(spark, 4, 2, 3)
    assert knn_join(p, q, KnnSpec(9)).count() == 8
    padded = knn_join(p, q, KnnSpec(9, pad=True))
    assert padded.count() == 18
    assert {(r.point_id, r.dist) for r in padded.where("rank > 4").collect()} == {(-1, math.inf)}


def test_odd_values(spark):
    p, q = frames(spark, [[1.0], [math.nan], [math.inf], [2.0]], [[0.0]])
    for strategy in ("fused", "group_limit"):
        ids = [r.point_id for r in knn_join(p, q, KnnSpec(4, strategy=strategy)).orderBy("rank").collect()]
        assert ids == [0, 3, 2, 1]


def test_validation(spark):
    _, _, p, q = random_frames(spark, 4, 2, 3)
    for bad in (lambda: KnnSpec(0), lambda: KnnSpec(2, deg=-1), lambda: M.metric("cosine"), lambda: run("nothing", p, q, 3)):
        with pytest.raises(ValueError):
            bad()
    for spec in (KnnSpec(2, strategy="x"), KnnSpec(2, precision="quarter"), KnnSpec(2, "l1", precision="half")):
        with pytest.raises(ValueError):
            knn_join(p, q, spec).count()


def test_metrics(spark):
    points, queries, p, q = random_frames(spark, 20, 3, 9)
    want = {
        "l2": lambda a, b: ((a - b) ** 2).sum(),
        "l2_partial": lambda a, b: (a * a).sum() - 2 * (a * b).sum(),
        "dot": lambda a, b: (a * b).sum(),
        "l1": lambda a, b: abs(a - b).sum(),
        "l3": lambda a, b: (abs(a - b) ** 3).sum(),
        "linf": lambda a, b: abs(a - b).max(),
        "kl": lambda a, b: (a * (np.log(a) - np.log(b))).sum(),
    }
    assert M.metrics() == sorted(want)
    for name, f in want.items():
        for r in distances(p, q, name).collect():
            assert math.isclose(r.dist, f(points[r.point_id], queries[(r.query_id - 1) // 3]), rel_tol=1e-9, abs_tol=1e-12)


def test_kl_of_zero_and_own_metric(spark):
    p, q = frames(spark, [[0.0, 1.0]], [[0.5, 0.5]])
    assert math.isclose(distances(p, q, "kl").first().dist, math.log(2))
    M.register_metric("first", lambda a, b: F.abs(a[0] - b[0]))
    try:
        assert distances(p, q, "first").first().dist == 0.5
    finally:
        del M._METRICS["first"]


def test_quantise():
    x = np.array([1.0, 1 / 3, 65504.0, -2.5e-3])
    assert kernel.quantise(x, "half").tolist() == x.astype(np.float16).astype(float).tolist()
    near = kernel.quantise(x, "bfloat16")
    assert np.allclose(near, x, rtol=2**-8) and (near.astype(np.float32).view(np.uint32) & 0xFFFF == 0).all()


def test_verify_and_checksums(spark):
    _, _, p, q = random_frames(spark, 50, 3, 4)
    a = knn_join(p, q, KnnSpec(6))
    assert verify(a, knn_join(p, q, KnnSpec(6, strategy="sort")))
    wrong = a.withColumn("point_id", F.when((F.col("query_id") == 1) & (F.col("rank") == 2), 999).otherwise(F.col("point_id")))
    assert [(r.query_id, r["rank"], r.reason) for r in mismatches(a, wrong).collect()] == [(1, 2, "label")]
    assert {r.reason for r in mismatches(a, a.where("rank < 6")).collect()} == {"missing"}
    each = {r.query_id: r.checksum for r in checksum(a).collect()}
    assert total_checksum(a) == sum(each.values()) % 2**32
    tied = spark.createDataFrame([(1, 1, 5, 0.5), (1, 2, 6, 0.5), (1, 3, 7, 0.9)], "query_id long, rank int, point_id long, dist double")
    other = spark.createDataFrame([(1, 1, 6, 0.5), (1, 2, 5, 0.5), (1, 3, 8, 0.9)], "query_id long, rank int, point_id long, dist double")
    assert verify(tied, other)


def test_radius(spark):
    dist = stub_distances(spark, 3, 40, 10)
    rows = radius_filter(dist, 6).collect()
    for q in range(3):
        own = sorted(r.dist for r in dist.where(F.col("query_id") == q).collect())
        assert sorted(r.dist for r in rows if r.query_id == q) == [d for d in own if d < own[5]]


def test_plans(spark, tmp_path):
    _, _, p, q = random_frames(spark, 50, 3, 4)
    plan = knn_join(p, q, KnnSpec(3, strategy="group_limit"))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "BroadcastNestedLoopJoin" in plan
    assert "WindowGroupLimit" not in knn_join(p, q, KnnSpec(3, strategy="sort"))._jdf.queryExecution().toString()


@pytest.mark.parametrize("n,q,d,k", [(32_768, 13, 10, 256), (8192, 3, 10, 2048)])
@pytest.mark.parametrize("strategy", ["fused", "group_limit"])
def test_large_shapes(spark, n, q, d, k, strategy):
    points, queries = np.random.default_rng(42).random((n, d)), np.random.default_rng(43).random((q, d))
    p = spark.range(n, numPartitions=8).select(F.col("id").alias("point_id")).mapInPandas(lambda it: (b.assign(p=list(points[b.point_id])) for b in it), "point_id long, p array<double>")
    _, qs = frames(spark, points[:1], queries)
    same(got(knn_join(p, qs, KnnSpec(k, strategy=strategy))), expected(points, queries, k))


def test_tiles_bound_the_memory():
    """A hundred thousand queries against a block of points, in this process."""
    import resource

    import pyarrow as pa

    rng = np.random.default_rng(1)
    points, queries = rng.random((4096, 8)), rng.random((100_000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(list(points))], ["point_id", "p"])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = pa.Table.from_batches(kernel.nearest(np.arange(100_000), queries, 2, "l2", "double")([batch]))
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 300  # MB; all distances are 3.3 GB
    assert out.num_rows == 200_000
    found = out.column("point_id").to_numpy().reshape(-1, 2)
    for i in (0, 1, 50_000, 99_999):
        assert found[i].tolist() == np.argsort(((points - queries[i]) ** 2).sum(axis=1))[:2].tolist()


@pytest.mark.parametrize("tile_bytes", [1, 3 * 8 * 4096, 1 << 24])
@pytest.mark.parametrize("metric", ["l2", "l2_partial"])
def test_tiles_agree(tile_bytes, metric):
    """Ties, equal points, not-a-number and infinity, whatever the tile."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    points = rng.integers(0, 3, (300, 4)).astype(float)
    points[7], points[100], points[150, 0] = np.nan, np.inf, -np.inf
    queries = np.r_[rng.integers(0, 3, (20, 4)).astype(float), [[np.nan] * 4]]
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), pa.array(list(points[a:b]))], ["point_id", "p"]) for a, b in ((0, 90), (90, 91), (91, 300))]
    with np.errstate(invalid="ignore"):
        got = pa.Table.from_batches(kernel.nearest(np.arange(21), queries, 9, metric, "double", tile_bytes)(batches)).to_pandas()
        for i, q in enumerate(queries):
            dist = kernel.exact(points, q, metric)
            order = np.lexsort((np.arange(300), dist))[:9]
            own = got[got.query_id == i]
            assert own.point_id.tolist() == order.tolist() and np.array_equal(own.dist.to_numpy(), dist[order], equal_nan=True)


def test_own_algorithm(spark):
    from lodestar.plans import algorithms
    from lodestar.plans.runner import bench

    _, _, p, q = random_frames(spark, 50, 3, 4)
    algorithms.register_algorithm("mine", lambda points, queries, k: knn_join(points, queries, KnnSpec(k, strategy="sort")))
    try:
        assert got(run("mine", p, q, 5)) == got(run("serial", p, q, 5))
        log = bench(spark, "mine", p, q, 5, postprocess=lambda found: found.orderBy("query_id", "rank"), block_size=128, items_per_thread="2,1,1").collect()
        spent = {r.phase: r.time for r in log}
        assert spent["selection"] > 0 and spent["postprocessing"] > 0 and {(r.block_size, r.items_per_thread) for r in log} == {(128, "2,1,1")}
        with pytest.raises(ValueError, match="built in"):
            algorithms.register_algorithm("bits", None)
    finally:
        algorithms.ALGORITHMS.pop("mine"), algorithms.CUSTOM.pop("mine")


def test_grid():
    from lodestar.plans import grid

    grid.check("bits", 2048, 512, 16)
    grid.check("serial", 3, 7, 9)
    for name, k, block, items, message in [("bits", 8, None, None, "k value: 8"), ("bits", 16, 64, None, "block size: 64"), ("bits-sq", 16, 128, 17, "batch size: 17"), ("block-select", 16, 64, 11, "thread queue size: 11"), ("fused-tc-half", 512, None, None, "k value: 512"), ("rapidsai-fused", 65, None, None, "k value: 65")]:
        with pytest.raises(ValueError, match=f"Unsupported {message}"):
            grid.check(name, k, block, items)
    more = [
        ("fused-regs", 256, None, None, {}, "k value: 256"),
        ("fused-regs-tunable", 256, 32, None, {}, "block size: 32"),
        ("fused-regs-tunable", 256, 8, (16, 4, 1), {}, "query register count: 16"),
        ("fused-regs-tunable", 256, 8, (8, 8, 1), {}, "point register count: 8"),
        ("fused-cache", 512, None, None, {}, "k value: 512"),
        ("fused-cache", 4, 8, None, {}, "query_block_size value: 8"),
        ("fused-cache", 4, 4, (3, 4, 1), {}, "queries_reg value: 3"),
        ("fused-cache", 4, 4, (16, 2, 1), {}, "db_reg value: 2"),
        ("fused-cache", 4, 4, (16, 16, 8), {}, "dim_reg value: 8"),
        ("fused-cache", 4, 4, (16, 16, 4), {"deg": 3}, "dim_mult value: 3"),
        ("partial-bitonic-warp-static", 16, 32, None, {}, "block size: 32"),
        ("partial-bitonic-soa", 16, 1024, None, {}, "block size: 1024"),
        ("partial-bitonic-regs", 16, 96, None, {}, "block size: 96"),
        ("partial-bitonic-buffered-static", 16, 64, None, {}, "block size: 64"),
        ("partial-bitonic", 24, None, None, {}, "k value: 24"),
        ("warp-select-tunable", 16, 128, 1, {}, "thread queue size: 1"),
        ("fused-tc-double", 16, 64, None, {}, "block size: 64"),
        ("tiled-dist", 1, 64, None, {}, "tile size: 64"),
    ]
    for name, k, block, items, rest, message in more:
        with pytest.raises(ValueError, match=f"Unsupported {message}"):
            grid.check(name, k, block, items, **rest)
    grid.check("fused-cache", 256, 4, (16, 16, 4), 4, 16)
    grid.check("partial-bitonic-buffered", 16, 7)
    with pytest.raises(ValueError, match="must not be lower than 16, but is 15"):
        grid.check("fused-cache", 256, 4, (16, 16, 4), 4, 15)
    assert grid.legal_at_least(17, (16, 32, 64)) == 32
    with pytest.raises(ValueError, match="Unsupported"):
        grid.legal_at_least(65, (16, 64))


def test_groups_are_cut_by_size(spark, monkeypatch):
    """One group with most rows and many small ones, a null group: the large one is dealt to parts, results are those of a window."""
    from lodestar.operators import topk

    rows = [("hot", float(i * 7919 % 10_007), i) for i in range(3000)] + [(f"g{i % 200}" if i % 200 else None, float(i), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, v double, id long").repartition(4)
    sizes = topk.cut_by_size(df, ["g"], ["id"], 100).groupBy("g", "_ls_part").count().collect()
    assert max(r["count"] for r in sizes) < 200 and sum(r.g == "hot" for r in sizes) == 30 and sum(r.g != "hot" for r in sizes) == 200
    monkeypatch.setattr(topk, "PART_ROWS", 100)
    found = top_k(df, ["g"], "v", ["id"], 3, strategy="two_level", deg=0)
    assert sorted(map(str, found.collect())) == sorted(map(str, top_k(df, ["g"], "v", ["id"], 3).collect()))


def test_heap_drops_rows_before_sorting():
    """Batches whose rows the k-th of their group rules out cost no sort; ties at the k-th are kept."""
    import pandas as pd

    from lodestar.operators.topk import _running

    frame = lambda rows: pd.DataFrame(rows, columns=["g", "_ls_place", "v", "id"])
    first = frame([("a", 0, float(i), i) for i in range(5)] + [(None, 0, 1.0, 50), ("b", 2, None, 9)])
    second = frame([("a", 0, 9.0, 10), ("a", 0, 1.0, -1), ("a", 0, 0.5, 11), (None, 0, 0.0, 51), ("b", 0, 3.0, 12), ("c", 0, 7.0, 13)])
    (best,) = _running(["g"], ["_ls_place", "v", "id"], [True, True, True], 2)([first, second, second.iloc[:1]])
    got = sorted((str(r.g), r.id) for r in best.itertuples())
    assert got == sorted([("a", 0), ("a", 11), (str(None), 50), (str(None), 51), ("b", 12), ("b", 9), ("c", 13)])
