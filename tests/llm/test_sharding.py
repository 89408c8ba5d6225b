"""Extendible hashing: every bucket fits, only oversized ones split."""

from collections import defaultdict

from lodestar.llm import sharding as S


def shards(df, limit):
    rows = S.assign_shards(df, limit=limit).collect()
    buckets = defaultdict(list)
    for r in rows:
        buckets[r.shard].append(r)
    return rows, buckets


def check(rows, buckets, limit):
    sizes = {s: sum(r.n_bytes for r in rs) for s, rs in buckets.items()}
    for s, rs in buckets.items():
        assert {(r.depth, r.shard_bytes, r.shard_rows) for r in rs} == {(len(s), sizes[s], len(rs))}
        assert sizes[s] <= limit or (len(rs) == 1 and not rs[0].fits)
    names = sorted(sizes)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:])), "prefix-free"
    for s in names:  # a parent that fits would not have split
        if s:
            assert sum(n for t, n in sizes.items() if t.startswith(s[:-1])) > limit


def test_fits_and_splits(spark):
    df = spark.createDataFrame([(i, "x" * (i % 97)) for i in range(3000)], "doc_id long, text string")
    rows, buckets = shards(df, 4000)
    assert len(rows) == 3000 and len(buckets) > 30
    check(rows, buckets, 4000)


def test_one_bucket_nulls_extra_columns(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "é", 2), (1, "é", 2)], "doc_id long, text string, cell int")
    rows, buckets = shards(df, 100)
    assert list(buckets) == [""] and {r.n_bytes for r in rows} == {0, 2}


def test_hot_content_and_giant_row(spark):
    df = spark.createDataFrame([(7, "same" * 10)] * 2000 + [(8, "y" * 5000)] + [(i, "z") for i in range(100)], "doc_id long, text string")
    rows, buckets = shards(df, 4000)
    assert len(rows) == 2101
    check(rows, buckets, 4000)
    assert sum(not r.fits for r in rows) == 1


def test_addresses_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i % 50, "x" * (i % 50)) for i in range(400)] + [(7, None), (None, ""), (7, "many")] * 300, "doc_id long, text string")
    before, S.EQUAL = S.EQUAL, 70
    try:
        first = sorted(map(str, S.assign_shards(df.coalesce(1), limit=900).collect()))
        assert first == sorted(map(str, S.assign_shards(df.repartition(7), limit=900).collect()))
    finally:
        S.EQUAL = before
    assert first == sorted(map(str, S.assign_shards(df, limit=900).collect())) and len(first) == 1300


def test_empty(spark):
    assert S.assign_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0
