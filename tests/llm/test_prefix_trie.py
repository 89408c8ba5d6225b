"""The trie against one built in memory."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.llm.prefix_trie import trie, turn_arrays

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def expected(rows):
    """Of rows (conv_id, turn, role, text): the nodes, by sets of prefixes."""
    said = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            said[c].append((t is not None, t or 0, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).hexdigest(), r, x))
    paths = {c: tuple((r, x) for *_, r, x in sorted(v)) for c, v in said.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(paths):
        ends[paths[c]].append(c)
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        words = len([w for w in p[-1][1].encode().split()]) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * words
            leaves[p[:d]] += children[p] == 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], digest(ends[p])) for p, m in members.items())


def found(df, **more):
    rows = trie(turn_arrays(df), **more).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows)


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_random(spark, parts):
    """Few different turns, so that nodes and copies cross ranges; ids that leave in many pieces."""
    random.seed(parts)
    rows = []
    for c in range(-20, 130):
        for t in range(random.choice([1, 2, 3, 3, 6])):
            rows.append((c, t, random.choice(["user", "assistant"]) if random.random() < 0.1 else "user", random.choice(["a", "a", "b c", " a  b\t"])))
    rows += [(1000 + c, t, "user", "the same") for c in range(200) for t in range(3)]
    rows += [(2000 + c, 0, "user", "the same") for c in range(100)]
    random.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert found(spark.createDataFrame(rows, SCHEMA), chunk=40) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_edges(spark):
    """Null turns, roles, texts and keys, ties, repeated rows, empty and very long texts, a very long conversation, other columns."""
    rows = [
        (5, None, "user", "first"), (5, 0, None, None), (5, 0, "a", "tie"), (5, 0, "a", "tie"), (6, 1, "", ""), (7, 1, None, ""), (None, 0, "user", "nobody"),
        (8, 3, "user", "w " * 200_000), (9, 3, "user", "w " * 200_000), *[(10, t, "user", "x") for t in range(2000)], *[(11, t, "user", "x") for t in range(1999)],
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"path": F.lit(1), "part": F.lit("x"), "turns": F.lit(2)})
    assert found(df) == expected(rows)


def test_turnless_and_empty(spark):
    arrays = spark.createDataFrame([(3, []), (4, None)], "conv_id bigint, turns array<struct<hash:string,words:bigint>>")
    (root,) = trie(arrays).collect()
    assert (root.conv_id, root.depth, root.n_convs, root.n_leaves, root.ends_sha256) == (3, 0, 2, 1, hashlib.sha256(b"3,4").hexdigest())
    assert trie(arrays.limit(0)).collect() == []
    assert trie(turn_arrays(spark.createDataFrame([], SCHEMA))).collect() == []
