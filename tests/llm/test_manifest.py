"""Manifests against trees built in memory."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lodestar.llm.manifest import FIELDS, folded, leaf_of, verify

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def siblings(tree, at, arity):
    out = []
    for level in tree[:-1]:
        low = at - at % arity
        out.append(("".join(level[low:at]), "".join(level[at + 1 : low + arity])))
        at //= arity
    return out


def expected(rows, arity):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, levels([leaf(r) for r in own], arity)))
    top = levels([t[-1][0] for _, t in trees], arity)
    out = []
    for g, (own, tree) in enumerate(trees):
        for i, r in enumerate(own):
            out.append((str(r[0]), tree[0][i], tree[-1][0], top[-1][0], siblings(tree, i, arity) + siblings(top, g, arity)))
    return sorted(out)


def plain(rows):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, [tuple(x) for x in r.proof]) for r in rows)


@pytest.mark.parametrize("arity, stride", [(3, 1), (3, 2), (2, 3), (3, 5)])
def test_proofs(spark, arity, stride):
    """A group with most rows, groups of one row, a null and an empty group, repeated rows, null and repeated keys."""
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", "en", i, f"text {i}\n") for i in range(150)]
    rows += [(1, "é", None, None, None), (None, None, "de", 2, ""), (7, None, "de", 2, ""), (7, None, "de", 2, "x"), (8, "", "de", 2, "y"), (9, "dup", "a", 1, "z"), (9, "dup", "a", 1, "z")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"g": F.lit(1), "part": F.lit(2), "rank": F.lit(3)})
    found = verify(df, arity=arity, stride=stride, proofs=True).collect()
    assert plain(found) == expected(rows, arity)
    assert all(r.verified and r.folded_root == r.root for r in found)
    assert all(r.proof_sha256 == h(*[x for pair in r.proof for x in pair]) for r in found)


def test_tampered(spark):
    rows = [(i, f"s{i % 3}", "en", 1, "a\nb" if i % 2 else "ab") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    offered = leaf_of(df, FIELDS, {"text": F.replace("text", F.lit("\n"), F.lit(""))})
    found = {r.doc_id: r for r in verify(df, offered=offered, proofs=True).collect()}
    for i, *rest in rows:
        other = leaf((i, *rest[:-1], rest[-1].replace("\n", "")))
        assert found[i].folded_root == folded(other, [tuple(x) for x in found[i].proof])
        assert found[i].verified == (i % 2 == 0) and found[i].leaf == leaf((i, *rest))


def test_edges(spark):
    """One row is its own root; an empty table has no rows; very long texts; keys of another type; other fields."""
    one = [(1, "s", "en", 1, "x" * 3_000_000)]
    (row,) = verify(spark.createDataFrame(one, SCHEMA)).collect()
    assert row.leaf == row.subroot == row.root == leaf(one[0]) and row.proof_sha256 == h() and row.verified
    empty = verify(spark.createDataFrame([], SCHEMA), proofs=True)
    assert empty.collect() == [] and empty.columns[0] == "doc_id" and empty.columns[-1] == "proof"
    named = spark.createDataFrame([("b", "x"), ("a", "y")], "name string, body string")
    found = verify(named.withColumn("all", F.lit("one")), key="name", group="all", fields=("body",)).collect()
    assert {r.name for r in found} == {"a", "b"} and all(r.root == h(leaf(("y",)), leaf(("x",))) for r in found)
