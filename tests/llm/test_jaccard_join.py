"""The similarity join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import jaccard_join as J
from lodestar.llm import linking as L


def words_of(text):
    return (text or "").encode().lower().split()


def set_of(text, n=5):
    w = words_of(text)
    return frozenset([tuple(w)] if 0 < len(w) < n else zip(*(w[i:] for i in range(n))))


def expected(rows, percent=80, n=5):
    """Of (key, text) rows: set size and smallest key that links reach."""
    sets = [set_of(t, n) for _, t in rows]
    name = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and name[i] != name[j]:
                a, b = sorted((name[i], name[j]))
                name = [a if x == b else x for x in name]
    least = {}
    for (k, _), n in zip(rows, name):
        if k is not None:
            least[n] = min(least.get(n, k), k)
    return sorted((str(k), len(s), str(least.get(n))) for (k, _), s, n in zip(rows, sets, name))


def found(df, **more):
    return sorted((str(r[0]), r.n_shingles, str(r.component_id)) for r in J.classes(df, **more).collect())


def corpus(seed):
    """Near copies at and about the limit, passages in many texts, short texts, texts of few words."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    passage, out = [word() for _ in range(40)], []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 5, 9, 30, 120]))]
        if rng.random() < 0.5:
            base = passage + base
        out.append(base)
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            out.append(copy[: len(copy) - rng.randrange(3)])
    out += [["x", "y"], ["X", "y"], ["x"], ["a"] * 30, ["a"] * 7, ["a", "b"] * 40, ["b", "a"] * 40]
    texts = [" ".join(w) for w in out] + ["", None, " \t\n", "é Ä a b c", "É ä a b c", "é Ä A B C"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed, percent, tokens, bulk", [(1, 80, None, None), (2, 80, 300, 2), (3, 50, 2000, 4)])
def test_against_all_pairs(spark, monkeypatch, seed, percent, tokens, bulk):
    """Also with groups of few texts, and with shingles that are sent once."""
    if tokens:
        monkeypatch.setattr(J, "TOKENS", tokens)
        monkeypatch.setattr(J, "BULK", bulk)
    rows = corpus(seed)
    rows += [(rows[5][0], rows[5][1]), (1000, rows[6][1]), (None, rows[7][1]), (None, "all alone " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "size": F.lit("x"), "k": F.lit(2)})
    assert found(df.repartition(4), percent=percent) == expected(rows, percent)


def test_exchange_in_one_process():
    """Counts and answers of the packed exchange against a count of sets."""
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(rng.choice(pool[: rng.integers(5, 400)], 60)) for _ in range(90)]
    old = J.BULK
    try:
        J.BULK = 5
        teams = {t: dict(J._packed(sets[a : a + 30], list(range(a, a + 30)), 7)) for t, a in enumerate((0, 30, 60))}
    finally:
        J.BULK = old
    import pyarrow as pa

    rows = sorted((b, t, x) for t, own in teams.items() for b, x in own.items() if x)
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], ["bucket", "team", "packed"])
    answers = [r for b in J._answer(iter([batch])) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    answers.sort(key=lambda r: r[0])
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in answers], pa.int64()), pa.array([x for _, x in answers], pa.binary())], ["team", "packed"])
    got = {r["node"]: r for b in J._adapt(80)(iter([batch])) for r in b.to_pylist()}
    count = {}
    for s in sets:
        for t in np.unique(s >> J.LOW).tolist():
            count[t] = count.get(t, 0) + 1
    for i, s in enumerate(sets):
        shared = sorted((count[t], t) for t in (s >> J.LOW).tolist() if count[t] > 1)
        base = len(shared) - -(-len(s) * 80 // 100) + 1
        if base < 1:
            assert i not in got
        else:
            assert got[i]["base"] == base and np.frombuffer(got[i]["tokens"], np.uint64).tolist() == [t for _, t in shared]


def test_matches_lengthen_where_candidates_are_many():
    rare, common = np.full(60, 2), np.full(60, 5000)
    assert J.matches(rare, 10, 40) >= 1 and J.matches(common, 10, 40) > 1
    assert J.matches(np.array([2]), 1, 1) == 1
    for base in (1, 3, 30):
        assert base + J.matches(common, base, 40) - 1 <= 60


def test_empty_and_alone(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert J.classes(none).columns == ["doc_id", "n_shingles", "component_id"] and J.classes(none).collect() == []
    bare = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "one"), (5, "w " * 300_000)], "doc_id long, text string")
    assert found(bare) == [("1", 0, "1"), ("2", 0, "2"), ("3", 0, "3"), ("4", 1, "4"), ("5", 1, "5")]


def test_one_block_that_all_texts_share(spark, monkeypatch):
    """Most rows of a block in one component: groups of rows stay small, rows are not copied with its square, no link is lost."""
    monkeypatch.setattr(L, "LARGE", 32)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for c in range(400):
        own = list(base)
        for at in rng.sample(range(5, 145), 1):
            own[at] = f"n{c}x{at}"
        texts.append(" ".join(own))
    texts += [" ".join(base[:70] + [f"o{c}x{i}" for i in range(80)]) for c in range(20)]
    sizes = []
    real = L._dealt

    def dealt(*args):
        out = real(*args).persist()
        sizes.append((out.groupBy("block", "i", "j").count().agg(F.max("count")).first()[0] or 0, out.count(), args[1].count()))
        return out

    monkeypatch.setattr(L, "_dealt", dealt)
    rows = list(enumerate(texts))
    got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert got == expected(rows)
    assert all(most <= 4 * 32 for most, _, _ in sizes)
    assert all(moved <= 12 * met for _, moved, met in sizes), sizes
