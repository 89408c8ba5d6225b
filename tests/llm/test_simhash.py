"""Bit-sliced SimHash classes against brute force."""

import random

import numpy as np
import pytest
import xxhash

from lodestar.llm import bitslice
from lodestar.llm import linking as L
from lodestar.llm import simhash as S


def brute_fingerprint(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    n, name = len(fps), list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= radius and name[i] != name[j]:
                    name[i] = name[j] = min(name[i], name[j])
                    changed = True
    return name


TEXTS = [None, "", " \t\n", "one", "One two", "a b c", "A  B\nC", "é Éa b c d", "x " * 5000, "the quick brown fox " * 3, "w\x0bx\x0cy z"]


def test_fingerprint():
    for t in TEXTS:
        assert S.fingerprint(t) == brute_fingerprint(t), t


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 200, 700])
def test_close_pairs(radius, n):
    rng = random.Random(n * 10 + radius)
    seeds = [rng.getrandbits(64) for _ in range(max(1, n // 8))]
    values = np.array([rng.choice(seeds) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for _ in range(n)], np.uint64)
    groups = np.sort(np.array([rng.randrange(3) for _ in range(n)]))
    got = {(int(i), int(j)) for a, b in bitslice.close_pairs(values, groups, radius) for i, j in zip(a, b)}
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if groups[i] == groups[j] and bin(int(values[i] ^ values[j])).count("1") <= radius}
    assert got == want


@pytest.mark.parametrize("block", [4, 2048])
def test_components(spark, block):
    rng = random.Random(5)
    fps = []
    for _ in range(40):
        fp = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 9)):
            fps.append(fp)
            for _ in range(rng.randrange(4)):
                fp ^= 1 << rng.randrange(64)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = S.close_edges(spark.createDataFrame([(f,) for f in signed], "fp long"), 2, block).collect()
    at = {f: i for i, f in enumerate(signed)}
    parent = list(range(len(fps)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for e in edges:
        assert bin((e.u ^ e.v) & (2**64 - 1)).count("1") <= 2
        a, b = sorted((root(at[e.u]), root(at[e.v])))
        parent[b] = a
    assert [root(i) for i in range(len(fps))] == brute_components(fps, 2)


def test_classes(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [*TEXTS, " ".join(words), " ".join(words[:399] + ["other"]), " ".join(words).upper(), "quite another text here"]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(3, "one", "c"), (None, "one", "c")]
    got = S.classes(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert len(got) == len(rows)
    ids, fps = [r[0] for r in rows], [brute_fingerprint(r[1]) for r in rows]
    name = brute_components(fps, 2)
    want = {}
    for i, n in enumerate(name):
        want.setdefault(n, []).append(ids[i])
    expected = sorted((-1 if ids[i] is None else ids[i], fps[i], min(x for x in want[n] if x is not None)) for i, n in enumerate(name))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got) == expected


def test_empty(spark):
    assert S.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def near_copies():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    groups = []
    for _ in range(30):
        words = [word() for _ in range(rng.randrange(150, 400))]
        group = [" ".join(words)]
        for _ in range(rng.randrange(5)):
            copy = list(words)
            for _ in range(max(1, len(copy) // 100)):
                copy[rng.randrange(len(copy))] = word()
            group.append(" ".join(copy))
        groups.append(group)
    return groups + [[" ".join(word() for _ in range(rng.randrange(1, 60)))] for _ in range(100)]


@pytest.mark.parametrize("large", [20_000, 8])
def test_similar_classes(spark, monkeypatch, large):
    monkeypatch.setattr(L, "LARGE", large)
    monkeypatch.setattr(S, "ORDINARY", 32)
    groups = near_copies()
    rows = [(i, t, g) for i, (g, t) in enumerate((g, t) for g, group in enumerate(groups) for t in group)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, hash long")
    of = {i: g for i, _, g in rows}
    got = S.similar_classes(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    for members in by.values():
        assert len({of[r.doc_id] for r in members}) == 1, "clean documents stay apart"
        assert [r.doc_id for r in members if r.keeper] == [min(r.doc_id for r in members)]
    assert len(by) <= len(groups) + 1


def test_copies_alike_by_one_text_only(spark, monkeypatch):
    """Copies that are each close to one text but not to each other; and the same without that text."""
    monkeypatch.setattr(L, "LARGE", 60)
    asked = []
    monkeypatch.setattr(L, "NEAREST", (2, 16, None))
    real = L._near_pairs
    monkeypatch.setattr(L, "_near_pairs", lambda *a: asked.append(a[1]) or real(*a))
    rng = random.Random(3)

    def copies(name, n):
        base = [f"{name}{i}" for i in range(200)]
        out = [" ".join(base)]
        for c in range(n):
            own = list(base)
            for at in rng.sample(range(5, 195, 10), 3):
                own[at] = f"new{name}{c}x{at}"
            out.append(" ".join(own))
        return out

    texts = copies("a", 150) + copies("b", 100)[1:] + [" ".join(f"c{i}" for i in range(300))]
    sets = [set(S.shingles(t).tolist()) for t in texts]
    name = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((name[i], name[j]))
                name = [a if x == b else x for x in name]
    got = {r.doc_id: r.component for r in S.similar_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    classes: dict = {}
    for i, c in got.items():
        classes.setdefault(c, []).append(i)
    want: dict = {}
    for i, n in enumerate(name):
        want.setdefault(n, []).append(i)
    assert sorted(map(sorted, classes.values())) == sorted(want.values())
    assert max(map(len, want.values())) == 151 and len(asked) <= 3


def test_keep_one(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base, "a"), (3, base.upper(), "b"), (9, base.replace("w150 ", "other "), None), (7, None, "c"), (8, "", "c"), (4, "fine text alone", "d"), (4, "fine text alone", "d"), (None, base, "e"), (None, "null key", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = S.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, "null key"), (3, base.upper()), (4, "fine text alone"), (7, None)]
    assert S.keep_one(df.limit(0)).count() == 0


def shingle_set(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def brute_classes(texts, similarity=0.8):
    sets = [shingle_set(t) for t in texts]
    name = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if name[i] != name[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                old, new = max(name[i], name[j]), min(name[i], name[j])
                name = [new if n == old else n for n in name]
    return name


def same_classes(spark, texts):
    got = {r.doc_id: r.component for r in S.similar_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    least = {}
    for i in range(len(texts)):
        least.setdefault(got[i], i)
    return [least[got[i]] for i in range(len(texts))], brute_classes(texts)


def test_links_are_verified(spark):
    """Two ten-word texts that differ in the last word share 5 of 7 shingles: both stay; so do longer ones below 0.8."""
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        ten = [f"w{rng.randrange(10**6)}" for _ in range(10)]
        texts += [" ".join(ten), " ".join(ten[:9] + ["other"])]
    for n in (100, 300, 1000):
        for changed in (0.02, 0.021, 0.023, 0.025, 0.03, 0.04) * 4:
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            copy = list(words)
            for at in rng.sample(range(n), int(n * changed)):
                copy[at] = "changed"
            texts += [" ".join(words), " ".join(copy)]
    got, want = same_classes(spark, texts)
    assert got == want
    assert len(set(want[:80])) == 80


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 9, 31, 33, 100, 400, 3000):
        for _ in range(20):
            both = rng.integers(0, 2**63, n).astype(np.uint64)
            extra = int(rng.integers(0, n // 4 + 1))
            split = int(rng.integers(0, extra + 1))
            more = rng.integers(0, 2**63, extra).astype(np.uint64)
            a, b = np.unique(np.r_[both, more[:split]]), np.unique(np.r_[both, more[split:]])
            assert S.jaccard(a, b) < 0.8 or not S.too_different(S.sketch(a), S.sketch(b), len(a) + len(b), 0.8)


def test_repeated_lines_count_once(spark):
    """One line repeated makes no two texts alike, nor do numbers of repeats set copies apart."""
    rng = random.Random(2)
    line = " ".join(f"l{i}" for i in range(10))
    own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(6)]
    texts = [" ".join([line] * 50 + [o]) for o in own] + [" ".join([line] * n + [own[0]]) for n in (2, 9)]
    got, want = same_classes(spark, texts)
    assert got == want == [0, 1, 2, 3, 4, 5, 0, 0]


def test_a_key_named_like_a_column_of_the_operator(spark):
    rows = S.classes(spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "z y x w")], "fp long, text string"), key="fp").collect()
    assert sorted((r.fp, r.component_id) for r in rows) == [(1, 1), (2, 1), (3, 3)]
