"""Interval expansion against brute force over all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lodestar.llm import suffix_dedup as S


def brute(texts, length):
    bodies = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                hit[i : i + length] = True
        edge = np.diff(np.r_[0, hit.view(np.int8), 0])
        kept = bytes(x for x, h in zip(b, hit) if not h)
        out.append((len(b), int(hit.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randrange(5, 80)) for _ in range(6)]
    out = [None, "", "short", "a" * (3 * length), "ab" * length, text(60) * 2]
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts += [text(rng.randrange(25)), p[a : a + rng.randrange(len(p))]]
        out.append(" ".join(parts))
    near = text(120)
    for _ in range(12):
        i = rng.randrange(len(near))
        out.append(near[:i] + word() + near[i + rng.randrange(4) :])
    return out + [near, near, passages[0]]


@pytest.mark.parametrize("seed,length,group", [(1, 200, 4096), (2, 60, 4096), (3, 33, 4096), (4, 60, 3), (5, 200, 1), (6, 33, 2)])
def test_against_brute_force(spark, seed, length, group):
    texts = corpus(seed, length)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(6, texts[6], "x"), (None, texts[9], "x"), (7, texts[8], "x")]
    got = S.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, hash string"), length=length, group=group).collect()
    want = [(r[0], *w) for r, w in zip(rows, brute([r[1] for r in rows], length))]
    order = lambda x: str(x)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got), key=order) == sorted(want, key=order)
    assert 0 < sum(w[2] for w in want) < sum(w[1] for w in want)


def test_empty(spark):
    assert S.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_frequent_core(spark):
    """One line among different neighbours in every text: the core's rows are split down to single strings."""
    rng = random.Random(9)
    line = "".join(rng.choice("abcdefgh ") for _ in range(170))
    side = lambda n: "".join(rng.choice("xyz") for _ in range(n))
    ends = [side(40) for _ in range(5)]
    texts = [side(60) + rng.choice(["", rng.choice(ends)]) + line + rng.choice(["", rng.choice(ends)]) + side(60) for _ in range(1500)]
    got = S.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), group=20).collect()
    want = brute(texts, 200)
    assert [(r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in sorted(got)] == want
    assert 0 < sum(w[2] > 0 for w in want) < len(want)


@pytest.mark.parametrize("most", [1, 7, 64, 1000])
def test_anchors_in_parts(most):
    raw = np.random.default_rng(1).integers(0, 5, 500).astype(np.uint64)
    for window in (2, 9, 65):
        assert S.anchors(raw, window, most).tolist() == S.anchors(raw, window).tolist()


def test_pieces_of_a_long_text():
    """A text longer than a slice has the same anchors, cores and neighbourhoods as in one piece."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (5000, 10, 260, 900)]
    batch, shape = S.pa.RecordBatch.from_pylist([{"text": t} for t in texts]), S.Shape(100)

    def seen(most):
        return [(row + int(a.doc[i]), int(a.place[i]), int(a.size[i]), int(a.core[i]), int(around)) for row, a in S._anchored(batch, 0, shape, most) for i, around in enumerate(a.around())]

    assert sorted(seen(300)) == sorted(seen(10**6)) and len(seen(300)) > 100


def test_expand_rows():
    rng = random.Random(3)
    span = 12
    for _ in range(30):
        n = rng.randrange(2, 40)
        groups = np.sort(np.array([rng.randrange(3) for _ in range(n)]))
        side = lambda: bytes(rng.choice(b"ab") for _ in range(rng.choice([span, span, rng.randrange(span)])))
        before, behind = [side() for _ in range(n)], [side() for _ in range(n)]
        weight = np.array([rng.choice([1, 1, 1, 2]) for _ in range(n)])
        low = rng.randrange(4)
        limits = np.full(n, low), np.full(n, span - low)
        least, most = S.expand(groups, before, behind, span, weight, limits=limits)
        for i in range(n):
            fits = []
            for k in range(low, span - low + 1):
                if k > len(before[i]) or span - k > len(behind[i]):
                    continue
                mine = (groups[i], before[i][:k], behind[i][: span - k])
                others = [(groups[j], before[j][:k], behind[j][: span - k]) for j in range(n) if j != i]
                if mine in others or weight[i] > 1:
                    fits.append(k)
            assert (least[i], most[i]) == ((min(fits), max(fits)) if fits else (span + 1, -1))
