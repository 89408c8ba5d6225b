"""Merkle fingerprints against the same tree built in Python."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from lodestar.llm import fingerprint as M


def md5(s, n):
    return hashlib.md5(s.encode()).hexdigest()[:n]


def tree(text):
    """(fingerprint, leaves, sections as lists of paragraphs)."""
    text = text or ""
    sections, nodes, leaves = [], [], set()
    for s in text.split("\n\n"):
        paragraphs = []
        for p in s.split("\n"):
            own = [md5(x, 32) for x in re.findall(M.LEAF, p)]
            leaves |= {x[:8] for x in own}
            paragraphs.append(md5("".join(own), 16) + ":" + ".".join(x[:8] for x in own))
        nodes.append(md5(",".join(p[:16] for p in paragraphs), 16))
        sections.append(paragraphs)
    root = hashlib.sha256(f"{len(text)}:{','.join(nodes)}".encode()).hexdigest()[:32]
    return ";".join([root, *[n + "=" + ",".join(s) for n, s in zip(nodes, sections)]]), leaves, sections


def dice(a, b):
    (fa, la, _), (fb, lb, _) = tree(a), tree(b)
    if fa.split(";")[0] == fb.split(";")[0]:
        return 1.0
    return 2 * len(la & lb) / max(1, len(la) + len(lb))


def unlike(a, b):
    """(place, x, y) between the common beginning and the common end of two lists."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    for i in range(max(len(a), len(b))):
        yield first + i, a[i] if i < len(a) else None, b[i] if i < len(b) else None


def places(a, b):
    out = []
    for i, x, y in unlike(tree(a)[2], tree(b)[2]):
        if x is None or y is None:
            out.append(str(i))
        elif x != y:
            out += [f"{i}:{j}" for j, p, q in unlike(x, y) if p != q]
    return out


WORDS = " ".join(f"word{i}" for i in range(200))
ROWS = [
    (9, "One two three four five six.\nSecond line here\n\nA new section\n \t\n\nthird"),
    (7, WORDS),
    (5, WORDS),
    (3, None),
    (2, "é" * 100 + " 😀😀 " + "x" * 100),
    (1, "ab"),
    (-4, "\n\n"),
]


def test_pairs_against_python(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, bucket string")
    got = {r.doc_id: r for r in M.edited_pairs(df).collect()}
    assert len(got) == len(ROWS)
    for i, (key, text) in enumerate(ROWS):
        text, following = text or "", ROWS[(i + 1) % len(ROWS)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        r = got[key]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == tree(text)[0]
        assert r.edited_fingerprint == tree(edited)[0]
        assert abs(r.near_edited - dice(text, edited)) < 1e-12
        assert r.differing == ",".join(places(text, edited)) and r.n_differing == len(places(text, edited))
        assert abs(r.near_next - dice(text, following)) < 1e-12
    assert got[7].near_next == 1.0 and got[7].near_edited > 0.5


def test_many_buckets_repeats_and_nulls(spark):
    rows = [(i * 7 % 1000, f"text {i} " * (i % 5 + 1)) for i in range(1000)] + [(4, "dup"), (4, "dup"), (None, "last")]
    got = M.with_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert len(got) == len(rows)
    follows = {}
    for r in got:
        follows.setdefault(r.text, []).append(r.next_text)
    ids = {t: k for k, t in rows}
    ends = [t for r in got for t in [r.next_text] if ids[r.text] is None]
    assert ends == [f"text {next(i for i in range(1000) if i * 7 % 1000 == 999)} " * (next(i for i in range(1000) if i * 7 % 1000 == 999) % 5 + 1)]
    for r in got:
        if r.key is not None and r.key > 0 and r.key != 4 and r.key != 5:
            assert ids[r.next_text] == r.key - 1
    # every row is the next one of exactly one row
    assert sorted(r.text for r in got) == sorted(r.next_text for r in got)


def test_single_row_and_empty(spark):
    one = M.edited_pairs(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one[0].near_next == 1.0
    assert M.edited_pairs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_places_of_differing_branches(spark):
    rows = [
        ("a b\nc d\n\ne f", "a b\nc X\n\ne f", ["0:1"]),
        ("a\nb", "b\na", ["0:0", "0:1"]),
        ("a\nb", "a\nb\nb\n\nc", ["0:2", "1"]),
        ("a\n\nb\n\nc", "a\n\nc", ["1"]),
        ("a\nb\nc\n\nd", "a\nnew\nb\nc\n\nd", ["0:1"]),
        ("a", "a", []),
        ("", "x", ["0:0"]),
        ("x\n\n\ny", "x\n\n\n\ny", ["1:1", "2"]),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "a string, b string").coalesce(1)
    got = df.select(M.differing(M.fingerprint(F.col("a")), M.fingerprint(F.col("b"))).alias("at")).collect()
    for (a, b, want), r in zip(rows, got):
        assert want == places(a, b)
        assert r["at"] == want


def test_random_edits(spark):
    rng = random.Random(1)
    text = lambda: "".join(rng.choice(["a", "b ", "\n", "\n\n"]) for _ in range(rng.randrange(12)))
    rows = [(text(), text()) for _ in range(400)]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(2)
    got = df.select("a", "b", M.fingerprint(F.col("a")).alias("fa"), M.fingerprint(F.col("b")).alias("fb"), M.differing(M.fingerprint(F.col("a")), M.fingerprint(F.col("b"))).alias("at")).collect()
    for r in got:
        assert (r.fa, r.fb) == (tree(r.a)[0], tree(r.b)[0])
        assert (r.fa[:32] == r.fb[:32]) == (r.a == r.b) == (not r["at"])
        assert r["at"] == places(r.a, r.b)


def test_long_texts(spark):
    """Blank lines by the hundred thousand, and two unrelated texts of 10^5 words."""
    rng = random.Random(2)
    words = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(100_000))
    rows = [(3, "a" + "\n" * 200_000 + "b"), (2, words()), (1, words())]
    got = {r.doc_id: r for r in M.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2].near_next < 0.005 and got[2].near_edited > 0.5
    assert got[3].fingerprint == tree(rows[0][1])[0]


def test_string_keys(spark):
    rows = [(f"key-{i:04}", f"text {i}") for i in range(300)] + [(None, "none"), ("key-0150", "text 150")]
    got = M.edited_pairs(spark.createDataFrame(rows, "doc_id string, text string").select("*", F.lit(1).alias("key"), F.lit(2).alias("tie"))).collect()
    assert len(got) == 302
    near = {r.key: r.next_text for r in M.with_next(spark.createDataFrame(rows, "doc_id string, text string"), "doc_id", "text").collect()}
    assert near["key-0007"] == "text 6" and near["key-0000"] == "none" and near[None] == "text 299"
