"""Winnowing against a word-by-word search."""

import random
import re
import time

import numpy as np
import pytest

from lodestar.llm import winnow as W


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    doc = words(text)
    hit, names = set(), set()
    for item, t in items:
        w = words(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1) if w else ():
            for p in range(len(doc) - n + 1):
                if doc[p : p + n] == w[s : s + n]:
                    hit |= set(range(p, p + n))
                    if item is not None:
                        names.add(str(item))
    return len(doc), hit, sorted(names)


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "Ünï", "x9"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 40, 80]))) for i in range(25)]
    items += [(None, text(20)), (90, None), (91, "..."), (92, "rep " * 30), (5, text(12)), (93, "one TWO-three")]
    docs = [None, "", "only other words here", "rep " * 9, "Rep, " * 12, "one two! three four"]
    for _ in range(40):
        parts = [text(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(w) + 1)
            parts += [" ".join(w[a : a + rng.choice([8, 9, 10, 11, 30])]).upper(), text(rng.randrange(12))]
        docs.append("; ".join(parts))
    return list(enumerate(docs)), items


@pytest.mark.parametrize("most", [10**6, 60])
def test_against_brute_force(spark, most):
    docs, items = corpus()
    rows = [(*d, "x") for d in docs] + [(7, docs[7][1], "x"), (None, docs[8][1], "x")]
    got = W.contamination(
        spark.createDataFrame(rows, "doc_id long, text string, items string"), spark.createDataFrame(items, "item_id long, text string").coalesce(1), most_words=most
    ).collect()
    order = lambda x: (x[0] is None, x[0] or 0, str(x[1:]))
    got = sorted(((r.doc_id, r.n_words, sorted(i for s in r.hit_spans for i in range(s.start, s.end)), r["items"]) for r in got), key=order)
    want = []
    for key, text, _ in rows:
        n, hit, names = brute(text, items)
        want.append((key, n, sorted(hit), names))
    assert got == sorted(want, key=order)
    assert any(w[2] for w in want)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.hit_spans for r in W.contamination(docs, none).collect()] == [[]]
    assert W.contamination(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("most", [10**6, 60])
def test_keep_clean(spark, most):
    docs, items = corpus(5)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, items string")
    kept = W.keep_clean(df, spark.createDataFrame(items, "item_id long, text string").coalesce(1), most_words=most)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in docs if not brute(t, items)[1]]


@pytest.mark.parametrize("most", [10**6, 50])
def test_texts_of_few_words(spark, most):
    """Long runs of one word, and of two or three in all orders: places that match in very many ways."""
    rng = random.Random(11)
    few = lambda n, k: " ".join(rng.choice("abc"[:k]) for _ in range(n))
    items = [(1, "a " * 40), (2, "a " * 10 + "b " * 10), (3, few(60, 2)), (4, few(60, 3)), (5, few(200, 2)), (6, "a a a"), (7, "b a b a b a"), (8, "c")]
    docs = ["a " * 9, "a " * 10, "a " * 300, "b " * 50, "b " * 9 + "a " * 9, "a " * 9 + "b " * 10, *[few(rng.choice([8, 30, 120]), 2) for _ in range(12)], *[few(60, 3) for _ in range(6)]]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = W.contamination(df, spark.createDataFrame(items, "item_id long, text string"), most_words=most).collect()
    assert len(got) == len(docs)
    for r in got:
        n, hit, names = brute(docs[r.doc_id], items)
        assert (r.n_words, {i for s in r.hit_spans for i in range(s.start, s.end)}, r["items"]) == (n, hit, names), docs[r.doc_id]


def test_repeated_words_are_not_quadratic():
    """Twenty thousand equal words on both sides within a second."""
    same = "rep " * 20_000
    index = W.Index.build([(i, same) for i in range(3)] + [(9, "rep rop " * 10_000)])
    numbers = np.array([index.vocabulary[w] for w in W.words_of(same)], np.uint64)
    began = time.perf_counter()
    hit, items = index.hits(numbers)
    assert time.perf_counter() - began < 1 and hit.all() and items == {0, 1, 2}


def test_join_with_copies_and_clashing_names(spark):
    docs, items = corpus(7)
    rows = [(1, docs[9][1], "x", 1.0)] * 3 + [(2, docs[9][1], "y", 2.0), (3, None, "z", 3.0), (4, "", "z", 3.0)]
    df = spark.createDataFrame(rows, "_ls_hash long, text string, at string, n_words double")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["_ls_hash"], r.n_words, r["items"]) for r in W.contamination(df, table, key="_ls_hash", most_words=10).collect()]
    n, hit, names = brute(docs[9][1], items)
    assert sorted(got) == sorted([(1, n, names)] * 3 + [(2, n, names), (3, 0, []), (4, 0, [])])
    kept = W.keep_clean(df, table, most_words=10)
    assert kept.columns == df.columns and kept.count() == (2 if hit else 6)
