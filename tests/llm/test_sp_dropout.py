"""Merge-dropout against the library without dropout, a heap with it, and exact round trips."""

import random

import numpy as np
import pytest

from lodestar.llm import sp_dropout as S

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None,
    "",
    " ",
    "   two  spaces   ",
    "Hello world, this is a test of the tokenizer.",
    "line\none\ttwo\r\n\x00end",
    "Éaux où 日本語 😀 ▁mark▁ ñ",
    "unbelievable internationalization " * 5,
    "x" * 500,
    "abcdefghij" * 30,
    "​  odd",
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(1)
    parts = ["the", "tion", "ing", "é", "ß", "\n", " ", "  ", "ou", "ère", ".", ",", "A", "7", "日"]
    return ["".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randrange(400))) for _ in range(60)]


def split(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_no_dropout_is_the_library(library, long_texts):
    own = S.Encoder(PATH, 0.0)
    texts = [t for t in TEXTS if S.SPACE not in (t or "")] + long_texts
    for t, ids in zip(texts, split(*own.encode(texts, list(range(len(texts)))))):
        assert ids == library.encode(t or ""), t


@pytest.mark.parametrize("rate", [0.1, 0.5, 1.0])
def test_rows_agree_with_heap(long_texts, rate):
    own, alone = S.Encoder(PATH, rate), S.Encoder(PATH, rate)
    names = list(range(len(long_texts)))
    got = own.encode(long_texts, names)
    before, S.WIDTHS = S.WIDTHS, ()
    try:
        want = alone.encode(long_texts, names)
    finally:
        S.WIDTHS = before
    assert split(*got) == split(*want)


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.9])
def test_round_trip(long_texts, rate):
    own = S.Encoder(PATH, rate)
    texts = TEXTS + long_texts
    assert own.decode(*own.encode(texts, texts)) == [(t or "").encode() for t in texts]


def test_library_decodes_the_same(library, long_texts):
    own = S.Encoder(PATH, 0.3)
    for t, ids in zip(long_texts, split(*own.encode(long_texts, long_texts))):
        assert library.decode(ids) == t


def test_seeds_and_documents_vary(long_texts):
    text = "unbelievable internationalization of considerable transformations " * 20
    a = split(*S.Encoder(PATH, 0.2, seed=1).encode([text, text], [1, 2]))
    b = split(*S.Encoder(PATH, 0.2, seed=2).encode([text], [1]))
    again = split(*S.Encoder(PATH, 0.2, seed=1).encode([*long_texts, text], [*range(60), 1]))
    assert a[0] != a[1] and a[0] != b[0] and again[-1] == a[0]
    plain = len(S.Encoder(PATH, 0.0).encode([text], [1])[0])
    assert plain < len(a[0]) < 2.5 * plain


def naive(model, chunk, key, limit):
    """The agenda by looking at all pairs each time; a skipped pair is left alone until a side grows."""
    parts, skipped = [(i, s) for i, s in enumerate(model.symbols(np.array([ord(c) for c in chunk], np.uint32)).tolist())], set()
    while True:
        best = None
        for (i, a), (_, b) in zip(parts, parts[1:]):
            made = model.pairs.get(a << 16 | b)
            if made is not None and (i, a, b) not in skipped and (best is None or (model.rank[made], i) < best[:2]):
                best = (model.rank[made], i, a, b, made)
        if best is None:
            break
        _, i, a, b, made = best
        if limit and bool(S._skips(np.uint64(key), i, made, np.uint64(limit))):
            skipped.add((i, a, b))
            continue
        at = [p for p, _ in parts].index(i)
        parts[at : at + 2] = [(i, made)]
    out = []
    for i, s in parts:
        out += [s] if s < model.size else [int(model.byte_id[x]) for x in chunk[i].encode()]
    return out


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.6])
def test_every_place_has_its_own_draw(long_texts, rate):
    """Against a plain agenda with the key of document and place; in slices of occurrences too."""
    own, texts = S.Encoder(PATH, rate, seed=5), [t for t in TEXTS if t] + long_texts[:20] + ["same words same words " * 30] * 2
    before, S.OCCURRENCES = S.OCCURRENCES, 97
    try:
        got = split(*own.encode(texts, list(range(len(texts)))))
    finally:
        S.OCCURRENCES = before
    with np.errstate(over="ignore"):
        for d, t in enumerate(texts):
            name = S.mix(np.array([S.xxhash.xxh64_intdigest(str(d).encode())], np.uint64) + own.seed * S.GOLDEN)
            want = []
            for i, c in enumerate(S.CHUNK.findall(" " + t)):
                want += naive(own.model, c, S.mix(name + S.GOLDEN * np.uint64(i))[0], own.limit)
            assert got[d] == want, t
    if rate:
        with np.errstate(over="ignore"):
            words = [naive(own.model, " words", S.mix(name + S.GOLDEN * np.uint64(i))[0], own.limit) for i in range(2000)]
        assert len({tuple(w) for w in words}) > 3
        assert got[-1] != got[-2]


def test_rate_of_skips():
    keys = S.mix(np.arange(200_000, dtype=np.uint64))
    assert abs(S._skips(keys, 3, 77, np.uint64(int(0.1 * 2**64))).mean() - 0.1) < 0.005


def test_frames(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null key", "x"), (4, TEXTS[4], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = S.encode(df, PATH)
    got = out.collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    assert len({tuple(r.ids) for r in got if r.doc_id == 4}) == 1
    back = {(r.doc_id, r.text) for r in S.decode(out, PATH).collect()}
    assert back == {(i, t or "") for i, t, _ in rows}
    assert S.encode(df.limit(0), PATH).count() == 0
