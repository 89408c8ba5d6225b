"""Token files: exact round trip, order and positions."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import token_binary as T
from lodestar.llm.common import range_buckets

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


TEXTS = [None, "", " ", "a", "Hello  world\n\n  it's 123 <|endoftext|>!", "Éaux où 日本語 😀  x", "x" * 3000, "the of and " * 500, "\t\t  a b", "don't we'll 'tis"]


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], list(range(0, 70000, 7))])
def test_round_trip(values):
    values = np.array(values, np.uint32)
    control, data, spans = T.encode_ranks(values)
    assert len(control) == -(-len(values) // 4) and spans.sum() == len(data)
    assert (T.decode_ranks(control, data)[: len(values)] == values).all()


def test_runs_are_padded_alone():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 4, 5, 0, 11, 3])
    values = rng.integers(0, 1 << 20, counts.sum()).astype(np.uint32)
    control, data, spans = T.encode_ranks(values, counts)
    at = fours = start = 0
    for n, span in zip(counts.tolist(), spans.tolist()):
        got = T.decode_ranks(control[fours : fours + -(-n // 4)], data[start : start + span])
        assert (got[:n] == values[at : at + n]).all() and len(got) == -(-n // 4) * 4
        at, fours, start = at + n, fours + -(-n // 4), start + span


def test_words_alone_encode_like_texts():
    own = T.Encoder(PATH)
    extra = ["it's _a_b c__ +_+ x²", "a\u00a0b\u200bc", "  lead", "tail  ", "\n\n a\n b", " ".join(f"w{i} Éa{i}" for i in range(50)), "|x|y || z!? 'll 'S"]
    texts = TEXTS + extra
    for _ in range(2):
        for t, ids in zip(texts, own.encode(texts)):
            assert np.frombuffer(ids, own.kind).tolist() == tokenizer().encode(t or "", add_special_tokens=False).ids, t


def test_random_texts_encode_like_the_library():
    """Over an alphabet of every kind of space, control characters, special tokens, letters and digits."""
    rng = random.Random(6)
    parts = [*"\x00\x0b\x0c\x1b\x1c\x1d\x1e\x1f\x7f\x85\xa0\t\n\r  ab'sZ1_!.²ªºé×ÿſ", "\u2028", "\u3000", "日", "😀", "<|endoftext|>", "<|endof", "'ll", " the", "'S"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(20_000)]
    own, library = T.Encoder(PATH), tokenizer()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for a in range(0, len(texts), 500):
        for t, ids, w in zip(texts[a : a + 500], own.encode(texts[a : a + 500]), want[a : a + 500]):
            assert np.frombuffer(ids, own.kind).tolist() == w, repr(t)


def test_each_word_is_encoded_once():
    """However words are joined, the library's model gets each of them once, many in a call."""
    words = ["alpha", "beta", "gamma", "d\u00e9lta", "12", "'s", "...", "\n"]
    texts = [f" {a}{b} {c}" for a in words for b in words for c in words]
    own, library, got, calls = T.Encoder(PATH), tokenizer(), [], 0

    class Model:
        def encode_batch_fast(self, batch, **options):
            nonlocal calls
            calls += 1
            got.extend(batch[0])
            return model.encode_batch_fast(batch, **options)

    model, own.model = own.model, Model()
    for _ in range(2):
        for t, ids in zip(texts, own.encode(texts)):
            assert np.frombuffer(ids, own.kind).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    assert calls == 1 and len(got) == len(set(got)) < len(texts)


def test_texts_end_words():
    """Texts lie one after another: no word, white space or shortened word goes over an end."""
    ends = ["a", "'", "s", "'s", " ", "  ", "\n", "'r", "e", "'l", "l", "1", "!", "\u00e9", "", None, "<|endof", "text|>", "\u65e5", "\u00d7"]
    texts = [x for a in ends for b in ends for x in (a, b)]
    own, library = T.Encoder(PATH), tokenizer()
    for t, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, own.kind).tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("change", ["prefix", "lower", "letters"])
def test_other_tokenizers_go_through_the_library(change, tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    other = tokenizer()
    if change == "prefix":
        other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    elif change == "lower":
        other.normalizer = normalizers.Lowercase()
    else:  # knows few letters and drops the others
        other = Tokenizer(models.BPE({"a": 0, "b": 1, "ab": 2}, [("a", "b")]))
        other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    other.save(path := str(tmp_path / "other.json"))
    own, texts = T.Encoder(path), ["Abab zab", "x", "", "ab AB", "\u00e9ab"]
    want = [other.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, own.kind).tolist() for x in own.encode(texts)] == want


def test_groups_of_texts(monkeypatch):
    """Texts are encoded by groups of bytes; groups and what is remembered change no result."""
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": pa.array([r[1] for r in rows], pa.string())})
    library = tokenizer()
    monkeypatch.setattr(T, "REMEMBERED", 3)
    for size in (1, 10, 1000, 1 << 20):
        monkeypatch.setattr(T, "TEXT_BYTES", size)
        out = pa.Table.from_batches(T.tokenized(iter([batch]), PATH, "doc_id", T.END))
        assert out.column("doc_id").to_pylist() == [r[0] for r in rows]
        for (_, t), ids in zip(rows, out.column("ids").to_pylist()):
            assert np.frombuffer(ids, "<u2").tolist() == [*library.encode(t or "", add_special_tokens=False).ids, T.END]


def test_files(spark, tmp_path):
    rows = [(50 - i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null key", "x"), (45, "again", "x"), (46, TEXTS[4], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = T.write_tokens(df, str(tmp_path / "t"), PATH)
    got = sorted(T.positions(spark, path).collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    at, want = 0, {}
    for key, text, _ in rows:
        ids = np.array([*tokenizer().encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(key, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r.start == at
        at += r.n_tokens
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    assert not any(want.values())


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.positions(spark, T.write_tokens(df, str(tmp_path / "t"), PATH)).count() == 0


def test_buckets_spread_a_hot_key(spark):
    from pyspark.sql import functions as F

    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 5000).otherwise(F.col("id")).alias("k"), F.xxhash64("id").alias("tie"))
    rows = df.withColumn("b", range_buckets(df, "k", F.col("tie"), 12)).collect()
    ordered = sorted(rows, key=lambda r: (r.k, r.tie % 2**64 >> 1))
    assert [r.b for r in ordered] == sorted(r.b for r in rows)
    sizes = np.bincount([r.b for r in rows])
    assert sizes.max() < 2 * 9000 / 12
