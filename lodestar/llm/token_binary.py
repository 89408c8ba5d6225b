"""Token ids in binary files: frequency-ranked, byte-aligned, separate control bytes.

Ids are replaced by their rank among all ids of the corpus (0 the most
frequent), so most need one byte.  Four ranks share a control byte, two bits
each for the byte length less one; control bytes and data bytes are separate
columns.  Decoding looks up, for each control byte, how many data bytes it
spans and which of them make up its four values, and gathers all of them at
once in numpy.

A file row is one document (end id included, ranks padded with zeros to a
multiple of four); files are Parquet written by Spark's committer in ascending
key order, with the id of each rank in a file of its own.  So any store that
Spark reads will do, and a lost executor costs a task.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import durable, partitions, prepare, range_buckets

END = 0
#: Distinct words whose ids a Python worker remembers; more are forgotten before the next texts.
REMEMBERED = 600_000
#: Bytes of text that are encoded at once; a longer text alone.
TEXT_BYTES = 8 << 20
#: Words that the library's model encodes in a call.
WORDS = 20_000
#: Documents decoded at once.
ROWS = 500
#: Buckets of the key order for each shuffle partition.
BUCKETS = 3

_CODES = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
LENGTHS = (_CODES + 1).astype(np.int64)
SPANS = LENGTHS.sum(axis=1)
#: For each control byte, where its 16 value bytes come from; 16 is a byte that is zero.
_FROM = np.cumsum(np.c_[np.zeros(256, np.int64), LENGTHS[:, :3]], axis=1)
GATHER = np.where(np.arange(4) < LENGTHS[:, :, None], _FROM[:, :, None] + np.arange(4), 16).reshape(256, 16).astype(np.int32)


def encode_ranks(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(control bytes, data bytes, data bytes of each run) of unsigned 32-bit values.

    ``counts`` are the lengths of runs (documents), each padded on its own; one
    run by default.
    """
    counts = np.array([len(values)]) if counts is None else counts
    fours = -(-counts // 4)
    at = np.arange(len(values)) + np.repeat(np.cumsum(4 * fours - counts) - (4 * fours - counts), counts)
    padded = np.zeros(4 * int(fours.sum()), "<u4")
    padded[at] = values
    code = (padded > 0xFF).view(np.uint8) + (padded > 0xFFFF).view(np.uint8) + (padded > 0xFFFFFF).view(np.uint8)
    four = code.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = padded.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    ends = np.r_[0, np.cumsum(SPANS[control])][np.r_[0, np.cumsum(fours)]]
    return control, data, np.diff(ends)


def decode_ranks(control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The values, padding included, by table lookup."""
    spans = SPANS[control]
    start = (np.cumsum(spans) - spans).astype(np.int32)
    at = GATHER[control]
    source = np.where(at < 16, start[:, None] + at, np.int32(len(data)))
    return np.append(data, np.uint8(0))[source].reshape(-1, 4).view("<u4").ravel()


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, length of each) of a binary array without nulls."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return held, np.diff(ends).astype(np.int64)


def _binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    ends = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


#: The byte-level BPE pre-tokenizer's classes of characters, by UTF-8 byte, for ASCII and Latin letters.
_OTHER, _LETTER, _DIGIT, _BLANK, _SPACE, _BEYOND = range(6)
_CLASSES = np.full(256, _OTHER, np.uint8)
_CLASSES[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = _LETTER
_CLASSES[list(b"0123456789")] = _DIGIT
_CLASSES[ord(" ")] = _BLANK
_CLASSES[list(b"\t\n\v\f\r")] = _SPACE
#: Their classes may differ between Unicode versions or readers of them.
_CLASSES[[*range(0x1C, 0x20), *range(0xC0, 0xC3), *range(0xC6, 256)]] = _BEYOND
#: In UTF-8 all others that begin with 0xC3 are letters.
_SIGNS = (0x97, 0xB7)


def _words(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pre-tokenizer's words begin in the bytes of texts, one after another, that begin at ``begins``.

    Its rule is ``'(?:[stmd]|re|ve|ll)| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.  No
    text may be empty or hold bytes beyond the classes.
    """
    kind = _CLASSES[data]
    first = np.zeros(len(data) + 1, bool)
    first[begins] = first[-1] = True
    white = (kind == _BLANK) | (kind == _SPACE)
    starts = first.copy()
    # Runs of a class, with the blank before them.
    starts[1:-1] |= (kind[1:] != kind[:-1]) & ~((kind[:-1] == _BLANK) & ~white[1:])
    # White space before other characters gives up its last character; the others are one word.
    at = np.flatnonzero(white[1:] & white[:-1] & ~first[1:-1]) + 1
    starts[at] = ~(first[at + 1] | white[np.minimum(at + 1, len(data) - 1)])
    # Shortened words after an apostrophe that begins a word.
    at = np.flatnonzero((data == ord("'")) & starts[:-1])
    if len(at):
        ahead = np.append(data, np.zeros(2, np.uint8))
        one, two = ahead[at + 1], ahead[at + 2]
        held = ~first[at + 1]
        short = held & np.isin(one, list(b"stmd"))
        pairs = np.isin(one, list(b"rv")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        long = held & ~first[np.minimum(at + 2, len(data))] & pairs
        starts[at[short | long] + 1] = False
        starts[at[long] + 2] = False
        starts[at[short] + 2] = True
        starts[at[long] + 3] = True
    return np.flatnonzero(starts[:-1])


class Encoder:
    """Whole texts to little-endian 16- or 32-bit ids of a byte-level BPE of the tokenizers library.

    The tokenizer never merges over the words that it splits a text into, so
    many texts are split at once in numpy, each distinct word is encoded once by
    the library's own model, and its ids are remembered.  Texts that hold an
    added token, or characters other than ASCII and Latin letters, go through
    the library's tokenizer whole, as do all texts of other kinds of tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values(), default=0) < 1 << 16 else "<u4")
        #: The library's model alone, over words already split.
        self.model = Tokenizer(self.tokenizer.model)
        # The library's printable letter for each byte: its alphabet in order of bytes is ASCII and Latin-1
        # letters for themselves, then the others.
        alphabet = set(ByteLevel.alphabet())
        own = [b for b in range(256) if chr(b) in alphabet]
        others = sorted(alphabet - {chr(b) for b in own})
        self.letters = {b: chr(b) for b in own} | dict(zip([b for b in range(256) if chr(b) not in alphabet], others))
        # A letter is a byte, so the ids of words encoded together are parted by their bytes.
        self.spans = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.spans[i] = len(token)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        split, model = made.get("pre_tokenizer") or {}, made["model"]
        plain = made.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True)
        joins = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        self.splits = plain and joins and alphabet <= vocabulary.keys()
        self._forget()

    def _forget(self) -> None:
        """Number of each word; ids of all words, one after another; where each word's begin."""
        self.numbers: dict[bytes, int] = {}
        self.held, self.at = np.zeros(0, self.kind), np.zeros(1, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        joined = b"".join(words).decode("latin-1").translate(self.letters)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        bounds = [0, *ends.tolist()]
        ids = self.model.encode_batch_fast([[joined[a:b] for a, b in zip(bounds, bounds[1:])]], is_pretokenized=True, add_special_tokens=False)[0].ids
        ids = np.array(ids, self.kind)
        upto = np.searchsorted(np.cumsum(self.spans[ids]), ends) + 1
        self.numbers.update(zip(words, range(len(self.numbers), len(self.numbers) + len(words))))
        self.at = np.append(self.at, len(self.held) + upto)
        self.held = np.append(self.held, ids)

    def _split(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts, one after another, and how many each has."""
        ends = np.cumsum(lengths)
        starts = _words(data, (ends - lengths)[lengths > 0])
        words = _binary(data, np.diff(np.r_[starts, len(data)])).dictionary_encode()
        if len(self.numbers) > REMEMBERED:
            self._forget()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        own = np.fromiter(map(self.numbers.get, distinct, repeat(-1)), np.int64, len(distinct))
        fresh = np.flatnonzero(own < 0)
        own[fresh] = len(self.numbers) + np.arange(len(fresh))
        for at in range(0, len(fresh), WORDS):
            self._learn([distinct[i] for i in fresh[at : at + WORDS].tolist()])
        number = own[np.asarray(words.indices)]
        begin, counts = self.at[number], np.diff(self.at)[number]
        upto = np.r_[0, np.cumsum(counts)]
        ids = self.held[np.repeat(begin - upto[:-1], counts) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.r_[0, np.searchsorted(starts, ends)]])

    def _whole(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Which texts are beyond what is split here."""
        if not self.splits:
            return lengths > 0
        odd = _CLASSES[data] == _BEYOND
        if len(data) > 1:
            odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == _SIGNS[0]) | (data[1:] == _SIGNS[1]))
        ends = np.cumsum(lengths)
        out = np.zeros(len(lengths), bool)
        out[np.searchsorted(ends, np.flatnonzero(odd), "right")] = True
        blob = data.tobytes()
        for added in self.added:
            at = blob.find(added)
            while at >= 0:  # over two texts: no harm
                out[np.searchsorted(ends, at, "right")] = True
                at = blob.find(added, at + 1)
        return out

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after another, and how many each has; null counts as empty."""
        column = pc.fill_null(column, "").cast(pa.string())
        column.validate(full=True)  # UTF-8
        data, lengths = _flat(column)
        whole = self._whole(data, lengths)
        if not whole.any():
            return self._split(data, lengths)
        plain = np.repeat(~whole, lengths)
        ids, n = self._split(data[plain], lengths[~whole])
        others = [self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids for t in column.filter(pa.array(whole)).to_pylist()]
        counts = np.zeros(len(lengths), np.int64)
        counts[~whole], counts[whole] = n, [len(x) for x in others]
        out, plain = np.empty(int(counts.sum()), self.kind), np.repeat(~whole, counts)
        out[plain], out[~plain] = ids, np.fromiter(chain.from_iterable(others), self.kind)
        return out, counts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        ids, counts = self.ids(pa.array(texts, pa.string()))
        return _binary(ids.view(np.uint8), counts * self.kind.itemsize).to_pylist()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenized(batches: Iterator[pa.RecordBatch], path: str, key: str, end: int) -> Iterator[pa.RecordBatch]:
    """``key, ids, width`` of batches of keys and texts."""
    own = encoder(path)
    width = own.kind.itemsize
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)).astype(np.int64)
        group = (np.cumsum(lengths) - lengths) // TEXT_BYTES
        for at, to in pairwise(np.flatnonzero(np.diff(group, prepend=-1, append=-1)).tolist()):
            part = batch.slice(at, to - at)
            ids, counts = own.ids(part.column(1))
            ids = np.insert(ids, np.cumsum(counts), end)
            yield pa.RecordBatch.from_arrays([part.column(0), _binary(ids.view(np.uint8), (counts + 1) * width), pa.array(np.full(len(counts), width, np.int32))], [key, "ids", "width"])


def tokenize(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """``key, ids`` (little-endian, end id last), ``width`` (bytes of an id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tokenized(batches, path, key, end)

    prepare(df.sparkSession)
    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids binary, width int")


def id_counts(tokens: DataFrame) -> DataFrame:
    """``id, n`` over all documents; each task sends one row for each id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            n = np.bincount(_flat(batch.column(0))[0].view(f"<u{batch.column(1)[0].as_py()}"))
            if len(n) > len(total):
                total, n = n.astype(np.int64), total
            total[: len(n)] += n
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"])

    return tokens.select("ids", "width").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(df: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END) -> str:
    """Tokenize ``df`` and write the files under ``path``; returns ``path``.

    Null texts count as empty (the end id alone).  Null keys come first; rows of
    one key are ordered by a hash of their ids, so repeated rows are files rows
    of their own.  An empty table gives files without rows.  Other columns are
    ignored.  ``key`` must be an integer column.
    """
    spark = df.sparkSession
    tokens = durable(tokenize(df, tokenizer, key, text, end), "tokens")
    # As many rows as the vocabulary has ids, at most.
    ranked = id_counts(tokens).orderBy(F.desc("n"), "id")
    of_rank = np.array([r.id for r in ranked.collect()], np.int64)
    rank_of = np.zeros(int(of_rank.max(initial=-1)) + 1, np.uint32)
    rank_of[of_rank] = np.arange(len(of_rank), dtype=np.uint32)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(of_rank)], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, lengths = _flat(batch.column(1))
            width = batch.column(2)[0].as_py()
            counts = lengths // width
            control, data, spans = encode_ranks(rank_of[ids.view(f"<u{width}")], counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), batch.column(4), pa.array(counts), _binary(control, -(-counts // 4)), _binary(data, spans)],
                [key, "bucket", "tie", "n_tokens", "control", "data"],
            )

    n = partitions(spark)
    kind = df.schema[key].dataType.simpleString()
    bucket = range_buckets(tokens, key, F.col("tie"), n * BUCKETS)
    placed = tokens.withColumn("tie", F.xxhash64("ids")).select(key, "ids", "width", bucket.alias("bucket"), "tie")
    coded = placed.mapInArrow(run, f"`{key}` {kind}, bucket int, tie bigint, n_tokens bigint, control binary, data binary")
    # Neighbouring buckets share a partition; their number is the partition's, so nothing is sampled.
    dealt = coded.repartitionById(n, F.expr(f"bucket div {BUCKETS}").cast("int"))
    order = F.shiftrightunsigned("tie", 1)
    dealt.sortWithinPartitions("bucket", F.asc_nulls_first(key), order, "tie").write.parquet(f"{path}/tokens")
    return path


def _decoder(spark, path: str, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What makes ``key, bucket, tie, n_tokens, ids`` of file rows in a task."""
    of_rank = np.array([r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                counts = np.asarray(part.column(3))
                ranks = decode_ranks(_flat(part.column(4))[0], _flat(part.column(5))[0])
                padded = -(-counts // 4) * 4
                kept = np.ones(len(ranks), bool)
                for i in range(1, 4):  # up to three values of padding at each end
                    last = np.cumsum(padded) - i
                    kept[last[padded - counts >= i]] = False
                yield pa.RecordBatch.from_arrays([*part.columns[:4], _binary(of_rank[ranks[kept]].view(np.uint8), 4 * counts)], [key, "bucket", "tie", "n_tokens", "ids"])

    return run


def _coded(spark, path: str, key: str) -> tuple[DataFrame, str]:
    """Rows of the files, and the schema of those columns that stay."""
    prepare(spark)
    files = spark.read.parquet(f"{path}/tokens").select(key, "bucket", "tie", "n_tokens", "control", "data")
    return files, f"`{key}` {files.schema[key].dataType.simpleString()}, bucket int, tie bigint, n_tokens bigint"


def read_tokens(spark, path: str, key: str = "doc_id") -> DataFrame:
    """``key, bucket, tie, n_tokens, ids`` (little-endian 32-bit) of files that :func:`write_tokens` wrote."""
    files, kept = _coded(spark, path, key)
    return files.mapInArrow(_decoder(spark, path, key), f"{kept}, ids binary")


def positions(spark, path: str, key: str = "doc_id") -> DataFrame:
    """``key, start, n_tokens, ids_crc32`` in the files' order, all read from the files.

    Ids are summed where they are decoded, so they don't leave the task.  Starts
    are prefix sums: within a bucket by a window, over buckets from one number a
    bucket.
    """
    decode = _decoder(spark, path, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in decode(batches):
            crc = [zlib.crc32(x.as_buffer()) for x in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], [key, "bucket", "tie", "n_tokens", "ids_crc32"])

    files, kept = _coded(spark, path, key)
    rows = files.mapInArrow(run, f"{kept}, ids_crc32 bigint")
    sums = spark.read.parquet(f"{path}/tokens").groupBy("bucket").agg(F.sum("n_tokens").alias("n")).orderBy("bucket").collect()
    before, total = [], 0
    for r in sums:
        before.append((r.bucket, total))
        total += r.n
    offsets = F.broadcast(spark.createDataFrame(before, "bucket int, before long"))
    window = Window.partitionBy("bucket").orderBy(F.asc_nulls_first(key), F.shiftrightunsigned("tie", 1), "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("n_tokens").over(window)).join(offsets, "bucket")
    return placed.select(key, (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")

