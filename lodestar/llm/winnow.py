"""Benchmark decontamination by winnowing.

Words become k-gram hashes; from every window of consecutive hashes the
smallest is kept (the last of equals).  A span shared by a document and an item
that is at least ``k + window - 1`` words long holds a whole window in both, so
both keep the same hash of it.  Kept hashes of documents are joined with those
of the benchmark, and every hit is extended: the few spans around it are looked
up among the spans of the items, each once, however often a text repeats
itself.  The hit words are those of all spans found.  Items shorter than a span
are spans of their own, looked up among the document's grams of their length.

The benchmark's spans go to the executors while they are below a checked bound
(``most_words``).  Beyond it both sides are joined as tables: documents send the
kept hashes that a bit map of the benchmark's lets through, and the spans around
those that are joined; texts stay where they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import ascii_lower, durable, fresh, meet, prepare
from lodestar.llm.suffix_dedup import _bit_map as bit_map
from lodestar.llm.suffix_dedup import _in_map as in_map

#: Words in a window that counts as contamination; k-gram; hashes in a winnowing window.
SPAN, GRAM = 10, 5
#: Benchmark words that are sent to the executors, at most, and bytes of them.
MOST_WORDS, WORD_BYTES = 1_000_000, 16
#: Fixed value: what is a word, over lower-cased UTF-8; the same for Spark.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8").lower())


def grams(ids: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of k consecutive word numbers, from everywhere or from ``at``."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n if at is None else len(at), np.uint64)
    for i in range(k):
        out = (out ^ (ids[i : i + n] if at is None else ids[at + i])) * MIX
        out ^= out >> np.uint64(32)
    return out


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions kept: the last smallest hash of each window."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = hashes[:n].copy(), np.arange(n)
    for i in range(1, window):
        better = hashes[i : i + n] <= best
        best = np.where(better, hashes[i : i + n], best)
        at = np.where(better, np.arange(i, i + n), at)
    return np.unique(at)


def around(kept: np.ndarray, words: int, span: int, gram: int) -> np.ndarray:
    """Starts of the spans that hold a gram of ``kept``, each once."""
    starts = np.unique((kept[:, None] + np.arange(gram - span, 1)).ravel())
    return starts[(starts >= 0) & (starts <= words - span)]


def covered(words: int, spans: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Which words are in a span, of (starts, length)."""
    step = np.zeros(words + 1, np.int64)
    for starts, n in spans:
        np.add.at(step, starts, 1)
        np.add.at(step, starts + n, -1)
    return np.cumsum(step)[:words] > 0


class Spans:
    """Spans of one length, known by hash and by one place each, with the items that hold them."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, items: np.ndarray, n: int):
        self.n, self.ids = n, ids
        hashes = grams(ids, n, starts)
        order = np.lexsort((items, hashes))
        hashes, starts, items = hashes[order], starts[order], items[order]
        new = np.r_[True, hashes[1:] != hashes[:-1]] if len(hashes) else np.zeros(0, bool)
        self.hashes, self.places = hashes[new], starts[new]
        own = new | np.r_[True, items[1:] != items[:-1]] if len(hashes) else new
        self.items = items[own]
        self.first = np.flatnonzero(new[own])
        self.last = np.r_[self.first[1:], len(self.items)].astype(np.int64)

    def among(self, numbers: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``starts`` where a span of an item begins, and which spans those are; compared word by word."""
        if not len(self.hashes) or not len(starts):
            return starts[:0], starts[:0]
        hashes = grams(numbers, self.n, starts)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = self.hashes[at] == hashes
        starts, at = starts[same], at[same]
        each = np.arange(self.n)
        same = (numbers[starts[:, None] + each] == self.ids[self.places[at][:, None] + each]).all(axis=1)
        return starts[same], at[same]

    def items_of(self, spans: np.ndarray) -> set[int]:
        out: set[int] = set()
        for i in np.unique(spans).tolist():
            out.update(self.items[self.first[i] : self.last[i]].tolist())
        return out


@dataclass
class Index:
    """Kept hashes and spans of benchmark items, words as numbers; 0 is any word that is in none."""

    span: int
    gram: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    ids: list = field(default_factory=list)

    @classmethod
    def build(cls, items: list[tuple], span: int = SPAN, gram: int = GRAM) -> Index:
        self = cls(span, gram)
        flat, kept, found, at = [], [np.zeros(0, np.uint64)], {}, 0
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint64)
            n = min(span, len(words))
            starts = at + np.arange(len(words) - n + 1)
            found.setdefault(n, []).append((starts, np.full(len(starts), len(self.ids))))
            if n == span:
                hashes = grams(numbers, gram)
                kept.append(hashes[winnow(hashes, span - gram + 1)])
            flat.append(numbers)
            self.ids.append(item)
            at += len(words)
        flat = np.concatenate(flat) if flat else np.zeros(0, np.uint64)
        self.kept = np.unique(np.concatenate(kept))
        self.spans = {n: Spans(flat, *(np.concatenate(x) for x in zip(*rows)), n) for n, rows in found.items()}
        return self

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """(which words are hit, which items) of one document's word numbers."""
        spans, items = [], set()
        unknown = np.flatnonzero(numbers == 0)  # no span goes over one
        for n, own in self.spans.items():
            if len(numbers) < n:
                continue
            if n == self.span:
                if not np.any(np.diff(np.r_[-1, unknown, len(numbers)]) > n):
                    continue
                hashes = grams(numbers, self.gram)
                kept = winnow(hashes, n - self.gram + 1)
                at = np.minimum(np.searchsorted(self.kept, hashes[kept]), len(self.kept) - 1)
                starts = around(kept[self.kept[at] == hashes[kept]], len(numbers), n, self.gram)
            else:
                starts = np.flatnonzero(numbers[: len(numbers) - n + 1])
            starts, found = own.among(numbers, starts)
            if len(starts):
                spans.append((starts, n))
                items |= own.items_of(found)
        return covered(len(numbers), spans), items


FOUND = "n_words bigint, hit_spans array<struct<start:int,end:int>>, items array<string>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _runs(hit: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, hit.view(np.int8), 0]))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]


def _scan(index: Index, text: int, keep: list[str]):
    known = index.vocabulary.get

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spans, items = [], [], []
            for value in batch.column(text):
                words = words_of(value.as_py())
                hit, found = index.hits(np.array([known(w, 0) for w in words], np.uint64))
                n_words.append(len(words))
                spans.append(_runs(hit))
                items.append(sorted({str(index.ids[i]) for i in found if index.ids[i] is not None}))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(n_words, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))], [*keep, "n_words", "hit_spans", "items"])

    return run


def _held(items: DataFrame, item: str, text: str, most: int) -> list[tuple] | None:
    """The benchmark, if its words and their bytes are within the bound."""
    body = F.coalesce(F.col(text), F.lit(""))
    size = items.agg(F.sum(F.regexp_count(ascii_lower(body), F.lit(WORDS))).alias("words"), F.sum(F.octet_length(body)).alias("bytes")).first()
    if (size.words or 0) > most or (size.bytes or 0) > WORD_BYTES * max(most, 1 << 16):
        return None
    return [tuple(r) for r in items.select(item, text).collect()]


# -- a benchmark beyond the bound: both sides as tables ---------------------------


def _numbers(text: str | None) -> np.ndarray:
    """Words as 64-bit hashes, the same on both sides."""
    words = words_of(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.array([x.tolist() for x in values], pa.list_(kind))


def _item_spans(span: int, gram: int):
    """``name, text`` of items to ``name, n, spans, kept``: hashes of its spans of n words, and of what winnowing keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, spans, kept = [], [], []
            for value in batch.column(1):
                numbers = _numbers(value.as_py())
                n = min(span, len(numbers))
                hashes = grams(numbers, gram) if n == span else np.zeros(0, np.uint64)
                ns.append(n)
                spans.append(np.unique(grams(numbers, n)).view(np.int64) if n else np.zeros(0, np.int64))
                kept.append(np.unique(hashes[winnow(hashes, span - gram + 1)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int32()), _lists(spans, pa.int64()), _lists(kept, pa.int64())], ["name", "n", "spans", "kept"])

    return run


def _doc_spans(span: int, gram: int, long_map: np.ndarray, short_maps: dict[int, np.ndarray]):
    """``at, text`` of documents to ``at, n, kept, start, span``: spans around kept hashes in the map, and short spans in theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, value in enumerate(batch.column(1)):
                numbers = _numbers(value.as_py())
                hashes = grams(numbers, gram)
                kept = winnow(hashes, span - gram + 1)
                kept = kept[in_map(long_map, hashes[kept].view(np.int64))]
                for p in kept.tolist():
                    starts = around(np.array([p]), len(numbers), span, gram)
                    out.append((np.full(len(starts), row), span, np.full(len(starts), hashes[p]), starts, grams(numbers, span, starts)))
                for n, held in short_maps.items():
                    own = grams(numbers, n)
                    starts = np.flatnonzero(in_map(held, own.view(np.int64)))
                    out.append((np.full(len(starts), row), n, np.zeros(len(starts), np.uint64), starts, own[starts]))
            if not out:
                continue
            rows = np.concatenate([x[0] for x in out])
            columns = [batch.column(0).take(pa.array(rows)), pa.array(np.repeat([x[1] for x in out], [len(x[0]) for x in out]), pa.int32())]
            columns += [pa.array(np.concatenate([x[i] for x in out]).astype(np.uint64).view(np.int64)) for i in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays(columns, ["at", "n", "kept", "start", "span"])

    return run


def _joined(docs: DataFrame, text: str, items: DataFrame, item: str, item_text: str, span: int, gram: int) -> DataFrame:
    """``at, hit_spans, items`` of the texts that any item hits; ``at`` is the text's md5."""
    told = durable(items.select(F.col(item).cast("string").alias("name"), F.col(item_text)).mapInArrow(_item_spans(span, gram), "name string, n int, spans array<bigint>, kept array<bigint>"), "items")
    kept = durable(told.select(F.explode("kept").alias("kept")).distinct(), "kept")
    spans = durable(told.select("n", F.explode("spans").alias("span"), "name").distinct(), "spans")
    shorts = {n: bit_map(spans.where(F.col("n") == n).select("span")) for n in (r.n for r in spans.where(F.col("n") < span).select("n").distinct().collect())}  # span - 1 numbers at most
    texts = docs.select(F.md5(F.coalesce(F.col(text), F.lit(""))).alias("at"), F.col(text))
    found = texts.mapInArrow(_doc_spans(span, gram, bit_map(kept), shorts), "at string, n int, kept bigint, start bigint, span bigint")
    # Copies of a text, and spans around several kept hashes, count once.
    found = durable(found.distinct(), "around")
    long = meet(found.where(F.col("n") == span), kept, "kept")
    near = durable(long.unionByName(found.where(F.col("n") < span)).select("at", "n", "start", F.xxhash64("n", "span").alias("code")).distinct(), "near")
    codes = spans.select(F.xxhash64("n", "span").alias("code"), "name")
    hits = durable(meet(near, durable(codes.select("code").distinct(), "codes"), "code"), "hits")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1).to_pylist():
                starts, ends = np.array([x["start"] for x in value]), np.array([x["start"] + x["n"] for x in value])
                step = np.zeros(int(ends.max()) + 1, np.int64)
                np.add.at(step, starts, 1)
                np.add.at(step, ends, -1)
                out.append(_runs(np.cumsum(step)[:-1] > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, SPANS)], ["at", "hit_spans"])

    where = hits.groupBy("at").agg(F.collect_list(F.struct("start", "n")).alias("hits")).mapInArrow(merged, "at string, hit_spans array<struct<start:int,end:int>>")
    # A span's items, all of them once for each text that has it.
    names = codes.where("name is not null").groupBy("code").agg(F.sort_array(F.collect_set("name")).alias("names"))
    own = meet(hits.select("at", "code").distinct(), durable(names, "names"), "code").select("at", F.explode("names").alias("name"))
    named = own.groupBy("at").agg(F.sort_array(F.collect_set("name")).alias("items"))
    return durable(where.join(named, "at", "left").select("at", "hit_spans", F.coalesce("items", F.array().cast("array<string>")).alias("items")), "contaminated")


def contamination(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", span: int = SPAN, gram: int = GRAM, most_words: int = MOST_WORDS
) -> DataFrame:
    """``key, n_words, hit_spans, items``: word ranges of a document that any item covers, and those items.

    ``hit_spans`` are disjoint (start, end) in words, ``items`` item names as
    sorted strings.  Null texts have no words; null item names cover words but
    are not named; rows that repeat come back as often.  Texts that repeat
    themselves cost no more than others of their length.  Empty tables give no
    rows or no hits.  Beyond ``most_words`` spans are known by 64 bits of hash.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    held = _held(items, item, item_text, most_words)
    if held is not None:
        return docs.select(key, text).mapInArrow(_scan(Index.build(held, span, gram), 1, [key]), f"`{key}` {kind}, {FOUND}")
    hit = _joined(docs, text, items, item, item_text, span, gram)
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_count(ascii_lower(body), F.lit(WORDS)).cast("long")
    slim = docs.select(F.col(key).alias("k"), F.md5(body).alias("at"), words.alias("n_words"))
    met = meet(slim, hit, "at", left=True)
    none = F.array().cast("array<struct<start:int,end:int>>")
    return met.select(F.col("k").alias(key), "n_words", F.coalesce("hit_spans", none).alias("hit_spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def keep_clean(
    docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", span: int = SPAN, gram: int = GRAM, most_words: int = MOST_WORDS
) -> DataFrame:
    """``docs`` without the documents that any item hits, columns as they are."""
    prepare(docs.sparkSession)
    at, held = docs.columns.index(text), _held(items, item, item_text, most_words)
    if held is None:
        (own,) = fresh(docs, "at")
        hit = _joined(docs, text, items, item, item_text, span, gram).select(F.col("at").alias(own))
        return docs.withColumn(own, F.md5(F.coalesce(F.col(text), F.lit("")))).join(hit, own, "left_anti").select(*docs.columns)
    index = Index.build(held, span, gram)
    known = index.vocabulary.get

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = []
            for value in batch.column(at):
                hit, _ = index.hits(np.array([known(w, 0) for w in words_of(value.as_py())], np.uint64))
                clean.append(not hit.any())
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
