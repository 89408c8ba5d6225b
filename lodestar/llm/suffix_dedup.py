"""Removal of byte strings that occur more than once, exact over the whole corpus.

Every byte that some ``length``-byte string covers which also starts anywhere
else (in another document or the same one) is removed.

*Dealing out.*  Byte grams are winnowed: of each run of ``window`` grams the
smallest hash is an anchor.  The window is a third of the string's grams, so
any string has an anchor in its middle third that depends on the string alone.
Two equal strings thus share an anchor and the ``core`` bytes around it, and
only anchors whose core occurs more than once can matter: one pass counts
cores, a bit map of fixed size holds the repeated ones, a second pass keeps
their anchors.  Anchors with equal neighbourhoods (all that strings over the
core can hold, told by 128 bits of hashes) become one row that weighs as many.

*Interval expansion.*  The suffixes that start at the cores are sorted, and the
bytes before them form the Burrows-Wheeler column of the collection.  Backward
extension goes breadth-first: in each round every interval of rows splits by
the preceding byte, so after ``l`` rounds an interval is a string of ``l``
bytes before the core.  Rows of an interval that also agree on ``span - l``
bytes after it, or one row that weighs more than one, share a string of the
full length.  The agreement after the core is the common prefix, which rounds
ask for by falling values while the extension grows; an interval of weight one
is abandoned, and rounds stop at the minimum length.

*Frequent cores.*  A core with more than ``group`` different neighbourhoods is
split by what is next to it: strings with few bytes before the core have many
after it, and the other way round, so each half of the possible ``l`` shares
more bytes than the core and its rows meet by those; again and again while
groups are large, down to single strings, whose rows need not meet at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import durable, meet, partitions, prepare, small

LENGTH = 200
GRAM = 8
#: Bytes of text that are winnowed at once.
SLICE = 2_000_000
#: Bits of the map of repeated cores, at least and at most: 32 MB to the executors, whatever the corpus.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Bits for each repeated core, up to the bound; a fuller map lets more anchors through, none are lost.
BITS = 24
#: Rows of one core that meet in a task; beyond, they are split by the bytes next to it.
GROUP = 4096

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Windows looked at at once: places in them are kept in the lower bits of hashes.
WINDOWS = 1 << 22
PLACE = (1 << 26) - 1


class Shape:
    """Distances that follow from the length of the strings."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        grams = length - gram + 1
        self.length, self.gram, self.window = length, gram, (grams + 2) // 3
        if self.window < 2:
            raise ValueError("length is too short")
        self.left = self.window - 1  # core: bytes before and from the anchor
        self.right = length - (grams - self.window)
        self.span = length - self.left - self.right  # beyond the core, on both sides together


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """The ``gram`` bytes from each place as one number."""
    n = len(data) - gram + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(gram):
        out = out << np.uint64(8) | data[i : i + n]
    return out


def anchors(raw: np.ndarray, window: int, most: int = WINDOWS) -> np.ndarray:
    """Places of the smallest hash in each window, the last of equals; ``most`` windows at once."""
    n = len(raw) - window + 1
    found = [_anchors(raw[a : min(n, a + most) + window - 1], window) + a for a in range(0, n, most)]
    place = np.concatenate(found) if found else np.zeros(0, np.int64)
    return place[np.r_[True, place[1:] != place[:-1]]] if len(place) else place


def _anchors(raw: np.ndarray, window: int) -> np.ndarray:
    n = len(raw)
    # Hash in the upper bits, place from the end in the lower: minima carry their place.
    least = _mix(raw * GOLDEN) & ~np.uint64(PLACE) | (np.uint64(PLACE) - np.arange(n, dtype=np.uint64))
    step = 1
    while 2 * step <= window:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if window > step:
        least = np.minimum(least[: step - window], least[window - step :])
    return PLACE - (least & np.uint64(PLACE)).astype(np.int64)


def _fold(raw: np.ndarray, at: np.ndarray, size: int, gram: int, seed: int) -> np.ndarray:
    """Hash of ``size`` bytes from each place, ``gram`` at a time, the last ones overlapping."""
    out = np.full(len(at), seed, np.uint64)
    for i in [*range(0, size - gram + 1, gram), *([size - gram] if size % gram else [])]:
        out = _mix((out ^ raw[at + i]) * GOLDEN)
    return out


class Anchored:
    """Anchors of documents whose bytes lie one after the other, or of a piece of a long one.

    ``piece`` is (bytes before the piece, bytes of the document, first and last
    of the piece's own windows, whether the first is another piece's).
    """

    def __init__(self, data: np.ndarray, lengths: np.ndarray, shape: Shape, piece: tuple | None = None):
        self.data, self.shape = data, shape
        raw = _grams(data, shape.gram)
        if piece is None:
            ends = np.cumsum(lengths)
            at = anchors(raw, shape.window)
            doc = np.searchsorted(ends, at, side="right")
            self.place, size = at - (ends - lengths)[doc], lengths[doc]
        else:
            before, total, low, high, again = piece
            at = anchors(raw[low : high + shape.window - 1], shape.window)[int(again) :] + low
            doc = np.zeros(len(at), np.int64)
            self.place, size = at + before, np.full(len(at), total)
        left, right = self.place - shape.left, size - self.place - shape.right
        ok = (left >= 0) & (right >= 0)
        left, right = np.minimum(left, shape.span), np.minimum(right, shape.span)
        ok &= left + right >= shape.span  # else no string fits around the core
        self.at, self.doc, self.place, self.left, self.right, self.size = at[ok], doc[ok], self.place[ok], left[ok], right[ok], size[ok]
        self.raw = raw
        self.core = _fold(raw, self.at - shape.left, shape.left + shape.right, shape.gram, 1)

    def keep(self, rows: np.ndarray) -> None:
        for name in ("at", "doc", "place", "left", "right", "size", "core"):
            setattr(self, name, getattr(self, name)[rows])

    def around(self) -> np.ndarray:
        """Hash of core and all that strings over it can hold."""
        s, out = self.shape, np.zeros(len(self.at), np.uint64)
        full = (self.left == s.span) & (self.right == s.span)
        out[full] = _fold(self.raw, self.at[full] - s.left - s.span, s.left + s.right + 2 * s.span, s.gram, 2)
        for i in np.flatnonzero(~full).tolist():
            a, b = self.at[i] - s.left - self.left[i], self.at[i] + s.right + self.right[i]
            out[i] = xxhash.xxh64_intdigest(self.data[a:b].tobytes(), int(self.left[i]) * 1000 + int(self.right[i]) + 3)
        return out


def _anchored(batch: pa.RecordBatch, column: int, shape: Shape, most: int = SLICE) -> Iterator[tuple[int, Anchored]]:
    """(first row, anchors) of runs of rows of bounded bytes, and of the pieces of longer rows; nulls are empty."""
    texts = batch.column(column).fill_null("").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + most, side="right")) - 1)
        body = held[ends[row] : ends[last]]
        if len(body) <= most:
            yield row, Anchored(body, np.diff(ends[row : last + 1]), shape)
        else:
            windows, beside = len(body) - shape.gram - shape.window + 2, shape.span + max(shape.left, shape.right) + shape.gram
            for low in range(0, windows, most):
                high, first = min(windows, low + most), max(0, low - 1)
                a, b = max(0, first - beside), min(len(body), high + shape.window + beside)
                yield row, Anchored(body[a:b], np.array([b - a]), shape, (a, len(body), first - a, high - a, low > 0))
        row = last


def _core_pass(shape: Shape):
    """Cores and how often each slice has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, found in _anchored(batch, 0, shape):
                core, n = np.unique(found.core, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(n.astype(np.int32))], ["core", "n"])

    return run


def _bit_map(values: DataFrame) -> np.ndarray:
    """A bit for each hash of a column of longs, by its low bits.

    As large as their number asks for, up to ``MOST_BITS``; comes to the driver
    in pieces of 8 KB.  A fuller map lets more rows through, none are lost.
    """
    values, piece = values.toDF("core"), 1 << 16
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS * max(values.count(), 1)).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.asarray(batch.column(0)).view(np.uint64) & np.uint64(bits - 1)
            for number in np.unique(slot // np.uint64(piece)).tolist():
                own = np.zeros(piece, bool)
                own[(slot[slot // np.uint64(piece) == number] % np.uint64(piece)).astype(np.int64)] = True
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], ["piece", "held"])

    slots = values.repartition(partitions(values.sparkSession), F.expr(f"(core & {bits - 1}L) div {piece}")).sortWithinPartitions(F.expr(f"core & {bits - 1}L"))
    out = np.zeros(bits // 8, np.uint8)
    for row in slots.mapInArrow(run, "piece bigint, held binary").collect():
        at = row.piece * piece // 8
        out[at : at + piece // 8] |= np.frombuffer(row.held, np.uint8)
    return out


def _in_map(held: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = (values.view(np.uint64) & np.uint64(8 * len(held) - 1)).astype(np.int64)
    return (held[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _filtered(docs: DataFrame, held: np.ndarray, once: bool = False) -> DataFrame:
    """Documents (``key, hash, text``) whose hash is in the map: before a shuffle moves texts.

    With ``once``, of equal rows a task passes on one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            batch = batch.filter(pa.array(_in_map(held, np.asarray(batch.column(1)))))
            if once:
                new = []
                for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    new.append(row not in seen)
                    seen.add(row)
                batch = batch.filter(pa.array(new, pa.bool_()))
            yield batch

    return docs.select("key", "hash", "text").mapInArrow(run, docs.select("key", "hash", "text").schema)


def _anchor_pass(shape: Shape, held: np.ndarray):
    """Anchors whose cores may be repeated: ``key, hash, place, size, core, around``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, found in _anchored(batch, 2, shape):
                found.keep(np.flatnonzero(_in_map(held, found.core)))
                rows = pa.array(row + found.doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                        pa.array(found.place.astype(np.int32)),
                        pa.array(found.size.astype(np.int32)),
                        pa.array(found.core.view(np.int64)),
                        pa.array(found.around().view(np.int64)),
                    ],
                    ["key", "hash", "place", "size", "core", "around"],
                )

    return run


#: A neighbourhood: how many anchors have it, and the bytes on both sides of its core (reversed before it), or just how many there are.
ROW = "core bigint, around bigint, n bigint, n_left int, n_right int, before binary, behind binary"


def _neighbourhoods(shape: Shape):
    """From a text and its places: neighbourhoods with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for text, at in zip(*(c.to_pylist() for c in batch.columns)):
                body = text.encode()
                for x in at:
                    a, b = x["place"] - shape.left, x["place"] + shape.right
                    before, behind = body[max(0, a - shape.span) : a][::-1], body[b : b + shape.span]
                    for column, value in zip(columns, (x["core"], x["around"], x["n"], len(before), len(behind), before, behind)):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["core", "around", "n", "n_left", "n_right", "before", "behind"])

    return run


def _split(span: int):
    """Rows of a group (all strings with ``low`` to ``high`` bytes before the core) to those of its two halves.

    Rows of a half share what all its strings hold: ``low`` bytes before and
    ``span - high`` bytes behind the core; ``shared`` is their hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lows, highs, shared = [], [], [], []
            for i, (before, behind, low, high) in enumerate(zip(*(batch.column(c).to_pylist() for c in (5, 6, 7, 8)))):
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    if len(before) >= a and len(behind) >= span - b:
                        rows.append(i)
                        lows.append(a)
                        highs.append(b)
                        shared.append(xxhash.xxh64_intdigest(before[:a] + behind[: span - b], 1000 * a + b) - 2**63)
            same = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*same.columns[:7], pa.array(lows, pa.int32()), pa.array(highs, pa.int32()), pa.array(shared, pa.int64())], [*same.schema.names[:7], "low", "high", "shared"])

    return run


def _matrix(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(v) for v in values], np.int64)
    out = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(-1, width)
    return out, lengths


def expand(groups: np.ndarray, before: list[bytes], behind: list[bytes], span: int, weight=None, sizes=None, limits=None) -> tuple[np.ndarray, np.ndarray]:
    """For each row the fewest and the most bytes before its core of the repeated strings over it.

    ``groups`` are the cores' numbers, ``before`` reversed.  ``weight`` says how
    often each row occurs (once by default), ``sizes`` how many bytes there are
    on both sides (the lengths of what is given by default; a row that is its
    group alone needs no more), ``limits`` the least and most bytes before the
    core that count.  A row over which no string is repeated gets (span + 1, -1).
    """
    n = len(groups)
    least, most = np.full(n, span + 1), np.full(n, -1)
    if not n:
        return least, most
    weight = np.ones(n, np.int64) if weight is None else weight
    low, high = (np.zeros(n, np.int64), np.full(n, span)) if limits is None else limits
    left, n_left = _matrix(before, span)
    right, n_right = _matrix(behind, span)
    if sizes is not None:
        n_left, n_right = sizes
    # Suffixes in order, and the common prefix of neighbours behind the core.
    mark = np.zeros((n, 8 + span), np.uint8)
    mark[:, :8] = groups.astype(">u8").view(np.uint8).reshape(n, 8)
    mark[:, 8:] = right
    order = np.argsort(mark.view(f"V{8 + span}").ravel(), kind="stable")
    groups, left, n_left, right, n_right = groups[order], left[order], n_left[order], right[order], n_right[order]
    weight, low, high = weight[order], low[order], high[order]
    differ = right[1:] != right[:-1]
    prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), span)
    prefix = np.minimum(prefix, np.minimum(n_right[1:], n_right[:-1]))
    prefix = np.r_[-1, np.where(groups[1:] == groups[:-1], prefix, -1)]
    # Rows of the current intervals: their places in suffix order, and the interval of each.
    rows = np.arange(n)
    interval = np.cumsum(prefix < 0)
    for extended in range(span + 1):
        # Neighbours in an interval agree on span - extended bytes behind the core iff no prefix between is shorter.
        block = np.cumsum(prefix < span - extended)[rows]
        enough = n_right[rows] >= span - extended
        joined = (interval[1:] == interval[:-1]) & (block[1:] == block[:-1])
        shared = (np.r_[joined, False] | np.r_[False, joined] | (weight[rows] > 1)) & enough & (low[rows] <= extended) & (extended <= high[rows])
        hit = order[rows[shared]]
        least[hit] = np.minimum(least[hit], extended)
        most[hit] = extended
        if extended == span:
            break
        # Backward extension: split by the byte before, in the order that the suffixes have.
        longer = n_left[rows] > extended
        rows, interval = rows[longer], interval[longer]
        split = interval * 256 + left[rows, extended]
        by = np.argsort(split, kind="stable")
        rows, split = rows[by], split[by]
        change = np.r_[True, split[1:] != split[:-1]] if len(split) else np.zeros(0, bool)
        number = np.cumsum(change)
        several = np.bincount(number, weights=weight[rows])[number] > 1 if len(number) else np.zeros(0, bool)
        rows, interval = rows[several], number[several]
        if not len(rows):
            break
    return least, most


def _expand_pass(shape: Shape):
    """Rows sorted by group to what repeated strings cover: ``core, around, least, most`` bytes before the core."""

    def covered(rest: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(rest).combine_chunks()
        of = lambda name: rows.column(name).to_numpy()
        core, low, shared = of("core"), of("low"), of("shared")
        groups = np.cumsum(np.r_[0, (core[1:] != core[:-1]) | (low[1:] != low[:-1]) | (shared[1:] != shared[:-1])])
        before, behind = ([x or b"" for x in rows.column(c).to_pylist()] for c in ("before", "behind"))
        sizes = of("n_left").astype(np.int64), of("n_right").astype(np.int64)
        least, most = expand(groups, before, behind, shape.span, of("n"), sizes, (low, of("high")))
        ok = np.flatnonzero(most >= 0)
        return pa.RecordBatch.from_arrays([pa.array(core[ok]), pa.array(of("around")[ok]), pa.array(least[ok].astype(np.int32)), pa.array(most[ok].astype(np.int32))], ["core", "around", "least", "most"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        names = ("core", "low", "shared")
        for batch in batches:
            if not batch.num_rows:
                continue
            group = [batch.column(c).to_numpy() for c in names]
            other = np.flatnonzero(np.any([g != g[-1] for g in group], axis=0))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut or (rest and any(rest[-1].column(c)[-1].as_py() != g[-1] for c, g in zip(names, group))):
                if cut:
                    rest.append(batch.slice(0, cut))
                yield covered(rest)
                rest = []
            rest.append(batch.slice(cut))
        if rest:
            yield covered(rest)

    return run


def repeated_stretches(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``key, hash, start, stop``: stretches of bytes, not merged, that repeated strings cover.

    ``hash`` is ``xxhash64`` of the text (null as empty): it tells rows of one
    key apart.
    """
    spark, shape = df.sparkSession, Shape(length)
    prepare(spark)
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cores = docs.select("text").mapInArrow(_core_pass(shape), "core bigint, n int").groupBy("core").agg(F.sum("n").alias("n")).where("n > 1")
    repeated = durable(cores.select("core"), "cores")
    found = durable(docs.mapInArrow(_anchor_pass(shape, _bit_map(repeated)), f"key {kind}, hash bigint, place int, size int, core bigint, around bigint"), "anchors")

    each = found.groupBy("core", "around").agg(F.count("*").alias("n"), F.min(F.struct("key", "hash", "place", "size")).alias("one"))
    each = durable(each, "neighbourhoods")
    several = each.groupBy("core").agg(F.count("*").alias("several")).where("several > 1")
    marked = each.join(several, "core", "left")
    # Of cores with several neighbourhoods the bytes are asked for; a core's only one needs its lengths.
    asked = marked.where("several > 1").groupBy(F.col("one.key").alias("asked_key"), F.col("one.hash").alias("asked_hash"))
    asked = durable(asked.agg(F.collect_list(F.struct(F.col("one.place").alias("place"), "core", "around", "n")).alias("at")), "asked")
    likely = _filtered(docs, _bit_map(asked.select("asked_hash")), once=True)
    texts = likely.join(asked, likely.key.eqNullSafe(asked.asked_key) & (likely.hash == asked.asked_hash)).select("text", "at")
    beside = lambda n: F.least(n, F.lit(shape.span)).cast("int")
    nothing = F.lit(None).cast("binary")
    alone = marked.where("several is null and n > 1").select(
        "core", "around", "n", beside(F.col("one.place") - shape.left).alias("n_left"), beside(F.col("one.size") - F.col("one.place") - shape.right).alias("n_right"), nothing.alias("before"), nothing.alias("behind")
    )
    rows = texts.mapInArrow(_neighbourhoods(shape), ROW)
    frequent = durable(several.where(F.col("several") > group).select("core"), "frequent")
    parts, hot = [], None
    if frequent.limit(1).count():
        rows, few = durable(rows, "rows"), small(frequent)
        hot = rows.join(few, "core", "left_semi").select(*rows.columns, F.lit(0).alias("low"), F.lit(shape.span).alias("high"))
        rows = rows.join(few, "core", "left_anti").select(*rows.columns)
    state = [F.lit(0).alias("low"), F.lit(shape.span).alias("high"), F.lit(0).cast("long").alias("shared")]
    ready = rows.unionByName(alone).select("*", *state)

    def expanded(rows: DataFrame) -> DataFrame:
        dealt = rows.repartition(partitions(spark), "core", "low", "shared").sortWithinPartitions("core", "low", "shared")
        return dealt.mapInArrow(_expand_pass(shape), "core bigint, around bigint, least int, most int")

    parts.append(expanded(ready))
    while hot is not None:
        halves = durable(hot.mapInArrow(_split(shape.span), f"{ROW}, low int, high int, shared bigint"), "halves")
        names = ["core", "low", "shared"]
        large = durable(halves.groupBy(*names).agg(F.count("*").alias("several")).where(F.col("several") > group).select(*names), "large")
        if large.limit(1).count() == 0:
            parts.append(expanded(halves))
            break
        few = small(large)
        parts.append(expanded(halves.join(few, names, "left_anti").select(*halves.columns)))
        hot = halves.join(few, names, "left_semi").select(*halves.columns)
        # A group of one string is its repetition: its rows need not meet.
        parts.append(hot.where("low = high").select("core", "around", F.col("low").alias("least"), F.col("low").alias("most")))
        hot = hot.where("low < high")
        if hot.limit(1).count() == 0:
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # All strings over one core overlap, so they cover one stretch; every anchor of a neighbourhood has it.
    return meet(found, durable(out, "stretches"), ["core", "around"]).select(
        "key", "hash", (F.col("place") - shape.left - F.col("most")).cast("int").alias("start"), (F.col("place") - shape.left - F.col("least") + length).cast("int").alias("stop")
    )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of each document to maximal runs."""
    for batch in batches:
        out = []
        for at in batch.column(2).to_pylist():
            runs: list[list[int]] = []
            for start, stop in sorted((x["start"], x["stop"]) for x in at):
                if runs and start <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], stop)
                else:
                    runs.append([start, stop])
            out.append([{"start": a, "stop": b} for a, b in runs])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, _RUNS)], ["of_key", "of_hash", "spans"])


_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _cut(name: str, held: np.ndarray | None = None):
    """Documents (``key, hash, text, spans``) to what remains of them.

    With a map, documents without runs: those whose hash is not in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if held is not None:
                batch = batch.filter(pa.array(~_in_map(held, np.asarray(batch.column(1)))))
            size, removed, spans, kept, texts = [], [], [], [], []
            found = batch.column(3).to_pylist() if held is None else [None] * batch.num_rows
            for text, runs in zip(batch.column(2).to_pylist(), found):
                body, runs = text.encode(), runs or []
                edges = [0, *[e for m in runs for e in (m["start"], m["stop"])], len(body)]
                rest = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2])) if runs else body
                size.append(len(body))
                removed.append(len(body) - len(rest))
                spans.append(runs)
                kept.append(hashlib.sha256(rest).hexdigest())
                texts.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, _RUNS), pa.array(kept, pa.string()), pa.array(texts, pa.binary())], [name, "n_bytes", "n_removed", "spans", "kept_sha256", "kept"]
            )

    return run


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``key, n_bytes, n_removed, spans, kept_sha256, kept`` for every row of ``df``.

    Strings are judged on the input; overlapping strings count; matches never
    go over documents.  ``spans`` are the maximal removed runs in bytes,
    ``kept`` the remaining bytes.  Null texts are empty; rows that repeat are
    documents of their own, so they remove each other; null keys are a key like
    any other; an empty table gives an empty result; other columns are ignored.
    """
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).select("key", F.xxhash64("text").alias("hash"), "text")
    found = repeated_stretches(df, key, text, length, group)
    # At most one stretch for each anchor of a document.
    lists = found.groupBy("key", "hash").agg(F.collect_set(F.struct("start", "stop")).alias("at"))
    spans = durable(lists.mapInArrow(_merged, f"of_key {kind}, of_hash bigint, spans array<struct<start:int,stop:int>>"), "spans")
    # Only texts that lose something move to meet their runs.
    held = _bit_map(spans.select("of_hash"))
    losing = _filtered(docs, held)
    met = losing.join(spans, losing.key.eqNullSafe(spans.of_key) & (losing.hash == spans.of_hash), "left").select("key", "hash", "text", "spans")
    schema = f"`{key}` {kind}, n_bytes bigint, n_removed bigint, spans array<struct<start:int,stop:int>>, kept_sha256 string, kept binary"
    return met.mapInArrow(_cut(key), schema).unionByName(docs.mapInArrow(_cut(key, held), schema))
