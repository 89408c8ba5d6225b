"""SentencePiece BPE with seeded merge-dropout, and lossless decoding.

Encoding follows the model's agenda: of all adjacent pairs that make a piece,
the best scored (leftmost of equals) merges next.  Each merge, when it comes
up, is skipped if a keyed hash of seed, document, place and piece falls below the dropout
rate; a skipped pair stays apart unless one of its sides grows.  So one seed
gives one segmentation anywhere, and other seeds, documents or places in a text
give others.  With a rate of zero the result is the model's own.

Pieces never go over a space that follows other characters, so a text is cut
into chunks at spaces.  Different chunks are segmented once a batch without
dropout, which also gives the merges that come up.  Where the hash skips none
of them the segmentation stands; every other occurrence is segmented for
itself.  Chunks of about the same length are segmented together: the agenda of
each is a row of a matrix, and every round pops the best pair of each row.
Long chunks have a heap each.

Characters that the model lacks, the replacement mark of spaces included, fall
back to bytes; decoding inverts all of it.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from lodestar.llm.common import prepare

#: The mark that the model writes for a space.
SPACE = "▁"
RATE = 0.1
SEED = 42
#: Chunks up to these lengths are segmented together; longer ones alone.
WIDTHS = (6, 10, 16, 28, 64)
ROWS = 400
#: Occurrences of chunks taken at once.
OCCURRENCES = 100_000
NONE, FREE = 0xFFFF, np.uint32(0xFFFFFFFF)
LAST = np.int32(2**31 - 1)
CHUNK = re.compile(r" *[^ ]+| +")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Model:
    """Tables of a SentencePiece BPE model without normalization, with byte fallback and a leading space."""

    def __init__(self, path: str):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        size = own.piece_size()
        self.bytes_of: list[bytes] = [b""] * size
        byte_id, pieces, score = np.zeros(256, np.int32), {}, np.zeros(size)
        for i in range(size):
            piece = own.id_to_piece(i)
            if own.is_byte(i):
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
                byte_id[self.bytes_of[i][0]] = i
            elif not (own.is_control(i) or own.is_unknown(i) or own.is_unused(i)):
                text = piece.replace(SPACE, " ")
                self.bytes_of[i] = text.encode()
                pieces[text], score[i] = i, own.get_score(i)
        if any(" " in p.lstrip(" ") for p in pieces):
            raise ValueError("a piece goes over a space that follows other characters")
        self.byte_id, self.size = byte_id, size
        symbols = dict(pieces)
        for c in sorted({c for p in pieces for c in p} - symbols.keys()):
            symbols[c] = size + len(symbols) - len(pieces)
        if size + len(symbols) - len(pieces) >= NONE:
            raise ValueError("too many symbols")
        # Best first; equal scores share a rank, so that the leftmost wins.
        order = np.unique(-score, return_inverse=True)[1]
        self.rank = np.append(order.astype(np.int32), LAST)
        self.char = np.full(0x10000, NONE, np.uint32)
        for b in range(128):
            self.char[b] = byte_id[b]
        for c, i in symbols.items():
            if len(c) == 1 and ord(c) < 0x10000:
                self.char[ord(c)] = i
        self.pairs: dict[int, int] = {}
        for p, i in pieces.items():
            for at in range(1, len(p)):
                a, b = symbols.get(p[:at]), symbols.get(p[at:])
                if a is not None and b is not None:
                    self.pairs[a << 16 | b] = i
        self._hash()
        self.n_bytes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.first_byte = np.cumsum(self.n_bytes) - self.n_bytes

    def _hash(self) -> None:
        bits = max(12, (8 * len(self.pairs)).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, FREE, np.uint32), np.full(1 << bits, -1, np.int32)
        for key, value in self.pairs.items():
            slot = (key * 0x9E3779B1 & 0xFFFFFFFF) >> int(self.shift)
            while self.keys[slot] != FREE:
                slot = slot + 1 & self.mask
            self.keys[slot], self.values[slot] = key, value

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that a pair of symbols makes, or -1."""
        key = left << np.uint32(16) | right
        slot = key * np.uint32(0x9E3779B1) >> self.shift
        found = self.values[slot]
        at = self.keys[slot]
        todo = np.flatnonzero((at != key) & (at != FREE))
        found[at != key] = -1
        slot = slot[todo]
        while len(todo):
            slot = slot + np.uint32(1) & np.uint32(self.mask)
            at = self.keys[slot]
            hit = at == key[todo]
            found[todo[hit]] = self.values[slot[hit]]
            more = ~hit & (at != FREE)
            todo, slot = todo[more], slot[more]
        return found

    def symbols(self, points: np.ndarray) -> np.ndarray:
        return np.where(points < 0x10000, self.char[np.minimum(points, 0xFFFF)], np.uint32(NONE))


def _skips(key, place, piece, limit: np.uint64):
    """Whether the keyed hash drops the merge to ``piece`` at ``place``."""
    with np.errstate(over="ignore"):
        return mix(key + GOLDEN * (np.asarray(place, np.uint64) * np.uint64(0x10001) + np.asarray(piece, np.uint64) + np.uint64(1))) < limit


def segment_one(model: Model, symbols: list[int], key: int, limit: int, merges: list | None = None) -> list[tuple[int, int]]:
    """(place, symbol) of one chunk's segments, by a heap; adds (place, piece) of the merges done to ``merges``."""
    n = len(symbols)
    symbol, after, before = list(symbols), [*range(1, n), -1], [-1, *range(n - 1)]
    agenda: list[tuple[int, int, int, int, int]] = []

    def push(i: int) -> None:
        j = after[i]
        made = model.pairs.get(symbol[i] << 16 | symbol[j], -1) if j >= 0 else -1
        if made >= 0:
            heapq.heappush(agenda, (int(model.rank[made]), i, symbol[i], symbol[j], made))

    for i in range(n - 1):
        push(i)
    while agenda:
        _, i, a, b, made = heapq.heappop(agenda)
        j = after[i]
        if symbol[i] != a or j < 0 or symbol[j] != b or (limit and bool(_skips(np.uint64(key), i, made, np.uint64(limit)))):
            continue
        if merges is not None:
            merges.append((i, made))
        symbol[i], symbol[j], after[i] = made, -1, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [(i, s) for i, s in enumerate(symbol) if s >= 0]


def segment_rows(model: Model, symbol: np.ndarray, keys: np.ndarray, limit: int, merges: list | None = None) -> np.ndarray:
    """Segments of many chunks at once: ``symbol`` (rows x width, NONE-padded by -1) with -1 where merged away.

    Adds (rows, places, pieces) of the merges done to ``merges``.
    """
    rows, width = symbol.shape
    out = symbol.copy()
    if width < 2 or not rows:
        return out
    sym = np.where(symbol < 0, NONE, symbol).astype(np.uint32)
    after = np.tile(np.arange(1, width + 1, dtype=np.int32), (rows, 1))
    before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (rows, 1))
    # One column more: what stands after the end never makes a pair.
    sym = np.concatenate([sym, np.full((rows, 1), NONE, np.uint32)], axis=1)
    made = np.full((rows, width + 1), -1, np.int32)
    made[:, : width - 1] = model.lookup(sym[:, : width - 1].ravel(), sym[:, 1:width].ravel()).reshape(rows, -1)
    rank = model.rank[made]
    gone = np.zeros((rows, width + 1), bool)
    at, bound = np.arange(rows), np.uint64(limit)
    while True:
        best = rank.argmin(axis=1)
        row = np.arange(len(at))
        live = rank[row, best] < LAST
        n_live = int(live.sum())
        if n_live < 0.7 * len(at):
            ended = ~live
            out[at[ended]] = np.where(gone[ended, :width] | (out[at[ended]] < 0), -1, sym[ended, :width].astype(np.int64))
            if not n_live:
                return out
            at, best, keys = at[live], best[live], keys[live]
            sym, after, before, made, rank, gone = sym[live], after[live], before[live], made[live], rank[live], gone[live]
            row = np.arange(len(at))
        elif n_live < len(at):
            row, best = row[live], best[live]
        piece = made[row, best]
        if limit:
            skip = _skips(keys[row], best, piece, bound)
            rank[row[skip], best[skip]] = LAST
            row, best, piece = row[~skip], best[~skip], piece[~skip]
        if not len(row):
            continue
        if merges is not None:
            merges.append((at[row], best, piece))
        second = after[row, best]
        sym[row, best] = piece
        gone[row, second] = True
        rank[row, second] = LAST
        third = after[row, second]
        after[row, best] = third
        inside = third < width
        before[row[inside], third[inside]] = best[inside]
        for left, right, who in ((best, third, row), (before[row, best], best, row)):
            ok = left >= 0
            r, a, b = who[ok], left[ok], right[ok]
            new = model.lookup(sym[r, a], sym[r, b])
            made[r, a] = new
            rank[r, a] = model.rank[new]


class Encoder:
    def __init__(self, path: str, rate: float = RATE, seed: int = SEED):
        self.model = Model(path)
        self.limit = min(int(rate * 2.0**64), 2**64 - 1)
        self.seed = np.uint64(seed & 2**64 - 1)

    def _ids(self, place_symbol: list[tuple[int, int]], chunk: str) -> list[int]:
        out = []
        for place, s in place_symbol:
            if s < self.model.size:
                out.append(s)
            else:
                out += [int(self.model.byte_id[b]) for b in chunk[place].encode()]
        return out

    def _segment(self, chunks: list[str], of: np.ndarray, keys: np.ndarray, limit: int, merges: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, how many each has); row i is chunk ``of[i]`` with ``keys[i]``.

        Adds (rows, places, pieces) of the merges done to ``merges``.
        """
        lengths = np.array([len(c) for c in chunks], np.int64)
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.model.symbols(points).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        counts, parts = np.zeros(len(of), np.int64), []
        size = lengths[of]
        low = 0
        for width in (*WIDTHS, None):
            rows = np.flatnonzero((size > low) & ((size <= width) if width else True))
            low = width
            if not len(rows):
                continue
            if width is None:
                for r in rows.tolist():
                    c = int(of[r])
                    own = symbols[starts[c] : starts[c] + lengths[c]].tolist()
                    done: list | None = None if merges is None else []
                    ids = np.array(self._ids(segment_one(self.model, own, int(keys[r]), limit, done), chunks[c]), np.int32)
                    if done:
                        places, pieces = np.array(done, np.int64).T
                        merges.append((np.full(len(done), r), places, pieces))
                    counts[r] = len(ids)
                    parts.append((np.array([r]), ids))
                continue
            place = np.arange(width)
            inside = place < size[rows][:, None]
            matrix = np.where(inside, symbols[np.minimum(starts[of[rows]][:, None] + place, len(symbols) - 1)], -1)
            found = None if merges is None else []
            done = segment_rows(self.model, matrix, keys[rows], limit, found)
            if found:
                merges += [(rows[r], p, x) for r, p, x in found]
            plain = (done < self.model.size).all(axis=1)
            kept = done[plain]
            counts[rows[plain]] = (kept >= 0).sum(axis=1)
            parts.append((rows[plain], kept[kept >= 0].astype(np.int32)))
            for i in np.flatnonzero(~plain).tolist():
                found = [(p, int(s)) for p, s in enumerate(done[i]) if s >= 0]
                ids = np.array(self._ids(found, chunks[of[rows[i]]]), np.int32)
                counts[rows[i]] = len(ids)
                parts.append((rows[i : i + 1], ids))
        ids = np.zeros(int(counts.sum()), np.int32)
        first = np.cumsum(counts) - counts
        for rows, own in parts:
            ids[ranges(first[rows], counts[rows])] = own
        return ids, counts

    def _dropped(self, chunk_at: np.ndarray, keys: np.ndarray, merges: list, chunks: int) -> np.ndarray:
        """Which occurrences of chunks have a merge that the hash skips, by the merges of their plain segmentation."""
        row, place, piece = (np.concatenate(x) for x in zip(*merges)) if merges else (np.zeros(0, np.int64),) * 3
        order = np.argsort(row, kind="stable")
        place, piece = place[order], piece[order]
        n = np.bincount(row, minlength=chunks)
        first, out = np.cumsum(n) - n, np.zeros(len(chunk_at), bool)
        for a in range(0, len(chunk_at), OCCURRENCES):
            own = chunk_at[a : a + OCCURRENCES]
            at = ranges(first[own], n[own])
            occurrence = np.repeat(np.arange(a, a + len(own)), n[own])
            out[occurrence[_skips(keys[occurrence], place[at], piece[at], np.uint64(self.limit))]] = True
        return out

    def encode(self, texts: list[str | None], names: list) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has); ``names`` tell documents apart in the keyed hash."""
        index: dict[str, int] = {}
        number, chunk_at, n_chunks = index.setdefault, [], []
        for t in texts:
            found = CHUNK.findall(" " + t) if t else []
            chunk_at += [number(c, len(index)) for c in found]
            n_chunks.append(len(found))
        if not chunk_at:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        chunk_at, n_chunks, chunks = np.array(chunk_at, np.int64), np.array(n_chunks, np.int64), list(index)
        merges: list = []
        everything = np.arange(len(chunks))
        ids, counts = self._segment(chunks, everything, np.zeros(len(chunks), np.uint64), 0, merges)
        which = chunk_at  # of each occurrence, which segmentation it has
        if self.limit:
            name = np.array([xxhash.xxh64_intdigest(str(x).encode()) for x in names], np.uint64)
            with np.errstate(over="ignore"):
                place = (np.arange(len(chunk_at)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)).astype(np.uint64)
                keys = mix(np.repeat(mix(name + self.seed * GOLDEN), n_chunks) + GOLDEN * place)
            dropped = np.flatnonzero(self._dropped(chunk_at, keys, merges, len(chunks)))
            which, parts, sizes = chunk_at.copy(), [ids], [counts]
            which[dropped] = len(chunks) + np.arange(len(dropped))
            for a in range(0, len(dropped), OCCURRENCES):
                some = dropped[a : a + OCCURRENCES]
                more = self._segment(chunks, chunk_at[some], keys[some], self.limit)
                parts.append(more[0])
                sizes.append(more[1])
            ids, counts = np.concatenate(parts), np.concatenate(sizes)
        first, each = np.cumsum(counts) - counts, counts[which]
        ends = np.r_[0, np.cumsum(each)][np.r_[0, np.cumsum(n_chunks)]]
        return ids[ranges(first[which], each)], np.diff(ends)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 texts: pieces' bytes in a row, less the leading space."""
        m = self.model
        held = m.all_bytes[ranges(m.first_byte[ids], m.n_bytes[ids])].tobytes()
        ends = np.r_[0, np.cumsum(m.n_bytes[ids])][np.r_[0, np.cumsum(counts)]].tolist()
        return [held[a + 1 : b] if b > a else b"" for a, b in zip(ends, ends[1:])]


def ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for counts[0] steps, then on from first[1], and so on."""
    total = np.cumsum(counts)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(first - (total - counts), counts)


@lru_cache(maxsize=4)
def encoder(path: str, rate: float, seed: int) -> Encoder:
    """One encoder for each Python worker and setting."""
    return Encoder(path, rate, seed)


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", rate: float = RATE, seed: int = SEED) -> DataFrame:
    """``key, ids (array<int>), n_chars, lossless``: one row per row, decoded again in place.

    ``lossless`` is true if the decoded ids are the text.  Null and empty texts
    have no ids.  Rows with equal key and text get equal ids, null keys are a
    key like any other; an empty table gives an empty result; other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, rate, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(1).to_pylist()
                ids, counts = own.encode(texts, part.column(0).to_pylist())
                same = [(t or "").encode() == b for t, b in zip(texts, own.decode(ids, counts))]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array([len(t or "") for t in texts], pa.int64()), pa.array(same, pa.bool_())], [key, "ids", "n_chars", "lossless"])

    prepare(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, n_chars bigint, lossless boolean")


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with ``text`` decoded from ``ids``; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, 0.0, 0)
        for batch in batches:
            lists = batch.column(at).to_pylist()
            out = own.decode(np.array([i for x in lists for i in x or ()], np.int64), np.array([len(x or ()) for x in lists], np.int64))
            texts = [None if x is None else o.decode() for x, o in zip(lists, out)]
            yield pa.RecordBatch.from_arrays([*[c for n, c in zip(batch.schema.names, batch.columns) if n != text], pa.array(texts, pa.string())], [*[n for n in batch.schema.names if n != text], text])

    prepare(df.sparkSession)
    kept = df.drop(text)
    at = kept.columns.index(ids)
    return kept.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", `{text}` string")
