"""Block kernel of the fused search: distances by matrix product, running top-k.

A task holds the k nearest of its own points for every query and never the
distance matrix: queries go by tiles, points by blocks, and a tile's distances
to a block take ``TILE_BYTES`` whatever the number of queries.  Candidates come from ``|p|^2 - 2 p.q``; those that rounding
cannot rule out are measured again, term by term and left to right, so the
distances equal those of the Column metrics bit for bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Points in a block, and bytes of the distances of a block to the queries of a tile.
BLOCK, TILE_BYTES = 4096, 16 * 1024 * 1024
#: Bytes of candidates' vectors that are measured at once, about.
EXACT_BYTES = 8 * 1024 * 1024


def quantise(x: np.ndarray, precision: str) -> np.ndarray:
    """Values as the type would hold them, in double."""
    if precision == "double":
        return x
    if precision == "float":
        return x.astype(np.float32).astype(np.float64)
    if precision == "half":
        return x.astype(np.float16).astype(np.float64)
    if precision == "bfloat16":
        bits = x.astype(np.float32).view(np.uint32)
        rounded = (bits + np.uint32(0x7FFF) + (bits >> np.uint32(16) & np.uint32(1))) & np.uint32(0xFFFF0000)
        return np.where(np.isnan(x), np.nan, rounded.view(np.float32)).astype(np.float64)
    raise ValueError(f"Unsupported precision {precision!r}")


def _sum(terms: np.ndarray) -> np.ndarray:
    """Left-to-right sums of rows."""
    return np.add.accumulate(terms, axis=1)[:, -1] if terms.shape[1] else np.zeros(len(terms))


def exact(points: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows that belong together (or of all rows to one query)."""
    if metric == "l2":
        return _sum((points - queries) ** 2)
    return _sum(points * points) - 2.0 * _sum(points * queries)


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


class Held:
    """The k nearest so far of each query, in order; places without a neighbour come last."""

    def __init__(self, queries: int, k: int):
        self.k, self.n = k, np.zeros(queries, np.int64)
        self.dist, self.names = np.full((queries, k), np.inf), np.zeros((queries, k), np.int64)

    def limit(self, tile: slice) -> np.ndarray:
        """The distance that a neighbour may have at most, of each query."""
        return np.where(self.n[tile] == self.k, self.dist[tile, -1], np.inf)

    def add(self, low: int, high: int, query: np.ndarray, dist: np.ndarray, names: np.ndarray) -> None:
        """Candidates of the queries from ``low`` to ``high``; ties go by name, not-a-number comes last."""
        full = np.arange(self.k) < self.n[low:high, None]
        query = np.r_[np.repeat(np.arange(low, high), self.n[low:high]), query]
        dist, names = np.r_[self.dist[low:high][full], dist], np.r_[self.names[low:high][full], names]
        order = np.lexsort((names, dist, query))
        query, dist, names = query[order], dist[order], names[order]
        count = np.bincount(query - low, minlength=high - low)
        place = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
        first = place < self.k
        self.dist[query[first], place[first]], self.names[query[first], place[first]] = dist[first], names[first]
        self.n[low:high] = np.minimum(count, self.k)


    def batches(self, query_ids: np.ndarray, rows: int) -> Iterator[pa.RecordBatch]:
        """``query_id, point_id, dist``, the neighbours of so many queries at a time."""
        for low in range(0, len(query_ids), rows):
            part = slice(low, low + rows)
            full = np.arange(self.k) < self.n[part, None]
            if full.any():
                columns = [np.repeat(query_ids[part], self.n[part]), self.names[part][full], self.dist[part][full]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_id", "point_id", "dist"])


def nearest(query_ids: np.ndarray, queries: np.ndarray, k: int, metric: str, precision: str, tile_bytes: int = TILE_BYTES):
    """A ``mapInArrow`` function: points to their k nearest for each query."""
    queries = quantise(queries, precision)
    norms, twice = np.einsum("ij,ij->i", queries, queries), 2.0 * queries
    # Bound of the rounding error of a matrix product against a sum in order.
    slack = 1e-13 * max(1, queries.shape[1])
    tile_rows = max(1, tile_bytes // (8 * BLOCK))
    exact_rows = max(BLOCK, EXACT_BYTES // (8 * max(1, queries.shape[1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(len(query_ids), k)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids, points = np.asarray(part.column(0)), quantise(_matrix(part.column(1)), precision)
                if not len(ids):
                    continue
                own = np.einsum("ij,ij->i", points, points)
                largest = np.nanmax(np.abs(own), initial=0.0)
                for low in range(0, len(queries), tile_rows):
                    tile = slice(low, min(len(queries), low + tile_rows))
                    rough = twice[tile] @ points.T
                    np.subtract(own, rough, out=rough)
                    limit = held.limit(tile) - (norms[tile] if metric == "l2" else 0.0)
                    margin = slack * (largest + norms[tile] + 1.0)
                    # Not-a-number on either side rules nothing out.
                    near = ~(rough > (limit + margin)[:, None])
                    if rough.shape[1] > k and near.sum() > 4 * k * len(near):  # the block's own k nearest bound it better
                        limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1])
                        near = ~(rough > (limit + margin)[:, None])
                    ends = np.cumsum(near.sum(axis=1))
                    a = 0
                    while a < len(near):
                        done = ends[a - 1] if a else 0
                        b = max(a + 1, int(np.searchsorted(ends, done + exact_rows, side="right")))
                        q, j = np.nonzero(near[a:b])
                        if len(q):
                            held.add(low + a, low + b, low + a + q, exact(points[j], queries[low + a + q], metric), ids[j])
                        a = b
        yield from held.batches(query_ids, tile_rows)

    return run


def certified(query_ids: np.ndarray, queries: np.ndarray, k: int, metric: str, precision: str, tile_bytes: int = TILE_BYTES, measured: list[int] | None = None):
    """A ``mapInArrow`` function like :func:`nearest`: products of quantised vectors rule points out, results are exact.

    The triangle inequality bounds what quantising can change: a distance between
    quantised vectors differs from the true one by no more than both vectors moved.
    Single-precision sums of ``dim`` products are off by less than ``dim`` units of
    rounding of the product of the norms.  What these bounds cannot rule out is
    measured in double, term by term.  ``measured`` (in this process) counts those.
    """
    if metric not in ("l2", "l2_partial"):
        raise ValueError(f"Unsupported metric {metric!r}")

    def halved(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Quantised vectors in single precision, their squared norms, and how far each has moved."""
        with np.errstate(over="ignore", invalid="ignore"):
            rough = quantise(x, precision)
            return rough.astype(np.float32), np.einsum("ij,ij->i", rough, rough), np.sqrt(np.einsum("ij,ij->i", x - rough, x - rough)) * (1 + 1e-9)

    own_q, norms_q, moved_q = halved(queries)
    exact_norms = np.einsum("ij,ij->i", queries, queries)
    unit = 2.0**-23 * (queries.shape[1] + 8)
    tile_rows = max(1, tile_bytes // (32 * BLOCK))
    exact_rows = max(BLOCK, EXACT_BYTES // (8 * max(1, queries.shape[1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(len(query_ids), k)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids, points = np.asarray(part.column(0)), _matrix(part.column(1))
                if not len(ids):
                    continue
                own, norms, moved = halved(points)
                for low in range(0, len(queries), tile_rows):
                    tile = slice(low, min(len(queries), low + tile_rows))
                    with np.errstate(over="ignore", invalid="ignore"):
                        rough = norms_q[tile, None] + norms - 2.0 * (own_q[tile] @ own.T).astype(np.float64)
                        off = unit * 2.0 * np.sqrt(norms_q[tile, None] * norms) + 1e-30
                        shift = moved_q[tile, None] + moved
                        limit = held.limit(tile) + (exact_norms[tile] if metric == "l2_partial" else 0.0)
                        near_most = np.sqrt(np.maximum(limit, 0.0)) * (1 + 1e-9) + 1e-15 * np.sqrt(exact_norms[tile])
                        least = np.sqrt(np.maximum(rough - off, 0.0)) - shift
                        # Not-a-number on either side rules nothing out.
                        near = ~(least > near_most[:, None])
                        if least.shape[1] > k and near.sum() > 4 * k * len(near):  # the block's own k nearest bound it better
                            most = np.sqrt(np.maximum(rough + off, 0.0)) + shift
                            most[np.isnan(most)] = np.inf
                            near &= ~(least > (np.partition(most, k - 1, axis=1)[:, k - 1] * (1 + 1e-9))[:, None])
                    ends = np.cumsum(near.sum(axis=1))
                    if measured is not None:
                        measured.append(int(ends[-1]))
                    a = 0
                    while a < len(near):
                        done = ends[a - 1] if a else 0
                        b = max(a + 1, int(np.searchsorted(ends, done + exact_rows, side="right")))
                        q, j = np.nonzero(near[a:b])
                        if len(q):
                            held.add(low + a, low + b, low + a + q, exact(points[j], queries[low + a + q], metric), ids[j])
                        a = b
        yield from held.batches(query_ids, tile_rows)

    return run


@dataclass(frozen=True)
class Kept:
    """Rows that are not beaten by k others of their query, as far as a task's blocks tell."""

    k: int
    largest: bool = False


@dataclass(frozen=True)
class Steps:
    """Of each block's distances in order the last of every ``rows``."""

    rows: int


#: Numbers that a metric's form works on at once, and rows of a batch that leaves, about.
WORK, ROWS = 16 * 1024, 64 * 1024


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and vectors, a row a component, of some points."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part.column(0).to_numpy(), np.ascontiguousarray(_matrix(part.column(1)).T)


class _Sender:
    """Rows as batches of about ``ROWS``."""

    def __init__(self):
        self.held, self.n = [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(columns)
        self.n += len(columns[0])
        if self.n >= ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            columns = [x[0] if len(self.held) == 1 else np.concatenate(x) for x in zip(*self.held)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_id", "point_id", "dist"])
        self.held, self.n = [], 0


def _unbeaten(dist: np.ndarray, keep: Kept, limit: np.ndarray) -> np.ndarray:
    """Which distances may be among the k first; ``limit``, that of each query, becomes closer."""
    # In this order not-a-number is last, or the very first of the largest.
    place = np.where(np.isnan(dist), -np.inf, -dist) if keep.largest else dist
    near = ~(place > limit[:, None])
    near &= ~np.isnan(place) | np.isnan(limit)[:, None]
    if dist.shape[1] >= keep.k:
        many = np.nonzero(near.sum(axis=1) > keep.k)[0]
        if len(many):
            kth = np.partition(place[many], keep.k - 1, axis=1)[:, keep.k - 1]
            limit[many] = np.fmin(limit[many], kth)
            near[many] &= (place[many] <= limit[many, None]) | np.isnan(limit[many])[:, None]
    return near


def pairs(query_ids: np.ndarray, queries: np.ndarray, block: Callable[[np.ndarray, np.ndarray], np.ndarray], limits: np.ndarray | None = None, keep: Kept | Steps | None = None):
    """A ``mapInArrow`` function: points to ``query_id, point_id, dist`` of their pairs with all queries.

    ``limits`` holds a distance of each query that pairs may have at most
    (not-a-number: any).  A task holds a block of points, and of distances those
    to a few queries; of ``keep`` a number a query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit, out = np.full(len(query_ids), np.nan), _Sender()
        for ids, points in _blocks(batches):
            some = max(1, WORK // len(ids))
            for low in range(0, len(query_ids), some):
                part = slice(low, low + some)
                with np.errstate(all="ignore"):
                    dist = block(points, queries[part])
                if isinstance(keep, Steps):
                    at = np.arange(keep.rows - 1, len(ids), keep.rows)
                    if len(at):
                        ends = np.partition(dist, at, axis=1)[:, at]
                        real = ~np.isnan(ends)
                        asked = np.repeat(query_ids[part], real.sum(axis=1))
                        yield from out.add(asked, np.zeros(len(asked), np.int64), ends[real])
                    continue
                near = None
                if limits is not None:
                    near = (dist <= limits[part, None]) | np.isnan(limits[part])[:, None]
                if keep is not None:
                    unbeaten = _unbeaten(dist, keep, limit[part])
                    near = unbeaten if near is None else near & unbeaten
                if near is None:
                    yield from out.add(np.repeat(query_ids[part], len(ids)), np.tile(ids, len(dist)), dist.ravel())
                else:
                    q, j = np.nonzero(near)
                    if len(q):
                        yield from out.add(query_ids[low + q], ids[j], dist[q, j])
        yield from out.flush()

    return run


def in_rings(query_ids: np.ndarray, queries: np.ndarray, to_pivots: np.ndarray, radii: np.ndarray, places: dict[int, np.ndarray], block: Callable[[np.ndarray, np.ndarray], np.ndarray], keep: Kept):
    """A ``mapInArrow`` function: points ``(key, vector, ring, distances to pivots)`` to ``query_id, point_id, dist``.

    ``places`` holds the queries of each ring.  A point whose distance to a pivot
    differs from the query's by more than the query's radius is not the query's;
    where that leaves less than a quarter of some queries' pairs, only the points
    that are left are measured.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit, out = np.full(len(query_ids), np.nan), _Sender()
        for batch in batches:
            keys, rings = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            vectors, far = _matrix(batch.column(1)), _matrix(batch.column(3))
            for ring in np.unique(rings):
                own = np.nonzero(rings == ring)[0]
                asked = places[int(ring)]
                for at in range(0, len(own), BLOCK):
                    rows = own[at : at + BLOCK]
                    ids, points, off = keys[rows], np.ascontiguousarray(vectors[rows].T), far[rows].T
                    some = max(1, WORK // len(ids))
                    for low in range(0, len(asked), some):
                        part = asked[low : low + some]
                        meets = np.ones((len(part), len(ids)), bool)
                        for d, own_d in zip(off, to_pivots[part].T):
                            meets &= np.abs(d - own_d[:, None]) <= radii[part, None]
                        left = np.nonzero(meets.any(axis=0))[0]
                        if not len(left):
                            continue
                        fewer = 4 * len(left) < len(ids)
                        chosen, met = (left, meets[:, left]) if fewer else (np.arange(len(ids)), meets)
                        with np.errstate(all="ignore"):
                            dist = block(np.ascontiguousarray(points[:, chosen]) if fewer else points, queries[part])
                        # A point that a bound rules out is farther than the radius, so it beats none that counts.
                        bound = limit[part]
                        near = _unbeaten(dist, keep, bound) & met
                        limit[part] = bound
                        q, j = np.nonzero(near)
                        if len(q):
                            yield from out.add(query_ids[part[q]], ids[chosen[j]], dist[q, j])
        yield from out.flush()

    return run
