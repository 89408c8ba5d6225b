"""Toxicity by weak supervision.

1. Voters are mined from labelled rows: whole words and word beginnings that
   are so much more frequent in toxic texts that it is not by chance.  With a
   short fixed list they are lexicon voters (toxic where they occur); pattern
   voters look at how many lexicon entries occur, how often and how densely, and
   vote clean where nothing occurs.  The row's given label is one more voter.
2. A generative label model estimates by expectation maximisation, starting
   from the majority of the votes, how often each voter votes what under either
   label, the given label's voter included: none is trusted beforehand.  Voters
   are correlated: under either label they form a tree, the one with the most
   mutual information, and each votes by a rate that depends on what its parent
   voted.  So a voter that repeats another one adds nothing.
3. A linear classifier is trained on the posterior labels.  Its features are
   the text's words and word beginnings, hashed, and what lexicon and patterns
   see, so it also finds texts that no entry covers.

Fitting takes at most ``FIT_ROWS`` labelled rows, those with the smallest
hashes of their keys; what comes to the driver grows with those rows only.
Scoring covers every row, whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import durable, prepare

#: Labelled rows that a fit takes, at most.
FIT_ROWS = 20_000
#: Bytes of text that a fit takes, at most (labelled rows in order of their keys' hash), and mined entries that become voters.
FIT_BYTES, MOST_VOTERS = 256 * 1024 * 1024, 512
#: Log likelihood ratio that makes an entry sure.
SURE = 17.0
#: Clean rows for each toxic row of an entry that is pure.
PURE = 0.02
#: Lengths of word beginnings that may become entries.
STEMS = (4, 5, 6, 7, 8)
#: Min-hashes that find copies in the sample.
MIN_HASHES = 4
REJECT_AT = 0.7
#: Buckets of hashed words and word beginnings; lengths of those beginnings.
BUCKETS = 1 << 14
HASHED = (4, 6)
#: Distinct words whose hashes and entries a scorer remembers.
REMEMBERED = 100_000
#: Weight of what is known of a voter alone against what is seen beside its parent, in rows.
PRIOR_ROWS = 5.0
#: Ridge of what lexicon and patterns see, and of hashed words.
RIDGE, HASHED_RIDGE = 0.3, 3.0
#: Rows that a fit looks at at once.
BLOCK = 500
WORD = re.compile(r"[^\W\d_]+")
#: A short list of insults that holds without any labels.
SEED_WORDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "imbecile", "dumbass", "bastard")
ROWS = 500


def fit_key(key: Column) -> Column:
    """crc32 of the key as text modulo 3; rows with 1 are held out."""
    return F.crc32(key.cast("string")) % 3


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _candidates(words: list[str]) -> set[str]:
    """Whole words and beginnings; a beginning ends in "*"."""
    out = set()
    for w in set(words):
        out.add(w)
        for n in STEMS:
            if len(w) > n:
                out.add(w[:n] + "*")
    return out


@dataclass
class Lexicon:
    """``pure`` of the entries, the first ones, occur in toxic texts alone or nearly so."""

    entries: list[str]
    pure: int

    def __post_init__(self):
        self.at = {e: i for i, e in enumerate(self.entries)}
        self.heads = {e.rstrip("*")[:4] for e in self.entries}

    def of(self, word: str) -> list[int]:
        """Entries that a word matches."""
        if word[:4] not in self.heads:
            return []
        get = self.at.get
        return [i for i in (get(word), *[get(word[:n] + "*") for n in STEMS if len(word) > n]) if i is not None]


#: Totals beside the entries' own counts.
TOTALS = ("hit words", "entries", "per 100 words", "any", "three or more", "pure hits", "any pure")


def tokens(word: str) -> list[int]:
    """Buckets of a word and its beginnings."""
    return [xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in (word, *[word[:n] + "*" for n in HASHED if len(word) > n])]


def features(lexicon: Lexicon, counted: Counter) -> tuple[dict[int, float], list[float]]:
    """(capped count of each entry that occurs, totals) of a text's words."""
    counts: Counter = Counter()
    n = pure = 0
    for word, times in counted.items():
        found = lexicon.of(word)
        if found:
            n += times
            pure += times * (min(found) < lexicon.pure)
            for i in found:
                counts[i] += times
    words = counted.total()
    totals = [math.log1p(n), math.log1p(len(counts)), min(3.0, 10.0 * n / (words + 5)), float(n > 0), float(n >= 3), math.log1p(pure), float(pure > 0)]
    return {i: min(c, 3) / 3 for i, c in counts.items()}, totals


# -- voters and label model ---------------------------------------------------


def votes(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 toxic, -1 clean, 0 abstains; a column for each entry, then for each pattern."""
    n, density = np.expm1(totals[:, 0]), totals[:, 2]
    patterns = [
        np.where(n >= 2, 1, 0),
        np.where(n >= 3, 1, np.where(n == 0, -1, 0)),
        np.where(np.expm1(totals[:, 1]) >= 3, 1, 0),
        np.where(density >= 0.1, 1, np.where(density == 0, -1, 0)),
    ]
    return np.column_stack([(counts > 0).astype(np.int8), *patterns]).astype(np.int8)


@dataclass
class LabelModel:
    """The label's rate and, under both labels, each voter's votes given its parent's."""

    prior: float
    parent: np.ndarray  # of each voter; -1 for none
    rates: np.ndarray  # (label, voter, parent's vote + 1, vote + 1)

    def log_odds(self, seen: np.ndarray) -> np.ndarray:
        ratio = np.log(self.rates[1]) - np.log(self.rates[0])
        out = np.full(len(seen), math.log(self.prior / (1 - self.prior)))
        voter = np.arange(seen.shape[1])
        for a in range(0, len(seen), BLOCK):
            own = seen[a : a + BLOCK].astype(np.int64) + 1
            out[a : a + BLOCK] += ratio[voter, own[:, np.maximum(self.parent, 0)], own].sum(axis=1)
        return out

    def accuracy(self, voter: int) -> tuple[float, float]:
        """How often a voter votes clean under clean, toxic under toxic (parents' votes weighed alike)."""
        return float(self.rates[0, voter, :, 0].mean()), float(self.rates[1, voter, :, 2].mean())


def _joint(seen: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted counts of each two voters' votes: (voter, vote + 1, voter, vote + 1)."""
    n, out = seen.shape[1], 0.0
    for a in range(0, len(seen), BLOCK):
        own = seen[a : a + BLOCK]
        hot = np.stack([own == v for v in (-1, 0, 1)], axis=2).reshape(len(own), -1).astype(np.float32)
        out = out + hot.T @ (hot * weight[a : a + BLOCK, None].astype(np.float32))
    return np.asarray(out, np.float64).reshape(n, 3, n, 3)


def voter_tree(joints: list[np.ndarray]) -> np.ndarray:
    """The parent of each voter in the tree with the most mutual information given the label."""
    n, worth = joints[0].shape[0], 0.0
    for joint in joints:
        share = joint / max(1e-9, joint[0, :, 0, :].sum()) + 1e-12
        alone = share.sum(axis=3)[:, :, 0]
        worth = worth + joint[0, :, 0, :].sum() * (share * np.log(share / (alone[:, :, None, None] * alone[None, None, :, :]))).sum(axis=(1, 3))
    parent, inside = np.full(n, -1), np.zeros(n, bool)
    inside[0] = True
    best, via = worth[0].copy(), np.zeros(n, np.int64)
    for _ in range(n - 1):
        best[inside] = -np.inf
        i = int(best.argmax())
        parent[i], inside[i] = via[i], True
        closer = (worth[i] > best) & ~inside
        best[closer], via[closer] = worth[i][closer], i
    return parent


def _rates(seen: np.ndarray, weight: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Votes of each voter given its parent's, smoothed towards its votes alone."""
    n = seen.shape[1]
    counts = np.zeros(9 * n)
    for a in range(0, len(seen), BLOCK):
        own = seen[a : a + BLOCK].astype(np.int64) + 1
        above = np.where(parent >= 0, own[:, np.maximum(parent, 0)], 0)
        counts += np.bincount((9 * np.arange(n) + 3 * above + own).ravel(), np.repeat(weight[a : a + BLOCK], n), 9 * n)
    counts = counts.reshape(n, 3, 3)
    alone = counts.sum(axis=1) + 0.1
    alone /= alone.sum(axis=1, keepdims=True)
    out = counts + PRIOR_ROWS * alone[:, None, :]
    return out / out.sum(axis=2, keepdims=True)


def fit_label_model(seen: np.ndarray, rounds: int = 20) -> tuple[LabelModel, np.ndarray]:
    """EM from the majority of the votes; returns the model and its posteriors.

    First voters count as independent; then the tree is chosen by the
    posteriors, and EM goes on with it.
    """
    post = 1 / (1 + np.exp(-np.clip(seen.sum(axis=1, dtype=np.float64), -4, 4)))
    parent = np.full(seen.shape[1], -1)
    for stage in range(2):
        if stage:
            parent = voter_tree([_joint(seen, 1 - post), _joint(seen, post)])
        for _ in range(rounds):
            model = LabelModel(float(np.clip(post.mean(), 1e-3, 1 - 1e-3)), parent, np.stack([_rates(seen, 1 - post, parent), _rates(seen, post, parent)]))
            new = 1 / (1 + np.exp(-np.clip(model.log_odds(seen), -30, 30)))
            done = np.abs(new - post).max() < 1e-4
            post = new
            if done:
                break
    return model, post


class Sparse:
    """Rows of hashed words: buckets of each row (repeats count), scaled by the root of its words."""

    def __init__(self, buckets: list[np.ndarray], scale: np.ndarray):
        self.lengths = np.array([len(b) for b in buckets], np.int64)
        self.buckets = np.concatenate(buckets) if buckets else np.zeros(0, np.uint16)
        self.ends, self.scale = np.r_[0, np.cumsum(self.lengths)], scale

    def _blocks(self):
        for a in range(0, len(self.lengths), BLOCK):
            b = min(len(self.lengths), a + BLOCK)
            yield a, b, self.buckets[self.ends[a] : self.ends[b]], np.repeat(np.arange(b - a), self.lengths[a:b])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(row, w[own], b - a) for a, b, own, row in self._blocks()]) * self.scale

    def back(self, r: np.ndarray) -> np.ndarray:
        r = r * self.scale
        return sum((np.bincount(own, r[a:b][row], BUCKETS) for a, b, own, row in self._blocks()), np.zeros(BUCKETS))


def fit_linear(dense: np.ndarray, hashed: Sparse, target: np.ndarray, rounds: int = 60, memory: int = 8) -> np.ndarray:
    """Weights (of the dense features, the hashed ones, bias last) of a ridge logistic regression on soft labels, by L-BFGS."""
    k = dense.shape[1]
    penalty = np.r_[np.full(k, RIDGE), np.full(BUCKETS, HASHED_RIDGE), 1e-6]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = dense @ w[:k] + hashed.times(w[k:-1]) + w[-1]
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        value = (np.logaddexp(0, z) - target * z).sum() + (penalty * w * w).sum() / 2
        return value, np.r_[dense.T @ off, hashed.back(off), off.sum()] + penalty * w

    w = np.zeros(k + BUCKETS + 1)
    value, slope = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        toward, kept = -slope, []
        for s, y, r in reversed(steps):
            kept.append(r * (s @ toward))
            toward = toward - kept[-1] * y
        if steps:
            s, y, r = steps[-1]
            toward = toward / (r * (y @ y))
        else:
            toward = toward / max(1.0, np.abs(slope).max())
        for (s, y, r), c in zip(steps, reversed(kept)):
            toward = toward + (c - r * (y @ toward)) * s
        size, fall = 1.0, slope @ toward
        while size > 1e-6:
            new, new_slope = loss(w + size * toward)
            if new <= value + 1e-4 * size * fall:
                break
            size /= 2
        else:
            break
        s, y = size * toward, new_slope - slope
        small = value - new < 1e-5 * max(1.0, abs(new))
        w, value, slope = w + s, new, new_slope
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y, 1 / (s @ y))]
        if small:
            break
    return w


class Model:
    """Scores texts; remembers the part of each word."""

    def __init__(self, lexicon: Lexicon, entries: np.ndarray, totals: np.ndarray, hashed: np.ndarray, bias: float):
        self.lexicon, self.entries, self.totals, self.hashed, self.bias = lexicon, entries, totals.tolist(), hashed, bias
        self.known: dict[str, float] = {}

    def _part(self, word: str) -> float:
        return float(self.hashed[tokens(word)].sum())

    def score(self, text: str | None) -> float:
        counted = Counter(words_of(text))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, total = self.known, 0.0
        for word in counted:
            part = known.get(word)
            if part is None:
                part = known[word] = self._part(word)
            total += part
        counts, totals = features(self.lexicon, counted)
        z = self.bias + total / math.sqrt(max(1, len(counted))) + sum(c * self.entries[i] for i, c in counts.items()) + sum(a * b for a, b in zip(totals, self.totals))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(z)))))

    def __getstate__(self):
        return {**self.__dict__, "known": {}}


# -- fitting ------------------------------------------------------------------


def _min_hashes(text: str | None) -> list[int]:
    words = words_of(text)
    shingles = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    values = np.fromiter((xxhash.xxh64_intdigest(x) for x in shingles), np.uint64, len(shingles))
    return [int((values * np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) & 2**64 - 1) >> np.uint64(1)).min()) for i in range(MIN_HASHES)]


def _within_bytes(sample: DataFrame) -> DataFrame:
    """The first rows in order of their keys' hash that have ``FIT_BYTES`` of text together, one row at least."""
    sizes = sample.select("key", F.xxhash64("key").alias("hash"), F.octet_length("text").alias("n")).orderBy("hash", "key").collect()  # FIT_ROWS at most
    if sum(r.n for r in sizes) <= FIT_BYTES:
        return sample
    total, kept = 0, []
    for r in sizes:
        total += r.n
        if kept and total > FIT_BYTES:
            break
        kept.append((r.key,))
    kind = sample.schema["key"].dataType.simpleString()
    return sample.join(F.broadcast(sample.sparkSession.createDataFrame(kept, f"key {kind}")), "key")


def _apart(sample: DataFrame) -> DataFrame:
    """One row of each group of copies of a label: words of a text that was copied are not frequent words.

    Rows of one label that share a min-hash of their shingles are copies.  At
    most ``FIT_ROWS`` rows of a few numbers come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [_min_hashes(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(hashes, pa.list_(pa.int64()))], ["key", "label", "hashes"])

    kind = sample.schema["key"].dataType.simpleString()
    rows = sample.select("key", "text", "label").mapInArrow(run, f"key {kind}, label int, hashes array<bigint>").orderBy("key").collect()
    first: dict[tuple, int] = {}
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, r in enumerate(rows):
        for at, h in enumerate(r.hashes):
            j = root(first.setdefault((r.label, at, h), i))
            a, b = sorted((root(i), j))
            parent[b] = a
    kept = [(r.key,) for i, r in enumerate(rows) if root(i) == i]
    return sample.join(F.broadcast(sample.sparkSession.createDataFrame(kept, f"key {kind}")), "key")


def _mine(sample: DataFrame) -> tuple[DataFrame, int, int]:
    """``entry, pos, neg`` (rows with it, by label) of the sample, and its rows by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, seen = batch.slice(at, ROWS), {}
                for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for e in _candidates(words_of(text)):
                        both = seen.setdefault(e, [0, 0])
                        both[label] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64())], ["entry", "pos", "neg"])

    counted = sample.select("text", "label").mapInArrow(run, "entry string, pos bigint, neg bigint").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    return counted, n.get(1, 0), n.get(0, 0)


def surely(positive: int, negative: int) -> Column:
    """Whether an entry's share of toxic rows exceeds the sample's so clearly that it is not chance, by likelihood ratio."""
    base, share = positive / (positive + negative), F.col("pos") / (F.col("pos") + F.col("neg"))
    ratio = F.col("pos") * F.log(share / base) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    return (share > base) & (ratio >= SURE)


def choose_entries(rows: list[tuple[str, int, int]]) -> tuple[list[str], int]:
    """(entries, pure ones first; how many are pure), without those that say what a chosen one says.

    Of a beginning and a word or longer beginning with about the same rows the
    longer stays; under a beginning that is nearly always toxic the longer go.
    """
    ranked = sorted(((pos - 3 * neg, len(entry.rstrip("*")), pos, neg, entry) for entry, pos, neg in rows), reverse=True)
    chosen: dict[str, tuple[int, int]] = {}
    longer: dict[str, int] = {}  # of each beginning, rows of the most frequent longer entry
    for _, _, pos, _, entry in ranked:
        stem = entry.rstrip("*")
        for n in STEMS:
            if n < len(stem) or (n == len(stem) and not entry.endswith("*")):
                longer[stem[:n]] = max(longer.get(stem[:n], 0), pos)
    for _, _, pos, neg, entry in ranked:
        stem = entry.rstrip("*")
        shorter = [chosen[e] for n in STEMS if (e := stem[:n] + "*") in chosen and (n < len(stem) or e != entry)]
        if any(n <= PURE * p for p, n in shorter) or longer.get(entry.endswith("*") and stem, 0) >= 0.95 * pos:
            continue
        chosen[entry] = (pos, neg)
    return sorted(chosen, key=lambda e: chosen[e][1] > PURE * chosen[e][0]), sum(n <= PURE * p for p, n in chosen.values())


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on labelled rows that are not held out; without both labels, on the fixed list alone.

    Of several labels of a key the toxic one counts, of several texts the one
    with the smallest hash.
    """
    prepare(docs.sparkSession)
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (fit_key(F.col(key)) != 1))
    known = known.groupBy(F.col(key).alias("key")).agg(F.max(F.col(label)).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(FIT_ROWS)
    named = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "key")
    one = named.groupBy("key", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one"))
    sample = durable(one.select("key", F.col("one.text").alias("text"), "label"), "fit")
    sample = _apart(_within_bytes(sample))
    counted, positive, negative = _mine(sample)
    rows = [tuple(r) for r in counted.where(surely(positive, negative)).collect()] if positive and negative else []
    mined, pure = choose_entries(rows) if rows else ([], 0)
    mined, pure = mined[:MOST_VOTERS], min(pure, MOST_VOTERS)
    first = list(dict.fromkeys([*mined[:pure], *SEED_WORDS]))
    lexicon = Lexicon([*first, *[e for e in mined[pure:] if e not in first]], len(first))
    n_entries = len(lexicon.entries)
    if not positive or not negative:
        # No labels to learn from: any hit of the fixed list is toxic.
        return Model(lexicon, np.zeros(n_entries), np.array([0, 0, 0, 5.0, 0, 0, 0]), np.zeros(BUCKETS), -3.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, y in zip(batch.column(0), batch.column(1)):
                counted = Counter(words_of(value.as_py()))
                counts, totals = features(lexicon, counted)
                hashed = np.array([b for w in counted for b in tokens(w)], np.uint16)
                seen = np.array([*totals, *[x for pair in counts.items() for x in pair]], np.float32)
                rows.append({"seen": seen.tobytes(), "hashed": hashed.tobytes(), "words": len(counted), "label": y.as_py()})
            yield pa.RecordBatch.from_pylist(rows, _MADE)

    made = sample.select("text", "label").mapInArrow(run, "seen binary, hashed binary, words int, label int").collect()
    # In an order of their own, so that sums come out the same.
    made.sort(key=lambda r: (r.label, r.words, bytes(r.hashed), bytes(r.seen)))
    counts, totals, given = np.zeros((len(made), n_entries), np.float32), np.zeros((len(made), len(TOTALS)), np.float32), np.array([r.label for r in made])
    for i, r in enumerate(made):
        own = np.frombuffer(r.seen, np.float32)
        totals[i], pairs = own[: len(TOTALS)], own[len(TOTALS) :].reshape(-1, 2)
        counts[i, pairs[:, 0].astype(np.int64)] = pairs[:, 1]
    hashed = Sparse([np.frombuffer(r.hashed, np.uint16) for r in made], 1 / np.sqrt([max(1, r.words) for r in made]))
    del made
    seen = np.column_stack([votes(counts, totals), np.where(given == 1, 1, -1)]).astype(np.int8)
    _, post = fit_label_model(seen)
    w = fit_linear(np.column_stack([counts, totals]), hashed, post)
    return Model(lexicon, w[:n_entries], w[n_entries : n_entries + len(TOTALS)], w[n_entries + len(TOTALS) : -1], float(w[-1]))


_MADE = pa.schema([("seen", pa.binary()), ("hashed", pa.binary()), ("words", pa.int32()), ("label", pa.int32())])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score``: one row per row; the score of a null or empty text is that of no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], [key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``key, held_out, score, predicted`` for every row of ``docs``.

    Null keys are not held out and never fitted on; rows that repeat are scored
    each; an empty table gives an empty result; other columns are ignored.
    """
    scored = score(docs, fit(docs, labels, key, text, label), key, text)
    return scored.select(key, F.coalesce(fit_key(F.col(key)) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= REJECT_AT).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Rows of ``docs`` that the classifier does not reject, columns as they are."""
    model = fit(docs, labels, key, text, label)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t.as_py()) < REJECT_AT for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
