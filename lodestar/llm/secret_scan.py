"""Secrets in texts through a trigram inverted index, DataFrame operations only.

Each rule's regex is parsed on the driver and turned into a Boolean query over
trigrams that any match must contain.  The index has a posting ``(trigram,
document)`` for every trigram that occurs in some rule's query; postings of a
document meet in one bit set (combined map-side), on which all queries are
evaluated: that is the intersection and union of posting lists.  Postings are
slim (a key and a hash), and so is the list of documents that survive; while
that list is small it is broadcast to where the texts are, so texts stay there,
and beyond ``most_broadcast`` rows it meets them by a shuffle.  Documents that
survive for a rule are verified by running its regex over the whole text.  A
rule without mandatory trigrams scans all texts.

Trigrams are taken from lower-cased text, so a query is necessary for a match,
never sufficient; every reported span comes from the regex itself.
"""

from __future__ import annotations

import re._constants as C
import re._parser as P
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import FEW, durable, fresh, small


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` code points or the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Base patterns and lengths.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Well-known key formats beyond the base kinds.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[0-9]{6,}-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    # What follows the header may be missing, and such matches are dropped: so a run of beginnings that leads
    # nowhere is passed over at once, however long, and not looked through from each of them.
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}(\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})?", 1, 1),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + ADDED
MOST_EXACT = 64
#: Code points of a text that are cut apart at once.
PIECE = 4096
#: Steps of a prefix sum by doubling: arrays of up to so many elements.
STEPS = tuple(1 << i for i in range(30))


# -- Boolean trigram queries -------------------------------------------------
# A query is True (nothing is mandatory), a trigram, or ("and" | "or", [queries]).


def _join(kind: str, parts: list):
    if kind == "and":
        parts = [p for p in parts if p is not True]
        return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)
    return True if any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", parts)


def _of_strings(strings: set[str]):
    """Some string of the set occurs, so all trigrams of one of them do."""
    each = []
    for s in sorted(strings):
        each.append(_join("and", sorted({s[i : i + 3] for i in range(len(s) - 2)})))
    return _join("or", each) if each else True


def _walk(items, exact: set[str] | None):
    """(strings that this can match if few, else None; query)."""
    current, queries = {""}, []

    def flush():
        nonlocal current
        queries.append(_of_strings(current))
        current = {""}

    for op, arg in items:
        sub, query = None, True
        if op is C.LITERAL:
            sub = {chr(arg).lower()}
        elif op is C.IN and all(x[0] is C.LITERAL for x in arg) and len(arg) <= 8:
            sub = {chr(x[1]).lower() for x in arg}
        elif op is C.SUBPATTERN:
            sub, query = _walk(arg[3], None)
        elif op is C.BRANCH:
            each = [_walk(x, None) for x in arg[1]]
            if all(x[0] is not None for x in each):
                sub = set().union(*(x[0] for x in each))
            else:
                query = _join("or", [_join("and", [x[1], _of_strings(x[0]) if x[0] is not None else True]) for x in each])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, inner = arg
            found, query = _walk(inner, None)
            if found is not None and (least, most) == (0, 1):
                sub, query = found | {""}, True
            elif least == 0:
                query = True
            elif found is not None:
                query = _join("and", [query, _of_strings(found)])
        elif op is C.AT:
            sub = {""}
        if sub is not None and len(sub) * len(current) <= MOST_EXACT:
            current = {a + b for a in current for b in sub}
        else:
            flush()
            queries.append(query if sub is None else _join("and", [query, _of_strings(sub)]))
            if sub is not None and len(sub) <= MOST_EXACT:
                current = set(sub)
    if not queries:
        return current, True
    flush()
    return None, _join("and", queries)


def trigram_query(pattern: str):
    """The Boolean query over lower-case trigrams that every match satisfies."""
    exact, query = _walk(P.parse(pattern), None)
    return _join("and", [query, _of_strings(exact)]) if exact is not None else query


def trigrams_of(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def _evaluate(query, bit: dict[str, Column]) -> Column:
    if isinstance(query, str):
        return bit[query]
    parts = [_evaluate(q, bit) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


# -- index, candidates, verification -----------------------------------------


def postings(df: DataFrame, trigrams: list[str], keys: dict[str, Column], text: Column) -> DataFrame:
    """``*keys, trigram`` (an index into ``trigrams``) for each that a text contains."""
    # A projection of its own: texts are lower-cased once, not for each trigram.
    lowered = df.select(*[c.alias(k) for k, c in keys.items()], F.lower(text).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(i)) for i, t in enumerate(trigrams)]))
    return lowered.select(*keys, F.explode(found).alias("trigram"))


def candidates(df: DataFrame, rules: tuple[Rule, ...], keys: dict[str, Column], text: Column) -> DataFrame:
    """``*keys, rules``: a bit for each rule whose trigram query a document satisfies."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted(set().union(*map(trigrams_of, queries.values())))
    found = postings(df, trigrams, keys, text)
    words = [f"bits{w}" for w in range((len(trigrams) + 62) // 63)]
    masks = found.groupBy(*keys).agg(
        *[F.expr(f"bit_or(if(trigram div 63 = {w}, shiftleft(1L, trigram % 63), 0L))").alias(name) for w, name in enumerate(words)]
    )
    bit = {t: F.expr(f"(bits{i // 63} & {1 << i % 63}L) != 0") for i, t in enumerate(trigrams)}
    mask = F.lit(0).cast("long")
    for i, r in enumerate(rules):
        if queries[r.kind] is not True:
            mask = mask.bitwiseOR(F.when(_evaluate(queries[r.kind], bit), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return masks.select(*keys, mask.alias("rules")).where(F.col("rules") != 0)


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, combine) -> Column:
    """``combine`` of each element and all before it, by doubling: no array grows element by element."""

    def step(held: Column, by: Column) -> Column:
        moved = F.concat(F.slice(held, 1, by), F.zip_with(F.slice(held, by + 1, F.size(held) - by), F.slice(held, F.lit(1), F.size(held) - by), combine))
        return F.when(F.size(held) > by, moved).otherwise(held)

    return F.aggregate(F.array(*map(F.lit, STEPS)), values, step)


def _spans(text: Column, rule: Rule, at: int) -> Column:
    """Array of (start, kind number, end, kind) of a rule's matches, in code points.

    ``split`` gives what lies between matches and ``regexp_extract_all`` the
    matches, so lengths add up to offsets.
    """
    pattern = F.lit(rule.pattern)
    between = F.transform(F.split(text, rule.pattern, -1), lambda s: F.length(s))
    lengths = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda s: F.length(s))
    tests = lengths if not rule.group else F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda s: F.length(s))
    # Where each match ends; after the last one there is a gap more.
    steps = F.zip_with(between, lengths, lambda gap, n: gap + F.coalesce(n, F.lit(0)))
    rows = F.arrays_zip(_running(steps, lambda a, b: a + b).alias("end"), lengths.alias("n"), tests.alias("test"))
    kept = F.filter(rows, lambda x: x["n"].isNotNull() & (x["test"] >= rule.least))
    return F.transform(
        kept,
        lambda x: F.struct((x["end"] - x["n"]).alias("start"), F.lit(at).alias("order"), x["end"].alias("end"), F.lit(rule.kind).alias("kind")),
    )


def find_secrets(df: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES, most_broadcast: int = FEW) -> DataFrame:
    """``df`` with a column ``secrets``: array of (start, order, end, kind) sorted by start, then rule.

    Offsets count code points, ends are exclusive.  Null texts count as empty,
    null keys and repeated rows are scanned like others, an empty table gives an
    empty result.  A column that has the name ``secrets`` is replaced, any other
    is kept.
    """
    kinds = "array<struct<start:int,order:int,end:int,kind:string>>"
    body = F.coalesce(F.col(text), F.lit(""))
    keys = {"key": F.col(key).cast("string"), "hash": F.xxhash64(body)}
    found = durable(candidates(df.select(key, text), rules, keys, body), "candidates")
    own_key, own_hash, key_, hash_, which = fresh(df, "own_key", "own_hash", "key", "hash", "rules")
    found = found.toDF(key_, hash_, which)
    found = small(found, most_broadcast)
    marked = df.drop("secrets").select("*", keys["key"].alias(own_key), keys["hash"].alias(own_hash))
    joined = marked.join(found, F.col(own_key).eqNullSafe(F.col(key_)) & (F.col(own_hash) == F.col(hash_)), "left")
    empty = F.array().cast(kinds)
    each = []
    for i, r in enumerate(rules):
        likely = body.rlike(r.pattern) if trigram_query(r.pattern) is True else F.col(which).bitwiseAND(F.lit(1 << i).cast("long")) != 0
        each.append(F.when(likely, _spans(body, r, i).cast(kinds)).otherwise(empty))
    return joined.withColumn("secrets", F.array_sort(F.concat(*each))).drop(own_key, own_hash, key_, hash_, which)


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with ``[REDACTED]`` for every span (sorted by start); overlapping spans count as one.

    The text is cut into pieces first, so that reaching a span does not count
    code points from the beginning.
    """

    def between(pieces: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
        part = lambda i, a, n: F.coalesce(F.substring(F.get(pieces, i), a + 1, n), F.lit(""))
        low, high = F.pmod(start, F.lit(PIECE)), F.pmod(end, F.lit(PIECE))
        whole = F.when(last > first + 1, F.array_join(F.slice(pieces, first + 2, last - first - 1), "")).otherwise("")
        return F.when(first == last, part(first, low, high - low)).otherwise(F.concat(part(first, low, F.lit(PIECE)), whole, part(last, F.lit(0), high)))

    def cut(held: Column) -> Column:
        # From the furthest end before each span to its start; none if they overlap.
        gaps = F.zip_with(held["before"], held["starts"], lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        clear = F.filter(gaps, lambda x: x["b"] >= x["a"])
        kept = F.transform(clear, lambda x: between(held["pieces"], x["a"], x["b"]))
        rest = between(held["pieces"], F.array_max(held["ends"]), F.length(text))
        return F.concat(F.array_join(kept, "[REDACTED]"), F.lit("[REDACTED]"), rest)

    ends = _running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    held = F.struct(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"),
        F.transform(spans, lambda x: x["start"]).alias("starts"),
        ends.alias("ends"),
        F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(spans) - 1)).alias("before"),
    )
    return _bound(held, cut)


def redact(df: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES, most_broadcast: int = FEW) -> DataFrame:
    """``df`` with every secret in ``text`` replaced by ``[REDACTED]``; overlapping spans count as one.

    Rows and columns stay as they are otherwise, one named ``secrets`` too; null
    texts stay null; an empty table stays empty.
    """
    (spare,) = fresh(df, "spare")
    source = df.withColumnRenamed("secrets", spare)
    at = spare if text == "secrets" else text
    found = find_secrets(source, at, spare if key == "secrets" else key, rules, most_broadcast)
    changed = found.withColumn(at, F.when(F.size("secrets") > 0, redacted(F.col(at), F.col("secrets"))).otherwise(F.col(at)))
    return changed.select(*source.columns).withColumnRenamed(spare, "secrets")
