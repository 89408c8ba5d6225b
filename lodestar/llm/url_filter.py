"""URL filter: host and path rules, then logistic regression on hashed n-grams.

Scoring is DataFrame operations only: character n-grams of host and path are
hashed by md5 into a fixed number of buckets, and the logit is the mean of their
weights, held as one constant array of whole numbers: it does not depend on the
order of a sum, on the machine or on the engine.  The model is fitted on the
driver to a small labelled URL table: names put together from a topic and a
neutral word, and names of common letter pairs, which say nothing and are
ordinary.  The fit takes its steps in one order, with sums and products only, so
that any machine finds the same weights.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import LOWER, UPPER, ascii_lower, fresh

#: Fixed values: (verdict, host, start of the path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
BUCKETS = 1 << 13
SIZES = (3, 4, 5)
#: Weights are kept as whole multiples of one in so many.
UNIT = 10_000
#: Labelled rows that a fit takes, at most.
MOST_LABELLED = 10_000
#: Passes over the labelled rows, step of the first one, shrinking of all weights in a pass.
PASSES, RATE, RIDGE = 20, 12.0, 0.05
#: Units of logit from which a page is blocked; of topics held out as a whole it blocks hardly an ordinary page (tests).
BLOCK_AT = -5_000

#: What the small labelled table is made of: topics of unwanted and of ordinary sites, words that go with either.
UNWANTED = (
    "pills", "viagra", "meds", "steroids", "casino", "poker", "slots", "bets", "betting", "lottery", "jackpot", "adult", "porn", "escort", "cams",
    "hookup", "loans", "payday", "replica", "spam", "backlinks", "ads", "adserver", "popups", "tracker", "clickbait", "warez", "cracks", "scam",
)
ORDINARY = (
    "news", "library", "weather", "museum", "history", "science", "garden", "recipes", "travel", "council", "school", "university", "health",
    "poetry", "music", "chess", "river", "photos", "books", "theater", "orchestra", "kitchen", "letters", "mathematics", "geology", "village",
    "harbor", "railway", "bakery", "gallery", "astronomy", "philosophy", "hospital", "forest", "parish", "cycling", "swimming", "climate", "language", "editor",
)
NEUTRAL = ("online", "best", "top", "daily", "my", "world", "city", "direct", "plus", "center")
#: Words of paths: of unwanted pages, of ordinary ones; half of all paths have none.
UNWANTED_PATHS = ("buy", "bonus", "winner", "offer", "promo", "click", "redirect", "deal", "signup", "discount")
ORDINARY_PATHS = ("article", "about", "docs", "archive", "help", "guide", "research", "team", "contact", "notes")
ENDINGS = ("example.com", "example.net", "example.org")
LANGUAGES = ("en", "de", "fr", "es")
PREFIXES = ("", "www.", "m.", "blog.")
SUFFIXES = ("", "/", ".html")
#: The commonest letter pairs of English text.
PAIRS = ("th", "he", "in", "er", "an", "re", "nd", "at", "on", "nt", "ha", "es", "st", "en", "ed", "to", "it", "ou", "ea", "hi", "is", "or", "ti", "as", "te", "et", "ng", "of", "al", "de", "se", "le", "sa", "si", "ar", "ve", "ra", "ld", "ur")
#: Ordinary names that are made of them.
SAYING_NOTHING = 1200


def _held(name: str, held_out: bool | None) -> bool:
    return held_out is None or held_out == (hashlib.md5(name.encode()).digest()[0] % 4 == 0)


def _url(name: str, copy: int, paths: tuple[str, ...]) -> str:
    """A page of a site: all but the name and a path's word follow from a hash, so that they say nothing."""
    d = hashlib.md5(f"{name} {copy}".encode()).digest()
    page = f"{paths[d[0] % len(paths)]}-{d[1]}" if d[2] % 2 else str(d[1])
    return f"https://{PREFIXES[d[3] % 4]}{name}.{ENDINGS[d[4] % 3]}/{LANGUAGES[d[5] % 4]}/{page}{SUFFIXES[d[6] % 3]}"


def labelled_urls(held_out: bool | None = None, by: str = "name") -> list[tuple[str, int]]:
    """(url, 1 if unwanted).  ``held_out`` picks the quarter that is held out, or the rest; None is all.

    ``by`` says a quarter of what: of the names, or of the topics with all their names.
    """
    out = []
    for label, topics, paths in ((1, UNWANTED, UNWANTED_PATHS), (0, ORDINARY, ORDINARY_PATHS)):
        for topic in topics:
            for word in NEUTRAL:
                for name in (f"{word}-{topic}", f"{topic}-{word}"):
                    if _held(topic if by == "topic" else name, held_out):
                        out += [(_url(name, copy, paths), label) for copy in range(2)]
    for i in range(SAYING_NOTHING):
        digest = hashlib.md5(f"pairs {i}".encode()).digest()
        name = "".join(PAIRS[b % len(PAIRS)] for b in digest[: 2 + digest[15] % 4])
        if _held(name, held_out):
            out.append((_url(name, 0, ORDINARY_PATHS), 0))
    return out


HOST, PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; "" for null or no ``://``."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def parts_of(url: str) -> tuple[str, str]:
    """(host, path) of a url, in Python."""
    host, path = re.match(HOST, url), re.match(PATH, url)
    return (host[1].translate(str.maketrans(UPPER, LOWER)), path[1]) if host and path else ("", "")


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null.

    One expression of ``len(rules)`` tests; rules are an argument of the
    program, not data.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def features(host: Column, path: Column) -> Column:
    """Bucket numbers, from 0, of the distinct n-grams of host and path; in a path all digits are one."""

    def cut(text: Column, n: int, mark: str):
        return lambda i: (F.conv(F.substring(F.md5(F.concat(F.lit(mark), F.substring(text, i, F.lit(n)))), 1, 4), 16, 10).cast("int") % BUCKETS).cast("int")

    grams = []
    for mark, text in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), F.translate(path, "123456789", "0" * 9), F.lit("$")))):
        for n in SIZES:
            at = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
            grams.append(F.transform(at, cut(text, n, mark)))
    return F.array_distinct(F.concat(*grams))


def features_of(url: str) -> list[int]:
    """The same in Python, for the labelled table."""
    host, path = parts_of(url)
    found = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path.translate(str.maketrans('123456789', '0' * 9))}$")):
        for n in SIZES:
            found |= {int(hashlib.md5((mark + text[i : i + n]).encode()).hexdigest()[:4], 16) % BUCKETS for i in range(len(text) - n + 1)}
    return sorted(found)


def logistic(x: float) -> float:
    """1 / (1 + e^-x) by products alone: libraries differ in the last bits of exp."""
    power = 1.0 - max(-30.0, min(30.0, x)) / 4096
    for _ in range(12):
        power *= power
    return 1.0 / (1.0 + power)


@lru_cache(maxsize=4)
def fit(labelled: tuple[tuple[str, int], ...]) -> tuple[int, tuple[int, ...]]:
    """(bias, weights), in units, of a ridge logistic regression; at most ``MOST_LABELLED`` rows.

    Steps row by row in the order of the urls' md5; rows of the rarer label weigh more.
    """
    rows = [(features_of(url), label) for url, label in sorted(labelled[:MOST_LABELLED], key=lambda r: hashlib.md5(r[0].encode()).digest())]
    ones = sum(label for _, label in rows)
    if not rows:
        return 0, (0,) * BUCKETS
    share = {1: len(rows) / (2 * max(1, ones)), 0: len(rows) / (2 * max(1, len(rows) - ones))}
    weights, bias = [0.0] * BUCKETS, 0.0
    used = sorted({i for own, _ in rows for i in own})
    for n in range(PASSES):
        rate = RATE / (1 + n / 4)
        for own, label in rows:
            total = bias
            for i in own:
                total += weights[i] / len(own)
            step = rate * share[label] * (label - logistic(total))
            bias += step / 64
            for i in own:
                weights[i] += step
        for i in used:
            weights[i] *= 1 - RIDGE
    return round(bias * UNIT), tuple(round(w * UNIT) for w in weights)


def logit_of(host: Column, path: Column, model: tuple[int, tuple[int, ...]]) -> Column:
    """How much speaks for a page being unwanted: a whole number of units, the mean weight of its n-grams and the bias."""
    bias, weights = model
    held = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")  # folded into one constant
    found = features(host, path)
    total = F.aggregate(found, F.lit(0).cast("long"), lambda acc, i: acc + F.get(held, i))
    return F.floor(total / F.greatest(F.size(found), F.lit(1))).cast("long") + F.lit(bias).cast("long")


def judge(df: DataFrame, url: str = "url", labelled: list[tuple[str, int]] | None = None, rules: tuple = RULES) -> DataFrame:
    """``df`` with ``host, path, score, rule, verdict, logit``.

    The verdict is the rule's, or else ``block`` where the logit is at least
    ``BLOCK_AT`` units; ``score`` is its logistic.  Null urls and urls without
    ``://`` have an empty host and path, fit no rule and are judged by the logit
    of nothing.  Columns of those names are replaced; rows that repeat are judged
    each; an empty table gives an empty result; without labelled rows every logit
    is 0.
    """
    model = fit(tuple(labelled_urls() if labelled is None else labelled))
    names = ["host", "path", "score", "rule", "verdict", "logit"]
    kept = [c for c in df.columns if c not in names]
    h, p, own, found_rule = fresh(df, "host", "path", "logit", "rule")
    cut = df.select(*kept, host_of(F.col(url)).alias(h), path_of(F.col(url)).alias(p))
    host, path, logit = F.col(h), F.col(p), F.col(own)
    found = cut.select(*kept, h, p, logit_of(host, path, model).alias(own), rule_of(host, path, rules).alias(found_rule))
    return found.select(
        *kept,
        host.alias("host"),
        path.alias("path"),
        (F.lit(1.0) / (1.0 + F.exp(-logit / UNIT))).alias("score"),
        F.col(f"{found_rule}.rule").alias("rule"),
        F.coalesce(F.col(f"{found_rule}.verdict"), F.when(logit >= BLOCK_AT, "block").otherwise("allow")).alias("verdict"),
        logit.alias("logit"),
    )
