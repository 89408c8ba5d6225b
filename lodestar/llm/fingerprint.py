"""Merkle fingerprints of documents, in DataFrame operations only.

A document is a tree: sections (between empty lines) hold paragraphs (lines),
paragraphs hold leaves of a few words.  A leaf's hash is of its text, a
paragraph's of its leaves' hashes, a section's of its paragraphs', the root's
of the sections' and the length.  Text is cut at fixed separators (two line
ends, one line end) and leaves leave nothing out, so the children of a node
say all that it holds: equal roots mean equal texts.

The fingerprint string is the tree: ``root;section;section...``, a section
``hash=paragraph,paragraph...``, a paragraph ``hash:leaf.leaf...``, leaves'
hashes shortened (their parent hashes the whole ones).  Likeness of two
fingerprints is the share of distinct leaves in common (Dice), 1 for equal
roots.  :func:`differing` descends from the roots and enters only nodes that
differ, which locates an edit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import partitions, range_buckets

#: A leaf has up to four words; a word counts up to 40 characters, longer ones go on in further words.
LEAF = r"(?:[^\x20\x09-\x0D]{1,40}[\x20\x09-\x0D]*){1,4}|[\x20\x09-\x0D]+"
LEAF_DIGITS, NODE_DIGITS, ROOT_DIGITS = 8, 16, 32
BUCKETS = 4


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hash(children: Column, digits: int = NODE_DIGITS) -> Column:
    return F.substring(F.md5(children), 1, digits)


def fingerprint(text: Column) -> Column:
    """The fingerprint string of a text; null counts as empty."""

    def paragraph(p: Column) -> Column:
        leaves = F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.md5(x))
        shown = lambda own: F.array_join(F.transform(own, lambda x: F.substring(x, 1, LEAF_DIGITS)), ".")
        return _bound(leaves, lambda own: F.concat(_hash(F.array_join(own, "")), F.lit(":"), shown(own)))

    def section(s: Column) -> Column:
        of = lambda own: F.array_join(F.transform(own, lambda p: F.substring(p, 1, NODE_DIGITS)), ",")
        return _bound(F.transform(F.split(s, "\n", -1), paragraph), lambda own: F.concat(_hash(of(own)), F.lit("="), F.array_join(own, ",")))

    def whole(body: Column) -> Column:
        of = lambda own: F.array_join(F.transform(own, lambda s: F.substring(s, 1, NODE_DIGITS)), ",")
        top = lambda own: F.sha2(F.concat(F.char_length(body).cast("string"), F.lit(":"), of(own)), 256)
        sections = F.transform(F.split(body, "\n\n", -1), section)
        return _bound(sections, lambda own: F.concat(F.substring(top(own), 1, ROOT_DIGITS), F.lit(";"), F.array_join(own, ";")))

    return _bound(F.coalesce(text, F.lit("")), whole)


def root(fp: Column) -> Column:
    return F.substring(fp, 1, ROOT_DIGITS)


def sections(fp: Column) -> Column:
    """The strings of a fingerprint's sections, in order."""
    return F.split(F.substring(fp, ROOT_DIGITS + 2, 2**31 - 1), ";", -1)


def paragraphs(section: Column) -> Column:
    """The strings of a section's paragraphs, in order."""
    return F.split(F.substring(section, NODE_DIGITS + 2, 2**31 - 1), ",", -1)


def leaves(fp: Column) -> Column:
    """Distinct leaf hashes of a fingerprint."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(fp, r"^[0-9a-f]+;|[0-9a-f]+[=:]|[;,]", "."), r"\.+"), lambda x: x != ""))


def likeness(a: Column, b: Column, a_leaves: Column, b_leaves: Column) -> Column:
    """From 0 to 1: Dice share of distinct leaves; 1 for equal roots."""
    total = F.size(a_leaves) + F.size(b_leaves)
    dice = 2.0 * F.size(F.array_intersect(a_leaves, b_leaves)) / F.greatest(total, F.lit(1))
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(dice)


def _unlike(a: Column, b: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """``body(x, y, place)`` for the children of two nodes between those that their beginnings and ends have in common.

    Children meet by place; where one node has more of them the other's child
    is null.  The nodes must differ.
    """

    def same(x: Column, y: Column) -> Column:
        return F.array_position(F.zip_with(x, y, lambda u, v: u.eqNullSafe(v)), False).cast("int") - 1

    def of(both: Column) -> Column:
        a, b, first = both["a"], both["b"], both["first"]
        last = F.least(same(F.reverse(a), F.reverse(b)), F.size(a) - first, F.size(b) - first)
        middle = lambda x, last: F.slice(x, first + 1, F.size(x) - first - last)
        pairs = _bound(last, lambda n: F.zip_with(middle(a, n), middle(b, n), lambda x, y: F.struct(x.alias("x"), y.alias("y"))))
        return F.transform(pairs, lambda pair, i: body(pair["x"], pair["y"], first + i))

    held = F.struct(a.alias("a"), b.alias("b"))
    return _bound(held, lambda h: _bound(F.struct(h["a"].alias("a"), h["b"].alias("b"), same(h["a"], h["b"]).alias("first")), of))


def differing(a: Column, b: Column) -> Column:
    """Places where two trees differ, in order, by descent from the roots: none if the roots are equal.

    At each node, children that both beginnings or both ends have in common are
    passed over; of the rest, those at the same place are compared and entered
    if unequal.  ``"3:0"`` is paragraph 0 of section 3 (from 0, counted in either
    tree); ``"3"`` is a section that only one tree has.
    """
    nowhere = F.array().cast("array<string>")

    def in_section(x: Column, y: Column, at: Column) -> Column:
        deeper = _unlike(paragraphs(x), paragraphs(y), lambda p, q, j: F.when(p.eqNullSafe(q), F.lit(None).cast("string")).otherwise(F.concat_ws(":", at.cast("string"), j.cast("string"))))
        return F.when(x.isNull() | y.isNull(), F.array(at.cast("string"))).when(x == y, nowhere).otherwise(F.array_compact(deeper))

    return F.when(root(a) == root(b), nowhere).otherwise(F.flatten(_unlike(sections(a), sections(b), in_section)))


def with_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, text, next_text``: each row with the text of the next smaller key, the last with the first's.

    Rows go to buckets of the key's range; in a bucket a window finds the next
    row, and a copy of the first row of the following bucket stands guard at
    its end.  So a text moves once and no task sees all rows.  Rows of equal
    keys are ordered by their texts' hashes; null keys come last.
    """
    n = partitions(df.sparkSession) * BUCKETS
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.withColumn("bucket", range_buckets(rows.select("key", "tie"), "key", F.col("tie"), n))
    # In descending order the buckets run from the highest to the lowest.
    down = [F.desc_nulls_last("key"), F.shiftrightunsigned("tie", 1).desc(), F.desc("tie")]
    rank = lambda k, t: F.struct(k.isNotNull(), k, F.shiftrightunsigned(t, 1), t)
    heads = rows.groupBy("bucket").agg(F.max(rank(F.col("key"), F.col("tie"))).alias("head"))
    # One row a bucket: the bucket before it in descending order; the first follows the last.
    order = Window.orderBy(F.desc("bucket"))
    before = heads.select("bucket", "head", F.lag("bucket").over(order).alias("before"), F.min("bucket").over(Window.partitionBy()).alias("last"))
    guards = F.broadcast(before.select(F.col("bucket").alias("of"), F.coalesce("before", "last").alias("to"), "head", F.col("before").isNull().alias("wraps")))
    own = rows.withColumn("guard", F.lit(0))
    placed = rows.join(guards, (rows.bucket == guards.of) & (rank(F.col("key"), F.col("tie")) == F.col("head")))
    guard = placed.select("key", "text", "tie", F.col("to").alias("bucket"), F.lit(1).alias("guard")).dropDuplicates(["bucket"])
    window = Window.partitionBy("bucket").orderBy("guard", *down)
    seen = own.unionByName(guard).select("key", "text", "guard", F.lead("text").over(window).alias("next_text"))
    return seen.where("guard = 0").select("key", "text", "next_text")


def edited_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document's, and their likeness.

    The edited text has its last third (floor of code points) replaced by as
    many first code points of the next document's, or all of it.  Null texts
    count as empty; a lone row follows itself; an empty table gives an empty
    result.  Other columns are ignored.
    """
    near = with_next(df, key, text)
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    # The next text's fingerprint is made again: it would be a third of what moves to the window.
    made = near.select("key", n.cast("long").alias("n_chars"), fingerprint(F.col("text")).alias("fp"), fingerprint(F.col("next_text")).alias("next_fp"), edited.alias("edited"))
    made = made.select("key", "n_chars", "fp", "next_fp", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_fp"))
    made = made.select("*", *[leaves(F.col(c)).alias(f"{c}_leaves") for c in ("fp", "edited_fp", "next_fp")])
    like = lambda c: likeness(F.col("fp"), F.col(c), F.col("fp_leaves"), F.col(f"{c}_leaves"))
    made = made.withColumn("places", differing(F.col("fp"), F.col("edited_fp")))
    return made.select(
        F.col("key").alias(key),
        "n_chars",
        "edited_sha256",
        F.col("fp").alias("fingerprint"),
        F.col("edited_fp").alias("edited_fingerprint"),
        like("edited_fp").alias("near_edited"),
        like("next_fp").alias("near_next"),
        F.size("places").alias("n_differing"),
        F.array_join("places", ",").alias("differing"),
    )
