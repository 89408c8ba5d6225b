"""The thin queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import fingerprint, jaccard_join, manifest, oracles, prefix_trie, secret_scan, sharding, simhash, sp_dropout, suffix_dedup, token_binary, toxicity, url_filter, winnow
from lodestar.llm.common import durable, table
from lodestar.storage import new_path


def op1_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = token_binary.write_tokens(table(spark, sf_dir, "documents"), new_path(spark, "token-files"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_binary.positions(spark, path)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda x: x["order"] < len(secret_scan.BASE))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(r.kind).alias(f"n_{r.kind}") for r in secret_scan.BASE],
        F.sha2(secret_scan.joined_spans(base), 256).alias("base_sha256"),
        secret_scan.joined_spans(F.col("secrets")).alias("spans"),
    )


def op4_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict", "logit")


def op8_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op10_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = sp_dropout.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_chars", F.size("ids").cast("long").alias("n_pieces"), "lossless", "ids")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = durable(prefix_trie.turn_arrays(table(spark, sf_dir, "conversations")), "turns")
    heads = arrays.select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(4)).cast("int")
    own = F.slice("turns", h + 1, F.size("turns"))
    met = arrays.join(heads, F.col("conv_id") - F.col("conv_id") % 20 == F.col("base"), "left")
    rebuilt = met.select("conv_id", F.when(F.col("head").isNull(), own).otherwise(F.concat(F.slice("head", 1, h), own)).alias("turns"))
    return prefix_trie.trie(rebuilt)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = manifest.leaf_of(docs, manifest.FIELDS, {"text": F.replace("text", F.lit("\n"), F.lit(""))})
    even = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    return manifest.verify(docs, offered=F.when(even, tampered))


QUERIES = {f.__name__: f for f in (op1_merkle_fingerprints, op2_token_binary, op3_secret_scan, op4_extendible_sharding, op5_simhash_near_dedup, op6_winnowing_decontamination, op7_url_filter, op8_weak_toxicity, op9_suffix_dedup, op10_sentencepiece_dropout, op11_prefix_trie, op12_jaccard_join, op13_merkle_manifest)}


def __getattr__(name: str):
    """``ORACLE``, made when asked for: one twin holds a fitted model."""
    if name == "ORACLE":
        return oracles.oracle()
    raise AttributeError(name)
