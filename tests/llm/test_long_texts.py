"""A text of a million characters, one without spaces, and one line of one character go through every operator."""

import random

import pytest

from lodestar.llm import fingerprint, secret_scan, sharding, simhash, sp_dropout, suffix_dedup, token_binary, toxicity, winnow

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))) for _ in range(5000)]
    long = " ".join(rng.choice(words) + rng.choice(["", "", "", ".", "\n", "\n\n"]) for _ in range(180_000))[:1_000_000]
    solid = "".join(rng.choice("abcdefghijklmnop0123456789=") for _ in range(200_000))
    rows = [(1, long), (2, solid), (3, "z" * 200_000), (4, "secret=abcdef1 " * 5000), (5, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").persist()


def test_fingerprint(docs):
    rows = {r.doc_id: r for r in fingerprint.edited_pairs(docs).collect()}
    assert rows[1].n_chars == 1_000_000 and 0.5 < rows[1].near_edited < 0.9


def test_secrets(docs):
    rows = {r.doc_id: len(r.secrets) for r in secret_scan.find_secrets(docs).collect()}
    assert rows[4] == 5000 and rows[5] == 0


def test_shards(docs):
    rows = sharding.assign_shards(docs, limit=300_000).collect()
    assert {r.doc_id for r in rows if not r.fits} == {1}


def test_near_duplicates(docs):
    assert {r.doc_id: r.component_id for r in simhash.classes(docs).collect()} == {i: i for i in range(1, 6)}
    assert simhash.keep_one(docs).count() == 5


def test_contamination(spark, docs):
    item = docs.where("doc_id = 1").first().text[500_000:500_400]
    rows = winnow.contamination(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in rows if r.hit_spans} == {1}


def test_toxicity(spark, docs):
    assert {r.predicted for r in toxicity.judge(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()} == {0}


def test_repeated_strings(docs):
    rows = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.deduplicate(docs).collect()}
    assert rows[3] == (200_000, 200_000) and rows[4][1] == rows[4][0] and rows[1] == (1_000_000, 0)


def test_tokens(spark, docs, tmp_path):
    path = token_binary.write_tokens(docs, str(tmp_path / "t"), public_tokenizers.path("byte_bpe_50k.json"))
    assert token_binary.positions(spark, path).count() == 5


def test_pieces(docs):
    assert all(r.lossless for r in sp_dropout.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).collect())
