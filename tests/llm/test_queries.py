"""Registered queries on the smallest tables: the SQL twins, and brute force where SQL has no word for it."""

import hashlib
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from lodestar.llm import queries as Q
from lodestar.llm import simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test data")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))
    assert set(Q.ORACLE) < set(Q.QUERIES)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels", "conversations"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = connection.sql(Q.ORACLE[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in found.fetchall())


def test_op2(spark, texts):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    own, at = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    rows = sorted(Q.op2_token_binary(spark, SF).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == sorted(texts)
    for r in rows:
        ids = np.array([*own.encode(texts[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op4(spark, texts):
    rows = Q.op4_extendible_sharding(spark, SF).collect()
    assert {r.doc_id: r.n_bytes for r in rows} == {k: len(t.encode()) for k, t in texts.items()}
    assert all(r.fits for r in rows)


def test_op5(spark, texts):
    keys = sorted(texts)
    fps = np.array([simhash.fingerprint(texts[k]) for k in keys], np.uint64)
    name = list(range(len(keys)))
    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[:i]) <= 2).tolist():
            a, b = sorted((name[i], name[j]))
            name = [a if x == b else x for x in name]
    rows = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op5_simhash_near_dedup(spark, SF).collect()}
    assert rows == {k: (f"{int(f):016x}", keys[n]) for k, f, n in zip(keys, fps, name)}


def test_op7(spark):
    rows = Q.op7_url_filter(spark, SF).collect()
    bad = ("cheap-pills", "spam-farm", "casino-win", "free-bets", "adult-x", "ads-track")
    free = [r for r in rows if r.rule is None]
    wrong = [r.host for r in free if (r.verdict == "block") != any(b in r.host for b in bad)]
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count() and not wrong


def test_op8(spark, texts):
    rows = Q.op8_weak_toxicity(spark, SF).collect()
    assert len(rows) == len(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_op9(spark, texts):
    bodies = {k: t.encode() for k, t in texts.items()}
    count = Counter(hash(b[i : i + 200]) for b in bodies.values() for i in range(len(b) - 199))
    for r in Q.op9_suffix_dedup(spark, SF).collect():
        b = bodies[r.doc_id]
        step = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 199):
            if count[hash(b[i : i + 200])] > 1:
                step[i] += 1
                step[i + 200] -= 1
        hit = np.cumsum(step)[: len(b)] > 0
        runs = int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum())
        kept = hashlib.sha256(np.frombuffer(b, np.uint8)[~hit].tobytes()).hexdigest()
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(hit.sum()), runs, kept)


def test_op10(spark, texts):
    """Every document against a plain agenda of each chunk."""
    from test_sp_dropout import PATH, naive

    from lodestar.llm import sp_dropout as S

    rows = Q.op10_sentencepiece_dropout(spark, SF).collect()
    assert len(rows) == len(texts) and all(r.lossless and r.n_pieces == len(r.ids) for r in rows)
    model, limit = S.Model(PATH), int(S.RATE * 2.0**64)
    for r in sorted(rows, key=lambda r: r.n_chars)[:120]:
        want, chunks = [], S.CHUNK.findall(" " + texts[r.doc_id]) if texts[r.doc_id] else []
        with np.errstate(over="ignore"):
            name = S.mix(np.array([S.xxhash.xxh64_intdigest(str(r.doc_id).encode())], np.uint64) + np.uint64(S.SEED) * S.GOLDEN)
            for i, c in enumerate(chunks):
                want += naive(model, c, S.mix(name + S.GOLDEN * np.uint64(i))[0], limit)
        assert r.ids == want
