"""The pipeline's stages on a small made-up corpus, against what each must keep."""

import random
from collections import Counter
from pathlib import Path

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, item = text(200), text(40)
    rows = [(i, text(rng.randrange(20, 80))) for i in range(60)]
    rows += [(100, base), (101, base), (102, base.replace(" ", "  ", 3)), (103, base + " more")]
    rows += [(200, text(20) + " " + " ".join(item.split()[5:20]) + " " + text(20))]
    rows += [(300, text(30) + " you idiot moron " + text(5) + " worthless scum")]
    rows += [(400, text(10) + " password=hunter2hunter2 " + text(10)), (500, None), (501, "")]
    docs = [(i, t, "en", "src", len(t or "")) for i, t in rows]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), {i: t for i, t in rows}


def test_stages(spark, folder, tmp_path):
    path, texts = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    columns = docs.columns
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen[name] = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == columns
    ids = {n: sorted(r.doc_id for r in rows) for n, rows in seen.items()}
    assert ids["toxicity"] == sorted(set(texts) - {300})
    assert ids["near_dedup"] == sorted(set(texts) - {300, 101, 102, 103, 501})
    assert ids["decontamination"] == sorted(set(ids["near_dedup"]) - {200})
    assert ids["secrets"] == ids["decontamination"] == ids["sentencepiece"]
    changed = {r.doc_id: r.text for r in seen["secrets"] if r.text != texts[r.doc_id]}
    assert list(changed) == [400] and "[REDACTED]" in changed[400] and "hunter2" not in changed[400]
    assert all(r.n_chars == len(r.text) for r in seen["secrets"] if r.text is not None)
    assert all(r.lossless for r in seen["sentencepiece"])


def test_run(spark, folder):
    rows = pipeline.run(spark, folder[0]).collect()
    assert len(rows) == len(folder[1]) - 6


NAMES = "doc_id long, text string, lang string, source string, n_chars long, _ls_hash string, _ls_key string, secrets string, `key` string, rules string"


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_edges_of_each_stage(spark, folder, name, stage):
    """Null keys, null and empty texts, repeated rows, a long text, clashing columns; and an empty table."""
    path, _ = folder
    rng = random.Random(7)
    long = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(60_000))
    rows = [(1, None), (2, ""), (None, "one line of words that is alone here"), (3, "twice the same words in this text"), (3, "twice the same words in this text"), (4, long), (5, "\n" * 50_000 + "z")]
    full = [(i, t, "en", "s", len(t or ""), "h", "k", "s", "y", "r") for i, t in rows]
    df = spark.createDataFrame(full, NAMES)
    out = stage(spark, df, path)
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
    every = sorted((i is None, i or 0) for i, _ in rows)
    if name == "near_dedup":  # null and empty are alike, and so are rows that repeat
        every = [x for i, x in enumerate(every) if x not in every[:i] and x != (False, 2)]
    assert got == every
    if name != "sentencepiece":
        assert out.columns == df.columns and {tuple(r)[5:] for r in out.collect()} == {tuple("hksyr")}
    empty = stage(spark, df.limit(0), path)
    assert empty.columns == out.columns and empty.count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").is_dir(), reason="no test data")
def test_near_dedup_of_the_tables(spark):
    """Classes of the documents against all pairs of texts: every link at 0.8 joins, nothing else does."""
    from lodestar.llm import simhash

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    keys = sorted(texts)
    sets = [simhash.shingles(texts[k]) for k in keys]
    holders: dict = {}
    for i, own in enumerate(sets):
        for x in own.tolist():
            holders.setdefault(x, []).append(i)
    both = Counter((i, j) for held in holders.values() for n, i in enumerate(held) for j in held[n + 1 :])
    name, links = list(range(len(keys))), 0
    for (i, j), n in both.items():
        if n / (len(sets[i]) + len(sets[j]) - n) >= 0.8:
            links += 1
            a, b = sorted((name[i], name[j]))
            name = [a if x == b else x for x in name]
    assert links > 50
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).select("doc_id").collect()) == sorted(keys[i] for i in set(name))
