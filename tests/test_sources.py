"""Generators, preprocessors, parsers, the log's scan and sink, streams, command line."""

import pytest
from pyspark.sql import functions as F

from lodestar import cli
from lodestar.functions import scalar as S
from lodestar.model import BENCH, PHASES, KnnSpec
from lodestar.plans.runner import bench
from lodestar.sources import benchlog
from lodestar.sources import vectors as V
from lodestar.streaming.knn import knn_stream


def test_parsers(spark):
    assert [S.parse_number(x) for x in ("", "7", "4k", "2M", "1g")] == [0, 7, 4096, 2 << 20, 1 << 30]
    assert S.parse_dim3("4,2k,3,9") == (4, 2048, 3) and S.parse_dim3("") == (1, 1, 1)
    assert S.parse_floats("1,2.5") == [1.0, 2.5] and S.parse_ints("") == []
    for bad in (lambda: S.parse_number("x"), lambda: S.parse_ints("1,a"), lambda: S.parse_floats("1;2")):
        with pytest.raises(ValueError):
            bad()
    df = spark.createDataFrame([("4k", "a,3"), ("x", "5"), ("", None), (None, "1,,7")], "n string, i string")
    rows = df.select(S.number(F.col("n")).alias("n"), *[S.item(F.col("i"), j).alias(f"i{j}") for j in range(3)]).collect()
    assert [r.n for r in rows] == [4096, None, 0, None]
    assert [(r.i0, r.i1, r.i2) for r in rows] == [(1, 3, 1), (5, 1, 1), (1, 1, 1), (1, 1, 7)]


def test_scalars(spark):
    df = spark.createDataFrame([("hopper01", 1.0, 1.0005), ("other", 0.0, 0.0), ("volta05", 1.0, 2.0)], "host string, a double, b double")
    rows = df.select(
        S.floats_per_second(F.col("host")).alias("rate"),
        S.approx_equal(F.col("a"), F.col("b")).alias("near"),
        S.relabel(F.col("host"), {"other": "none"}).alias("label"),
        S.category([(F.col("a") == 0, "zero"), (F.col("b") > 1.5, "far")]).alias("c"),
    ).collect()
    assert [r.near for r in rows] == [True, True, False] and [r.c for r in rows] == ["other", "zero", "far"]
    assert rows[0].rate == 2039 * 1024**3 / 4 and rows[1].rate == 0 and rows[1].label == "none"


def test_generators(spark):
    points, queries = V.generate(spark, "uniform:2,5", 500, 20, 3, seed=4)
    flat = [x for r in points.collect() for x in r.p]
    assert len(flat) == 1500 and all(2 <= x < 5 for x in flat) and queries.count() == 20
    again = [x for r in V.uniform(spark, 500, 3, "2,5", 4).collect() for x in r.p]
    assert flat == again
    values = [x for r in V.normal(spark, 2000, 2, "1,0.5", 1).collect() for x in r.p]
    assert abs(sum(values) / len(values) - 1) < 0.1
    for bad in ("uniform:3,3", "normal:0,0", "uniform:1,2,3", "zipf"):
        with pytest.raises(ValueError):
            V.generate(spark, bad, 5, 5, 2)
    with pytest.raises(ValueError):
        V.uniform(spark, 0, 2)


@pytest.mark.parametrize("name,sign", [("ascending", 1), ("descending", -1)])
def test_preprocessors(spark, name, sign):
    points, queries = V.PREPROCESSORS[name](*V.generate(spark, "uniform", 300, 4, 1, seed=2))
    rows = sorted(points.collect(), key=lambda r: r.point_id)
    assert [r.point_id for r in rows] == list(range(300))
    assert [r.p[0] for r in rows] == sorted((r.p[0] for r in rows), reverse=sign < 0)
    assert {tuple(r.q) for r in queries.collect()} == {(0.0,)}


def test_columnar(spark):
    points = V.uniform(spark, 20, 4, seed=1)
    wide = V.to_columnar(points, "point_id", "p")
    assert wide.count() == 4 and V.to_columnar(points, "point_id", "p", 5).count() > 4
    assert sorted(map(tuple, V.from_columnar(V.to_columnar(points, "point_id", "p", 5), "point_id", "p").collect())) == sorted(map(tuple, points.collect()))


def test_log_round_trip(spark, tmp_path):
    points, queries = V.generate(spark, "uniform", 60, 3, 4)
    log = bench(spark, "bits", points, queries, 5, repeats=2, generator="uniform")
    assert log.columns == [f.name for f in BENCH] and log.count() == 2 * len(PHASES)
    benchlog.write_log(log, str(tmp_path / "out"))
    one = next((tmp_path / "out").glob("*.csv"))
    named = tmp_path / "kselection-hopper01-108.csv"
    named.write_text(one.read_text())
    back = benchlog.read_log(spark, str(tmp_path / "kselection-*.csv"))
    r = back.first()
    assert (r.hostname, r.GPU, r.jobid, r.items_per_thread, r.items_per_thread3) == ("hopper01", "H100", 108, 1, 1)
    assert sorted(x.time for x in back.collect()) == sorted(x.time for x in log.collect())
    assert benchlog.measured(back.withColumn("iteration", F.col("iteration") + 9), "selection").count() == 1


def test_fused_and_distance_runs(spark):
    points, queries = V.generate(spark, "uniform", 60, 3, 4)
    for name, phase in (("fused-regs", "selection"), ("tiled-dist", "distances")):
        spent = {r.phase: r.time for r in bench(spark, name, points, queries, 5).collect()}
        assert spent[phase] > 0 and sum(v > 0 for v in spent.values()) == 1


def test_stream(spark, tmp_path):
    points, queries = V.generate(spark, "uniform", 60, 8, 4)
    queries.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    knn_stream(points, stream, KnnSpec(3), str(tmp_path / "out"), str(tmp_path / "state"), available_now=True).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 24


def test_command_line(spark, capsys):
    assert cli.main(["-a", "bits-sq", "-n", "200", "-q", "4", "-d", "3", "-k", "5", "-v", "serial"]) == 0
    out = capsys.readouterr()
    assert out.out.splitlines()[0] == ",".join(f.name for f in BENCH) and "mismatches 0" in out.err
    with pytest.raises(ValueError):
        cli.main(["-k", "0"])


def _log(spark, n=50):
    rows = [("bits", "uniform", "identity", i, 1024, 64, 8, 256, 10, f"{i % 3},1" if i % 4 else None, 1, "selection", i / 7) for i in range(n)]
    return spark.createDataFrame(rows, BENCH)


def test_log_source(spark, tmp_path):
    from lodestar.sources import logsource as L

    L.register(spark)
    for host, job in (("hopper01", 7), ("volta05", 8)):
        _log(spark).repartition(3).write.format("benchlog").mode("append").save(f"file://{tmp_path}/sub/x-{host}-{job}.csv")
    (tmp_path / "sub" / "_hidden.csv").write_text("nothing")
    (tmp_path / "empty-hopper01-9.csv").write_text("")
    back = spark.read.format("benchlog").load(str(tmp_path))
    assert back.rdd.getNumPartitions() == 6 and back.columns == [f.name for f in BENCH] + ["hostname", "jobid", "file"]
    assert sorted(map(str, back.where("jobid = 8").select(*[f.name for f in BENCH]).collect())) == sorted(map(str, _log(spark).collect()))
    assert {(r.hostname, r.jobid) for r in back.collect()} == {("hopper01", 7), ("volta05", 8)}
    _log(spark, 3).coalesce(1).write.format("benchlog").mode("overwrite").save(f"{tmp_path}/sub/x-volta05-8.csv")
    back = spark.read.format("benchlog").load(str(tmp_path))  # files are listed once a DataFrame
    assert back.where("hostname = 'volta05'").count() == 3 and back.count() == 53
    assert spark.read.format("benchlog").option("hostname", "hopper01").load(str(tmp_path)).count() == 50


def test_log_source_prunes_files_by_host(tmp_path):
    from lodestar.sources import logsource as L

    for name in ("a-hopper01-1.csv", "a-volta05-2.csv", "plain.csv"):
        (tmp_path / name).write_text("algorithm\nbits\n")
    assert len(L.LogReader(str(tmp_path)).partitions()) == 3
    reader = L.LogReader(str(tmp_path), "volta05")
    (one,) = reader.partitions()
    (batch,) = reader.read(one)
    assert batch.to_pylist()[0]["algorithm"] == "bits" and batch.to_pylist()[0]["time"] is None and batch.to_pylist()[0]["jobid"] == 2
    with pytest.raises(FileNotFoundError):
        L.LogReader(str(tmp_path / "no")).partitions()


def test_an_aborted_log_leaves_nothing(spark, tmp_path):
    from lodestar.sources import logsource as L

    L.register(spark)
    fails = _log(spark).repartition(4).withColumn("time", F.when(F.col("iteration") == 13, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("time")))
    with pytest.raises(Exception, match="lost"):
        fails.write.format("benchlog").mode("append").save(str(tmp_path / "x-hopper01-1.csv"))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
    writer = L.LogWriter(str(tmp_path / "y"), [f.name for f in BENCH], False)
    done = writer.write(iter([r.asDict() for r in _log(spark, 2).collect()]))
    assert (tmp_path / "y").is_dir() and not list((tmp_path / "y").glob("part*"))
    writer.abort([done, None])
    assert not list((tmp_path / "y").iterdir())
    with pytest.raises(ValueError):
        L.LogWriter(str(tmp_path), ["time"], False)


def test_large_log_is_many_files(spark, tmp_path, monkeypatch):
    """No task reads the whole log; files are one log, with headers that are no rows."""
    monkeypatch.setattr(benchlog, "FILE_ROWS", 10)
    row = ("bits", "uniform", "identity", 10, 4, 2, 3, 256, 1, "1,1", 1, "selection", 0.5)
    log = spark.createDataFrame([row] * 40, BENCH).repartition(4)
    path = str(tmp_path / "run-ampere02-7.csv")
    benchlog.write_log(log, path)
    assert len(list((tmp_path / "run-ampere02-7.csv").glob("part-*.csv"))) == 4
    back = benchlog.read_log(spark, path)
    assert back.count() == 40 and {(r.hostname, r.jobid, r.time) for r in back.collect()} == {("ampere02", 7, 0.5)}
    benchlog.write_log(log.limit(0), str(tmp_path / "none-ampere02-8.csv"))
    assert benchlog.read_log(spark, str(tmp_path / "none-ampere02-8.csv")).count() == 0
