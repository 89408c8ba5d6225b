"""The benchmark log: CSV scan with what its file names say, CSV sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.scalar import item
from lodestar.model import BENCH

#: The GPU of a host.
GPUS = {"volta05": "V100", "ampere01": "L40", "ampere02": "A100", "hopper01": "H100"}
#: Iterations before this one warm up.
WARM_UP = 10


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log rows with ``hostname, jobid`` from names like ``name-host-123.csv`` (of files or folders), ``GPU`` and the items split."""
    rows = spark.read.schema(BENCH).option("header", True).csv(path).withColumn("_ls_file", F.input_file_name())
    host = F.regexp_extract("_ls_file", r"-([A-Za-z0-9]+)-\d+\.csv(?:/[^/]*)?$", 1)
    gpus = F.create_map(*[F.lit(x) for pair in GPUS.items() for x in pair])
    return rows.withColumns(
        {
            "hostname": F.when(host != "", host),
            "jobid": F.regexp_extract("_ls_file", r"-(\d+)\.csv(?:/[^/]*)?$", 1).try_cast("long"),
            "GPU": F.try_element_at(gpus, host),
            "items_per_thread2": item(F.col("items_per_thread"), 1),
            "items_per_thread3": item(F.col("items_per_thread"), 2),
            "items_per_thread": item(F.col("items_per_thread"), 0),
        }
    ).drop("_ls_file")


def measured(log: DataFrame, *phases: str) -> DataFrame:
    """Rows after warm-up, of some phases if given."""
    rows = log.where(F.col("iteration") >= WARM_UP)
    return rows.where(F.col("phase").isin(*phases)) if phases else rows


#: Rows of a file, about.
FILE_ROWS = 1 << 20


def write_log(log: DataFrame, path: str) -> None:
    """CSV files with a header each, one for about ``FILE_ROWS`` rows: no task reads or writes a large log whole."""
    files = max(1, -(-log.count() // FILE_ROWS))
    log.select([f.name for f in BENCH]).coalesce(files).write.option("header", True).csv(path)
