"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "knn_l2_arrow",
    "knn_l2",
    "knn_l2_two_level",
    "knn_l2_heap",
    "knn_l2_radius",
    "knn_l2_radix",
    "knn_pivot",
    "knn_certified_half",
    "knn_l2_partial_arrow",
    "dist_l2",
    "topk_per_group",
    "topk_per_group_two_level",
    "topk_radix",
    "topk_global",
    "sort_asc",
    "bench_optima",
    "bench_fixed_optima",
    "bench_situations",
    "bench_harmonic",
)
#: Points and queries of the large search: 2^30 distances.
LARGE = (1 << 20, 1 << 10, 8, 10)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from lodestar.model import KnnSpec
    from lodestar.operators.knn import knn_join
    from lodestar.plans.queries import QUERIES
    from lodestar.sources.vectors import generate

    spent: dict[str, float] = {}
    for name in HEADLINE:
        for last in (False, True):  # the first run compiles
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if last:
                spent[name] = round(time.perf_counter() - began, 4)
    points, queries, dim, k = LARGE
    near, asked = (df.persist() for df in generate(spark, "uniform", points, queries, dim, seed=1))
    near.count(), asked.count()
    began = time.perf_counter()
    knn_join(near, asked, KnnSpec(k)).write.format("noop").mode("overwrite").save()
    spent["knn_fused_2_30"] = round(time.perf_counter() - began, 4)
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(spent.values()), 4), "unit": "sec", "queries": spent, "distances_per_sec": round(points * queries / spent["knn_fused_2_30"]), "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
