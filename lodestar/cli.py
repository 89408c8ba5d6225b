"""Command line: generate data, run an algorithm, log times, verify against another."""

from __future__ import annotations

import argparse
import secrets
import sys

from pyspark.sql import SparkSession

from lodestar.functions.scalar import parse_dim3, parse_number
from lodestar.model import BENCH, positive
from lodestar.operators.knn import total_checksum
from lodestar.operators.verify import mismatches
from lodestar.plans.algorithms import ALGORITHMS, run
from lodestar.plans.grid import check
from lodestar.plans.runner import bench
from lodestar.sources.vectors import PREPROCESSORS, from_columnar, generate, to_columnar


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("lodestar", description=__doc__)
    out.add_argument("-a", "--algorithm", default="bits", choices=sorted(ALGORITHMS))
    out.add_argument("-n", "--point-count", default="4k", type=parse_number)
    out.add_argument("-q", "--query-count", default="64", type=parse_number)
    out.add_argument("-d", "--dim", default="8", type=parse_number)
    out.add_argument("-k", default="10", type=parse_number)
    out.add_argument("-r", "--repeats", default="1", type=parse_number)
    out.add_argument("-s", "--seed", default=1, type=int, help="0 draws one")
    out.add_argument("-g", "--generator", default="uniform", help="name or name:params")
    out.add_argument("-p", "--preprocessor", default="identity", choices=sorted(PREPROCESSORS))
    out.add_argument("-v", "--verify", choices=sorted(ALGORITHMS), help="compare with this algorithm's result")
    out.add_argument("--deg", default=8, type=int)
    out.add_argument("--block-size", default="256", type=parse_number, help="logged; checked with --strict")
    out.add_argument("--items-per-thread", default="1", type=parse_dim3, help="up to three numbers; logged, checked with --strict")
    out.add_argument("--point-layout", default="row", choices=("row", "column"), help="column: points go through columnar blocks")
    out.add_argument("--query-layout", default="row", choices=("row", "column"))
    out.add_argument("--strict", action="store_true", help="errors for parameters that the original kernels do not have")
    out.add_argument("--header", action="store_true", help="print the names of the log's columns and stop")
    out.add_argument("--no-output", action="store_true", help="neither checksum nor verification")
    return out


def main(args: list[str] | None = None) -> int:
    given = parser().parse_args(args)
    if given.header:
        print(",".join(f.name for f in BENCH))
        return 0
    positive(point_count=given.point_count, query_count=given.query_count, dim=given.dim, k=given.k, repeats=given.repeats, block_size=given.block_size)
    if given.strict:
        check(given.algorithm, given.k, given.block_size, given.items_per_thread, given.deg, given.dim)
    spark = SparkSession.builder.getOrCreate()
    seed = given.seed or secrets.randbits(31) + 1
    points, queries = generate(spark, given.generator, given.point_count, given.query_count, given.dim, seed)
    points, queries = PREPROCESSORS[given.preprocessor](points.persist(), queries.persist())
    if given.point_layout == "column":
        points = from_columnar(to_columnar(points, "point_id", "p"), "point_id", "p").persist()
    if given.query_layout == "column":
        queries = from_columnar(to_columnar(queries, "query_id", "q"), "query_id", "q").persist()
    items = ",".join(map(str, given.items_per_thread))
    log = bench(spark, given.algorithm, points, queries, given.k, given.repeats, given.deg, given.generator, given.preprocessor, given.block_size, items)
    print(",".join(f.name for f in BENCH))
    for row in log.collect():
        print(",".join(f'"{x}"' if isinstance(x, str) and "," in x else f"{x:.16g}" if isinstance(x, float) else str(x) for x in row))
    if given.no_output or not ALGORITHMS[given.algorithm].selects:
        return 0
    found = run(given.algorithm, points, queries, given.k, given.deg)
    print(f"checksum {total_checksum(found)}", file=sys.stderr)
    if given.verify and ALGORITHMS[given.verify].selects:
        wrong = mismatches(run(given.verify, points, queries, given.k, given.deg), found).count()
        print(f"mismatches {wrong}", file=sys.stderr)
        return int(wrong > 0)
    return 0


if __name__ == "__main__":
    sys.exit(main())
