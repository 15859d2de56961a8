"""Commands: `queries` lists the registered queries, `query` runs one over a folder of tables, `release` publishes a site."""

from __future__ import annotations

import argparse
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogue
from .plans.release import release


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="weftline", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("queries")
    one = commands.add_parser("query")
    one.add_argument("name")
    one.add_argument("tables", help="folder of <table>.parquet")
    one.add_argument("--out", help="Parquet folder for the result; without it some rows are shown")
    site = commands.add_parser("release")
    for name in ("publications", "snapshot", "policy", "folder", "report", "root", "own-prefix", "api-root"):
        site.add_argument(f"--{name}", required=True)
    return out


def content_mark(df: DataFrame) -> tuple:
    """Numbers that tell a table's content, whatever its order and files: aggregated on executors."""
    row = F.to_json(F.struct(*df.columns))
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(row)), F.sum(F.crc32(row.cast("binary")))).first())


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "queries":
        print("\n".join(sorted(catalogue.queries())))
        return
    spark = spark or SparkSession.builder.appName("weftline").getOrCreate()
    if args.command == "query":
        found = catalogue.queries()[args.name](spark, args.tables.rstrip("/"))
        found.write.mode("errorifexists").parquet(args.out) if args.out else found.show(truncate=False)
        return
    publications = spark.read.parquet(args.publications)
    digest = hashlib.sha256(repr(content_mark(publications)).encode()).hexdigest()
    made = release(publications, args.snapshot, args.policy, args.folder, args.report, args.root, args.own_prefix, args.api_root, digest)
    print(f"{made['output']['publication_count']} publications in {args.folder}; report in {args.report}")


if __name__ == "__main__":
    main()
