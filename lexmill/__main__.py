"""python -m lexmill run | query: the enrichment run over stored tables, or one query of the catalogue, to a report or table."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .catalogue import QUERIES
from .plans.enrichment import Inputs, run_enrichment
from .sources.inputs import seed_keywords
from .stores import Checkpoints


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lexmill", description=__doc__)
    steps = out.add_subparsers(dest="step", required=True)
    run = steps.add_parser("run", help="keywords with metrics, search results and interest")
    run.add_argument("--keywords", required=True, help="comma-separated")
    for name in ("metrics", "serp", "points"):
        run.add_argument(f"--{name}", help="Parquet table")
    run.add_argument("--currency")
    run.add_argument("--resume", help="folder of checkpoints")
    query = steps.add_parser("query", help="a query of the catalogue")
    query.add_argument("name", choices=sorted(QUERIES))
    query.add_argument("sf_dir")
    for p in (run, query):
        p.add_argument("--out", required=True)
        p.add_argument("--format", choices=("csv", "json", "xlsx", "parquet"), default="csv")
        p.add_argument("--root", default="outputs", help="folder that reports stay in")
    return out


def written(rows: DataFrame, args: argparse.Namespace) -> str:
    return sinks.write_table(rows, args.out) if args.format == "parquet" else sinks.write_report(sinks.named(rows), args.out, args.format, args.root)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lexmill").getOrCreate()
    if args.step == "query":
        rows = QUERIES[args.name](spark, args.sf_dir)
    else:
        table = lambda p: spark.read.parquet(p) if p else None
        keywords = seed_keywords(spark.createDataFrame([(args.keywords,)], "raw string")).select("keyword", F.lit("").alias("source_url"))
        checkpoints = Checkpoints(spark, args.resume, {"keywords": args.keywords, "tables": [args.metrics, args.serp, args.points]}) if args.resume else None
        rows = run_enrichment(Inputs(keywords, table(args.metrics), table(args.serp), table(args.points), args.currency), checkpoints)
    print(written(rows, args))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
