"""Command line: ``python -m gleanframe crawl URL --pages PATH ...`` prints content as JSON lines."""

from __future__ import annotations

import argparse
import sys

from . import __version__


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gleanframe", description="Crawl a corpus of pages and print the content as JSON lines.")
    p.add_argument("--version", action="version", version=__version__)
    c = p.add_subparsers(dest="command").add_parser("crawl", help="crawl from an address")
    c.add_argument("url")
    c.add_argument("--pages", required=True, help="parquet table with url and html")
    c.add_argument("--limit", type=int, default=50)
    c.add_argument("--concurrency", type=int, default=10)
    c.add_argument("--strategy", choices=("shallow", "deep"), default="deep")
    c.add_argument("--format", choices=("markdown", "json", "xml", "xmltei"), default="json")
    c.add_argument("--include", nargs="+", action="extend", help="patterns of links to follow; may be given several times")
    c.add_argument("--exclude", nargs="+", action="extend", help="patterns of links not to follow; may be given several times")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command is None:
        parser().print_help()
        return 0
    from pyspark.sql import SparkSession

    from .plans.engine import Crawler
    from .settings import Settings
    from .sinks.files import print_jsonl

    spark = SparkSession.builder.appName("gleanframe").getOrCreate()
    settings = Settings(link_extraction_strategy=args.strategy, link_extraction_limit=args.limit, include_link_patterns=args.include, exclude_link_patterns=args.exclude, scraping_output_format=args.format, concurrency=args.concurrency)
    with Crawler(spark, spark.read.parquet(args.pages), settings) as crawler:
        print_jsonl(crawler.run(args.url))
    return 0


if __name__ == "__main__":
    sys.exit(main())
