"""Command line: spark-submit -m tenderlake <command> --data <feeds> --lake <tables> ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tenderlake.plans import medallion as M
from tenderlake.schema import SOURCES
from tenderlake.session import SETTINGS
from tenderlake.sources.feed import preview

_TEXT_FILTERS = ("adjudicatario", "organo", "nif", "objeto", "cpv", "ccaa", "source", "estado")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tenderlake")
    parser.add_argument("--data", default="data", help="folder of the feeds and dimensions")
    parser.add_argument("--lake", default="lake", help="folder of the tables")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("info", "compact", "silver", "index-files", "web-index", "marts"):
        commands.add_parser(name)
    ingest = commands.add_parser("ingest")
    ingest.add_argument("source", choices=SOURCES)
    ingest.add_argument("--overwrite", action="store_true")
    parse = commands.add_parser("parse-file")
    parse.add_argument("path")
    parse.add_argument("--limit", type=int, default=3)
    inspect = commands.add_parser("inspect")
    inspect.add_argument("id")
    inspect.add_argument("--source")
    for name in ("find", "stats"):
        search = commands.add_parser(name)
        for field in _TEXT_FILTERS:
            search.add_argument(f"--{field}")
        search.add_argument("--year", type=int)
        search.add_argument("--min-importe", type=float)
        search.add_argument("--max-importe", type=float)
        search.add_argument("--revisar", action="store_true", dest="solo_revisar")
        search.add_argument("--acuerdo-marco", action="store_true", dest="solo_acuerdo_marco")
        if name == "find":
            search.add_argument("--id")
            search.add_argument("--limit", type=int, default=40)
    return parser


def _filters(args: argparse.Namespace) -> dict:
    names = ("id", *_TEXT_FILTERS, "year", "min_importe", "max_importe", "solo_revisar", "solo_acuerdo_marco")
    return {n: getattr(args, n) for n in names if getattr(args, n, None) not in (None, False)}


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    lake = M.Lake(args.data, args.lake)
    match args.command:
        case "info":
            for source in SOURCES.values():
                print(source.name, lake.feed_folder(source.name), f"{source.coverage_from}+")
        case "parse-file":
            preview(spark, args.path, args.limit).show(args.limit, truncate=False, vertical=True)
        case "ingest":
            print(M.ingest(spark, lake, args.source, overwrite=args.overwrite))
        case "compact":
            M.compact(spark, lake).show()
        case "silver":
            print(M.build_silver(spark, lake))
        case "index-files":
            print(M.index_files(spark, lake))
        case "web-index":
            print(M.export_index(spark, lake))
        case "marts":
            for name, rows in M.build_marts(spark, lake).items():
                print(name, rows)
        case "find":
            M.find(spark, lake, _filters(args), args.limit).show(args.limit, truncate=False, vertical=True)
        case "inspect":
            M.inspect(spark, lake, args.id, args.source).show(20, truncate=False, vertical=True)
        case "stats":
            for block in M.stats(spark, lake, _filters(args)).values():
                block.show(50, truncate=False)


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    builder = SparkSession.builder.appName(f"tenderlake {args.command}")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    run(builder.getOrCreate(), args)


if __name__ == "__main__":
    main()
