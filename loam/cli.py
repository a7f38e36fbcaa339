"""Command line: index, add, remove, rebuild, search, preview, status, rules, reconcile, ocr, watch and the tool server."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from loam.api import Tools, clean_exts
from loam.functions.paths import ext_group
from loam.functions.snippet import wrap
from loam.manage import Index, to_json
from loam.plans import search as S
from loam.plans.qlang import QueryError
from loam.server import Server
from loam.session import ship
from loam.sources.store import StoreError
from loam.streaming.catchup import watch


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="loam", description="Full-text search over files.")
    out.add_argument("--index", default="./loam-index", help="folder of the index")
    sub = out.add_subparsers(dest="command", required=True)
    for name in ("index", "add", "remove", "rebuild"):
        sub.add_parser(name).add_argument("root")
    search = sub.add_parser("search")
    search.add_argument("query")
    search.add_argument("-n", "--limit", type=int, default=10)
    search.add_argument("--offset", type=int, default=0)
    search.add_argument("--ext", default="", help="comma-separated extensions, or doc, code or image")
    search.add_argument("--sort", default="relevance")
    preview = sub.add_parser("preview")
    preview.add_argument("path")
    preview.add_argument("query", nargs="?", default="")
    for name in ("status", "reconcile", "ocr", "mcp"):
        sub.add_parser(name)
    watching = sub.add_parser("watch")
    watching.add_argument("--seconds", type=float, help="how long; without it until interrupted")
    watching.add_argument("--interval", type=float, default=2.0)
    rules = sub.add_parser("rules").add_subparsers(dest="action", required=True)
    rules.add_parser("show")
    change = rules.add_parser("set")
    change.add_argument("--exclude-dirs", nargs="*")
    change.add_argument("--extra-text-exts", nargs="*")
    change.add_argument("--max-file-mb", type=int)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("loam").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    index = Index(spark, args.index)
    try:
        if args.command == "search":
            sort = args.sort
            if sort not in S.SORTS:
                print(f"unknown sort {sort!r}, using relevance", file=sys.stderr)
                sort = "relevance"
            exts = ext_group(args.ext) or tuple(clean_exts(args.ext))
            page = index.store.searcher().page(args.query, args.limit, args.offset, exts or None, sort)
            for r in page.hits.collect():  # a page's rows
                print(r.path if sort != "relevance" else f"{r.score:.4f}  {r.path}")
                print("    " + wrap(r.snippet, [(x.start, x.end) for x in r.highlighted], "\033[1m", "\033[0m").replace("\n", " "))
            print(f"{page.total} hits")
        elif args.command == "preview":
            row = index.store.searcher().preview(args.path, args.query).first()
            if row is None:
                print("not in the index", file=sys.stderr)
                return 1
            print(wrap(row.text, [(x.start, x.end) for x in row.highlighted], "\033[1m", "\033[0m"))
        elif args.command == "status":
            print(to_json(index.status()))
        elif args.command == "reconcile":
            print(to_json(index.reconcile()))
        elif args.command == "ocr":
            print(to_json(index.recognise_images()))
        elif args.command == "watch":
            watch(index, args.seconds, args.interval, lambda counts: print(to_json(counts)))
        elif args.command == "mcp":
            Server(Tools(spark, args.index)).serve()
        elif args.command == "rules":
            if args.action == "set":
                index.store.set_rules(exclude_dirs=args.exclude_dirs, extra_text_exts=args.extra_text_exts, max_file_mb=args.max_file_mb)
            print(to_json(index.store.rules()))
        else:
            print(to_json({"index": index.build, "add": index.add, "remove": index.remove, "rebuild": index.rebuild}[args.command](args.root)))
    except (QueryError, StoreError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
