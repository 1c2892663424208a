"""python -m mediaspark COMMAND STATE [...]: a library over a folder of snapshots.

scan, thumbnails, index, ocr, people, optimize, stats, export, restore and reset.  Exit 0: done; 1: some files failed; 2: bad
arguments, or no model for the command.
"""

from __future__ import annotations

import argparse
import importlib
import os
import sys
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import SparkSession

from .api import MediaLibrary
from .config import EngineConfig
from .operators import clustering, mutations
from .plans.pipeline import ClipStep, OcrStep, file_content, make_thumbnails
from .schemas import Library
from .sources.snapshots import _exists, optimize_after_import, read_snapshot
from .streaming.ingest import scan_directory


def _made(name: str) -> Callable:
    """The function MODULE:NAME."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="mediaspark")
    parser.add_argument(
        "command", choices=("scan", "thumbnails", "index", "ocr", "people", "optimize", "stats", "export", "restore", "reset")
    )
    parser.add_argument("state", help="folder of snapshots")
    parser.add_argument("path", nargs="?", help="image folder for scan, thumbnails, index and ocr; file for export and restore")
    parser.add_argument("--rebuild", action="store_true", help="people: forget all persons and cluster anew")
    parser.add_argument("--eps", type=float, help="people: cosine distance within which faces are neighbours")
    parser.add_argument("--min-samples", type=int, help="people: faces that found a person, at least")
    parser.add_argument("--algorithm", choices=("auto", "dbscan", "hdbscan"), default="auto", help="people: how faces are clustered")
    parser.add_argument("--limit", type=int, help="thumbnails, index, ocr: photos of this run, at most")
    parser.add_argument("--model", help="index, ocr: MODULE:NAME of a function that makes the model")
    parser.add_argument("--out", help="thumbnails: folder that all tasks share")
    parser.add_argument("--yes", action="store_true", help="reset without asking")
    args = parser.parse_args(argv)
    if args.command in ("scan", "thumbnails", "index", "ocr", "export", "restore") and not args.path:
        parser.print_usage(sys.stderr)
        return 2
    if args.command in ("index", "ocr") and not args.model:
        print(f"{args.command}: give --model MODULE:NAME", file=sys.stderr)
        return 2
    if args.command == "thumbnails" and not args.out:
        print("thumbnails: give --out FOLDER", file=sys.stderr)
        return 2
    if args.command == "people" and args.algorithm == "hdbscan":
        print("people: hdbscan is not available, choose auto or dbscan", file=sys.stderr)
        return 2
    if args.command == "scan" and "://" not in args.path and not os.path.isdir(args.path):
        print(f"no such folder: {args.path}", file=sys.stderr)
        return 2
    if args.command == "reset" and not args.yes and input("Forget the whole library? yes/no ").strip() != "yes":
        return 0
    spark = SparkSession.builder.appName("mediaspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    known = _exists(spark, f"{args.state}/_pointers")
    config = EngineConfig.from_env()
    given = {"cluster_eps": args.eps, "cluster_min_samples": args.min_samples}
    config = replace(config, **{k: v for k, v in given.items() if v is not None})
    app = MediaLibrary(read_snapshot(spark, args.state) if known else Library.empty(spark), config)
    report: dict | None = None
    if args.command == "scan":
        app.library, report = scan_directory(app.library, args.path, datetime.now(), app.config)
    elif args.command == "thumbnails":
        app.library, report = make_thumbnails(app.library, args.path, args.out, limit=args.limit)
    elif args.command in ("index", "ocr"):
        step = ClipStep(config, _made(args.model)) if args.command == "index" else OcrStep(_made(args.model))
        content = file_content(spark, args.path)
        app.library, report = step.run(app.library, lambda photos: content(photos if args.limit is None else photos.orderBy("id").limit(args.limit)))
    elif args.command == "optimize":
        print(optimize_after_import(spark, args.state))
    elif args.command == "people" and args.rebuild:
        app.library = clustering.recluster(app.library, app.config, args.algorithm)
        report = {"persons": app.library.persons.count()}
    elif args.command == "people":
        report = app.update_people()
    elif args.command == "restore":
        report = app.restore_knowledge(args.path)
    elif args.command == "export":
        app.export_knowledge(args.path)
    elif args.command == "reset":
        app.library = mutations.reset_library(app.library)
    else:
        app.knowledge_stats().show(vertical=True)
    if report:
        print(", ".join(f"{k}: {v}" for k, v in report.items()))
    if args.command not in ("stats", "export", "optimize"):
        app.save(args.state)
    return 1 if report and report.get("errors") else 0


if __name__ == "__main__":
    sys.exit(main())
