"""Commands: translate, text, preview, report-summary and a gui stub."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from . import api
from .operators import engines
from .plans.reports import readable

TRANSLATORS = {"argos": lambda: None, "identity": engines.identity, "tag": engines.tag, "prefix": engines.prefix}


def session(verbose: bool = False):
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if verbose else "ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexiforge")
    top.add_argument("--verbose", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("translate", "text"):
        c = commands.add_parser(name)
        c.add_argument("input")
        if name == "translate":
            c.add_argument("output")
        c.add_argument("--source", "--from", dest="source", required=True)
        c.add_argument("--target", "--to", dest="target", required=True)
        c.add_argument("--engine", default="argos")
        c.add_argument("--glossary")
        c.add_argument("--llm-model")
        c.add_argument("--n-ctx", type=int, default=1024)
        c.add_argument("--n-batch", type=int, default=64)
        c.add_argument("--n-threads", type=int, default=2)
        c.add_argument("--policy", default="auto", choices=("off", "auto", "safe", "smart"))
        c.add_argument("--report", action="store_true")
        c.add_argument("--report-json")
        c.add_argument("--translator", default="argos", choices=sorted(TRANSLATORS))
        c.add_argument("--editor", choices=sorted(engines.POST_EDITORS))
    commands.add_parser("preview").add_argument("input")
    commands.add_parser("report-summary").add_argument("reports", nargs="+")
    commands.add_parser("gui")
    return top


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.WARNING)
    try:
        if args.command == "preview":
            print(api.preview_file(args.input).units)
        elif args.command == "gui":
            print("No graphical interface is part of this package.")
        elif args.command == "report-summary":
            print(json.dumps(api.summarize_files(spark or session(args.verbose), args.reports), indent=2, ensure_ascii=False))
        else:
            options = {k: getattr(args, k) for k in ("engine", "glossary", "llm_model", "n_ctx", "n_batch", "n_threads", "policy", "report", "report_json")}
            options |= {"translator": TRANSLATORS[args.translator](), "edit": engines.POST_EDITORS.get(args.editor)}
            api.build_config(args.source, args.target, **{k: options[k] for k in ("engine", "glossary", "llm_model", "n_ctx", "n_batch", "n_threads", "policy")})
            spark = spark or session(args.verbose)
            if args.command == "text":
                done = api.translate_text(spark, args.input, args.source, args.target, **options)
                print(done.text)
            else:
                done = api.translate_file(spark, args.input, args.output, args.source, args.target, **options)
                print(done.output_path)
            for line in done.warnings:
                print(f"Warning: {line}", file=sys.stderr)
            if args.report:
                print(readable(done.report))
    except (ValueError, OSError) as problem:
        print(f"Error: {problem}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
