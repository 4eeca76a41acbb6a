"""Command line: python -m loomworks.cli <command> ...  (the stages, the small candidate pipeline, analysis and conversion)."""

from __future__ import annotations

import argparse
import json
import logging
import time
from pathlib import Path

from pyspark.sql import SparkSession

from .config import Config, backend_of
from .plans import runner


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomworks")
    top.add_argument("--log-level", default="INFO")
    top.add_argument("--log-dir", help="also log to <log-dir>/<command>/<time>.log")
    top.add_argument("--config", action="append", default=[], help="YAML; later files win")
    top.add_argument("--base", default="data")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("problems", "skeletons", "code", "ratings", "full", "convert"):
        p = sub.add_parser(name)
        p.add_argument("--mode", choices=("FIM", "L2R"), default="FIM")
        p.add_argument("--num-samples", type=int)
    sub.add_parser("analyze").add_argument("--output-dir", default="analysis")
    for name in ("generate", "score", "filter"):
        p = sub.add_parser(name)
        p.add_argument("source")
        p.add_argument("target")
        p.add_argument("--n", type=int, default=4)
        p.add_argument("--keep-ratio", type=float, default=0.5)
        p.add_argument("--min-code-len", type=int)
    return top


def handlers(folder: str | None, task: str) -> list[logging.Handler]:
    """SNK10: the console and, with a folder, a file for this run."""
    out: list[logging.Handler] = [logging.StreamHandler()]
    if folder:
        at = Path(folder, task, time.strftime("%Y%m%d_%H%M%S") + ".log")
        at.parent.mkdir(parents=True, exist_ok=True)
        out.append(logging.FileHandler(at, encoding="utf-8"))
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=args.log_level, handlers=handlers(args.log_dir, args.command), force=bool(args.log_dir))
    config = Config.from_files(*args.config)
    logging.info("%s with %s", args.command, args.config or "no configuration")
    spark = spark or SparkSession.builder.appName("loomworks").getOrCreate()
    run = runner.Runner(spark, args.base, backend_of(config), config)
    if args.command in ("problems", "full"):
        out = getattr(run, args.command)(args.mode, args.num_samples)
    elif args.command in ("skeletons", "code", "ratings"):
        out = getattr(run, args.command)(args.mode, args.num_samples)
    elif args.command == "convert":
        out = run.convert(args.mode)
    elif args.command == "analyze":
        out = run.analyze(args.output_dir)
    elif args.command == "generate":
        out = runner.generate_candidates(spark, args.source, args.target, args.n)
    elif args.command == "score":
        out = runner.score_file(spark, args.source, args.target)
    else:
        out = runner.filter_file(spark, args.source, args.target, args.keep_ratio, args.min_code_len if args.min_code_len is not None else int(config.get("filters.min_code_len", 16)))
    logging.info("%s: %s", args.command, out)
    if out is not None:
        print(out if isinstance(out, str) else json.dumps(out))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
