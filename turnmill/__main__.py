"""Command line: ``python -m turnmill study-a|study-b|study-c|study-d|audit|costs|query ...``."""

from __future__ import annotations

import argparse
import importlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import costs
from .functions.text import FILTERS
from .operators import chat
from .operators.ordering import numbered
from .plans import audit, registry, reports, studies
from .sources import tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="turnmill")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("study-a", "study-b", "study-c"):
        one = commands.add_parser(name, help="over turns (conv_id, turn, role, text) or raw conversations, as Parquet")
        one.add_argument("table")
        one.add_argument("--n", type=int, default=5000, help="records or conversations to sample")
        one.add_argument("--seed", type=int, default=42)
        one.add_argument("--language", default="English", help="of raw conversations")
        one.add_argument("--cache", help="folder for samples")
        one.add_argument("--out", default="results")
        if name != "study-b":
            one.add_argument("--judge", help="module:function from a prompt to a reply")
        if name == "study-a":
            one.add_argument("--filter", choices=sorted(FILTERS), default="strict")
    one = commands.add_parser("study-d", help="over a personal chat export")
    one.add_argument("export")
    one.add_argument("--out", default="results")
    one.add_argument("--judge", help="module:function from a prompt to a reply")
    one = commands.add_parser("audit", help="of a run's judge calls")
    one.add_argument("step", choices=("sample", "score", "relabel", "content-rule"))
    one.add_argument("--out", default="results")
    one.add_argument("--run", help="a run's folder; else the latest")
    one.add_argument("--n", type=int, default=100)
    one.add_argument("--seed", type=int, default=42)
    one.add_argument("--judge", help="for relabel: module:function from a prompt to a reply")
    one = commands.add_parser("costs", help="thresholds that prices decide")
    one.add_argument("--write", help="folder for the two documents")
    for name, value in vars(costs.Prices()).items():
        one.add_argument("--" + name.replace("_", "-"), type=float, default=value)
    one = commands.add_parser("query", help="run a registered query and write its rows as Parquet")
    one.add_argument("name", choices=sorted(registry.QUERIES))
    one.add_argument("tables")
    one.add_argument("out")
    return top


def function(name: str | None):
    """What ``module:function`` names."""
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def turns_of(spark: SparkSession, path: str, language: str) -> DataFrame:
    """Turns of a table of turns, or of one of raw conversations in ``language``."""
    rows = spark.read.parquet(path)
    return tables.conversation_turns(rows, language) if "conversation" in rows.columns else rows


def export_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(ord, prompt, response): the first answered prompt of each conversation of an export, oldest first."""
    turns = tables.read_export_zip(spark, path)
    first = chat.first_answers(turns.withColumn("conv_id", F.col("ord")))
    when = turns.groupBy(F.col("ord").alias("conv_id")).agg(F.min("created").alias("created"))
    # A single-user file: one window over its conversations is bounded.
    place = F.row_number().over(Window.orderBy(F.col("created").asc_nulls_first(), "conv_id")) - 1
    return first.join(when, "conv_id").withColumn("ord", place.cast("long")).select("ord", "prompt", "response")


def run_study(spark: SparkSession, args: argparse.Namespace) -> None:
    kind = args.command[-1]
    folder = reports.run_folder(args.out, f"study_{kind}")
    frames: dict = {}
    more = {"ask": function(args.judge), "transcripts": f"file://{(folder / audit.TRANSCRIPTS).resolve()}", "frames": frames} if kind != "b" else {}
    if kind == "d":
        figures = studies.study_d(export_prompts(spark, args.export), **more)
    else:
        path = lambda name: args.cache and tables.sample_path(args.cache, name, args.n, args.seed)
        turns = turns_of(spark, args.table, args.language)
        if kind == "a":
            records = tables.cached(spark, path("records"), lambda: chat.sampled_records(turns, args.n, args.seed))
            figures = studies.study_a(numbered(records, "conv_id"), FILTERS[args.filter], seed=args.seed, **more)
        else:
            some = tables.cached(spark, path("turns"), lambda: chat.sampled_turns(turns, args.n, args.seed))
            figures = (studies.study_b if kind == "b" else studies.study_c)(some, seed=args.seed, **more)
    reports.write_run(figures, args.out, vars(args), folder, frames)
    print(json.dumps({"run": str(folder), "outcome": figures["outcome"]}))


def run_audit(spark: SparkSession, args: argparse.Namespace) -> None:
    run = reports.resolve(args.out, args.run)
    if args.step == "sample":
        print(audit.write_sample(spark, run, args.n, args.seed))
    elif args.step == "score":
        print(json.dumps(audit.score(run), indent=2))
    elif args.step == "relabel":
        print(json.dumps(audit.relabel(spark, run, function(args.judge)), indent=2))
    else:
        print(json.dumps(audit.content_rule(spark, run), indent=2))


def run_costs(spark: SparkSession, args: argparse.Namespace) -> None:
    prices = costs.Prices(**{n: getattr(args, n) for n in vars(costs.Prices())})
    print(json.dumps(costs.derived_thresholds(spark, prices), indent=2))
    if args.write:
        folder = Path(args.write)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "cost_model.md").write_text(reports.cost_document(spark, prices), encoding="utf-8")
        (folder / "prefetch_return.md").write_text(reports.prefetch_document(), encoding="utf-8")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("turnmill").getOrCreate()
    if args.command == "query":
        registry.QUERIES[args.name](spark, args.tables).write.parquet(args.out)
    elif args.command == "audit":
        run_audit(spark, args)
    elif args.command == "costs":
        run_costs(spark, args)
    else:
        run_study(spark, args)


if __name__ == "__main__":
    main()
