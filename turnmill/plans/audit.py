"""Audit of a judge: a sheet for people, their agreement, and relabels by another model or a rule.

A run's transcripts are a table; what is audited is a bounded sample of them, so
sheets and relabels are plain files of the driver.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import judging, sampling, stats
from ..sources.tables import read_transcript
from .rules import Limits

VALID = ("ACCEPTABLE", "BORDERLINE", "UNACCEPTABLE")
TRANSCRIPTS = "judge_transcripts.jsonl"
SHEET, SAMPLE = "audit_sample.md", "audit_sample.jsonl"
#: Longest part of a text on the sheet.
SHOWN = 2000
# How a sheet names a pair, the judge's verdict and a person's.
_PAIR = re.compile(r"^## Pair (\d+)\n", re.M)
_JUDGE, _HUMAN = (re.compile(rf"\*\*{name} verdict:\*\*\s*([A-Za-z_]+)") for name in ("Judge", "Your"))


def _lines(path: Path) -> list[dict]:
    return [json.loads(x) for x in path.read_text(encoding="utf-8").splitlines() if x.strip()]


def _write_lines(path: Path, rows: list[dict]) -> None:
    path.write_text("".join(json.dumps(r) + "\n" for r in rows), encoding="utf-8")


def audited(spark: SparkSession, run: Path, n: int = 100, seed: int = 42) -> DataFrame:
    """(band, judge_verdict, prompt_b, response_a) of the judge's calls that people are to check."""
    calls = read_transcript(spark, f"file://{(run / TRANSCRIPTS).resolve()}")
    calls = calls.withColumn("_key", F.md5(F.concat_ws("\n", "prompt", "reply")))
    part = text.prompt_parts(F.col("prompt"))
    picked = sampling.audit_sample(calls, "_key", n, seed).orderBy("_key")
    return picked.select(
        F.coalesce("band", F.lit("unknown")).alias("band"), text.verdict(F.col("reply")).alias("judge_verdict"),
        part["prompt_b"].alias("prompt_b"), part["response_a"].alias("response_a"),
    )


def sheet(rows: list[dict]) -> str:
    """Markdown with the judge's verdict and an open line for a person's, pair by pair."""
    quote = lambda t: "> " + t[:SHOWN].replace("\n", "\n> ")
    lines = ["# Audit sample", "", f"{len(rows)} pairs. Put one of {', '.join(VALID)} in place of `_` after Your verdict.", ""]
    for r in rows:
        lines += [
            f"## Pair {r['id']}", f"- **Band:** {r['band']}", f"- **Judge verdict:** {r['judge_verdict']}", "", "**PROMPT_B:**", "",
            quote(r["prompt_b"]), "", "**RESPONSE:**", "", quote(r["response_a"]), "", "**Your verdict:** _", "", "---", "",
        ]
    return "\n".join(lines)


def read_sheet(filled: str) -> list[tuple[int, str, str]]:
    """(pair, judge's verdict, person's verdict) of a sheet; an open line is an underscore."""
    parts = _PAIR.split(filled)[1:]
    found = []
    for pair, body in zip(parts[::2], parts[1::2]):
        judge, human = _JUDGE.search(body), _HUMAN.findall(body)
        found.append((int(pair), judge.group(1).upper() if judge else "UNKNOWN", human[-1].upper() if human else "_"))
    return found


def write_sample(spark: SparkSession, run: Path, n: int = 100, seed: int = 42) -> Path:
    """The sheet and its rows as JSON lines; the sheet's path."""
    rows = [{"id": i, **r.asDict()} for i, r in enumerate(audited(spark, run, n, seed).collect(), 1)]  # n rows at most
    if not rows:
        raise ValueError(f"no calls of kind h5 in {run / TRANSCRIPTS}")
    _write_lines(run / SAMPLE, rows)
    (run / SHEET).write_text(sheet(rows), encoding="utf-8")
    return run / SHEET


def score(run: Path, limits: Limits = Limits()) -> dict:
    """Agreement of the people's verdicts with the judge's, pair by pair."""
    rows = read_sheet((run / SHEET).read_text(encoding="utf-8"))
    labelled = [r for r in rows if r[2] in VALID]
    both = [r for r in labelled if r[1] in VALID]
    agree = sum(judge == human for _, judge, human in both)
    rate = agree / len(both) if both else None
    verdict = "no pair has two verdicts" if rate is None else "validated" if rate >= limits.agreement else "not validated"
    return {
        "total": len(rows), "labelled": len(labelled), "unlabelled": len(rows) - len(labelled),
        "skipped_judge_unknown": len(labelled) - len(both), "auditable": len(both), "agreements": agree, "agreement": rate, "verdict": verdict,
    }


def _compared(rows: DataFrame, other: str) -> dict:
    got = stats.agreement(rows, "judge_verdict", other, VALID).first()
    pairs = rows.where(F.col("judge_verdict").isin(*VALID) & F.col(other).isin(*VALID)).groupBy("judge_verdict", other).count()
    unknown = rows.agg(*(F.count_if(~F.col(c).isin(*VALID)).alias(c) for c in ("judge_verdict", other))).first()
    return {
        "n_total": rows.count(), "n_auditable": got.n_auditable, "agreements": got.agreements, "agreement_rate": got.rate,
        "n_judge_unknown": unknown[0], "n_other_unknown": unknown[1],
        "confusion": {f"{r[0]}->{r[1]}": r[2] for r in pairs.orderBy("judge_verdict", other).collect()},
    }


def _sample(spark: SparkSession, run: Path) -> DataFrame:
    kinds = "id long, band string, judge_verdict string, prompt_b string, response_a string"
    return spark.createDataFrame([tuple(r[k.split()[0]] for k in kinds.split(", ")) for r in _lines(run / SAMPLE)], kinds)


def relabel(spark: SparkSession, run: Path, ask: Callable[[str], str]) -> dict:
    """The sample judged anew by another model. It shows how far verdicts depend on the model, and validates none."""
    items = _sample(spark, run).withColumn("prompt", judging.substitution_prompt(F.col("prompt_b"), F.col("response_a")))
    kinds = judging.judge(items, ask).select("id", "band", "judge_verdict", F.col("verdict").alias("other_verdict"), "reply")
    rows = [r.asDict() for r in kinds.orderBy("id").collect()]  # the sample
    _write_lines(run / "audit_relabel.jsonl", rows)
    return _compared(spark.createDataFrame(rows, kinds.schema), "other_verdict")


def by_content(rows: DataFrame, pattern: str = text.CONTENT) -> DataFrame:
    """``rows`` (prompt_b, response_a) with a verdict by a rule on content alone: what the pattern meets is unacceptable."""
    flagged = text.has_content(F.col("prompt_b"), pattern) | text.has_content(F.col("response_a"), pattern)
    return rows.withColumn("flagged", flagged).withColumn("rule_verdict", F.when(flagged, "UNACCEPTABLE").otherwise("ACCEPTABLE"))


def content_rule(spark: SparkSession, run: Path) -> dict:
    """The sample relabelled by content. The rule asks another question than the judge: agreement says nothing of it."""
    labelled = by_content(_sample(spark, run)).orderBy("id")
    rows = [r.asDict() for r in labelled.select("id", "judge_verdict", "rule_verdict", "flagged").collect()]
    _write_lines(run / "audit_content_rule.jsonl", rows)
    return {"n_flagged": sum(r["flagged"] for r in rows)} | _compared(labelled, "rule_verdict")
