"""Files of a study's figures: headline JSON, summary, documents, figure data, run folder.

These handle one row of figures or a bounded sample, so plain files of the
driver do; tables go out through Spark's writers (``sources.tables``).
"""

from __future__ import annotations

import json
import math
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import costs
from ..sources.tables import write_pareto_csv


def run_folder(root: str | Path, name: str) -> Path:
    """A new folder named by study and time; never one that exists."""
    stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%fZ")
    folder = Path(root) / f"{name}_{stamp}"
    folder.mkdir(parents=True)
    return folder


def resolve(root: str | Path, run: str | None = None) -> Path:
    """The folder of a run: one of that name below ``root``, else the path itself; without a name the latest."""
    if run is None:
        return latest(root)
    return Path(root) / run if (Path(root) / run).exists() else Path(run)


def latest(root: str | Path) -> Path:
    """The run that ``write_run`` last completed."""
    return Path(root) / (Path(root) / "latest.txt").read_text(encoding="utf-8").strip()


def _plain(value):
    """JSON has no NaN: undefined figures are null."""
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def _table(names: list[str], rows) -> list[str]:
    return ["| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |",
            *("| " + " | ".join(map(str, r)) + " |" for r in rows), ""]


def _shown(value) -> str:
    return f"{value:.4f}" if isinstance(value, float) else json.dumps(_plain(value))


def _hit_rows(hits: dict):
    """Rates of the three retrievers by cell, and what the first two gain over chance."""
    cells = {(h["k"], h["t"]): {name: x["rate"] for name in hits for x in hits[name] if (x["k"], x["t"]) == (h["k"], h["t"])} for h in hits["random"]}
    for (k, t), r in sorted(cells.items()):
        lifts = [f"{r[name] - r['random']:+.4f}" for name in ("dense", "tfidf")]
        yield [k, t, *(f"{r[name]:.4f}" for name in ("dense", "tfidf", "random")), *lifts]


def summary(figures: dict) -> str:
    """Markdown: the outcome and what it asks for, then one section for each group of figures."""
    lines = [f"# Study {figures['kind']}", "", f"Outcome: **{figures['outcome']}**", ""]
    action = costs.ACTIONS.get(figures["kind"], {}).get(figures["outcome"])
    if action:
        lines += [f"Next: {action}.", ""]
    for name, group in figures.items():
        if name == "hits":
            names = ["K", "T", "dense", "TF-IDF", "random", "dense lift", "TF-IDF lift"]
            lines += ["## Hits at K and T", "", *_table(names, _hit_rows(group))]
        elif isinstance(group, dict):
            lines += [f"## {name}", "", *_table(["Figure", "Value"], ((k, _shown(v)) for k, v in group.items()))]
    return "\n".join(lines)


def cost_document(spark, prices: costs.Prices | None = None) -> str:
    """Markdown of the cache's economics: prices, derived thresholds, sensitivity."""
    x = prices or costs.Prices()
    found = costs.derived_thresholds(spark, x)
    cells = costs.sensitivity(spark, x).orderBy("c_small", "p_small").collect()  # a literal grid
    return "\n".join([
        "# Cost model and derived thresholds", "", "Costs are shares of one call of the frontier model.", "",
        *_table(["Constant", "Value"], vars(x).items()),
        "## Derived thresholds", "", *_table(["Threshold", "Value"], ((k, _shown(v)) for k, v in found.items())),
        "## Least cache-hit rate", "",
        *_table(["c_small", "p_small", "min_p_cache", "feasible"], ((r.c_small, r.p_small, r.min_p_cache, r.feasible) for r in cells)),
    ])


def prefetch_document() -> str:
    """Markdown of the prefetch return a turn and its grid."""
    rows = {
        "value of a hit": costs.LATENCY_VALUE, "c_speculate": list(costs.C_SPECULATE), "K": list(costs.K_GRID),
        "T_pred": list(costs.T_PRED), "T_serve": list(costs.T_SERVE),
    }
    return "\n".join([
        "# Prefetch return", "", "Return a turn = hit rate x quality x value of a hit - K x c_speculate.", "",
        *_table(["Constant", "Value"], rows.items()),
        "HP4 passes if any cell of the grid returns more than 0.", "",
    ])


def cluster_document(examples: list[dict]) -> str:
    lines = ["# Examples of the largest clusters", ""]
    for e in examples:
        lines += [f"## Cluster {e['cluster']} (size {e['size']})", *("- " + t.replace("\n", " ") for t in e["examples"]), ""]
    return "\n".join(lines)


def recurring_document(pairs: list[dict]) -> str:
    lines = ["# Nearest recurring prompts", ""]
    for p in pairs:
        lines += [f"## Cosine {p['cos']:.3f}", "", f"**New ({p['i']}):** {p['prompt']}", "", f"**Prior ({p['j']}):** {p['prior']}", ""]
    return "\n".join(lines)


#: Frames of a bounded number of rows that become a document: its file, and what writes it.
DOCUMENTS = {"cluster_examples": ("cluster_examples.md", cluster_document), "recurring_pairs": ("recurring_pairs.md", recurring_document)}


def write_run(figures: dict, root: str | Path, config: dict | None = None, folder: Path | None = None, frames: dict | None = None) -> Path:
    """Headline, summary, configuration and frames of a run; the pointer to it and the log come last."""
    folder = folder or run_folder(root, f"study_{figures['kind'].lower()}")
    (folder / "headline_numbers.json").write_text(json.dumps(_plain(figures), indent=2), encoding="utf-8")
    (folder / "summary.md").write_text(summary(figures), encoding="utf-8")
    (folder / "config.json").write_text(json.dumps(_plain(config or {}), indent=2), encoding="utf-8")
    for name, frame in (frames or {}).items():
        if name in DOCUMENTS:
            file, text = DOCUMENTS[name]
            (folder / file).write_text(text([r.asDict() for r in frame.collect()]), encoding="utf-8")
        elif name == "pareto":
            write_pareto_csv(frame, f"file://{folder.resolve()}/pareto.csv")
        else:
            frame.coalesce(1).write.csv(f"file://{folder.resolve()}/figures/{name}.csv", header=True)
    bars = control_bars(figures)
    if bars:
        text = "\n".join(["name,subject,control", *(f"{n},{a},{b}" for n, a, b in bars)])
        (folder / "subset_vs_control.csv").write_text(text + "\n", encoding="utf-8")
    (Path(root) / "latest.txt").write_text(folder.name, encoding="utf-8")
    with open(Path(root) / "decisions.md", "a", encoding="utf-8") as log:
        log.write(f"- {folder.name}: {figures['outcome']}\n")
    return folder


def control_bars(figures: dict) -> list[tuple[str, float, float]]:
    """What study A found for its subject and for the control, by hypothesis."""
    if figures["kind"] != "A":
        return []
    h5 = figures.get("H5", {"best": 0.0, "control": 0.0})
    return [
        ("H1 coverage", figures["H1"]["coverage_median"], figures["H1_control"]["coverage_median"]),
        ("H3 fraction", figures["H3"]["fraction"], figures["H3"]["control"]),
        ("H5 rate", h5["best"], h5["control"]),
    ]


def histograms(values: dict[str, DataFrame], column: str, bins: int = 50) -> DataFrame:
    """(bin, lo, a count for each name) of several frames."""
    out = None
    for name, frame in values.items():
        one = histogram(frame, column, bins).withColumnRenamed("n", name)
        out = one if out is None else out.join(one.drop("lo"), "bin")
    return out.orderBy("bin")


def histogram(values: DataFrame, column: str, bins: int = 50, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(bin, lo, n): counts in equal bins; what lies outside counts in the outermost."""
    at = F.floor((F.col(column) - low) / (high - low) * bins)
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), at)).cast("int")
    counts = values.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    lo = low + F.col("bin") * (high - low) / bins
    return every.join(counts, "bin", "left").select("bin", lo.alias("lo"), F.coalesce("n", F.lit(0)).alias("n"))
