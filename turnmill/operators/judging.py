"""An injected judge behind Arrow batches, with retries, and the text that it is shown.

No judge comes with the engine. ``ask`` is any function from a prompt to a reply;
it raises ``Retry`` for what may pass (rate limits, server faults, timeouts) and
anything else for what will not. ``supplied`` stands in with a table of verdicts.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import verdict

#: Attempts, and seconds before the second one; each wait doubles.
ATTEMPTS = 6
FIRST_WAIT = 1.0
#: Longest part of a text that a judge is shown.
SHOWN = 1500


class Retry(RuntimeError):
    """The call may succeed when it is made again."""


def ask_again(ask: Callable[[str], str], prompt: str, wait: Callable[[float], None] = time.sleep) -> str:
    for attempt in range(ATTEMPTS):
        try:
            return ask(prompt)
        except Retry:
            if attempt == ATTEMPTS - 1:
                raise
            wait(FIRST_WAIT * 2**attempt)
    raise AssertionError("unreachable")


def substitution_prompt(prompt_b: Column, response_a: Column) -> Column:
    """Text that asks whether a reply serves another prompt; ``functions.text.prompt_parts`` reads it back."""
    # The names of the two blocks and of the verdicts.
    cut = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, SHOWN)
    return F.concat(
        F.lit("Would this response serve the prompt below? End with VERDICT: and one of ACCEPTABLE, BORDERLINE, UNACCEPTABLE.\n\nPROMPT_B:\n"),
        cut(prompt_b), F.lit("\n\nRESPONSE:\n"), cut(response_a),
    )


def judge(items: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """``items`` (prompt, ...) with the judge's ``reply`` and its ``verdict``."""
    schema = StructType([*items.schema.fields, StructField("reply", StringType())])

    def run(frames: Iterable[pd.DataFrame]):
        for frame in frames:
            yield frame.assign(reply=[ask_again(ask, p) for p in frame["prompt"]])

    return items.mapInPandas(run, schema).withColumn("verdict", verdict(F.col("reply")))


def supplied(items: DataFrame, verdicts: DataFrame, *key: str) -> DataFrame:
    """``items`` with the verdicts of a table (*key, verdict); UNKNOWN where it has none."""
    return items.join(verdicts.select(*key, "verdict"), list(key), "left").na.fill("UNKNOWN", ["verdict"])
