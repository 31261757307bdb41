"""Text predicates and parsing, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD = 500
# The patterns of the writing filters and of the content flag.
VERBS = (
    r"writ(?:e|ing)|draft|compos(?:e|ing)|generat(?:e|ing)|creat(?:e|ing)|"
    r"re-?writ(?:e|ing)|proof-?read|summar(?:ize|ise|y)|edit|paraphras(?:e|ing)|"
    r"rephras(?:e|ing)|polish|revis(?:e|ing)"
)
OUTPUTS = (
    r"email|e-mail|letter|cover\s+letter|report|essay|message|article|blog|"
    r"post|story|poem|summary|paragraph|memo|script|caption|bio|resume|cv|"
    r"abstract|proposal|press\s+release|speech|review|description"
)
REQUEST = r"please|can you|could you|would you|i need|i want|help me|how do i"
CONTENT = (
    r"\b("
    r"porn(?:o|ographic|ography)?|nsfw|erotic(?:a|ally)?|fetish|kink|"
    r"(?:hand|blow|rim)\s*job|cum(?:ming|shot)?|orgasm|"
    r"masturbat\w+|intercourse|coitus|"
    r"(?:big|tight|wet|hairy|small)?\s*(?:dick|cock|penis|pussy|vagina|clitoris|clit|boobs?|tits?|breasts?|nipples?|ass(?:hole)?|butt)|"
    r"nude|naked|nudity|undress(?:ed|ing)?|"
    r"fuck(?:ing|ed|er)?|shit|bitch|whore|slut|"
    r"sex(?:ual|ually|y)?|"
    r"horny|aroused|moan(?:ing|s)?|"
    r"anal|oral\s*sex|deepthroat|gangbang"
    r")\b"
)


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iU){pattern}")  # cases, words and white space as Unicode has them


def stripped(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def head(text: Column) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, HEAD)


def is_writing_strict(text: Column, verbs: str = VERBS, outputs: str = OUTPUTS) -> Column:
    """A writing verb and a named output in the head; no word bounds, on purpose."""
    return _has(head(text), verbs) & _has(head(text), outputs)


def is_writing_recall(text: Column, verbs: str = VERBS, outputs: str = OUTPUTS, request: str = REQUEST) -> Column:
    return _has(head(text), verbs) | (_has(head(text), outputs) & _has(head(text), request))


FILTERS = {"strict": is_writing_strict, "recall": is_writing_recall}


def has_content(text: Column, pattern: str = CONTENT) -> Column:
    return _has(F.coalesce(text, F.lit("")), pattern)


def normalise(text: Column) -> Column:
    """Lower case, runs of Unicode white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def verdict(reply: Column) -> Column:
    # Fixed value: the mark before a verdict.
    found = F.upper(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?i)VERDICT:\s*([A-Z]+)", 1))
    return F.when(found == "", "UNKNOWN").otherwise(found)


def verdict_score(v: Column) -> Column:
    return F.when(v == "ACCEPTABLE", 1.0).when(v == "BORDERLINE", 0.5).otherwise(0.0)


# Fixed value: how a judge prompt names its two blocks.
_BLOCK = r"(?s)PROMPT_B:\s*\n(.*?)\n\s*\nRESPONSE:\s*\n(.*)$"


def prompt_parts(prompt: Column) -> Column:
    """struct(prompt_b, response_a) of a judge prompt; empty where it does not parse."""
    text = F.coalesce(prompt, F.lit(""))
    part = lambda n: stripped(F.regexp_extract(text, _BLOCK, n))
    return F.struct(part(1).alias("prompt_b"), part(2).alias("response_a"))


def hit_key(key: Column) -> Column:
    """struct(k, t) of a key such as K=5@T=0.8."""
    return F.struct(
        F.regexp_extract(key, r"^K=(\d+)@", 1).cast("int").alias("k"),
        F.regexp_extract(key, r"@T=([0-9.]+)$", 1).cast("double").alias("t"),
    )


def md5_order(seed: int | str, *key: Column) -> Column:
    """Sampling order: md5 of seed and key, the same in every engine and partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key)))
