"""License scan: Aho-Corasick phrases and tags, shunting-yard licence expressions.

``scan_licenses`` finds, in one pass of one Aho-Corasick automaton over the words
of each whole text, notice phrases and identifier tags. The expression that
follows a tag ("MIT OR (GPL-2.0-only WITH Classpath-exception-2.0)") goes through
a shunting-yard parser into postfix form and is evaluated to a permission in
[0, 1]: ``or`` lets the reader choose (maximum), ``and`` binds to both (minimum),
``with`` adds an exception that closes half of the gap to 1. ``score`` is the
minimum over all notices and expressions of a text, 0 where it has none.

Defined cases: a null text counts as empty (no words, no labels, score 0); a null
doc_id stays null; repeated rows give repeated results; an empty table gives an
empty result; a malformed expression keeps its longest well-formed beginning, and
a word of prose after a tag is no licence.
The operator is a narrow map: no shuffle, and memory bounded by one text.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import read_table, slices

# The base phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Phrases of our own.
OWN_PHRASES = {
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx license identifier", "license expression", "licence expression")
#: How freely a text under the licence may be reused; the longest prefix counts.
PERMISSION = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "unlicense": 1.0,
    "cc0": 1.0, "public-domain": 1.0, "cc-by": 0.9, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6,
    "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.2,
    "proprietary": 0.0,
}
UNKNOWN_PERMISSION = 0.1

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double, n_tags long, expression string"
)

# Upper case becomes lower, every other byte outside words a space; bytes from
# 0x80 belong to characters outside ASCII and so to words.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LINE_END = re.compile(r"[\r\n]")
_RANK = {"or": 1, "and": 2, "with": 3}


def canonical(identifier: str) -> str:
    """A licence identifier without its version suffixes: Apache-2.0 is apache-2."""
    name = identifier.lower().rstrip("+")
    for tail in ("-only", "-or-later"):
        name = name.removesuffix(tail)
    name = re.sub(r"(\.0)+$", "", name)
    return re.sub(r"-\d+$", "", name) if name.startswith("cc-by") else name


def permission(label: str) -> float:
    best = max((k for k in PERMISSION if label == k or label.startswith(k + "-")), key=len, default=None)
    return UNKNOWN_PERMISSION if best is None else PERMISSION[best]


def is_identifier(name: str) -> bool:
    """A known licence, or a name that looks like one: with a digit, a hyphen, or in capitals; no word of prose."""
    return permission(canonical(name)) != UNKNOWN_PERMISSION or bool(re.search(r"[0-9-]", name)) or (len(name) > 1 and name.isupper())


def _parse(tokens: list[str]) -> tuple[int, list[str]]:
    """How many tokens the longest well-formed beginning has, and the postfix form of all tokens if that is all."""
    out, stack, operand, open_, longest = [], [], True, 0, 0
    for n, t in enumerate(tokens, 1):
        op = _RANK.get(t.lower())
        if t == "(":
            if not operand:
                break
            stack.append(t)
            open_ += 1
        elif t == ")":
            if operand or not open_:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            open_ -= 1
        elif op:
            if operand:
                break
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= op:
                out.append(stack.pop())
            stack.append(t.lower())
            operand = True
        else:
            if not operand or not (is_identifier(t) or out and stack and stack[-1] == "with"):
                break
            out.append(t)
            operand = False
        if not operand and not open_:
            longest = n
    return longest, out + stack[::-1]


def to_postfix(text: str) -> list[str]:
    """Shunting-yard over the longest well-formed beginning of a line."""
    tokens = [m.group() for m in _TOKEN.finditer(text)]
    longest, _ = _parse(tokens)
    return _parse(tokens[:longest])[1]


def evaluate(postfix: list[str]) -> tuple[float, set[str]]:
    """Permission of a postfix expression and the licences it names."""
    stack: list[float] = []
    labels: set[str] = set()
    exceptions = {i - 1 for i, t in enumerate(postfix) if t == "with"}
    for i, t in enumerate(postfix):
        if t == "or":
            b, a = stack.pop(), stack.pop()
            stack.append(max(a, b))
        elif t == "and":
            b, a = stack.pop(), stack.pop()
            stack.append(min(a, b))
        elif t == "with":
            stack.pop()
            stack.append((1.0 + stack.pop()) / 2)
        elif i in exceptions:
            stack.append(0.0)
        else:
            labels.add(label := canonical(t))
            stack.append(permission(label))
    return stack[-1], labels


_AUTOMATON = None


def _automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        a = ahocorasick.Automaton()
        for kind, phrases in (("base", BASE_PHRASES), ("own", OWN_PHRASES), ("tag", dict.fromkeys(TAGS, ""))):
            for phrase, label in phrases.items():
                a.add_word(f" {phrase} ", (kind, phrase, label))
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def scan_text(text: str | None) -> tuple:
    """The columns of SCHEMA after doc_id, for one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ")
    words = [w for w in words if w]
    line = " " + b" ".join(words).decode("latin-1") + " "
    hits = [(end + 1 - len(v[1]) - 2, v) for end, v in _automaton().iter(line)]
    hits.sort(key=lambda h: h[0])
    at, word, starts = 0, 0, []
    base, labels, scores, tags, tag_starts, said = set(), set(), [], [], [], []
    for start, (kind, phrase, label) in hits:
        word += line.count(" ", at, start)
        at = start
        if kind == "tag":
            tags.append(word + phrase.count(" "))
            tag_starts.append(word)
            continue
        if kind == "base":
            starts.append(word)
            base.add(label)
        labels.add(label)
        scores.append(permission(label))
    if tags:
        spans = [m.span() for m in _WORD.finditer(text)]
        # An expression ends with its line, or where the next tag begins.
        stops = [spans[n][0] for n in tag_starts[1:]] + [len(text)]
        for last, stop in zip(tags, stops):
            at = spans[last][1]
            end = _LINE_END.search(text, at, max(at, stop))
            postfix = to_postfix(text[at : end.start() if end else max(at, stop)])
            if postfix:
                value, named = evaluate(postfix)
                scores.append(value)
                labels |= named
                said.append(" ".join(postfix))
    return (
        len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None,
        ",".join(sorted(base)), ",".join(sorted(labels)), float(min(scores, default=0.0)),
        len(tags), "; ".join(said) or None,
    )


def _scan(batches):
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, SCHEMA.split(", "))])
    for batch in slices(batches):
        rows = [scan_text(t) for t in batch.column("text").to_pylist()]
        columns = list(zip(*rows)) if rows else [()] * (len(schema) - 1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema
        )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: words, base places, labels, expressions and score."""
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return slim.mapInArrow(_scan, SCHEMA)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))
