"""Packing: first-fit decreasing with a tournament tree, in randomised groups.

1. One pass turns each whole text into token ids (byte-level BPE; id 1 ends a
   document). Full sequences of ``LENGTH`` ids are complete at once: only their
   CRC travels on. What is left of a document, under ``LENGTH`` ids, is its tail.
2. Documents are dealt into groups of about ``GROUP_ROWS`` by a hash, whatever
   their order or source; so the number of groups follows the input and a group
   fits in a task's memory (its tails are 4 kB a row at most). Rows alike in id and text that
   stand more than ``GROUP_ROWS`` times would meet in one: they are counted first, one of them is
   turned into ids, and its copies are dealt like other rows.
3. Within a group tails are taken in order of falling length, and each goes to
   the first bin with room for it. The leaves of a tournament tree are the bins'
   free capacities and each node holds the larger of its two; a descent that
   prefers the left finds the first fitting bin in O(log bins).
4. The emptiest bins are then dissolved: as cuts are free, their pieces fill the
   gaps of ``MIN_GAP`` ids or more in other bins, as long as a bin vanishes whole.

Only a group's last bin or so is padded, beside gaps under ``MIN_GAP``.
``sequence_id`` is group * 2^32 + place, so no counter is shared between tasks.

Defined cases: a null text is empty and becomes the single id 1; a null doc_id
stays null; rows that repeat are packed once each; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, materialise, parts_for, read_table, slices

LENGTH = 2048
GROUP_ROWS = 1024
MIN_GAP = 32
#: Rows that stand more than GROUP_ROWS times (of 24 bytes each) whose list is broadcast.
BROADCAST_ROWS = 100_000
_SPAN = 1 << 16
END_ID = 1
#: The one added token of byte_bpe_50k.json: found in a text before the pattern is, as the tokenizers library does.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: The rank file of the same vocabulary as byte_bpe_50k.json; tests hold both equal.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
_MEMO_ROWS = 400_000
_ENCODERS: dict = {}


class _Split(Exception):
    """A piece that its neighbours' white space may change."""


class Encoder(dict):
    """Ids of texts as little-endian 16-bit strings, with a bounded memo.

    The vocabulary's pattern never matches across a single space that stands
    between two other characters, so the words between such spaces are encoded one
    by one and remembered. Where a piece begins or ends with white space, the whole
    text is encoded at once instead.
    """

    def __init__(self, ranks_path: str):
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.raw = tiktoken.Encoding(
            "packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Split
        ids = np.array(self.raw(" " + piece), dtype="<u2").tobytes()
        if len(self) < _MEMO_ROWS and len(piece) < 64:
            self[piece] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if SPECIAL in text:
            return np.array([SPECIAL_ID], dtype="<u2").tobytes().join(map(self.plain, text.split(SPECIAL)))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        """Ids of a text without the added token."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            try:
                rest = b"".join(map(self.__getitem__, rest))
                return np.array(self.raw(first), dtype="<u2").tobytes() + rest
            except _Split:
                pass
        return np.array(self.raw(text), dtype="<u2").tobytes()


def encoder(ranks_path: str = RANKS) -> Encoder:
    if ranks_path not in _ENCODERS:
        _ENCODERS[ranks_path] = Encoder(ranks_path)
    return _ENCODERS[ranks_path]


def crc(ids: bytes) -> int:
    """CRC-32 of ids as unsigned little-endian 32-bit numbers."""
    return zlib.crc32(np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes())


class Tournament:
    """Bins of equal capacity, and the first one with room in O(log bins)."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, need: int) -> int:
        """The first bin with room for ``need``, whose room shrinks by it."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < need:
                node += 1
        free[node] -= need
        found = node - self.leaves
        node //= 2
        while node:
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
            node //= 2
        return found


def pack_lengths(lengths: list[int], capacity: int = LENGTH, min_gap: int = MIN_GAP) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, length); ``lengths`` are from 1 to ``capacity``."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    tree = Tournament(max(1, len(lengths)), capacity)
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for i in order:
        bins.setdefault(tree.place(lengths[i]), []).append((i, 0, lengths[i]))
    full = [bins[b] for b in sorted(bins)]
    fill = [sum(p[2] for p in b) for b in full]
    donors = sorted(range(len(full)), key=lambda b: (fill[b], -b))
    # The fullest bins take first, so that a bin is rarely filled and then dissolved.
    gaps = {b: capacity - fill[b] for b in reversed(donors) if capacity - fill[b] >= min_gap}
    room = sum(gaps.values())
    for d in donors:
        room -= gaps.pop(d, 0)
        if room < fill[d]:
            break
        pieces, full[d] = full[d], []
        for item, start, length in pieces:
            while length:
                b = next(iter(gaps))
                part = min(length, gaps[b])
                full[b].append((item, start, part))
                fill[b] += part
                start, length, room = start + part, length - part, room - part
                gaps[b] -= part
                if not gaps[b]:
                    del gaps[b]
    return [b for b in full if b]


def _tokenise(ranks_path: str, capacity: int):
    def run(batches):
        encode = encoder(ranks_path)
        end = np.array([END_ID], dtype="<u2").tobytes()
        step = 2 * capacity
        for batch in slices(batches):
            tokens, whole, tails = [], [], []
            for text in batch.column("text").to_pylist():
                ids = encode(text or "") + end
                cut = len(ids) // step * step
                tokens.append(len(ids) // 2)
                whole.append([crc(ids[i : i + step]) for i in range(0, cut, step)])
                tails.append(ids[cut:])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("g"), batch.column("doc_id"), pa.array(tokens, pa.int64()),
                    pa.array(whole, pa.list_(pa.int64())), pa.array(tails, pa.binary()),
                ],
                names=["g", "doc_id", "tokens", "whole", "tail"],
            )

    return run


def _pack_group(capacity: int, min_gap: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["tokens"], r["whole"], r["tail"]))
        base = rows[0]["g"] << 32
        out = []
        n = 0
        for r in rows:
            for k, c in enumerate(r["whole"]):
                out.append((r["doc_id"], k * capacity, capacity, c, r["tokens"], base + n, 0))
                n += 1
        with_tail = [r for r in rows if r["tail"]]
        for pieces in pack_lengths([len(r["tail"]) // 2 for r in with_tail], capacity, min_gap):
            offset = 0
            for i, start, length in pieces:
                r = with_tail[i]
                ids = r["tail"][2 * start : 2 * (start + length)]
                at = len(r["whole"]) * capacity + start
                out.append((r["doc_id"], at, length, crc(ids), r["tokens"], base + n, offset))
                offset += length
            n += 1
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        columns = list(zip(*out)) if out else [()] * len(names)
        return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(names, columns)})

    return run


def pack(docs: DataFrame, capacity: int = LENGTH, group_rows: int = GROUP_ROWS, min_gap: int = MIN_GAP,
         ranks_path: str = RANKS) -> DataFrame:
    """One row per piece of a document in its sequence."""
    groups = max(1, -(-docs.count() // group_rows))
    doc_id, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    slim = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    often = slim.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.count("*").alias("copies"))
    often = materialise(often.where(F.col("copies") > group_rows), "often")
    n_often = often.count()
    kinds = "g long, doc_id long, tokens long, whole array<long>, tail binary"

    def group(*more) -> Column:
        return F.pmod(F.xxhash64("doc_id", "th", F.lit("packing"), *more), F.lit(groups)).alias("g")

    def tokenised(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(_tokenise(ranks_path, capacity), kinds)

    if not n_often:
        discard(often)
        ids = tokenised(slim.select(group(), "doc_id", "text"))
    else:
        known = F.broadcast(often) if n_often <= BROADCAST_ROWS else often
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))
        ids = tokenised(slim.join(known, same, "left_anti").select(group(), "doc_id", "text"))
        one = slim.join(known, same).groupBy("doc_id", "th").agg(F.max("copies").alias("copies"), F.min("text").alias("text"))
        one = tokenised(one.select(F.col("copies").alias("g"), "doc_id", "text")).withColumnRenamed("g", "copies")
        one = one.withColumn("th", F.xxhash64("whole", "tail"))
        spans = one.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / _SPAN))).alias("span"))
        every = F.sequence(F.col("span") * _SPAN, F.least(F.col("copies"), (F.col("span") + 1) * _SPAN) - 1)
        copies = spans.repartition("doc_id", "th", "span").select("*", F.explode(every).alias("copy"))
        ids = ids.unionByName(copies.select(group("copy"), "doc_id", "tokens", "whole", "tail"))
    packed = ids.groupBy("g").applyInArrow(_pack_group(capacity, min_gap), SCHEMA)
    # Pieces take a small part of the bytes of the tails they come from: dealt anew, they are written in few files.
    return packed.repartition("sequence_id").coalesce(parts_for(docs.sparkSession, groups * group_rows))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
