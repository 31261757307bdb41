"""SimHash near-dedup: bit-sliced comparison of 64-bit fingerprints.

1. Each whole text becomes a fingerprint (NumPy over Arrow batches): XXH64 of its
   3-word shingles, and per bit the majority. Written once to the shared folder.
2. Rows fold into distinct fingerprints (map-side combined), so that exact copies
   cost one row however many there are.
3. Candidates: two fingerprints within 2 bits agree on two of four 16-bit bands
   at least, so six band pairs give six 32-bit keys and no link is lost. Of the 32 bits
   outside a key, cut in three, a link leaves one part alike: keys held by more than
   ``BLOCK`` fingerprints are split by these parts, three copies a row instead of one a block.
   What is still larger is dealt into chunks, and each pair of
   chunks is a tile of its own: no key makes a task unbounded.
4. Within a tile the fingerprints stand as vertical bit planes, 64 rows to a
   machine word. Distances of all rows to all others grow plane by plane in
   carry-save counters (two bits and an overflow bit); a block is abandoned once
   every distance in it exceeds the radius. Only a spanning forest of a tile's
   links leaves it, never all pairs.
5. Components by alternating large-star and small-star rounds over the links,
   each round written to the shared folder.

Defined cases: null and empty texts have fingerprint zero and link like others;
a null doc_id gets its component's smallest id (null if there is none); repeated
rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, materialise, parts_for, read_table, slices

SHINGLE = 3
SEED = 42
RADIUS = 2
BANDS = 4
#: Rows of a tile's side.
BLOCK = 1024
#: Rows that go (of 16 bytes each) whose list is broadcast.
BROADCAST_ROWS = 500_000
_PAIRS = list(combinations(range(BANDS), BANDS - RADIUS))
_U1 = np.uint64(1)


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 8192):  # blocks bound the memory of long texts
        bits = np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * ones > len(h), bitorder="little")
    return int(majority.view(np.uint64)[0])


def _fingerprints(batches):
    for batch in slices(batches):
        fp = [fingerprint(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("th"), pa.array(np.array(fp, dtype=np.uint64).view(np.int64))],
            names=["doc_id", "th", "fp"],
        )


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp): hash of the text; fp as the signed long of the same 64 bits."""
    text = docs["text"].cast("string")
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return slim.mapInArrow(_fingerprints, "doc_id long, th long, fp long")


def _planes(fps: np.ndarray) -> np.ndarray:
    """Vertical bit planes: [64, ceil(n / 64)] words; bit r of word w is row 64 w + r."""
    width = -(-len(fps) // 64)
    padded = np.zeros(width * 64, dtype=np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little"))
    return packed.view(np.uint64).reshape(64, width)


def links(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with at most ``radius`` (2 or less) differing bits."""
    planes = _planes(right)
    full = ~np.uint64(0)
    rows, words = np.indices((len(left), planes.shape[1])).reshape(2, -1)
    low = np.zeros(len(rows), dtype=np.uint64)
    high, over = low.copy(), low.copy()
    for p in range(64):
        own = (left >> np.uint64(p) & _U1) * full
        x = planes[p][words] ^ own[rows]
        carry = low & x
        low ^= x
        over |= high & carry
        high ^= carry
        if p % 4 == 3:  # abandon the words in which every row is beyond the radius
            gone = over | (high & low) if radius == 2 else over | high if radius == 1 else over | high | low
            alive = gone != full
            if not alive.all():
                rows, words, low, high, over = (a[alive] for a in (rows, words, low, high, over))
                if not len(rows):
                    break
    near = ~(over | (high & low) if radius == 2 else over | high if radius == 1 else over | high | low)
    bits = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, r = np.nonzero(bits)
    i, j = rows[k], words[k] * 64 + r
    real = j < len(right)
    return i[real], j[real]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n vertices the smallest vertex linked to it, directly or not."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def _tile_links(left: np.ndarray, right: np.ndarray | None):
    """A spanning forest of the links of one tile as (fingerprint, fingerprint)."""
    if right is None:
        every = left
        i, j = links(left, left)
    else:
        every = np.concatenate([left, right])
        i, j = links(left, right)
        j = j + len(left)
    root = forest(len(every), i, j)
    child = np.flatnonzero(root != np.arange(len(root)))
    return every[child].view(np.int64), every[root[child]].view(np.int64)


def _compare(batches):
    """Rows sorted by tile (band pair, key, chunk a, chunk b); links of each tile.

    Small tiles with one chunk are compared several at a time: a link between
    two of them is as true as one within.
    """
    names = ("pair", "key", "a", "b", "side", "fp")
    rest: list[np.ndarray] | None = None
    pool: list[np.ndarray] = []
    pooled = 0
    empty = np.empty(0, dtype=np.int64)

    def out(pairs):
        a = np.concatenate([p[0] for p in pairs] or [empty])
        b = np.concatenate([p[1] for p in pairs] or [empty])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

    def flush():
        nonlocal pool, pooled
        made = _tile_links(np.unique(np.concatenate(pool)), None) if pool else (empty, empty)
        pool, pooled = [], 0
        return made

    def tiles(cols, final):
        """Complete tiles of the sorted columns, and what is left over."""
        nonlocal pooled
        pair, key, a, b, side, fp = cols
        if not len(fp):
            return [], cols
        new = np.flatnonzero((np.diff(pair) != 0) | (np.diff(key) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)) + 1
        starts = np.concatenate([[0], new])
        ends = np.concatenate([new, [len(fp)]])
        if not final:
            keep = starts[-1]
            starts, ends = starts[:-1], ends[:-1]
        else:
            keep = len(fp)
        made = []
        several = ends - starts > 1
        for s, e in zip(starts[several], ends[several]):
            values = fp[s:e].view(np.uint64)
            if a[s] != b[s]:
                left = side[s:e] == 0
                if left.any() and not left.all():
                    made.append(_tile_links(values[left], values[~left]))
                continue
            if pooled + len(values) > BLOCK and pool:
                made.append(flush())
            pool.append(values)
            pooled += len(values)
        return made, [c[keep:] for c in cols]

    for batch in batches:
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols)]
        made, rest = tiles(cols, False)
        if made:
            yield out(made)
    made = tiles(rest, True)[0] if rest is not None else []
    made.append(flush())
    yield out(made)


def _band_key(fp: Column, bands: tuple[int, ...]) -> Column:
    width = 64 // BANDS
    key = F.lit(0).cast("long")
    for b in bands:
        part = F.shiftrightunsigned(fp, b * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        key = F.shiftleft(key, width).bitwiseOR(part)
    return key


def _part_key(pair: Column, fp: Column) -> Column:
    """The three parts of the 32 bits outside each band pair, numbered from 1."""
    options = []
    for n, bands in enumerate(_PAIRS):
        rest = _band_key(fp, tuple(b for b in range(BANDS) if b not in bands))
        parts = [F.shiftrightunsigned(rest, low).bitwiseAND(F.lit((1 << size) - 1).cast("long")) for low, size in ((0, 11), (11, 11), (22, 10))]
        options.append((n, F.array(*(F.struct(F.lit(i + 1).alias("part"), p.alias("bits")) for i, p in enumerate(parts)))))
    out = None
    for n, parts in options:
        out = F.when(pair == n, parts) if out is None else out.when(pair == n, parts)
    return out


def _large(keyed: DataFrame, names: list[str]) -> DataFrame:
    """Keys of more than BLOCK rows, with their count; written, as rows are made anew for each use otherwise."""
    counts = keyed.groupBy(*names).count().where(F.col("count") > BLOCK)
    return materialise(counts.select(*(F.col(n).alias(f"l_{n}") for n in names), "count"), "large-keys")


def _meets(names: list[str]) -> Column:
    same = F.lit(True)
    for n in names:
        same = same & (F.col(n) == F.col(f"l_{n}"))
    return same


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """(u, v): links that span every component of the distinct ``fp`` values."""
    keyed = fps.select(
        "fp",
        F.explode(
            F.array(*(F.struct(F.lit(i).alias("pair"), _band_key(F.col("fp"), p).alias("key")) for i, p in enumerate(_PAIRS)))
        ).alias("k"),
    ).select("k.pair", "k.key", "fp")
    names = ["pair", "key"]
    large = _large(keyed, names)
    whole = F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("bits"))
    split = keyed.join(large, _meets(names), "left").withColumn(
        "p", F.explode(F.when(F.col("count").isNull(), F.array(whole)).otherwise(_part_key(F.col("pair"), F.col("fp"))))
    ).select("pair", "key", "p.part", "p.bits", "fp")
    names = ["pair", "key", "part", "bits"]
    n = F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit("chunk")), F.col("n")).cast("int")  # an even deal
    still = _large(split.where("part > 0"), names)
    dealt = (
        split.join(still, _meets(names), "left")
        .select(*names, "fp", n.alias("n"))
        .withColumn("own", own)
        .select(*names, "fp", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
        .select(
            # One number tells tiles of a pair apart as well as key, part and bits do, up to links that are checked anyhow.
            "pair", F.xxhash64("key", "part", "bits").alias("key"),
            F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
            (F.col("own") > F.col("other")).cast("int").alias("side"), "fp",
        )
    )
    tile = ["pair", "key", "a", "b"]
    return dealt.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(_compare, "u long, v long")


def components(edges: DataFrame, max_rounds: int = 60, parts: int | None = None) -> DataFrame:
    """(node, root) for each vertex of (u, v) that is not its component's root; the edges first written in ``parts``.

    Alternating large-star and small-star (Kiveris et al. 2014): each round
    hangs vertices on smaller ones until every component is one star.
    """
    now = materialise(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges", parts=parts
    )

    def mark(df):
        return tuple(df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())

    before = mark(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        parts = parts_for(edges.sparkSession, 2 * before[0])
        both = now.union(now.select("v", "u"))
        # Written tables on both sides of a join let Spark split a hub's rows.
        least = materialise(
            both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")),
            "least", parts=parts,
        )
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct(), "large", parts=parts)
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"), "low", parts=parts)
        small = large.join(low, F.col("u") == F.col("w"))
        step = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("w", "m"))
        after = materialise(
            step.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", parts=parts
        )
        seen = mark(after)
        for old in (now, least, large, low):
            discard(old)
        now = after
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp, root, component_id) for each row of ``docs``."""
    rows = materialise(with_fingerprints(docs), "fingerprints")
    parts = parts_for(docs.sparkSession, rows.count())
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct", parts=parts)
    stars = components(link_fingerprints(distinct.select("fp")), parts=parts)
    hung = materialise(
        distinct.join(stars, F.col("fp") == F.col("node"), "left").select(
            "fp", "low", F.coalesce("root", "fp").alias("root")
        ),
        "hung", parts=parts,
    )
    discard(distinct)
    smallest = materialise(
        hung.groupBy("root").agg(F.min("low").alias("component_id")).withColumnRenamed("root", "r"), "smallest", parts=parts
    )
    named = materialise(
        hung.join(smallest, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "root", "component_id"), "named", parts=parts
    )
    discard(hung)
    discard(smallest)
    found = rows.join(named, F.col("fp") == F.col("f")).select("doc_id", "th", "fp", "root", "component_id")
    found._turnmill_parts = parts
    return found


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    slim = found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return slim.coalesce(found._turnmill_parts)


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: its smallest doc_id.

    Of rows of the group that repeat the kept doc_id one stays, with the smallest hash
    of its text. A group whose rows all lack a doc_id keeps the row with the smallest hash
    of its text.

    What goes is decided on (doc_id, hash of text) alone. Rows with an id and text that goes
    meet that list, a broadcast up to ``BROADCAST_ROWS`` of it; rows alike in both that stand
    more than once are few, and only their texts are shuffled, folded to one row each.
    """
    found = near_duplicates(docs)
    # An id may stand on texts of several groups: a group's survivor is told by its text as well.
    ranked = F.struct((~F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("other"), "th")
    groups = found.groupBy("root").agg(F.min(ranked)["th"].alias("kept_th"), F.min("component_id").alias("kept_id"))
    # Joins of the written slim rows: Spark splits the rows of a hot group.
    groups = materialise(groups.select(F.col("root").alias("kept_root"), "kept_th", "kept_id"), "groups", parts=found._turnmill_parts)
    met = found.select("root", "doc_id", "th").join(groups, F.col("root") == F.col("kept_root"))
    kept = F.col("doc_id").eqNullSafe(F.col("kept_id")) & F.col("th").eqNullSafe(F.col("kept_th"))
    marks = met.groupBy(F.col("doc_id").alias("_turnmill_id"), F.col("th").alias("_turnmill_th")).agg(
        F.max(kept.cast("int")).alias("_turnmill_kept"), F.count("*").alias("_turnmill_n")
    )
    marks = materialise(marks.where("_turnmill_kept = 0 or _turnmill_n > 1"), "dropped", parts=found._turnmill_parts)
    n_marks, n_often = marks.agg(F.count("*"), F.count_if(F.col("_turnmill_kept") == 1)).first()
    some = F.broadcast(marks) if n_marks <= BROADCAST_ROWS else marks
    rows = docs.withColumn("_turnmill_text", F.xxhash64(docs["text"].cast("string")))
    same = rows["doc_id"].cast("long").eqNullSafe(F.col("_turnmill_id")) & (F.col("_turnmill_text") == F.col("_turnmill_th"))
    rows = rows.join(some, same, "left").where("_turnmill_kept is null or _turnmill_kept = 1")
    once = rows.where("_turnmill_n is null").select(*(F.col(f"`{c}`") for c in docs.columns))
    if not n_often:
        return once
    often = rows.where("_turnmill_n is not null").select(
        "_turnmill_id", "_turnmill_th", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_turnmill_row")
    )
    # Which of the rows alike stays does not depend on the partitioning.
    often = often.groupBy("_turnmill_id", "_turnmill_th").agg(F.min_by("_turnmill_row", F.to_json("_turnmill_row")).alias("_turnmill_row"))
    return once.unionByName(often.select("_turnmill_row.*"))
