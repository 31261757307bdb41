"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Built-in functions only. Steps:

1. One scan turns each text into its size in words. Rows alike in all fold into one
   with a number of copies (map-side combined), and many copies are cut into chunks
   of ``CHUNK``. These slim rows are written once and everything else reads them.
2. Targets: sources by code point, null last, weigh 3, 1, 2, repeating, and share
   150 % of all sizes; a target stops at twice its source's size. The fixpoint of
   resharing the excess is a level L with target = min(2 size, L weight): L rises,
   one aggregate at a time, until no further source stops.
3. Blocks: each source's chunks fall by hash into blocks of about ``BLOCK_ROWS`` rows,
   whose order is permuted. They fill the source's quota: whole passes over all blocks
   first, then blocks until the quota is met; in the last one copies in permuted order.
   A source misses its target by half a document at most.
4. Splitting tree: each source's quota of (pass, block) units is split between the halves
   of the output shards, again and again, down to single shards. A node holds
   one quota per source; of its n units exactly n_left go left, and the vector of these is
   drawn from the multivariate hypergeometric distribution, source after source, by
   inversion of the exact probabilities. The tree holds quotas, never units, so nothing
   is sorted at its root. A leaf then takes the next units of each source in permuted
   order: units of a source are disjoint between shards.
5. ``mixed_documents`` writes copies by shard, in ``PIECES`` pieces of it, each shuffled by a hash.

Counts and draws depend on row contents and seeds alone, so reruns agree. Prefix sums
over a source's blocks go by buckets of about ``BUCKET`` of them, so no window holds a
source's rows or blocks. Tree nodes hold a number per source: that is
meant for up to some ten thousand sources.

Defined cases: null texts have size 0 and are never taken; a null source is a
source of its own; null ids stay null; rows that repeat count each, and where the mix
takes some copies of rows with one id, source and text, it repeats one of them; an empty
table or one without words gives targets and takings of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import discard, materialise, read_table, words_of

# Fixed values of the contract.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_ROWS = 512
CHUNK = 64
BUCKET = 4096
#: Words of an output shard.
SHARD_WORDS = 4_000_000
PIECES = 32
SEED = "mix-2"
#: Tree levels between two written tables.
_LEVELS = 6
#: Repeated rows whose hashes (8 bytes each) are broadcast.
BROADCAST_ROWS = 100_000
_SPAN = 1 << 14


def row_hash(docs: DataFrame) -> Column:
    """Tells rows apart by id, text and source."""
    text, source = docs["text"].cast("string"), docs["source"].cast("string")
    return F.xxhash64(docs["doc_id"].cast("long"), F.xxhash64(text), source, F.lit(SEED))


def slim_rows(docs: DataFrame) -> DataFrame:
    """(source, doc_id, size, h, copies) of each distinct row."""
    rows = docs.select(
        docs["source"].cast("string").alias("source"), docs["doc_id"].cast("long").alias("doc_id"),
        F.size(words_of(docs["text"].cast("string"))).cast("long").alias("size"), row_hash(docs).alias("h"),
    )
    return rows.groupBy("source", "doc_id", "size", "h").agg(F.count("*").alias("copies"))


def chunks(base: DataFrame) -> DataFrame:
    """Slim rows with ``chunk`` and its ``m`` copies, ``CHUNK`` at most."""
    last = F.floor((F.col("copies") - 1) / CHUNK)
    span = base.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / _SPAN))).alias("_span"))
    every = F.sequence(F.col("_span") * _SPAN, F.least(last, (F.col("_span") + 1) * _SPAN - 1))
    rows = span.select("*", F.explode(every).alias("chunk")).drop("_span")
    return rows.withColumn("m", F.least(F.lit(CHUNK), F.col("copies") - F.col("chunk") * CHUNK))


def weighed(base: DataFrame) -> DataFrame:
    """(source, source_size, n_rows, n, weight): one row per source, numbered by code point, null last."""
    sizes = base.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("source_size"),
        F.coalesce(F.sum(F.when(F.col("size") > 0, F.col("copies"))), F.lit(0)).alias("n_rows"),
    )
    by = (F.col("source").isNull(), F.col("source"))
    ordered = sizes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("id", F.monotonically_increasing_id())
    fixed = materialise(ordered, "mix-ordered")
    # An id holds its partition above 33 bits and the place in it below: one offset a partition makes it a number.
    sums = fixed.groupBy(F.shiftright("id", 33).alias("part")).agg(F.count("*").alias("in_part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("offset"))
    n = F.col("offset") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    placed = fixed.join(sums, F.shiftright("id", 33) == F.col("part")).withColumn("n", n.cast("long"))
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), (F.col("n") % len(WEIGHTS)).cast("int"))
    return placed.select("source", "source_size", "n_rows", "n", weight.alias("weight"))


def targets(base: DataFrame) -> DataFrame:
    """(source, source_size, n_rows, n, target): one row per source."""
    sources = weighed(base)
    cap = F.col("source_size").cast("double") * MOST
    ratio = cap / F.col("weight")
    total = SHARE * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # with the sources below the level at their caps, the others share the rest
        stopped, weight = sources.agg(F.sum(F.when(ratio <= level, cap)), F.sum(F.when(ratio > level, F.col("weight")))).first()
        risen = (total - (stopped or 0.0)) / weight if weight else level
        if risen <= level:
            break
        level = risen
    return sources.select("source", "source_size", "n_rows", "n", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def _hash(*parts):
    return F.xxhash64(*(F.lit(p) if isinstance(p, (str, int)) else p for p in parts))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def with_block(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """``rows`` (source, h, chunk, size) with their source's figures and their block; null for rows without a word."""
    goal = goal.select(F.col("source").alias("s"), "source_size", "target", "n_blocks", "passes")
    met = rows.join(goal, _same("source", "s")).drop("s")
    block = F.pmod(_hash(F.col("h"), F.col("chunk"), SEED, "block"), F.col("n_blocks"))
    return met.withColumn("block", F.when(F.col("size") > 0, block)).drop("n_blocks")


def row_key() -> Column:
    """Order of chunks within a block that is taken in part."""
    return F.struct(_hash(F.col("h"), F.col("chunk"), SEED, "row").alias("k"), F.col("h").alias("h"), F.col("chunk").alias("c"))


def ranked(blocks: DataFrame) -> DataFrame:
    """``blocks`` (source, block, n_blocks, words) with their ``rank`` from 0 in permuted order and the words ``before`` them."""
    order = _hash(F.col("block"), SEED, "order")
    bucket = F.pmod(_hash(F.col("block"), SEED, "bucket"), F.ceil(F.col("n_blocks") / BUCKET))
    placed = blocks.withColumn("order", order).withColumn("bucket", bucket)
    sums = placed.groupBy(F.col("source").alias("bs"), F.col("bucket").alias("bb")).agg(
        F.sum("words").alias("bw"), F.count("*").alias("bn")
    )
    earlier = Window.partitionBy("bs").orderBy("bb").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "bs", "bb", F.coalesce(F.sum("bw").over(earlier), F.lit(0)).alias("bw"), F.coalesce(F.sum("bn").over(earlier), F.lit(0)).alias("bn")
    )
    within = Window.partitionBy("source", "bucket").orderBy("order", "block")
    words = F.coalesce(F.sum("words").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("rank", F.row_number().over(within) - 1).withColumn("before", words)
    met = placed.join(sums, _same("source", "bs") & (F.col("bucket") == F.col("bb")))
    met = met.withColumn("rank", F.col("rank") + F.col("bn")).withColumn("before", F.col("before") + F.col("bw"))
    return met.drop("bs", "bb", "bw", "bn", "order", "bucket")


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, goal, takings).

    rows: slim chunks with their source's figures and block. goal: one row per source.
    takings: per (source, block) the shards that take all its copies, and the shard
    ``part`` that takes those of chunks below ``cut``, and ``most`` copies of the chunk at it.
    """
    base = materialise(slim_rows(docs), "mix-rows")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = targets(base).withColumn("passes", passes)
    goal = goal.withColumn("n_blocks", F.greatest(F.ceil(F.col("n_rows") / BLOCK_ROWS), F.lit(1)).cast("long"))
    rows = with_block(chunks(base), goal)

    blocks = rows.where("block is not null").groupBy("source", "block").agg(F.sum(F.col("size") * F.col("m")).alias("words"))
    figures = goal.select(F.col("source").alias("s"), "source_size", "target", "passes", "n_blocks", "n")
    blocks = ranked(blocks.join(figures, _same("source", "s")).drop("s"))
    # The last pass takes a block whole (2) where it fits what is left of the quota, in part (1) where it does not.
    left = F.col("target") - F.col("passes") * F.col("source_size") - F.col("before")
    last = F.when(F.col("left") <= 0, 0).when(F.col("words") > F.col("left"), 1).otherwise(2)
    blocks = materialise(blocks.withColumn("left", left).withColumn("last", last), "mix-blocks")

    cut = blocks.where("last = 1").select(F.col("source").alias("s"), F.col("block").alias("b"), "left")
    earlier = Window.partitionBy("source", "block").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("size") * F.col("m")).over(earlier), F.lit(0))
    # Nearest: a copy is in if at least half of it is below the quota.
    most = F.least(F.col("m"), F.floor((F.col("left") - F.col("before")) / F.col("size") + 0.5))
    cuts = (
        rows.where("block is not null")
        .join(cut, _same("source", "s") & (F.col("block") == F.col("b")))
        .withColumn("key", row_key())
        .withColumn("before", before)
        .withColumn("most", most)
        .where("most > 0")
        .groupBy(F.col("source").alias("cs"), F.col("block").alias("cb"))
        .agg(F.max(F.struct("key", "most")).alias("x"))
        .select("cs", "cb", F.col("x.key").alias("cut"), F.col("x.most").alias("most"))
    )
    whole = F.col("passes") + F.when(F.col("last") > 0, 1).otherwise(0)
    in_all = blocks.groupBy(F.col("source").alias("as")).agg(F.count("*").alias("all_blocks"))
    units = blocks.withColumn("n_units", whole).where("n_units > 0").join(in_all, _same("source", "as"))
    units = units.select(
        "source", "block", "n", "last", "passes", "rank", "all_blocks", "words",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_units") - 1)).alias("pass"),
    )
    units = units.withColumn("place", F.col("pass") * F.col("all_blocks") + F.col("rank"))
    partial = (F.col("pass") == F.col("passes")) & (F.col("last") == 1)
    units = units.select("source", "block", "n", "place", "words", partial.alias("partial"))
    takings = split(units).groupBy("source", "block").agg(
        F.sort_array(F.collect_list(F.when(~F.col("partial"), F.col("shard")))).alias("whole"),
        F.max(F.when(F.col("partial"), F.col("shard"))).alias("part"),
    )
    takings = takings.join(cuts, _same("source", "cs") & (F.col("block") == F.col("cb")), "left").select(
        F.col("source").alias("s"), F.col("block").alias("b"), "whole", "part", "cut", "most"
    )
    takings = materialise(takings, "mix-takings")
    discard(blocks)
    return rows, goal, takings


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``good`` among ``total`` are in a draw of ``drawn`` without replacement, for a uniform ``u``.

    Inversion: weights follow from their neighbours' by exact ratios, over all values
    within ten deviations of the mean (beyond, a double holds no probability).
    """
    low = F.greatest(F.lit(0).cast("long"), drawn + good - total)
    high = F.least(good, drawn)
    one = F.greatest(total, F.lit(1).cast("long"))
    mean = drawn * good / one
    width = 10 * F.sqrt(mean * (1 - good / one) * (total - drawn) / F.greatest(total - 1, F.lit(1).cast("long"))) + 10
    a = F.greatest(low, F.floor(mean - width))
    values = F.sequence(a, F.greatest(a, F.least(high, F.ceil(mean + width))))

    def on(w: Column, x: Column) -> Column:
        return w * ((good - x).cast("double") * (drawn - x)) / ((x + 1).cast("double") * (total - good - drawn + x + 1))

    one_, zero = F.lit(1.0), F.lit(0.0)
    weight = F.aggregate(
        values, F.struct(one_.alias("w"), zero.alias("s")),
        lambda acc, x: F.struct(on(acc["w"], x).alias("w"), (acc["s"] + acc["w"]).alias("s")), lambda acc: acc["s"],
    )
    below = F.aggregate(
        values, F.struct(one_.alias("w"), zero.alias("s"), F.lit(0).cast("long").alias("k"), weight.alias("all")),
        lambda acc, x: F.struct(
            on(acc["w"], x).alias("w"), (acc["s"] + acc["w"]).alias("s"),
            (acc["k"] + F.when(acc["s"] + acc["w"] < u * acc["all"], 1).otherwise(0)).alias("k"), acc["all"].alias("all"),
        ),
        lambda acc: acc["k"],
    )
    return F.least(high, a + below)


def _draw(n_left: Column) -> Column:
    """The left child's quotas: hypergeometric source after source, from what the earlier ones leave."""
    q = F.col("q")

    def step(acc: Column, i: Column) -> Column:
        u = F.shiftrightunsigned(_hash(F.col("lo"), F.col("hi"), i, SEED, "tree"), 11) / float(1 << 53)
        own = F.get(q, i)
        x = hypergeometric(acc["rest"], own, acc["open"], u)
        return F.struct((acc["rest"] - own).alias("rest"), (acc["open"] - x).alias("open"), F.concat(acc["out"], F.array(x)).alias("out"))

    start = F.struct(F.col("n").alias("rest"), n_left.alias("open"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(q) - 1), start, step, lambda acc: acc["out"])


def tree(quotas: DataFrame, shards: int) -> DataFrame:
    """(shard, n, q, first): of each source n (quotas: n, units) the shard's quota, and its first unit's place."""
    listed = quotas.agg(F.sort_array(F.collect_list(F.struct("n", "units"))).alias("x")).where(F.size("x") > 0)
    node = listed.select(
        F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), F.transform("x", lambda s: s["n"]).alias("names"),
        F.transform("x", lambda s: s["units"]).alias("q"), F.transform("x", lambda s: F.lit(0).cast("long")).alias("first"),
    )
    written = None
    for level in range((shards - 1).bit_length()):
        if level and level % _LEVELS == 0:
            written, old = materialise(node.repartition("lo"), "mix-tree"), written
            node = written
            if old is not None:
                discard(old)
        n = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        mid = F.floor((F.col("lo") + F.col("hi")) / 2)
        node = node.withColumn("n", n).withColumn("mid", mid)
        n_left = F.round(F.col("n") * (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long")
        # The sequence number keeps the optimizer from writing the draw out at each of its uses.
        node = node.withColumn("l", F.when(F.col("hi") - F.col("lo") > 1, _draw(n_left))).withColumn("_row", F.monotonically_increasing_id())
        left = F.struct(F.col("lo").alias("lo"), F.col("mid").alias("hi"), F.col("l").alias("q"), F.col("first").alias("first"))
        right = F.struct(
            F.col("mid").alias("lo"), F.col("hi").alias("hi"), F.zip_with("q", "l", lambda a, b: a - b).alias("q"),
            F.zip_with("first", "l", lambda a, b: a + b).alias("first"),
        )
        same = F.struct("lo", "hi", "q", "first")
        children = F.when(F.col("hi") - F.col("lo") > 1, F.array(left, right)).otherwise(F.array(same))
        node = node.where("_row >= 0").select("names", F.explode(children).alias("c")).select("names", "c.*")
    leaf = node.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("names", "q", "first")).alias("c"))
    return leaf.select("shard", F.col("c.names").alias("n"), F.col("c.q").alias("q"), F.col("c.first").alias("first")).where("q > 0")


def split(units: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``units`` (n, place, words) with the ``shard`` that the tree deals them to."""
    words = units.agg(F.sum("words")).first()[0] or 0
    shards = max(1, -(-words // shard_words))
    quotas = units.groupBy("n").agg(F.count("*").alias("units"))
    dealt = tree(quotas, int(shards)).select(
        F.col("n").alias("un"), "shard", F.explode(F.sequence("first", F.col("first") + F.col("q") - 1)).alias("at")
    )
    return units.join(dealt, (F.col("n") == F.col("un")) & (F.col("place") == F.col("at"))).drop("un", "at")


def with_takings(rows: DataFrame, takings: DataFrame) -> DataFrame:
    """Rows (source, block, h, chunk, m) with ``whole`` (shards of all copies), and ``part`` and ``extra`` (copies that it takes)."""
    met = rows.join(takings, _same("source", "s") & (F.col("block") == F.col("b")), "left")
    key = row_key()
    extra = F.when(key < F.col("cut"), F.col("m")).when(key == F.col("cut"), F.col("most")).otherwise(0)
    extra = F.when(F.col("part").isNotNull(), F.coalesce(extra, F.lit(0))).otherwise(0)
    none = F.array().cast("array<bigint>")
    return met.withColumn("extra", extra.cast("long")).withColumn("whole", F.coalesce("whole", none)).drop("s", "b", "cut", "most")


def mix_counts(docs: DataFrame) -> DataFrame:
    """Each row with the list of the shards that hold its copies."""
    rows, _, takings = plan(docs)
    got = with_takings(rows, takings)
    each = got.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("copy"))
    shards = F.when(F.col("copy") <= F.col("extra"), F.concat("whole", F.array("part"))).otherwise(F.col("whole"))
    return each.select("doc_id", "size", "source", "source_size", "target", "h", shards.alias("shards"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, in its own columns, by shard and shuffled there."""
    slim, goal, takings = plan(docs)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    has_word = F.coalesce(docs["text"].cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    packed = docs.where(has_word).select(row, docs["source"].cast("string").alias("source"), row_hash(docs).alias("h"))
    repeated = materialise(slim.where("copies > 1 and size > 0").select(F.col("h").alias("rh")).distinct(), "mix-repeated")
    n_repeated = repeated.count()
    if not n_repeated:
        discard(repeated)
    known = F.broadcast(repeated) if n_repeated <= BROADCAST_ROWS else repeated
    single = packed.join(known, F.col("h") == F.col("rh"), "left_anti") if n_repeated else packed
    single = single.select("*", F.lit(0).cast("long").alias("chunk"), F.lit(1).cast("long").alias("m"), F.lit(1).alias("size"))
    met = with_takings(with_block(single, goal), takings)
    shards = F.when(F.col("extra") > 0, F.concat("whole", F.array("part"))).otherwise(F.col("whole"))
    copies = met.select("row", "h", F.posexplode(shards).alias("copy", "shard"))
    if n_repeated:
        # Of rows alike in id, text and source one stands for all; which one does not depend on the partitioning.
        one = packed.join(known, F.col("h") == F.col("rh"), "left_semi").withColumn("rest", F.to_json("row"))
        one = one.groupBy("h").agg(F.min_by("row", "rest").alias("row")).withColumnRenamed("h", "oh")
        again = with_takings(slim.where("copies > 1 and size > 0"), takings)
        part = F.when(F.col("extra") > 0, F.array(F.struct(F.col("part").alias("shard"), F.col("extra").alias("k"))))
        held = F.concat(
            F.transform("whole", lambda s: F.struct(s.alias("shard"), F.col("m").alias("k"))),
            F.coalesce(part, F.array().cast("array<struct<shard:bigint,k:bigint>>")),
        )
        again = again.select("h", "chunk", F.posexplode(held).alias("nth", "x"))
        again = again.select("h", "chunk", "nth", "x.shard", F.explode(F.sequence(F.lit(1).cast("long"), F.col("x.k"))).alias("k"))
        copies = copies.unionByName(
            again.join(one, F.col("h") == F.col("oh")).select("row", "h", _hash(F.col("chunk"), F.col("nth"), F.col("k")).alias("copy"), "shard"),
        )
    key = _hash(F.col("shard"), F.col("h"), F.col("copy"), SEED)
    placed = copies.select("row", "shard", key.alias("key")).withColumn("piece", F.pmod("key", F.lit(PIECES)))
    return placed.repartition("shard", "piece").sortWithinPartitions("shard", "piece", "key").select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix_counts(read_table(spark, sf_dir, "documents"))
    return got.select(
        "doc_id", "size", "source_size", "target",
        (F.size("shards") * F.col("size")).alias("taken"),
        F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"),
    )
