"""Sharding: size-tiered compaction with an atomically committed manifest.

A store is a folder that driver and executors share:

    data/<transaction>/part-*.parquet     immutable shards
    _manifests/v000000012.json            the shards of version 12

``append`` writes an arrival as small shards and commits a version that adds
them. ``compact`` groups shards that are not full by size tier (powers of
``FANOUT``); a tier with ``FANOUT`` runs or more is merged into files of about
``TARGET_BYTES`` and a version with the merged files in place of the old ones is
committed, until no tier is ripe. A row is rewritten once per tier that it climbs,
so O(log(target / arrival)) times. Merging coalesces scan partitions: no shuffle.

A manifest holds what its version adds and removes, and every ``FULL_EVERY``-th the whole
list, so a commit writes little and a reader follows a few manifests. It is written aside
and then renamed to the next version's name, which fails if another writer has taken it:
readers see a whole version or none. That needs an atomic rename without overwriting, as HDFS
and local files have; on an object store without one, commits need its put-if-absent in the
rename's place. A failed job leaves files that no manifest names; ``vacuum``
removes those older than its grace period, which must exceed the longest write, and a commit
checks that the files it names are still there. The driver handles file names and sizes only; a lost executor's task writes its file
again under Spark's commit protocol.

Defined cases: nulls, empty and very long texts, repeated rows and extra columns
are stored as they are; an empty arrival adds no shards; an empty store reads as
no rows of the given schema.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import read_table, shared_dir

TARGET_BYTES = 128 << 20
FANOUT = 4
#: Size of tier 0.
BASE_BYTES = 1 << 20
ARRIVALS = 8
FULL_EVERY = 16
#: Files younger than this may be a writer's that has not committed yet.
GRACE_SECONDS = 7 * 24 * 3600
#: Shards whose list (about 100 bytes each) is broadcast, and salts of a longer list's join.
BROADCAST_SHARDS = 20_000
SALTS = 64
_ARRIVAL = "_turnmill_arrival"


class Conflict(RuntimeError):
    """Another writer has committed the version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target_bytes, fanout
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self._fs.mkdirs(self._path("_manifests"))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    # -- manifests ---------------------------------------------------------
    def version(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("_manifests"))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"_manifests/v{version:09d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def shards(self, version: int | None = None) -> list[dict]:
        """The shards of a version: id, path below the root, bytes and tier."""
        version = self.version() if version is None else version
        steps = []
        while version:
            steps.append(self._manifest(version))
            if "all" in steps[-1]:
                break
            version -= 1
        found: dict[int, dict] = {}
        for step in reversed(steps):
            for s in step.get("all", step["add"]):
                found[s["id"]] = s
            for n in step["remove"]:
                found.pop(n, None)
        return list(found.values())

    def commit(self, add: list[dict], remove: list[int], after: int) -> int:
        """Make version ``after`` + 1, which adds and removes shards, or raise Conflict."""
        now = {s["id"]: s for s in self.shards(after)}
        first = max(now, default=-1) + 1
        new = [{**s, "id": first + i} for i, s in enumerate(add)]
        for s in new:
            if not self._fs.exists(self._path(s["path"])):
                raise FileNotFoundError(f"{s['path']} was removed before it was committed")
        manifest = {"version": after + 1, "add": new, "remove": remove}
        if (after + 1) % FULL_EVERY == 0:
            manifest["all"] = [s for n, s in now.items() if n not in set(remove)] + new
        aside = self._path(f"_manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self._conf)
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        never = self.spark.sparkContext._gateway.new_array(kind, 1)
        never[0] = kind.NONE
        try:
            context.rename(aside, self._path(f"_manifests/v{after + 1:09d}.json"), never)
        except Exception as error:
            self._fs.delete(aside, False)
            raise Conflict(f"version {after + 1} is taken") from error
        return after + 1

    def _found(self, folder: str) -> list[dict]:
        """Parquet files below a folder of this store with their sizes, in order of name."""
        found = []
        files = self._fs.listFiles(self._path(folder), True)
        whole = self._fs.makeQualified(self._path("")).toUri().getPath().rstrip("/") + "/"
        while files.hasNext():
            f = files.next()
            path = f.getPath().toUri().getPath()
            if path.endswith(".parquet") and "/_temporary/" not in path:
                found.append({"path": path.removeprefix(whole), "bytes": f.getLen(), "tier": self.tier(f.getLen())})
        return sorted(found, key=lambda s: s["path"])

    def tier(self, size: int) -> int:
        return 0 if size <= BASE_BYTES else 1 + int(math.log(size / BASE_BYTES, self.fanout))

    # -- writing -----------------------------------------------------------
    def append(self, arrival: DataFrame) -> int:
        folder = f"data/{uuid.uuid4().hex}"
        arrival.write.parquet(f"{self.root}/{folder}")
        return self.adopt(folder)

    def adopt(self, folder: str, files: list[dict] | None = None) -> int:
        """Commit the files of a folder below the root, or the given ones of it, as one arrival."""
        files = self._found(folder) if files is None else files
        while True:
            try:
                return self.commit(files, [], self.version())
            except Conflict:
                continue

    def append_split(self, rows: DataFrame, arrivals: int) -> list[int]:
        """Deal rows evenly into arrivals, write all in one pass, commit one by one."""
        folder = f"data/{uuid.uuid4().hex}"
        by = F.pmod(F.monotonically_increasing_id(), F.lit(arrivals))
        rows.withColumn(_ARRIVAL, by).write.partitionBy(_ARRIVAL).parquet(f"{self.root}/{folder}")
        parts: dict[str, list[dict]] = {}
        for s in self._found(folder):
            parts.setdefault(s["path"].rpartition("/")[0], []).append(s)
        return [self.adopt(part, files) for part, files in sorted(parts.items())]

    def ripe(self, shards: list[dict]) -> list[dict]:
        """The runs of the lowest tier with enough of them, or none."""
        open_shards = [s for s in shards if s["bytes"] < self.target / 2]
        for tier in sorted({s["tier"] for s in open_shards}):
            runs = [s for s in open_shards if s["tier"] == tier]
            if len(runs) >= self.fanout:
                return runs
        return []

    def compact(self, schema: StructType) -> int:
        """Merge ripe tiers until there are none; the last committed version."""
        while True:
            at = self.version()
            now = self.shards(at)
            runs = self.ripe(now)
            if not runs:
                return at
            folder = f"data/{uuid.uuid4().hex}"
            files = max(1, round(sum(s["bytes"] for s in runs) / self.target))
            merged = self.spark.read.schema(schema).parquet(*(f"{self.root}/{s['path']}" for s in runs))
            merged.coalesce(files).write.parquet(f"{self.root}/{folder}")
            try:
                self.commit(self._found(folder), [s["id"] for s in runs], at)
            except Conflict:  # someone was faster: the merged files stay unnamed
                self._fs.delete(self._path(folder), True)

    def vacuum(self, grace_seconds: float = GRACE_SECONDS) -> int:
        """Delete data files older than the grace period that the latest version does not name; how many."""
        before = (time.time() - grace_seconds) * 1000
        found = self._found("data")
        named = {s["path"] for s in self.shards()}
        old = [s["path"] for s in found if s["path"] not in named]
        old = [p for p in old if self._fs.getFileStatus(self._path(p)).getModificationTime() <= before]
        for path in old:
            self._fs.delete(self._path(path), False)
        return len(old)

    # -- reading -----------------------------------------------------------
    def read(self, schema: StructType, version: int | None = None, columns: list | None = None) -> DataFrame:
        """The rows of a version, or ``columns`` of them, with shard_id, tier and shard_bytes.

        Columns are computed before rows meet the list of shards. The driver has
        that list anyhow: up to ``BROADCAST_SHARDS`` shards it is broadcast, beyond
        that rows are salted, so that no shard gathers in one task.
        """
        facts = [(s["path"], s["id"], s["tier"], s["bytes"]) for s in self.shards(version)]
        kinds = "_turnmill_name string, shard_id long, tier int, shard_bytes long"
        known = self.spark.createDataFrame(facts, kinds)
        if facts:
            rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/{f[0]}" for f in facts))
            # A task's files of several arrivals have one name: only the path below the root is unique.
            below = F.substring_index(F.col("_metadata.file_path"), "/data/", -1)
            file = F.concat(F.lit("data/"), below).alias("_turnmill_file")
        else:
            rows, file = self.spark.createDataFrame([], schema), F.lit(None).cast("string").alias("_turnmill_file")
        own = [F.col(f"`{c}`") for c in rows.columns if c not in ("shard_id", "tier", "shard_bytes")]
        rows = rows.select(*(columns if columns is not None else own), file)
        if len(facts) <= BROADCAST_SHARDS:
            met = rows.join(F.broadcast(known), F.col("_turnmill_file") == F.col("_turnmill_name"), "left")
        else:
            salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("_turnmill_salt")
            dealt = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_turnmill_n"))
            same = (F.col("_turnmill_file") == F.col("_turnmill_name")) & (F.col("_turnmill_salt") == F.col("_turnmill_n"))
            met = rows.select("*", salt).join(dealt, same, "left").drop("_turnmill_n", "_turnmill_salt")
        return met.drop("_turnmill_file", "_turnmill_name")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in ARRIVALS parts, are compacted, and are read back by shard.

    One row per document: doc_id, its shard, the shard's tier and bytes, the
    committed version and the CRC of the text as read back.
    """
    docs = read_table(spark, sf_dir, "documents")
    store = ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    store.append_split(docs, ARRIVALS)
    version = store.compact(docs.schema)
    store.vacuum(grace_seconds=0)  # the store is this query's own: nobody else writes
    columns = [F.col("doc_id"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32")]
    return store.read(docs.schema, version, columns).withColumn("version", F.lit(version))
