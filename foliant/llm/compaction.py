"""Sharding by size-tiered compaction under a versioned manifest.

Arrivals are appended as they come: each partition of the written rows is a
small immutable Parquet shard. Compaction puts the shards below ``FULL`` of
``target_bytes`` into tiers by size (each ``fan_in`` times larger than the one
below); a tier with ``fan_in`` shards or more is merged, as many of a tier at
once as fit, so a row is rewritten about once a tier at most. An arrival of over
twice the target is split. What comes out has 0.75 to 1.5 times the target, but
for a tier's rest. Whole shards are read and written by one task each; no row is
exchanged. All merges of a round are committed together.

A version of the store is a manifest: a small file that names immutable parts,
each a list of up to ``PART`` shards with their rows and bytes. A commit writes
anew only the parts that lose shards. The manifest is written beside its place
and then renamed to it, without overwriting, so that a version appears whole or
not at all and of two writers one has to try again. That needs a file system with
an atomic rename; on an object store without one, writers have to take turns.
Shards and parts that no manifest names are invisible: what a lost executor or
driver left behind does no harm, and ``vacuum`` removes it.

Defined cases: all rows and columns are kept as they are, nulls, repeated rows,
empty and very long texts too. An append without rows commits a version without
new shards. Columns named like the ones that ``read`` adds (shard, shard_rows,
version) are replaced there. The store talks to Hadoop's file systems through the
driver's JVM, so it doesn't run under Spark Connect.
"""

from __future__ import annotations

import json
import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Merges of one job, and jobs at a time.
WAVE, JOBS = 256, 8
#: Share of the target from which on a shard is left alone; most that a merge or an arrival may have.
FULL, MOST, SPLIT = 0.75, 1.5, 2.0
#: Shards of a part of the manifest, and of a lookup table that is sent to the executors (some 100 bytes each).
PART, SENT = 10_000, 50_000
ADDED = ["shard", "shard_rows", "version"]


class Conflict(Exception):
    """Another writer committed a version that this change can't be put on."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fan_in: int = 4, smallest: int = 1 << 20):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.fan_in, self.smallest = target_bytes, fan_in, smallest
        # a session of its own, since it needs a setting: a union of one-partition tables has one partition for each
        self._own = spark.newSession()
        self._own.conf.set("spark.sql.unionOutputPartitioning", "false")
        jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    # ---- manifests

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests")))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _json(self, name: str) -> dict | list:
        stream = self._fs.open(self._path(f"{self.root}/manifests/{name}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, content: dict | list) -> None:
        out = self._fs.create(self._path(f"{self.root}/manifests/{name}"), False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()

    def manifest(self, version: int | None = None) -> dict:
        """{version, schema, parts, shards: [{path, rows, bytes, part}]}; version 0 is the empty store."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "schema": None, "parts": [], "shards": []}
        head = self._json(f"v{version:08d}.json")
        return {**head, "shards": [{**s, "part": p} for p in head["parts"] for s in self._json(p)]}

    def _commit(self, added: list[dict], removed: set[str], schema: dict | None, tries: int = 20) -> int:
        """Put a change on the latest version and publish the next one."""
        jvm = self.spark.sparkContext._jvm
        for _ in range(tries):
            latest = self.manifest()
            there = {s["path"] for s in latest["shards"]}
            if not removed <= there:
                raise Conflict("shards of this merge are gone from the latest version")
            if latest["schema"] and schema and latest["schema"] != schema:
                raise Conflict("the rows have other columns than the store")
            touched = {s["part"] for s in latest["shards"] if s["path"] in removed}
            loose = [{k: s[k] for k in ("path", "rows", "bytes")} for s in latest["shards"] if s["part"] in touched and s["path"] not in removed]
            loose = sorted(loose + added, key=lambda s: s["path"])
            parts = [p for p in latest["parts"] if p not in touched]
            for at in range(0, len(loose), PART):
                parts.append(f"part-{uuid.uuid4().hex}.json")
                self._put(parts[-1], loose[at : at + PART])
            draft = f".draft-{uuid.uuid4().hex}"
            self._put(draft, {"version": latest["version"] + 1, "schema": latest["schema"] or schema, "parts": parts})
            draft = self._path(f"{self.root}/manifests/{draft}")
            place = self._path(f"{self.root}/manifests/v{latest['version'] + 1:08d}.json")
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(self._conf).getUri(), self._conf)
            keep = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            try:
                context.rename(draft, place, keep)  # fails if the version is there
                return latest["version"] + 1
            except Exception as e:
                self._fs.delete(draft, False)
                if not self._fs.exists(place):
                    raise e
        raise Conflict("other writers were always first")

    # ---- shards

    def _write(self, rows: DataFrame, most_rows: int = 0) -> list[dict]:
        """Write rows as new shards (of ``most_rows`` rows at most, if given); their paths below the root, rows and bytes."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", most_rows).parquet(f"{self.root}/{folder}")
        made = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{folder}").select("_metadata.file_name", "_metadata.file_size").groupBy("file_name", "file_size").count().collect()
        return [{"path": f"{folder}/{r['file_name']}", "rows": r["count"], "bytes": r["file_size"]} for r in made]

    def append(self, rows: DataFrame) -> int:
        return self._commit(self._write(rows), set(), json.loads(rows.schema.json()))

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(1, size) / self.smallest, self.fan_in))) if size > self.smallest else 0

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Groups of similarly sized shards to merge, and shards to split (a group of one)."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < FULL * self.target:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        groups = [[s] for s in shards if s["bytes"] > SPLIT * self.target and s["rows"] > 1]
        for _, members in sorted(tiers.items()):
            if len(members) < self.fan_in:
                continue
            group, held = [], 0
            for s in sorted(members, key=lambda s: (s["bytes"], s["path"])):
                if group and (held >= self.target or held + s["bytes"] > MOST * self.target):
                    groups.append(group)
                    group, held = [], 0
                group.append(s)
                held += s["bytes"]
            if len(group) > 1:
                groups.append(group)
        return groups

    def _merge(self, groups: list[list[dict]], schema: T.StructType, most_rows: int) -> list[dict]:
        parts = [self._own.read.schema(schema).parquet(*[f"{self.root}/{s['path']}" for s in g]).coalesce(1) for g in groups]
        made = self._write(reduce(DataFrame.unionAll, parts), most_rows)
        before, after = sum(s["rows"] for g in groups for s in g), sum(s["rows"] for s in made)
        if before != after:
            raise RuntimeError(f"the merge read {before} rows and wrote {after}")
        return made

    def compact(self) -> int:
        """Merge until no tier holds enough shards and none is to be split; returns the version.

        Splitting a shard gives pieces that could be too large again, if its longest rows lie together; that ends at single rows.
        """
        while True:
            latest = self.manifest()
            groups = self.plan(latest["shards"])
            if not groups:
                return latest["version"]
            schema = T.StructType.fromJson(latest["schema"])
            jobs: dict[int, list[list[dict]]] = {}
            for g in groups:  # a split goes by rows, rounded so that few jobs are needed
                rows = g[0]["rows"] / (g[0]["bytes"] / self.target) if len(g) == 1 else 0
                jobs.setdefault(2 ** max(0, math.ceil(math.log2(rows)) - 1) if rows else 0, []).append(g)
            waves = [(some[at : at + WAVE], most) for most, some in jobs.items() for at in range(0, len(some), WAVE)]
            with ThreadPoolExecutor(JOBS) as pool:
                made = list(pool.map(lambda w: self._merge(w[0], schema, w[1]), waves))
            self._commit([s for x in made for s in x], {s["path"] for g in groups for s in g}, latest["schema"])

    def vacuum(self, keep: int = 2) -> None:
        """Drop all but the last ``keep`` versions and the files that none of those names. Not while others write or read."""
        versions = self.versions()
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifests/v{v:08d}.json"), False)
        kept = [self.manifest(v) for v in versions[-keep:]]
        named = {s["path"] for m in kept for s in m["shards"]}
        parts = {p for m in kept for p in m["parts"]}
        for f in self._fs.listStatus(self._path(f"{self.root}/manifests")):
            name = f.getPath().getName()
            if name.startswith(("part-", ".draft-")) and name not in parts:
                self._fs.delete(f.getPath(), False)
        folders = {p.rpartition("/")[0] for p in named}
        if not self._fs.exists(self._path(f"{self.root}/data")):
            return
        for d in self._fs.listStatus(self._path(f"{self.root}/data")):
            folder = f"data/{d.getPath().getName()}"
            if folder not in folders:
                self._fs.delete(d.getPath(), True)
                continue
            for f in self._fs.listStatus(d.getPath()):
                name = f"{folder}/{f.getPath().getName()}"
                if name.endswith(".parquet") and name not in named:
                    self._fs.delete(f.getPath(), False)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with the number of their shard in the manifest, its rows, and the version."""
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            raise ValueError("nothing was ever appended")
        schema = T.StructType.fromJson(manifest["schema"])
        shards = manifest["shards"]
        if not shards:
            empty = self.spark.createDataFrame([], schema)
            return empty.select(*[c for c in schema.names if c not in ADDED], F.lit(0).alias("shard"), F.lit(0).cast("long").alias("shard_rows"), F.lit(manifest["version"]).alias("version"))
        own = F.regexp_extract("_metadata.file_path", r"(data/[^/]+/[^/]+)$", 1)
        found = []
        for at in range(0, len(shards), SENT):  # the lookup tables are small, and the rows stay where they are read
            some = shards[at : at + SENT]
            index = self.spark.createDataFrame([(s["path"], i, s["rows"]) for i, s in enumerate(some, at)], "__path string, shard int, shard_rows long")
            rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{s['path']}" for s in some])
            rows = rows.select(*[c for c in schema.names if c not in ADDED], own.alias("__path"))
            found.append(rows.join(F.broadcast(index), "__path").drop("__path"))
        return reduce(DataFrame.unionAll, found).withColumn("version", F.lit(manifest["version"]))
