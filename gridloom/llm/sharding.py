"""Sharding by size-tiered compaction, in DataFrame operations and file system calls alone.

A store is a folder with immutable Parquet shards and numbered manifests.  An
arrival is appended as small shards, written as its partitions come, without a
shuffle.  Compaction puts shards of similar size (one tier: sizes within a factor
of ``fan_in``) together, in order, into groups of about the target size, and writes each
group as one file by one task.  A manifest is a small head, which names a version's parts,
and the parts, immutable files that list up to PART_SHARDS shards each; a new version writes parts for
its new shards alone and keeps those of the version before whose shards all stay.  The head
is written beside its place and renamed there, which fails if that version exists:
readers see the old version or the new one, never a part, and of two writers
one starts again from the other's version.

A lost executor costs its tasks alone: files of failed attempts are never
committed, and a folder that no manifest names is removed by ``vacuum`` once it is old
enough not to be that of a writer who has yet to commit.
Arrivals are cut by bytes, and the target grows with the store, so the shards, of
which the driver holds one entry each (never rows), are MOST_SHARDS or fewer after compaction,
but for the largest arrivals in between.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.scratch import filesystem, local_table, remove, scratch_path

#: Bytes of an arrival's shards before compression, and of compacted ones at least.
SMALL_BYTES = 8 << 20
TARGET_BYTES = 64 << 20
#: The target is so large that a store has no more shards of it than this.
MOST_SHARDS = 100_000
FAN_IN = 4
#: Shards in one part of a manifest.
PART_SHARDS = 10_000
#: Up to so many shards, their table is broadcast.
BROADCAST_SHARDS = 200_000
#: Seconds for which a folder that no manifest names stays: longer than any writer takes to commit.
OLD = 7 * 24 * 3600
#: The column that holds a row's file while rows are counted or placed.
FILE = "__file"
#: Groups that one job merges.
JOB_GROUPS = 64


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    parts: tuple[tuple[str, tuple[Shard, ...]], ...]

    @property
    def shards(self) -> tuple[Shard, ...]:
        return tuple(s for _, shards in self.parts for s in shards)


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs, self._root = filesystem(spark, self.root)

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def versions(self) -> list[int]:
        folder = self._path("manifests")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The manifest of ``version``, the latest one by default; None for a store without versions."""
        known = self.versions()
        if not known:
            return None
        head = json.loads(self._text("manifests", f"v{known[-1] if version is None else version:010d}.json"))
        return Manifest(head["version"], head["schema"], tuple((p, tuple(Shard(*s) for s in json.loads(self._text("parts", p)))) for p in head["parts"]))

    def _text(self, *parts: str) -> str:
        stream = self.fs.open(self._path(*parts))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, text: str, *parts: str):
        """A new file; its path."""
        path = self._path(*parts)
        self.fs.mkdirs(path.getParent())
        out = self.fs.create(path, False)
        out.write(bytearray(text.encode()))
        out.close()
        return path

    def _commit(self, last: Manifest | None, schema: str, gone: set[str], new: list[Shard]) -> Manifest:
        """The version after ``last``: its shards but those of the paths ``gone``, and ``new`` ones."""
        jvm = self.spark.sparkContext._jvm
        parts, loose = [], []
        for name, shards in last.parts if last else ():
            left = tuple(s for s in shards if s.path not in gone)
            if len(left) == len(shards) and len(shards) * 2 > PART_SHARDS:
                parts.append((name, shards))
            else:
                loose += left
        loose += new
        for k in range(0, len(loose), PART_SHARDS):
            name, shards = f"{uuid.uuid4().hex}.json", tuple(loose[k : k + PART_SHARDS])
            self._put(json.dumps([astuple(s) for s in shards]), "parts", name)
            parts.append((name, shards))
        manifest = Manifest(last.version + 1 if last else 1, schema, tuple(parts))
        head = json.dumps({"version": manifest.version, "schema": schema, "parts": [name for name, _ in parts]})
        final, beside = self._path("manifests", f"v{manifest.version:010d}.json"), self._put(head, "manifests", f".{uuid.uuid4().hex}")
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(beside, final, options)
        except Exception as error:
            self.fs.delete(beside, False)
            if self.fs.exists(final):
                raise Conflict(f"version {manifest.version}") from error
            raise
        return manifest

    def _written(self, df: DataFrame, rows: int | None) -> list[Shard]:
        """``df`` as new immutable files; files without rows are left out."""
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        (df.write.option("maxRecordsPerFile", rows) if rows else df.write).parquet(folder)
        files = {s.getPath().getName(): (s.getPath().toString(), s.getLen()) for s in self.fs.listStatus(self._path("shards", folder.rpartition("/")[2])) if s.getPath().getName().startswith("part-")}
        if not files:
            return []
        counts = self.spark.read.schema(df.schema).parquet(folder).select(_file_name()).groupBy(FILE).count().collect()  # a row a file
        return [Shard(files[r[FILE]][0], r["count"], files[r[FILE]][1]) for r in sorted(counts, key=lambda r: r[FILE])]

    def append(self, df: DataFrame, small: int = SMALL_BYTES) -> Manifest:
        """Commit ``df`` as shards of about ``small`` bytes before compression, at most."""
        new = self._written(df, _rows_of(df, small))
        while True:
            try:
                return self._commit(self.manifest(), df.schema.json(), set(), new)
            except Conflict:
                continue

    def compact(self, target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> Manifest | None:
        """Merge until no tier below the target has ``fan_in`` shards; each round is one committed version.

        The target is a MOST_SHARDS-th of the store, if that is larger than ``target``.
        """
        session = self.spark.newSession()
        session.conf.set("spark.sql.unionOutputPartitioning", "false")  # else one-partition groups would be united into one task
        while (last := self.manifest()) and (groups := plan(last.shards, max(target, sum(s.bytes for s in last.shards) // MOST_SHARDS), fan_in)):
            schema, merged = T.StructType.fromJson(json.loads(last.schema)), []
            for k in range(0, len(groups), JOB_GROUPS):
                parts = [session.read.schema(schema).parquet(*[s.path for s in g]).coalesce(1) for g in groups[k : k + JOB_GROUPS]]
                whole = parts[0]
                for part in parts[1:]:
                    whole = whole.union(part)
                merged += self._written(whole, None)
            gone = {s.path for g in groups for s in g}
            if sum(s.rows for s in merged) != sum(s.rows for g in groups for s in g):
                raise RuntimeError("a merge has lost rows; nothing is committed")
            try:
                self._commit(last, last.schema, gone, merged)
            except Conflict:
                continue
        return self.manifest()

    def vacuum(self, keep: int = 1, old: float = OLD) -> None:
        """Remove manifests before the last ``keep`` versions, and files older than ``old`` seconds that none of these names.

        A file that no manifest names may be one that a writer has yet to commit, so ``old`` must be longer than any
        writer takes; 0 is safe only where nobody else writes.
        """
        known = self.versions()
        kept = [self.manifest(v) for v in known[-keep:]]
        named = {s.path.rpartition("/")[2] for m in kept for s in m.shards}
        parts = {name for m in kept for name, _ in m.parts}
        for v in known[:-keep]:
            self.fs.delete(self._path("manifests", f"v{v:010d}.json"), False)
        before = (time.time() - old) * 1000
        listed = lambda *path: self.fs.listStatus(self._path(*path)) if self.fs.exists(self._path(*path)) else []
        for f in [*listed("parts"), *(f for f in listed("manifests") if f.getPath().getName().startswith("."))]:
            if f.getPath().getName() not in parts and f.getModificationTime() <= before:
                self.fs.delete(f.getPath(), False)
        for folder in listed("shards"):
            files = [f for f in self.fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            if any(f.getPath().getName() in named for f in files):
                for f in files:
                    if f.getPath().getName() not in named and f.getModificationTime() <= before:
                        self.fs.delete(f.getPath(), False)
            elif all(f.getModificationTime() <= before for f in [folder, *files]):
                self.fs.delete(folder.getPath(), True)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        got = self.manifest(version)
        if got is None:
            raise FileNotFoundError(f"{self.root} has no version")
        schema = T.StructType.fromJson(json.loads(got.schema))
        return self.spark.read.schema(schema).parquet(*[s.path for s in got.shards]) if got.shards else self.spark.createDataFrame([], schema)

    def located(self, *columns: str) -> DataFrame:
        """``columns`` of the latest version with shard (its number by path), shard_rows and shard_bytes.

        Where ``columns`` has one of these names, that one keeps it and the new column gets a trailing underscore.
        """
        got = self.manifest()
        names = local_table(self.spark, [(s.path.rpartition("/")[2], k, s.rows, s.bytes) for k, s in enumerate(sorted(got.shards, key=lambda s: s.path.rpartition("/")[2]))], f"{FILE} string, shard int, shard_rows long, shard_bytes long")
        for c in ("shard", "shard_rows", "shard_bytes"):
            names = names.withColumnRenamed(c, c + "_" * (c in columns))
        names = F.broadcast(names) if len(got.shards) <= BROADCAST_SHARDS else names  # a row a shard
        return self.read().select(*columns, _file_name()).join(names, FILE).drop(FILE)

    def drop(self) -> None:
        remove(self.spark, self.root)


def _rows_of(df: DataFrame, small: int) -> int:
    """How many rows of average length make ``small`` bytes: strings by their bytes, other columns by eight each."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    total = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in strings), F.lit(8 * len(df.columns)))
    mean = df.agg(F.avg(total)).first()[0]
    return max(1, int(small / mean)) if mean else 1


def _file_name():
    return F.element_at(F.split(F.input_file_name(), "/"), -1).alias(FILE)


def tier(size: int, fan_in: int = FAN_IN) -> int:
    return int(math.log(max(size, 1), fan_in))


def plan(shards: tuple[Shard, ...], target: int, fan_in: int) -> list[list[Shard]]:
    """Groups to merge: runs of a tier's shards, in order, filled up to the target size; only of tiers with ``fan_in`` shards or more."""
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if s.bytes * 2 <= target:
            tiers.setdefault(tier(s.bytes, fan_in), []).append(s)
    groups = []
    for _, members in sorted(tiers.items()):
        if len(members) < fan_in:
            continue
        group, size = [], 0
        for s in members:
            if group and size + s.bytes > target:
                groups.append(group)
                group, size = [], 0
            group.append(s)
            size += s.bytes
        groups.append(group)
    return [g for g in groups if len(g) > 1]


def shard(docs: DataFrame, name: str = "shards", target: int = TARGET_BYTES, small: int = SMALL_BYTES) -> ShardStore:
    """A new store in the shared folder with ``docs`` appended, compacted and vacuumed.

    All columns and rows are kept as they are: nulls, empty and very long texts,
    repeated rows.  A table without rows gives a version without shards.
    """
    store = ShardStore(docs.sparkSession, scratch_path(docs.sparkSession, name))
    store.append(docs, small)
    store.compact(target)
    store.vacuum(old=0)  # the store is this call's own
    return store
