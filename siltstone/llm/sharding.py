"""Sharding with size-tiered compaction.

Arrivals are written as small files that never change: one for each task and arrival. Compaction takes the tiers of
similarly sized files that have enough of them, packs each tier's files, in order of their first rows, into groups of
the target size, and writes a group as one file. What is current is a manifest: a table of files, written under a new
version; then the version is committed by renaming one small file into place, which fails where that version is there
(as one step on HDFS; a file system whose rename is no single step takes one writer at a time). A reader sees the last
committed version and opens the files of its manifest alone, whatever a lost executor or driver left half done.
Superseded files stay for readers of older versions until `vacuum`. Each writer has folders of its own, so one that
comes second changes nothing of what the first committed.

The driver holds the names of a version's files, one for each `target` bytes and each small file not yet merged.

Defined results: an empty table makes a version without files; null and empty texts, repeated rows and further columns
are stored as they are; a row larger than the target makes a file of its own size; ties in size are broken by the first
row.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Bytes of a shard that compaction aims for.
TARGET = 64 << 20
#: Sizes of a tier differ by this factor at most, from SMALLEST on; a tier of RUNS files is compacted.
FACTOR = 4
SMALLEST = 64 << 10
RUNS = 4
ARRIVALS = 4

_ENTRIES = "file string, bytes long, rows long, first struct<file: string, row: long>, tier int"


class Store:
    """A folder of shards with versions."""

    def __init__(self, spark: SparkSession, path: str, target: int = TARGET):
        self.spark, self.path, self.target = spark, path, target
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # versions

    def versions(self) -> list[int]:
        """The committed versions that are kept, in order."""
        folder = self._path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        return max(self.versions(), default=0)

    def _manifest_path(self, n: int) -> str:
        stream = self._fs.open(self._path(f"{self.path}/versions/v{n:08d}.json"))
        try:
            found = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return f"{self.path}/{found['manifest']}"

    def manifest(self, version: int | None = None) -> DataFrame:
        """The files of a version, the last one unless told."""
        n = self.version() if version is None else version
        if not n:
            return self.spark.createDataFrame([], _ENTRIES)
        return self.spark.read.schema(_ENTRIES).parquet(self._manifest_path(n))

    def commit(self, entries: DataFrame, after: int) -> int:
        """Makes `entries` the version that follows `after`; raises if another writer was first."""
        n = after + 1
        own = f"{n:08d}-{uuid.uuid4().hex}"
        entries.write.mode("errorifexists").parquet(f"{self.path}/manifests/{own}")
        self._fs.mkdirs(self._path(f"{self.path}/versions"))
        draft, final = self._path(f"{self.path}/versions/.draft-{own}"), self._path(f"{self.path}/versions/v{n:08d}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"version": n, "manifest": f"manifests/{own}"}).encode()))
        out.close()
        try:
            self._rename(draft, final)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            raise RuntimeError(f"version {n} was committed by another writer") from e
        return n

    def _rename(self, draft, final) -> None:
        """Renames, unless `final` is there: then FileAlreadyExistsException."""
        context, hadoop = self.spark.sparkContext, self.spark.sparkContext._jvm.org.apache.hadoop.fs
        options = context._gateway.new_array(hadoop.Options.Rename, 1)
        options[0] = hadoop.Options.Rename.NONE
        files = hadoop.FileContext.getFileContext(self._fs.getUri(), context._jsc.hadoopConfiguration())
        files.rename(self._fs.makeQualified(draft), self._fs.makeQualified(final), options)

    # data

    def _entries(self, folder: str, schema) -> DataFrame:
        """What a folder of new files holds; reads the places alone."""
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/data/{folder}")
        found = rows.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"), F.min("place").alias("first"))
        tier = F.greatest(F.lit(0), F.floor(F.log(float(FACTOR), F.col("bytes") / SMALLEST))).cast("int")
        return found.select(F.regexp_extract("path", r"/data/([^/]+/.*)$", 1).alias("file"), "bytes", "rows", "first", tier.alias("tier"))

    def _schema(self, docs_schema):
        empty = self.spark.createDataFrame([], docs_schema)
        return empty.select(F.struct("*").alias("row"), F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("row")).alias("place"), F.lit(0).alias("arrival")).schema

    def append(self, docs: DataFrame, arrivals: int = 1) -> int:
        """Writes new rows as small shards, in `arrivals` parts, and commits them beside what is there."""
        before = self.version()
        folder = f"append-{before + 1:08d}-{uuid.uuid4().hex}"
        try:
            place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").cast("long").alias("row"))
            rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), place.alias("place"))
            rows.schema  # rows that don't come straight from files have no place there
        except Exception as e:
            if "_metadata" not in str(e):
                raise
            place = F.struct(F.format_string("%010d", F.spark_partition_id()).alias("file"), F.monotonically_increasing_id().alias("row"))
            rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), place.alias("place"))
        # arrivals take turns row by row, so that small tables have all of them; merging sorts by place again
        rows = rows.withColumn("arrival", F.pmod("place.row", F.lit(arrivals)).cast("int"))
        rows.withColumn("part", F.col("arrival")).write.option("compression", "zstd").mode("overwrite").partitionBy("part").parquet(f"{self.path}/data/{folder}")
        added = self._entries(folder, self._schema(docs.schema))
        return self.commit(self.manifest().unionByName(added), before)

    def plan(self) -> DataFrame:
        """The files that compaction merges: file, group (dense from 0)."""
        small = self.manifest().filter(F.col("bytes") < self.target)
        tier = Window.partitionBy("tier")
        order = tier.orderBy("first", "file")
        picked = small.withColumn("runs", F.count("*").over(tier)).filter(F.col("runs") >= RUNS)
        packed = picked.withColumn("before", F.sum("bytes").over(order) - F.col("bytes")).withColumn("pack", F.expr(f"before div {self.target}"))
        groups = packed.groupBy("tier", "pack").agg(F.count("*").alias("n"), F.min("first").alias("first")).filter("n > 1")
        # as many rows as new files: a target's worth of input each
        numbered = groups.select("tier", "pack", (F.row_number().over(Window.orderBy("first", "tier", "pack")) - 1).alias("group"))
        return packed.join(numbered, ["tier", "pack"]).select("file", "group")

    def compact(self, schema) -> int:
        """Merges similarly sized files into files of the target size and commits; without such files the version stays."""
        before = self.version()
        folder = f"merge-{before + 1:08d}-{uuid.uuid4().hex}"
        self.plan().write.mode("errorifexists").parquet(f"{self.path}/plans/{folder}")
        plan = self.spark.read.schema("file string, group int").parquet(f"{self.path}/plans/{folder}")
        n = plan.agg(F.max("group")).first()[0]
        if n is None:
            return before
        inputs = self._read(schema, plan).join(plan.withColumnRenamed("file", "own"), F.col("file") == F.col("own")).select("row", "place", "arrival", "group")
        merged = inputs.repartitionById(n + 1, F.col("group")).sortWithinPartitions("group", "place").drop("group")
        merged.write.option("compression", "zstd").mode("overwrite").parquet(f"{self.path}/data/{folder}")
        kept = self.manifest().join(plan, "file", "left_anti").unionByName(self._entries(folder, self._schema(schema)))
        return self.commit(kept, before)

    def vacuum(self, keep: int = 2) -> None:
        """Forgets all versions but the last `keep` and deletes the files that none of those has; names pass the driver one by one.

        Broken off, it can be run again: a version goes after its files.
        """
        kept, gone = self.versions()[-keep:], self.versions()[:-keep]
        if not gone:
            return
        used = reduce(DataFrame.unionByName, [self.manifest(n).select("file") for n in kept])
        dead = reduce(DataFrame.unionByName, [self.manifest(n).select("file") for n in gone]).distinct().join(used, "file", "left_anti")
        for row in dead.toLocalIterator():
            self._fs.delete(self._path(f"{self.path}/data/{row['file']}"), False)
        for n in gone:
            manifest = self._path(self._manifest_path(n))
            self._fs.delete(self._path(f"{self.path}/versions/v{n:08d}.json"), False)
            self._fs.delete(manifest, True)

    def _read(self, schema, files: DataFrame) -> DataFrame:
        """The rows of the files named, each with its file; no other file is listed or opened."""
        paths = [f"{self.path}/data/{row['file']}" for row in files.select("file").toLocalIterator()]
        if not paths:
            return self.spark.createDataFrame([], self._schema(schema)).withColumn("file", F.lit(""))
        rows = self.spark.read.schema(self._schema(schema)).option("recursiveFileLookup", "true").parquet(*paths)
        return rows.withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), r"/data/([^/]+/.*)$", 1))

    def rows(self, schema, version: int | None = None) -> DataFrame:
        """A version, the last one unless told: row, place, arrival, and its shard's file, bytes, rows and tier."""
        manifest = self.manifest(version)
        return self._read(schema, manifest).join(manifest.select("file", "bytes", "rows", "tier"), "file")
