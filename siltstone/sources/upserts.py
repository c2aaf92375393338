"""A keyed store on plain Parquet that takes each batch once, whatever fails or is delivered again.

Keys are spread over a fixed number of buckets. A batch rewrites only the buckets of its keys, into a new folder, and one
small document in the log then names each bucket's folder, which commits it: readers see all of a batch or nothing.
The document also has the last batch of each stream, so a batch that is run again changes nothing. Of rows with one key the
last stays: a final one before any other, then the greatest number, then the greatest hash.

Contents are held against their hashes three times: as they arrive, as they lie in the buckets read, and as written.

Defined results: a null key is refused; a null content has a null hash; equal rows are one; an empty batch is noted and
changes no bucket. All batches must have the columns of the first.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class HashMismatch(ValueError):
    """Contents don't fit their hashes; `when` is arriving, existing or written."""

    def __init__(self, when: str, rows: int):
        super().__init__(f"{rows} contents {when} don't fit their hashes")
        self.when = when


class Snapshots:
    """key, number (long), final (boolean), sha256, content and further columns, one row a key."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "transaction_id", buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        at = self._at("log")
        fs = at.getFileSystem(self._conf)
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self, version: int | None = None) -> dict:
        """What a version (the last one) has: folders by bucket, last batches by stream."""
        versions = self.versions()
        if not versions:
            return {"version": 0, "buckets": self.buckets, "folders": {}, "streams": {}}
        text = self.spark.read.text(f"{self.path}/log/{version or versions[-1]:012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, state: dict) -> None:
        """Fails where another writer has committed this version."""
        draft, final = self._at(f"log/.{uuid.uuid4().hex}"), self._at(f"log/{state['version']:012d}.json")
        out = draft.getFileSystem(self._conf).create(draft, False)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(draft, final, options)

    def _rows(self, state: dict, among: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{folder}/bucket={b}" for b, folder in state["folders"].items() if among is None or int(b) in among]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def rows(self, version: int | None = None) -> DataFrame:
        return self._rows(self.state(version))

    def upsert(self, batch: DataFrame, number: int, stream: str = "") -> bool:
        """Whether the batch was new; `number` grows within a stream."""
        state = self.state()
        if number <= state["streams"].get(stream, -1):
            return False
        names = self.spark.createDataFrame([], self.schema).columns
        batch = batch.select(*names)
        bucket = F.pmod(F.xxhash64(self.key), F.lit(state["buckets"])).cast("int")
        # as many rows as there are buckets, at most
        seen = batch.groupBy(bucket.alias("bucket")).agg(F.count_if(F.col(self.key).isNull()).alias("nameless"), F.count_if(unfit()).alias("bad")).collect()
        if any(r["nameless"] for r in seen):
            raise ValueError(f"{sum(r['nameless'] for r in seen)} rows without {self.key}")
        _refuse("arriving", sum(r["bad"] for r in seen))
        folders = dict(state["folders"])
        if seen:
            touched = [r["bucket"] for r in seen]
            old = self._rows(state, touched)
            _refuse("existing", old.filter(unfit()).count())
            both = old.unionByName(batch)
            last = both.groupBy(self.key).agg(F.max_by(F.struct(*names), F.struct(F.coalesce("final", F.lit(False)), "number", "sha256", F.xxhash64(*names))).alias("r")).select("r.*")
            folder = f"rows/{uuid.uuid4().hex}"
            last.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            folders |= {str(b): folder for b in touched}
            _refuse("written", self._rows({"folders": folders}, touched).filter(unfit()).count())
        self._commit({"version": state["version"] + 1, "buckets": state["buckets"], "folders": folders, "streams": {**state["streams"], stream: number}})
        return True

    def follow(self, rows: DataFrame, checkpoint: str, stream: str = "stream"):
        """Starts a stream into the store, which runs over what is there and stops."""
        return rows.writeStream.foreachBatch(lambda batch, n: self.upsert(batch, n, stream) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def vacuum(self) -> int:
        """Deletes folders that the last version doesn't name; readers of older versions and writers must have ended."""
        kept, at = set(self.state()["folders"].values()), self._at("rows")
        fs = at.getFileSystem(self._conf)
        gone = [f.getPath() for f in (fs.listStatus(at) if fs.exists(at) else []) if f"rows/{f.getPath().getName()}" not in kept]
        for path in gone:
            fs.delete(path, True)
        return len(gone)


def unfit() -> Column:
    return ~F.sha2("content", 256).eqNullSafe(F.col("sha256"))


def _refuse(when: str, rows: int) -> None:
    if rows:
        raise HashMismatch(when, rows)
