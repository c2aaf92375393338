"""Writers: content-addressed bodies, checkpoints of small documents, rendered summaries, versions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T


def add_bodies(bodies: DataFrame, store: str) -> int:
    """Appends bodies (content) that the store (Parquet of sha256, content) lacks; what is there is never rewritten. Returns how many.

    Only the store's hashes are read. Contents that are already there are held against their hashes in `upserts.Snapshots`.
    """
    spark = bodies.sparkSession
    new = bodies.filter(F.octet_length("content") > 0).select(F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["sha256"])
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        new = new.join(spark.read.schema("sha256 string, content binary").parquet(store).select("sha256"), "sha256", "left_anti")
    written = Observation()
    new.observe(written, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(store)
    return written.get["n"]


def checkpoint_json(spark: SparkSession, path: str, payload: dict) -> None:
    """One small document, keys sorted: written beside its place, then renamed into it."""
    jvm = spark.sparkContext._jvm
    final, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".draft")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = final.getFileSystem(conf).create(draft, True)
    out.write(bytearray((json.dumps(payload, ensure_ascii=False, sort_keys=True, indent=2) + "\n").encode()))
    out.close()
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    # one step: readers see the old document or the new one
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(draft, final, options)


def _in_order(kind: T.DataType, c: Column) -> Column:
    """Structures with their fields in order of name."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_in_order(f.dataType, c[f.name]).alias(f.name) for f in sorted(kind, key=lambda f: f.name)]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _in_order(kind.elementType, x))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(c)))
    return c


def cell(rows: DataFrame, name: str, most: int = 120) -> Column:
    """A column as cells of a Markdown table: structures as JSON in order of names, nulls empty, on one line, cut to `most` characters."""
    kind = rows.schema[name].dataType
    nested = isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
    text = F.coalesce(F.to_json(_in_order(kind, F.col(name))) if nested else F.col(name).cast("string"), F.lit(""))
    line = F.replace(F.translate(text, "\n", " "), F.lit("|"), F.lit("\\|"))
    return F.when(F.length(line) > most, F.rpad(F.substring(line, 1, most - 1), most, "…")).otherwise(line)


def markdown(title: str, summary: DataFrame) -> str:
    """A summary, which is small, as a Markdown table in order of its first column."""
    names = summary.columns
    lines = summary.orderBy(names[0]).select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(summary, c) for c in names]), F.lit(" |")).alias("line"))
    return "\n".join([f"# {title}", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *(r["line"] for r in lines.toLocalIterator())]) + "\n"


def append_version(rows: DataFrame, path: str, version: int) -> None:
    rows.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(path)
