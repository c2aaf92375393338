"""Nearest vectors by random hyperplanes: several tables of sign codes, probes of neighbouring codes, exact ranking.

Equal vectors are one class, of its least key; only classes are stored and looked up, so copies neither fill buckets nor
crowd out other neighbours. Each table's code is the signs beside BITS hyperplanes, BITS by the number of classes. A query looks into
the codes that differ where it stands nearest to a hyperplane; how many probes that takes is fitted on a sample of at most
SAMPLE classes, so that the sample's own neighbours are found in a share of `recall`; the whole table's are nearer, and so
easier. Where probes of all tables would compare as many vectors as there are, there is one bucket, and the search is exact. A bucket's vectors and queries meet in a task, which keeps the best k of each query; larger buckets are cut, and
each part meets the queries by itself. What comes out is exact in its cosines; neighbours are missed, never invented.

Defined results: null vectors and those with null or not finite entries, without length, or not of the commonest number of
entries have no neighbours and are none; ties go by key; fewer than k other classes give all of them. Null keys are left
out; further columns don't enter; tables without rows give none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siltstone.sources.tables import Folder

TABLES = 8
#: Classes to a bucket, about.
FILL = 256
MOST_BITS = 24
#: Classes that the number of probes is fitted on, and queries among them.
SAMPLE, ASKED = 4096, 128
#: Vectors of a bucket that meet its queries in one task.
PART = 8192


@dataclass
class Index:
    """planes: tables * bits * entries. probes: codes that a query looks into, by table."""

    planes: np.ndarray
    probes: int

    @property
    def bits(self) -> int:
        return self.planes.shape[1]

    def sides(self, x: np.ndarray) -> np.ndarray:
        """How far each row stands from each hyperplane: rows * tables * bits."""
        return np.einsum("nd,tbd->ntb", x, self.planes)

    def codes(self, sides: np.ndarray) -> np.ndarray:
        return (sides > 0) @ (1 << np.arange(self.bits, dtype=np.int64))

    def probed(self, sides: np.ndarray, probes: int | None = None) -> np.ndarray:
        """rows * tables * probes: the codes nearest to each row, its own first. Flips are taken by the sum of squared distances of the flipped planes."""
        n, wanted = self.codes(sides), min(probes or self.probes, 1 << self.bits)
        order = np.argsort(np.abs(sides), axis=2)
        near = min(self.bits, max(1, int(np.ceil(np.log2(wanted))) + 4))
        first = order[:, :, :near]  # flips are among the planes that stand nearest
        cost = np.take_along_axis(sides, first, 2) ** 2
        flip = 1 << first.astype(np.int64)
        sums, masks = np.zeros((*n.shape, 1)), np.zeros((*n.shape, 1), np.int64)
        for k in range(near):
            sums = np.concatenate([sums, sums + cost[:, :, k : k + 1]], 2)
            masks = np.concatenate([masks, masks | flip[:, :, k : k + 1]], 2)
            if sums.shape[2] > wanted:
                keep = np.argpartition(sums, wanted - 1, axis=2)[:, :, :wanted]
                sums, masks = np.take_along_axis(sums, keep, 2), np.take_along_axis(masks, keep, 2)
        return n[:, :, None] ^ masks


def unit(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    x = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # entries of any size
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def classes(vectors: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(key, vector) with the class of each (rep), and the classes (rep, vector, copies)."""
    rows = vectors.select(F.col(key).alias("key"), F.col(column).alias("vector")).filter(F.col("key").isNotNull() & usable(F.col("vector")))
    size = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.filter(F.size("vector") == (size["d"] if size else 0))
    own = rows.groupBy("vector").agg(F.min("key").alias("rep"), F.count("*").alias("copies"))
    return rows, own.select("rep", "vector", "copies")


def fit(own: DataFrame, k: int, recall: float = 0.95, tables: int = TABLES, fill: int = FILL, seed: int = 11) -> Index | None:
    """An index of as many bits as the classes ask for; probes are doubled until the sample's neighbours are found. None for an empty table."""
    n = own.count()
    if not n:
        return None
    drawn = own.select("vector").orderBy(F.xxhash64("vector")).limit(SAMPLE).toArrow()
    x = unit(drawn["vector"])
    bits = int(min(max(np.ceil(np.log2(max(n / fill, 1))), 1), MOST_BITS))
    index = Index(np.random.default_rng(seed).normal(size=(tables, bits, x.shape[1])), 1)
    asked = x[:ASKED]
    like = asked @ x.T
    like[np.arange(len(asked)), np.arange(len(asked))] = -2
    best = np.argsort(-like, 1, kind="stable")[:, : min(k, len(x) - 1)]
    sides = index.sides(x)
    codes, ask = index.codes(sides), sides[: len(asked)]
    while index.probes < 1 << bits:
        looked = index.probed(ask)
        found = np.zeros(best.shape, bool)
        for t in range(tables):
            found |= (codes[best, t][:, :, None] == looked[:, t, None, :]).any(2)
        if not found.size or found.mean() >= recall:
            break
        index.probes *= 2
    if tables * index.probes >= 1 << bits:  # as many would be compared as there are: each then goes to all parts, of which there are fewer
        return Index(index.planes[:1, :0], 1)
    return index


def nearest(vectors: DataFrame, folder: Folder, k: int = 10, asked: Column | None = None, key: str = "vec_id", column: str = "embedding", recall: float = 0.95, index: Index | None = None, part: int = PART) -> DataFrame:
    """key, rank, neighbour (a class's least key), copies (of that class), cosine: of each row that `asked` selects (all without it)."""
    rows, own = classes(vectors, key, column)
    own = folder.save(own, "classes")
    index = index or fit(own, k, recall)
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, rank int, neighbour {kind}, copies long, cosine double"
    if index is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    wanted = rows.filter(F.coalesce(F.expr("true") if asked is None else asked, F.lit(False)))
    wanted = folder.save(wanted.join(own.select("vector", "rep"), "vector").select("key", "rep"), "asked")
    queries = own.join(wanted.select("rep").distinct(), "rep", "left_semi")
    sent = vectors.sparkSession.sparkContext.broadcast(index)
    tables = len(index.planes)

    def coded(probe: bool):
        def task(batches):
            for batch in batches:
                for i in range(0, batch.num_rows, 512):
                    some = batch.slice(i, 512)
                    sides = sent.value.sides(unit(some.column("vector")))
                    codes = sent.value.probed(sides) if probe else sent.value.codes(sides)[:, :, None]
                    row = pa.array(np.repeat(np.arange(len(codes)), codes.shape[1] * codes.shape[2]))
                    table = np.tile(np.repeat(np.arange(tables), codes.shape[2]), len(codes))
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array(codes.reshape(-1) * tables + table), "rep": some.column("rep").take(row), "vector": some.column("vector").take(row)})

        return task

    made = f"bucket long, rep {kind}, vector {own.schema['vector'].dataType.simpleString()}"
    stored = own.select("rep", "vector").mapInArrow(coded(False), made)
    # buckets beyond `part` vectors are cut; a query goes to each part
    cuts = stored.groupBy("bucket").agg(F.ceil(F.count("*") / part).alias("parts")).filter("parts > 1")
    placed = stored.join(cuts, "bucket", "left").select("bucket", F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1))).alias("p"), "rep", "vector")
    looks = queries.select("rep", "vector").mapInArrow(coded(True), made).join(cuts, "bucket", "left")
    looks = looks.select(F.col("bucket").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1)).alias("q"), F.col("rep").alias("asker"), F.col("vector").alias("x"))

    def rank(held: pa.Table, asking: pa.Table) -> pa.Table:
        name, found, values = [], [], []
        if held.num_rows and asking.num_rows:
            held = held.sort_by("rep")
            y, reps = unit(held["vector"]), held["rep"].to_numpy()
            most = min(k, len(reps))
            for i in range(0, asking.num_rows, 1024):
                some = asking.slice(i, 1024)
                who = some["asker"].to_numpy()
                like = np.round(unit(some["x"]) @ y.T, 12)
                like[who[:, None] == reps[None, :]] = -3
                best = np.argpartition(-like, most - 1, axis=1)[:, :most]
                least = np.take_along_axis(like, best, 1).min(1)
                # where more are as near as the last, the least keys
                for j in np.flatnonzero((like >= least[:, None]).sum(1) > most):
                    best[j] = np.argsort(-like[j], kind="stable")[:most]
                near = np.take_along_axis(like, best, 1)
                name.append(who)
                found += [r[c > -3] for r, c in zip(reps[best], near)]
                values += [c[c > -3] for c in near]
        return pa.table({"asker": pa.array(np.concatenate(name) if name else [], held.schema.field("rep").type), "found": pa.array(found, pa.list_(held.schema.field("rep").type)), "cosine": pa.array(values, pa.list_(pa.float64()))})

    got = placed.groupBy("bucket", "p").cogroup(looks.groupBy("b", "q")).applyInArrow(rank, f"asker {kind}, found array<{kind}>, cosine array<double>")

    def merge(group: pa.Table) -> pa.Table:
        """The best k of what the buckets gave, tables * probes * k at most; a neighbour of several tables comes once."""
        found, value = (np.concatenate(group.column(c).combine_chunks().to_numpy(zero_copy_only=False)) for c in ("found", "cosine"))
        found, at = np.unique(found, return_index=True)
        some = np.lexsort((found, -value[at]))[:k]
        rank = np.arange(1, len(some) + 1, dtype=np.int32)
        return pa.table({"asker": group["asker"].take(pa.array(np.zeros(len(some), int))), "rank": rank, "neighbour": pa.array(found[some], group.schema.field("found").type.value_type), "cosine": pa.array(value[at][some].astype(float))})

    best = got.groupBy("asker").applyInArrow(merge, f"asker {kind}, rank int, neighbour {kind}, cosine double")
    best = folder.save(best.join(own.select(F.col("rep").alias("neighbour"), "copies"), "neighbour"), "best")
    return wanted.join(best, wanted["rep"] == best["asker"]).select(F.col("key").alias(key), "rank", "neighbour", "copies", "cosine")
