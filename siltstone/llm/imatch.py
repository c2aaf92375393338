"""I-Match document fingerprints with randomised lexicons.

The lexicon is the terms whose share of the documents lies in a band, so its size is bounded by a document's distinct
terms over the band's lower end, whatever the number of documents. Random subsets of it come in levels, each level's a
quarter of the size of the last. A document's terms are made distinct and sorted; for each subset, those in it are
hashed together. The fingerprint is the row of these hashes; two are alike by the share of equal hashes on the levels
where subsets hold about one of the document's terms.

Defined results: null and empty texts and texts without words have the fingerprint of no term; texts without any term of
the band use all their terms; equal fingerprints have likeness 1; the row after the last in descending key is the first;
a single row is followed by itself; rows with a null key come last, each followed by the next of them and the last by an
empty text; rows repeated under one key follow each other; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltstone.llm import tokens
from siltstone.llm.tokens import U
from siltstone.llm.work import Work, partitions

#: Band of document shares whose terms make up the lexicon; its idf is -log of these.
BAND = (0.002, 0.3)
LEVELS = 6
SUBSETS = 24
#: Terms whose documents one pass counts; 8 bytes each. More take more passes.
TERMS_A_PASS = 1 << 21
_BITS = 52


def terms(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and id of the distinct terms of rows i to j-1, sorted."""
    w = tokens.words(data, offsets, i, j, tokens.ALNUM, fold=True)
    both = np.sort((w.row.astype(np.uint64) << U(_BITS)) | (w.hash >> U(64 - _BITS)))
    both = both[np.r_[True, both[1:] != both[:-1]][: len(both)]]
    return (both >> U(_BITS)).astype(np.int64), both & U((1 << _BITS) - 1)


def _task_counts(batches, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Terms of a task's rows (only those wanted), in how many rows each is, and the rows."""
    held, rows = [], 0
    ids, counts = np.zeros(0, U), np.zeros(0, np.int64)

    def fold():
        nonlocal ids, counts, held
        got = np.concatenate([ids, *(x for x, _ in held)])
        n = np.concatenate([counts, *(n for _, n in held)])
        ids, at = np.unique(got, return_inverse=True)
        counts = np.bincount(at, weights=n, minlength=len(ids)).astype(np.int64)
        held = []

    for batch in batches:
        rows += batch.num_rows
        data, offsets = tokens.buffers(batch.column("text"))
        for i, j in tokens.slices(offsets):
            _, id_ = terms(data, offsets, i, j)
            if wanted is not None and len(wanted):
                id_ = id_[wanted[np.minimum(np.searchsorted(wanted, id_), len(wanted) - 1)] == id_]
            held.append(np.unique(id_, return_counts=True))
        if sum(len(x) for x, _ in held) > 1 << 21:
            fold()
    fold()
    return ids, counts, rows


def lexicon(docs: DataFrame, work: Work, band: tuple[float, float] = BAND) -> np.ndarray:
    """Sorted ids of all terms whose share of the documents is in the band, by exact counts over all documents.

    A term of the band has at least that share in some task's rows, so the first pass gathers candidates only.
    """

    def candidates(batches):
        ids, counts, rows = _task_counts(batches)
        yield pa.RecordBatch.from_pydict({"term": ids[counts >= band[0] * rows].view(np.int64)})

    found = work.save(docs.select("text").mapInArrow(candidates, "term long").distinct(), "candidates")
    n, size = docs.count(), found.count()
    parts = max(1, -(-size // TERMS_A_PASS))
    kept = []
    for part in range(parts):
        own = found if parts == 1 else found.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == part)
        wanted = np.sort(own.toPandas()["term"].to_numpy(np.int64).view(np.uint64))

        def count(batches, wanted=wanted):
            ids, counts, _ = _task_counts(batches, wanted)
            yield pa.RecordBatch.from_pydict({"term": ids.view(np.int64), "n": counts})

        sums = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        kept.append(sums.filter((F.col("n") >= band[0] * n) & (F.col("n") <= band[1] * n)).select("term").toPandas()["term"].to_numpy(np.int64))
    return np.sort(np.concatenate(kept).view(np.uint64))


def _members(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of id, column) of every subset that an id is in."""
    at, columns = [], []
    for level in range(LEVELS):
        for s in range(SUBSETS):
            k = level * SUBSETS + s
            own = np.flatnonzero(tokens.mix(ids ^ U(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) >> U(64 - 2 * (level + 1)) == 0)
            at.append(own)
            columns.append(np.full(len(own), k))
    at, columns = np.concatenate(at), np.concatenate(columns)
    order = np.argsort(at, kind="stable")
    return at[order], columns[order]


@dataclass
class Lexicon:
    ids: np.ndarray

    def __post_init__(self):
        at, self.columns = _members(self.ids)
        self.first = np.searchsorted(at, np.arange(len(self.ids) + 1))

    def _sums(self, row: np.ndarray, id_: np.ndarray, at: np.ndarray, first: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
        size = first[at + 1] - first[at]
        each = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - first[at], size)
        cell = np.repeat(row, size) * (LEVELS * SUBSETS) + columns[each]
        value = (tokens.mix(np.repeat(id_, size) ^ U(0xD1B54A32D192ED03)) >> U(33)).astype(float) + 1
        return np.bincount(cell, weights=value, minlength=n * LEVELS * SUBSETS).astype(float)  # exact: below 2**53

    def prints(self, texts: pa.Array) -> np.ndarray:
        """One row of 16-bit hashes for each text; 0 where the text has no term of the subset."""
        data, offsets = tokens.buffers(texts)
        out = []
        for i, j in tokens.slices(offsets):
            row, id_ = terms(data, offsets, i, j)
            n = j - i
            at = np.minimum(np.searchsorted(self.ids, id_), max(len(self.ids) - 1, 0))
            some = self.ids[at] == id_ if len(self.ids) else np.zeros(len(id_), bool)
            sums = self._sums(row[some], id_[some], at[some], self.first, self.columns, n)
            bare = np.bincount(row[some], minlength=n) == 0
            rest = bare[row]
            if rest.any():
                own = np.unique(id_[rest])
                place, columns = _members(own)
                first = np.searchsorted(place, np.arange(len(own) + 1))
                sums += self._sums(row[rest], id_[rest], np.searchsorted(own, id_[rest]), first, columns, n)
            mixed = (tokens.mix(sums.astype(np.uint64)) % U(65535)).astype(np.uint16) + np.uint16(1)
            out.append(np.where(sums > 0, mixed, np.uint16(0)).reshape(n, -1))
        return np.concatenate(out) if out else np.zeros((0, LEVELS * SUBSETS), np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of two arrays of fingerprints: equal hashes over hashes that either has, on levels where not over three quarters of the subsets have terms (the last level at least)."""
    shape = (len(a), LEVELS, SUBSETS)
    x, y = a.reshape(shape), b.reshape(shape)
    filled = np.maximum((x > 0).sum(2), (y > 0).sum(2)) <= 0.75 * SUBSETS
    filled[:, -1] = True
    either = (((x > 0) | (y > 0)).sum(2) * filled).sum(1)
    same = (((x == y) & (x > 0)).sum(2) * filled).sum(1)
    return np.where((a == b).all(1), 1.0, same / np.maximum(either, 1))


def text_of(prints: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes().hex() for r in prints.astype(">u2")], pa.string())


def fingerprints(docs: DataFrame, lex: np.ndarray, key: str = "doc_id") -> DataFrame:
    """key, fingerprint."""
    sent = docs.sparkSession.sparkContext.broadcast(lex)  # bounded by the band

    def run(batches):
        own = Lexicon(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(key), text_of(own.prints(batch.column("text")))], [key, "fingerprint"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, fingerprint string")


def with_next(docs: DataFrame, key: str, work: Work) -> DataFrame:
    """Rows laid out so that each is directly followed, in its partition, by the next in descending key: stretch, ghost, key, text.

    Keys are cut into stretches at range-partition bounds; the first row of each stretch is sent once more as the end of
    the one before it (`ghost`).
    """
    n = partitions(docs.sparkSession)
    ids = docs.select(F.col(key).cast("long").alias(key)).filter(F.col(key).isNotNull())
    heads = ids.repartitionByRange(n, key).groupBy(F.spark_partition_id().alias("p")).agg(F.max(key).alias("top")).select("top").distinct()
    tops = np.sort(np.array([r["top"] for r in heads.collect()], np.int64))  # one row a partition
    follows = {int(t): (k + 1) % len(tops) for k, t in enumerate(tops)}

    @F.pandas_udf("array<int>")
    def stretches(keys: pd.Series) -> pd.Series:
        known = keys.notna()
        own = np.searchsorted(tops, keys.fillna(0).astype(np.int64).to_numpy()) if len(tops) else np.zeros(len(keys), np.int64)
        return pd.Series([[int(s), follows[int(k)]] if ok and int(k) in follows else [int(s) if ok else -1] for s, k, ok in zip(own, keys, known)])

    rows = docs.select(F.col(key).cast("long").alias(key), "text")
    rows = rows.select(key, "text", F.posexplode(stretches(key)).alias("ghost", "stretch"))
    return rows.repartition(n, "stretch").sortWithinPartitions("stretch", "ghost", F.col(key).desc(), "text")


def compare_edited(docs: DataFrame, lex: np.ndarray, work: Work, key: str = "doc_id") -> DataFrame:
    """Per document: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    sent = docs.sparkSession.sparkContext.broadcast(lex)  # bounded by the band

    def run(batches):
        own = Lexicon(sent.value)
        held = None

        def answer(table: pa.Table, last: bool):
            stretch, ghost, keys = (table.column(c).to_pylist() for c in ("stretch", "ghost", key))
            texts = [t or "" for t in table.column("text").to_pylist()]
            n = len(texts) if last else len(texts) - 1
            real = [k for k in range(n) if not ghost[k]]
            after = [texts[k + 1] if k + 1 < len(texts) and stretch[k + 1] == stretch[k] else "" for k in real]
            edited = []
            for k, t in zip(real, after):
                third = len(texts[k]) // 3
                edited.append(texts[k][: len(texts[k]) - third] + t[:third])
            prints = own.prints(pa.array([*texts, ""], pa.large_string()))
            changed = own.prints(pa.array(edited, pa.large_string()))
            real_ = np.array(real, np.int64)
            next_ = np.array([k + 1 if k + 1 < len(texts) and stretch[k + 1] == stretch[k] else len(texts) for k in real], np.int64)
            mine = prints[real_]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[k] for k in real], pa.int64()), pa.array([len(texts[k]) for k in real], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    text_of(mine), text_of(changed), pa.array(likeness(mine, changed)), pa.array(likeness(mine, prints[next_])),
                ],
                [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in batches:
            table = pa.Table.from_batches([batch])
            # few rows at a time: texts, edited texts and fingerprints are held at once
            for start in range(0, table.num_rows, 1000):
                part = table.slice(start, 1000)
                part = part if held is None else pa.concat_tables([held, part])
                if part.num_rows > 1:
                    yield from answer(part, False)
                held = part.slice(part.num_rows - 1)
        if held is not None:
            yield from answer(held, True)

    return with_next(docs, key, work).mapInArrow(run, f"{key} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
