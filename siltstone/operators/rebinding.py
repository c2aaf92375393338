"""Quotes of one version of documents bound anew to the segments of the next.

A quote is looked for word for word in the new segments of its own document. Its anchor is the hash of its document and its first
bytes, ANCHOR or less. Anchors and segments are dealt by document, once each; a task has its documents' anchors, eight bytes
each, before their segments come, which it goes over batch by batch: it hashes each place for each length of anchor in use and
sends on only segments with a place that has a quote's anchor. These meet the quotes by anchor, and whole quotes are compared.
So what is shuffled grows as the texts and quotes do, and no document is held whole.

An old binding is never changed: what comes out are new rows. `valid` has the first place in the document's new segments
and in how many segments the quote stands; `stale_binding` has none; `source_removed` has no segment of its document.

Defined results: an empty or null quote, or one of a null document, is `invalid`; rows of one citation are answered each by
itself; equal quotes of a document are looked for once; null segments hold nothing, but their document is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from siltstone.operators.near import mixed
from siltstone.sources.tables import Folder

#: Bytes of a quote that its anchor has, at most; shorter ones have the greatest power of two that they reach.
ANCHOR = 32
_P, _PER_LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def _runs(data: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the rising lengths the hash of the bytes that begin at each place with so many after it; each length goes on from the last."""
    h = np.zeros(len(data), np.uint64)
    done = 0
    for length in lengths:
        n = max(len(data) - length + 1, 0)
        h = h[:n].copy()
        for k in range(done, length):
            h *= _P
            h += data[k : k + n]
            h += np.uint64(1)
        done = length
        yield length, h + np.uint64(length) * _PER_LENGTH


def anchors(quotes: DataFrame, most: int = ANCHOR) -> DataFrame:
    """document_id, quote, anchor, length. quotes: distinct (document_id, quote), none empty."""
    rows = quotes.select("document_id", "quote", F.xxhash64("document_id").alias("d"))
    kind = rows.schema["document_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _bytes(batch.column("quote"))
            length = 1 << np.floor(np.log2(np.clip(np.diff(at), 1, most))).astype(np.int64)
            out = np.zeros(len(length), np.uint64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                h = np.zeros(len(own), np.uint64)
                for k in range(n):
                    h = h * _P + data[at[own] + k] + np.uint64(1)
                out[own] = h + np.uint64(n) * _PER_LENGTH
            key = mixed(out ^ mixed(batch.column("d").to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_pydict({"document_id": batch.column("document_id"), "quote": batch.column("quote"), "anchor": key.view(np.int64), "length": pa.array(length, pa.int32())})

    return rows.mapInArrow(task, f"document_id {kind}, quote string, anchor long, length int")


def places(segments: DataFrame, keyed: DataFrame, lengths: list[int]) -> DataFrame:
    """document_id, sequence, segment, anchor: each anchor of a quote that a segment has, once. Anchors come to where their document's segments do, before them."""
    rows = segments.filter("segment is not null").select("document_id", "sequence", "segment", F.xxhash64("document_id").alias("d"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    none = [F.lit(None).cast(kinds[c]).alias(c) for c in ("document_id", "sequence", "segment")]
    both = keyed.select(*none, F.xxhash64("document_id").alias("d"), "anchor").unionByName(rows.withColumn("anchor", F.lit(None).cast("long")))
    both = both.repartition("d").sortWithinPartitions(F.col("anchor").isNull())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, waiting = None, []
        for batch in batches:
            is_anchor = batch.column("anchor").is_valid()
            if is_anchor.true_count:
                waiting.append(batch.column("anchor").drop_null().to_numpy())
                batch = batch.filter(pc.invert(is_anchor))
            if not batch.num_rows or not waiting:
                continue
            if known is None:
                known = np.unique(np.concatenate(waiting))
                size = 1 << int(64 * len(known) - 1).bit_length()
                some = np.zeros(size, bool)  # tells most places apart without a search
                some[known & (size - 1)] = True
            data, at = _bytes(batch.column("segment"))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, min(int(np.searchsorted(at, at[i] + (1 << 20), "right")) - 1, batch.num_rows))
                own, begin = data[at[i] : at[j]], at[i:j] - at[i]
                size = np.diff(at[i : j + 1])
                row = np.repeat(np.arange(j - i), size)
                left = (begin + size)[row] - np.arange(len(own))  # bytes from here to the segment's end
                d = mixed(batch.column("d").slice(i, j - i).to_numpy().view(np.uint64))
                rows_, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for n, h in _runs(own, lengths):
                    key = mixed(h ^ d[row[: len(h)]]).view(np.int64)
                    hit = np.flatnonzero((left[: len(h)] >= n) & some[key & (len(some) - 1)])
                    hit = hit[known[np.minimum(np.searchsorted(known, key[hit]), len(known) - 1)] == key[hit]]
                    rows_.append(row[hit])
                    keys.append(key[hit])
                found = np.unique(np.stack([np.concatenate(rows_), np.concatenate(keys)], 1), axis=0)
                part = batch.slice(i, j - i).select(["document_id", "sequence", "segment"]).take(pa.array(found[:, 0]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found[:, 1])], ["document_id", "sequence", "segment", "anchor"])
                i = j

    return both.mapInArrow(task, f"document_id {kinds['document_id']}, sequence {kinds['sequence']}, segment string, anchor long")


def rebound(bindings: DataFrame, segments: DataFrame, folder: Folder, version: str, most: int = ANCHOR) -> DataFrame:
    """New rows for bindings (citation_id, document_id, quote): citation_id, document_id, quote, normalization_version, binding_status, sequence, quote_start, segment_hash, places.

    segments: document_id, sequence, segment, of the new version. quote_start counts characters from 0.
    """
    own = bindings.select("citation_id", "document_id", "quote")
    fit = own.filter("document_id is not null and quote != ''").select("document_id", "quote").distinct()
    keyed = folder.save(anchors(fit, most), "anchors")
    lengths = sorted(r[0] for r in keyed.select("length").distinct().collect())  # powers of two up to `most`
    held = places(segments, keyed, lengths)
    met = held.join(keyed.select(F.col("document_id").alias("of"), "anchor", "quote"), "anchor").filter("document_id = of")
    found = met.select("document_id", "quote", "sequence", F.instr(F.col("segment"), F.col("quote")).alias("at"), F.unhex(F.sha2("segment", 256)).alias("segment_hash")).filter("at > 0")
    best = found.groupBy("document_id", "quote").agg(F.min(F.struct("sequence", (F.col("at") - 1).alias("quote_start"), "segment_hash")).alias("first"), F.count("*").alias("places"))
    there = segments.select("document_id").distinct().withColumn("there", F.lit(True))
    out = own.join(folder.save(best, "places"), ["document_id", "quote"], "left").join(there, "document_id", "left")
    status = F.when(F.col("document_id").isNull() | (F.coalesce(F.col("quote"), F.lit("")) == ""), "invalid").when(F.col("there").isNull(), "source_removed").when(F.col("first").isNull(), "stale_binding").otherwise("valid")
    return out.select("citation_id", "document_id", "quote", F.lit(version).alias("normalization_version"), status.alias("binding_status"), "first.sequence", "first.quote_start", F.lower(F.hex("first.segment_hash")).alias("segment_hash"), F.coalesce("places", F.lit(0)).alias("places"))
