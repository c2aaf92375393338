"""Substring deduplication with a log-structured fingerprint index.

The index holds fingerprints of word windows as sorted runs, cut by ranges of the fingerprint; runs are never changed.
A new batch of documents is merge-joined with the runs range by range, its new fingerprints become a run, and runs of one
level are compacted into one of the next. Which windows are indexed is decided by their content: of each window of 13
words, the least of its nine 5-word fingerprints stands for it, so equal windows have equal entries, and neighbouring
windows mostly share theirs. Documents that meet in an entry are then verified: they send the fingerprints of the whole
windows that the entry stands for, and a window goes where a document with a smaller id has the very same.

What meets in a range is bounded: where several documents of a batch of rows have one fingerprint, they are joined there
and one of them stands for all.

Defined results: null and empty texts have no words and keep the empty text; documents of fewer words than a window lose
nothing; rows repeated under one doc_id don't take words from each other; rows with a null doc_id lose nothing and take
nothing; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltstone.llm import tokens
from siltstone.llm.packed import by_bucket, by_document, pack, pack_keys, unpack, unpack_keys
from siltstone.llm.tokens import U
from siltstone.llm.work import Work, partitions

WORDS = 13
#: Words of the pieces of which the least stands for a window.
PIECE = 5
#: Arrivals into which a whole table is divided, in order of its ids.
BATCHES = 3
#: Runs of one level that are compacted into one.
FAN_IN = 2
_BITS = 48

_SENT = "fragment int, kind int, docs binary, at binary, ids binary"
_SENT_ARROW = pa.schema([("fragment", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("at", pa.binary()), ("ids", pa.binary())])
_MET = pa.schema([("fragment", pa.int32()), ("bucket", pa.int32()), ("docs", pa.binary()), ("values", pa.binary())])
NEW, KNOWN, RUN = 0, 1, 2


def entries(w: tokens.Words, k: int = WORDS, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and entry (48 bits) of every window of k words."""
    _, at, print_ = w.windows(piece)
    least = np.full(len(w.hash) + k, U(1 << _BITS), U)
    least[at] = print_ >> U(64 - _BITS)
    span, size = k - piece + 1, 1
    while size < span:
        step = min(size, span - size)
        least[: len(least) - step] = np.minimum(least[: len(least) - step], least[step:])
        size += step
    n = np.maximum(w.counts - k + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + w.first[:-1][row]
    # least values crowd near 0; entries must fill the range that fragments cut
    return row, at, tokens.mix(least[at]) >> U(64 - _BITS)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, tokens.Words]]:
    data, offsets = tokens.buffers(batch.column("text"))
    for i, j in tokens.slices(offsets):
        yield i, j, tokens.words(data, offsets, i, j, tokens.BLANK_SPLIT, fold=False)


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def send_entries(docs: DataFrame, key: str, fragments: int) -> DataFrame:
    """Packed entries of each batch of rows, one document for each, by fragment; where several documents had one, all of these as known."""
    width = -(-(1 << _BITS) // fragments)

    def send(batches):
        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False).astype(np.int64)
            rows, ids = [], []
            for i, _, w in _slices(batch):
                row, _, entry = entries(w)
                new = np.r_[True, (entry[1:] != entry[:-1]) | (row[1:] != row[:-1])][: len(row)]
                rows.append(keys[row[new] + i])
                ids.append(entry[new])
            doc, id_ = _joined(rows, np.int64), _joined(ids, U)
            order = np.lexsort((doc, id_))
            doc, id_ = doc[order], id_[order]
            keep = np.r_[True, (id_[1:] != id_[:-1]) | (doc[1:] != doc[:-1])][: len(id_)]
            doc, id_ = doc[keep], id_[keep]
            new = np.r_[True, id_[1:] != id_[:-1]][: len(id_)]
            begin = np.flatnonzero(new)
            several = np.diff(np.r_[begin, len(id_)]) > 1
            met = several[np.cumsum(new) - 1] if len(begin) else np.zeros(0, bool)
            out = {name: [] for name in _SENT_ARROW.names}

            def put(kind, doc, id_, marks):
                fragment = (id_ // U(width)).astype(np.int64)
                cuts = np.searchsorted(fragment, np.arange(fragments + 1))
                for f in range(fragments):
                    a, b = cuts[f], cuts[f + 1]
                    if a < b:
                        for name, x in zip(out, (f, kind, pack_keys(doc[a:b]), np.packbits(marks[a:b]).tobytes(), pack(id_[a:b] - U(f * width), 6))):
                            out[name].append(x)

            put(NEW, doc[begin], id_[begin], several)
            put(KNOWN, doc[met], id_[met], met[met])
            yield pa.RecordBatch.from_pydict(out, schema=_SENT_ARROW)

    return docs.select(F.col(key).cast("long").alias(key), "text").filter(F.col(key).isNotNull()).mapInArrow(send, _SENT)


class FingerprintIndex:
    """Sorted immutable runs of window entries; `append` takes a batch of documents and returns what met."""

    def __init__(self, work: Work, key: str = "doc_id", name: str = "index"):
        self.work, self.key, self.name = work, key, name
        self.fragments = max(8, partitions(work.spark))
        self.width = -(-(1 << _BITS) // self.fragments)
        self.runs: list[tuple[int, str, DataFrame]] = []
        self.turn = 0

    def append(self, docs: DataFrame) -> DataFrame:
        """Merge-joins a batch with the runs: documents of either and entries that they share with others, packed by bucket of documents."""
        key, width, self_fragments = self.key, self.width, self.fragments

        def merge(group: pa.Table) -> pa.Table:
            f = group.column("fragment")[0].as_py()
            parts: dict[int, list] = {NEW: [], KNOWN: [], RUN: []}
            for kind, d, a, x in zip(*(group.column(c).to_pylist() for c in ("kind", "docs", "at", "ids"))):
                id_ = unpack(x, 6)
                marks = np.unpackbits(np.frombuffer(a, np.uint8), count=len(id_)).astype(bool) if kind == NEW else np.zeros(len(id_), bool)
                parts[kind].append((id_, unpack_keys(d), marks))
            got = {kind: [np.concatenate(c) for c in zip(*p)] if p else [np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, bool)] for kind, p in parts.items()}
            id_, doc, marked = got[NEW]
            order = np.argsort(id_, kind="stable")
            id_, doc, marked = id_[order], doc[order], marked[order]
            old, old_doc, _ = got[RUN]
            order = np.argsort(old, kind="stable")  # runs are sorted, so this merges them
            old, old_doc = old[order], old_doc[order]
            same = id_[1:] == id_[:-1]
            met = np.r_[False, same][: len(id_)] | np.r_[same, False][: len(id_)]
            at = np.minimum(np.searchsorted(old, id_), max(len(old) - 1, 0))
            was = old[at] == id_ if len(old) else np.zeros(len(id_), bool)
            flag = (met | was) & ~marked
            again = np.unique(at[was])
            docs_ = np.concatenate([doc[flag], old_doc[again] if len(old) else old_doc, got[KNOWN][1]])
            ids_ = np.concatenate([id_[flag], old[again] if len(old) else old, got[KNOWN][0]])
            first = np.r_[True, id_[1:] != id_[:-1]][: len(id_)] & ~was
            bucket, packed, values = by_bucket(docs_, (ids_ + U(f * width)).view(np.int64), self_fragments)
            return pa.table({"fragment": [f] * (len(bucket) + 1), "bucket": [*bucket, -1], "docs": [*packed, pack_keys(doc[first])], "values": [*values, pack(id_[first], 6)]}, schema=_MET)

        sent = send_entries(docs, key, self.fragments)
        for _, _, run in self.runs:
            sent = sent.unionByName(run.select("fragment", F.lit(RUN).alias("kind"), "docs", F.lit(b"").alias("at"), F.col("values").alias("ids")))
        self.turn += 1
        name = f"{self.name}-{self.turn}"
        got = self.work.save(sent.groupBy("fragment").applyInArrow(merge, "fragment int, bucket int, docs binary, values binary"), name)
        self.runs.append((0, name, got.filter("bucket < 0").select("fragment", "docs", "values")))
        return got.filter("bucket >= 0").select("bucket", "docs", "values")

    def close(self) -> None:
        """Deletes the runs and what met; a lasting index is one that isn't closed."""
        self.work.drop(*[f"{self.name}-{k + 1}" for k in range(self.turn)])
        self.runs = []

    def compact(self) -> None:
        """Merges the runs of any level that has FAN_IN of them into one of the next level."""
        while True:
            level = next((x for x, _, _ in self.runs if sum(y == x for y, _, _ in self.runs) >= FAN_IN), None)
            if level is None:
                return
            own = [r for r in self.runs if r[0] == level]
            rows = own[0][2]
            for r in own[1:]:
                rows = rows.unionByName(r[2])

            def merge(group: pa.Table) -> pa.Table:
                id_ = np.concatenate([unpack(x.as_py(), 6) for x in group.column("values")])
                doc = np.concatenate([unpack_keys(x.as_py()) for x in group.column("docs")])
                order = np.argsort(id_, kind="stable")
                return pa.table({"fragment": group.column("fragment").slice(0, 1), "docs": [pack_keys(doc[order])], "values": [pack(id_[order], 6)]})

            self.turn += 1
            name = f"{self.name}-{self.turn}"
            merged = self.work.save(rows.groupBy("fragment").applyInArrow(merge, "fragment int, docs binary, values binary"), name)
            self.runs = [r for r in self.runs if r[0] != level] + [(level + 1, name, merged)]


def repeats(docs: DataFrame, met: DataFrame, key: str) -> DataFrame:
    """Verifies what met: documents and first words of windows whose word sequence a document with a smaller id has, packed by bucket of documents."""
    fragments = max(8, partitions(docs.sparkSession))
    width = -(-(1 << 64) // fragments)

    def send(batches):
        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False).astype(np.int64)
            raw, ends = tokens.buffers(batch.column("values"))
            flat, ends = raw[ends[0] : ends[-1]].view(np.uint64), (ends - ends[0]) // 8
            docs_, starts, prints = [], [], []
            for i, j, w in _slices(batch):
                row, at, entry = entries(w)
                # entries of the slice's rows as one sorted list of (row, entry); rows of a slice are under 4096
                own = flat[ends[i] : ends[j]]
                wanted = np.unique((np.repeat(np.arange(j - i), np.diff(ends[i : j + 1])).astype(np.uint64) << U(_BITS)) | own)
                asked = (row.astype(np.uint64) << U(_BITS)) | entry
                place = np.minimum(np.searchsorted(wanted, asked), max(len(wanted) - 1, 0))
                some = np.flatnonzero(wanted[place] == asked) if len(wanted) else np.zeros(0, np.int64)
                row, at = row[some], at[some]
                sums = tokens.prefix(w.hash)
                prints.append(tokens.stretch(sums, at, at + WORDS))
                docs_.append(keys[row + i])
                starts.append((at - w.first[row]).astype(np.int32))
            doc, start, id_ = _joined(docs_, np.int64), _joined(starts, np.int32), _joined(prints, U)
            order = np.lexsort((doc, id_))
            doc, start, id_ = doc[order], start[order], id_[order]
            new = np.r_[True, id_[1:] != id_[:-1]][: len(id_)]
            least = doc[new][np.cumsum(new) - 1] if len(doc) else doc
            out = {name: [] for name in _SENT_ARROW.names}

            def put(kind, doc, start, id_):
                fragment = (id_ // U(width)).astype(np.int64)
                cuts = np.searchsorted(fragment, np.arange(fragments + 1))
                for f in range(fragments):
                    a, b = cuts[f], cuts[f + 1]
                    if a < b:
                        for name, x in zip(out, (f, kind, pack_keys(doc[a:b]), pack_keys(start[a:b].astype(np.int64)), id_[a:b].tobytes() if kind == NEW else b"")):
                            out[name].append(x)

            put(NEW, doc[doc == least], start[doc == least], id_[doc == least])
            put(KNOWN, doc[doc > least], start[doc > least], id_[doc > least])
            yield pa.RecordBatch.from_pydict(out, schema=_SENT_ARROW)

    def least(group: pa.Table) -> pa.Table:
        parts: dict[int, list] = {NEW: [], KNOWN: []}
        for kind, d, a, x in zip(*(group.column(c).to_pylist() for c in ("kind", "docs", "at", "ids"))):
            parts[kind].append((unpack_keys(d), unpack_keys(a), np.frombuffer(x, U)))
        docs_, starts = [p[0] for p in parts[KNOWN]], [p[1] for p in parts[KNOWN]]
        if parts[NEW]:
            doc, start, id_ = (np.concatenate(c) for c in zip(*parts[NEW]))
            order = np.lexsort((doc, id_))
            doc, start, id_ = doc[order], start[order], id_[order]
            new = np.r_[True, id_[1:] != id_[:-1]][: len(id_)]
            later = doc > doc[new][np.cumsum(new) - 1]
            docs_.append(doc[later])
            starts.append(start[later])
        return pa.table(dict(zip(("bucket", "docs", "values"), by_bucket(_joined(docs_, np.int64), _joined(starts, np.int64), fragments))), schema=pa.schema(list(_MET)[1:]))

    rows = docs.select(F.col(key).cast("long").alias(key), "text").join(by_document(met, key), key)
    return rows.mapInArrow(send, _SENT).groupBy("fragment").applyInArrow(least, "bucket int, docs binary, values binary")


def remove(docs: DataFrame, found: DataFrame, key: str, k: int = WORDS) -> DataFrame:
    """Per document: key, n_words, n_removed, kept (the words that stay, joined by one space)."""

    def cut(batches):
        for batch in batches:
            lists = batch.column("values")
            n_words, n_removed, kept = [], [], []
            for i, j, w in _slices(batch):
                raw = w.data.tobytes()
                for r in range(j - i):
                    a, b = w.first[r], w.first[r + 1]
                    start, end = w.start[a:b], w.end[a:b]
                    own = lists[i + r].as_py()
                    if own:
                        at = np.frombuffer(own, np.int64)
                        stay = ~tokens.covered(at, at + k, b - a)
                        start, end = start[stay], end[stay]
                    n_words.append(b - a)
                    n_removed.append(b - a - len(start))
                    kept.append(b" ".join([raw[x:y] for x, y in zip(start.tolist(), end.tolist())]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.large_string()).cast(pa.string())], [key, "n_words", "n_removed", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").join(by_document(found, key), key, "left").mapInArrow(cut, f"{key} {kind}, n_words long, n_removed long, kept string")


def deduplicate(docs: DataFrame, work: Work, key: str = "doc_id", batches: int = BATCHES) -> DataFrame:
    """Indexes a whole table as `batches` arrivals in order of its keys, then removes the repeated words of each document."""
    index = FingerprintIndex(work, key)
    bounds = sorted(set(docs.approxQuantile(key, [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    column, met = F.col(key), None
    for low, high in zip([None, *bounds], [*bounds, None]):
        rows = docs
        if low is not None:
            rows = rows.filter(column > int(low))
        if high is not None:
            rows = rows.filter(column <= int(high))
        flags = index.append(rows)
        met = flags if met is None else met.unionByName(flags)
        if high is not None:
            index.compact()
    found = work.save(repeats(docs, met, key), "repeats")
    index.close()
    return remove(docs, found, key)


def kept_sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
