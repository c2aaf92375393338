"""Suffix-array deduplication of long byte strings.

Strings of SPAN bytes are removed; where a shorter length is asked for too (`noted`), what strings of that length cover is
counted beside. Only places that can hold a repeated string reach a suffix array: each
string of the shorter length is named by the least fingerprint of its pieces, so equal strings have equal names, and a name that
occurs once rules its strings out. The stretches of text under one name that occurs more often, with what follows up to
SPAN bytes, are gathered by name into shards of bounded size. Each shard sorts its suffixes and takes common prefixes of
neighbours; where the stretches of one name fill several shards, each shard's suffixes are looked up in the suffix
arrays of the others by binary search.

What meets under a name is bounded by batches of rows: equal stretches of one batch are sent once. A name that many
batches have (a line common to many texts) is split by a second name of its strings, the least of other fingerprints.

Defined results: null and empty texts have no bytes and keep none; texts shorter than the span lose nothing; rows
repeated under one doc_id are places of their own; rows with a null doc_id lose nothing and take nothing; further
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltstone.llm import tokens
from siltstone.llm.packed import by_bucket, by_document, pack, pack_keys, unpack, unpack_keys
from siltstone.llm.suffix_array import Shard
from siltstone.llm.tokens import U
from siltstone.llm.work import Work, partitions

SPAN = 400
PIECE = 32
#: A name that more batches' documents have than this is split by second names.
COMMON = 256
#: Bytes of a shard's text; one name's stretches may fill four times as much before they take several shards.
SHARD = 1 << 19
#: Bytes of stretches that a task holds before it sends them.
HELD = 8 << 20
_BITS = 48
_FLAG = 1 << 62
_SENT = "fragment int, kind int, docs binary, starts binary, names binary, sizes binary, owns binary, bytes binary"
_MET = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("values", pa.binary())])
_SENT_ARROW = pa.schema([("fragment", pa.int32()), ("kind", pa.int32()), *((x, pa.binary()) for x in ("docs", "starts", "names", "sizes", "owns", "bytes"))])


def _slide(x: np.ndarray, span: int, pick) -> np.ndarray:
    """pick over x[i : i + span], for each i (what lies beyond the end is left out)."""
    x, size = x.copy(), 1
    while size < span:
        step = min(size, span - size)
        x[: len(x) - step] = pick(x[: len(x) - step], x[step:])
        size += step
    return x


def _spread(least: np.ndarray) -> np.ndarray:
    """Least values crowd near 0; names must fill the range that fragments cut."""
    return tokens.mix(least) >> U(64 - _BITS)


def _prints(data: np.ndarray, bounds: np.ndarray, span: int, piece: int, salt: int) -> np.ndarray:
    """Fingerprint of the piece at each place, above all others where a row ends in it."""
    n = len(data)
    sums = tokens.prefix(tokens._BYTES[data])
    at = np.arange(n - piece + 1)
    out = np.full(n + span, U(1 << _BITS), U)
    got = tokens.stretch(sums, at, at + piece)
    out[at] = (tokens.mix(got ^ U(salt)) if salt else got) >> U(64 - _BITS)
    end = np.repeat(bounds[1:], np.diff(bounds))
    out[:n][np.arange(n) + piece > end] = U(1 << _BITS)
    return out


def second_names(data: np.ndarray, bounds: np.ndarray, start: np.ndarray, span: int, piece: int) -> np.ndarray:
    """Other names of the strings that start at the given places."""
    return _spread(_slide(_prints(data, bounds, span, piece, 0x2545F4914F6CDD1D), span - piece + 1, np.minimum)[start])


def names(data: np.ndarray, bounds: np.ndarray, span: int = SPAN, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and name of each `span`-byte string within a row, and place and name of each piece that names any. bounds: rows' offsets in data."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < span:
        return none, np.zeros(0, U), none, np.zeros(0, U)
    print_ = _prints(data, bounds, span, piece, 0)
    end = np.repeat(bounds[1:], np.diff(bounds))
    place = np.arange(n)
    wide = span - piece + 1
    least = _slide(print_, wide, np.minimum)[:n]
    valid = place + span <= end
    # a piece names a string if its print is the least of some string that holds it
    most = np.concatenate([np.zeros(wide - 1, U), np.where(valid, least, U(0))])
    names_any = (_slide(most, wide, np.maximum)[:n] == print_[:n]) & (print_[:n] < U(1 << _BITS))
    start, held = np.flatnonzero(valid), np.flatnonzero(names_any)
    return start, _spread(least[start]), held, _spread(print_[held])


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = tokens.buffers(batch.column("text"))
    for i, j in tokens.slices(offsets, 1 << 19):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def shared_names(docs: DataFrame, key: str, span: int = SPAN, piece: int = PIECE, common: int = COMMON) -> DataFrame:
    """Documents and names (common ones flagged) of their pieces that occur more than once, anywhere, packed by bucket of documents."""
    fragments = max(8, partitions(docs.sparkSession))
    width = -(-(1 << _BITS) // fragments)

    def send(batches):
        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False).astype(np.int64)
            docs_, ids = [np.zeros(0, np.int64)], [np.zeros(0, U)]
            for i, j, data, bounds in _slices(batch):
                _, _, held, name = names(data, bounds, span, piece)
                docs_.append(keys[i + np.searchsorted(bounds, held, "right") - 1])
                ids.append(name)
            doc, id_ = np.concatenate(docs_), np.concatenate(ids)
            order = np.argsort(id_)
            doc, id_ = doc[order], id_[order]
            new = np.r_[True, id_[1:] != id_[:-1]][: len(id_)]
            begin = np.flatnonzero(new)
            several = np.diff(np.r_[begin, len(id_)]) > 1
            met = several[np.cumsum(new) - 1] if len(begin) else np.zeros(0, bool)
            out = {name: [] for name in _SENT_ARROW.names}
            for kind, d, x, marks in ((0, doc[begin], id_[begin], several), (1, doc[met], id_[met], met[met])):
                cuts = np.searchsorted((x // U(width)).astype(np.int64), np.arange(fragments + 1))
                for f in range(fragments):
                    a, b = cuts[f], cuts[f + 1]
                    if a < b:
                        for name, y in zip(out, (f, kind, pack_keys(d[a:b]), np.packbits(marks[a:b]).tobytes(), pack(x[a:b] - U(f * width), 6), b"", b"", b"")):
                            out[name].append(y)
            yield pa.RecordBatch.from_pydict(out, schema=_SENT_ARROW)

    def meet(group: pa.Table) -> pa.Table:
        f = group.column("fragment")[0].as_py()
        parts: dict[int, list] = {0: [], 1: []}
        for kind, d, a, x in zip(*(group.column(c).to_pylist() for c in ("kind", "docs", "starts", "names"))):
            id_ = unpack(x, 6)
            parts[kind].append((unpack_keys(d), id_, np.unpackbits(np.frombuffer(a, np.uint8), count=len(id_)).astype(bool)))
        docs_, ids = [p[0] for p in parts[1]], [p[1] for p in parts[1]]
        if parts[0]:
            doc, id_, marked = (np.concatenate(c) for c in zip(*parts[0]))
            order = np.argsort(id_)
            doc, id_, marked = doc[order], id_[order], marked[order]
            same = id_[1:] == id_[:-1]
            met = (np.r_[False, same][: len(id_)] | np.r_[same, False][: len(id_)]) & ~marked
            docs_.append(doc[met])
            ids.append(id_[met])
        doc, id_ = np.concatenate(docs_), np.concatenate(ids)
        _, at, times = np.unique(id_, return_inverse=True, return_counts=True)
        flags = np.where(times[at] > common, U(_FLAG), U(0)) if len(id_) else id_
        return pa.table(dict(zip(_MET.names, by_bucket(doc, (id_ + U(f * width) | flags).view(np.int64), fragments))), schema=_MET)

    rows = docs.select(F.col(key).cast("long").alias(key), "text").filter(F.col(key).isNotNull())
    return rows.mapInArrow(send, _SENT).groupBy("fragment").applyInArrow(meet, "bucket int, docs binary, values binary")


def in_shards(pieces: list[bytes], of: np.ndarray, starts: list[int], spans: tuple[int, ...] = (SPAN,), size: int = SHARD) -> list[np.ndarray]:
    """For each span, by row, which of its strings in distinct pieces start more than once (columns: the first `starts` places of a piece, which are its own). of: each piece's name, ascending; pieces of one name share a shard or, if they fill several, are merged."""
    out: list[np.ndarray] = [np.zeros((len(spans), 0), bool)] * len(pieces)
    begin = [*np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)]).tolist(), len(of)]
    own: list[int] = []
    filled = 0

    def put(own: list[int], marks: list[np.ndarray]) -> None:
        for k, x in zip(own, marks):
            out[k] = x

    for a, b in zip(begin[:-1], begin[1:]):
        total = sum(len(p) for p in pieces[a:b])
        if own and filled + total > size:
            put(own, Shard([pieces[k] for k in own], [starts[k] for k in own]).repeated(spans))
            own, filled = [], 0
        if total <= 4 * size:
            own += range(a, b)
            filled += total
            continue
        shards, low = [], a
        while low < b:
            high, room = low, 4 * size
            while high < b and (high == low or len(pieces[high]) <= room):
                room -= len(pieces[high])
                high += 1
            shards.append((range(low, high), Shard(pieces[low:high], starts[low:high])))
            low = high
        for own_, shard in shards:
            found = shard.repeated(spans)
            for _, other in shards:
                if other is not shard:
                    found = [x | y for x, y in zip(found, shard.found_in(other, spans))]
            put(own_, found)
    if own:
        put(own, Shard([pieces[k] for k in own], [starts[k] for k in own]).repeated(spans))
    return out


def repeats(docs: DataFrame, met: DataFrame, key: str, span: int = SPAN, noted: int | None = None, piece: int = PIECE, shard: int = SHARD) -> DataFrame:
    """Documents and ranges (first start * 2**31 + last start + 1, flagged for the shorter strings) of strings that occur more than once, packed by bucket of documents."""
    spans = (span,) if noted is None else (span, noted)
    flags, noted = (0, _FLAG)[: len(spans)], spans[-1]
    fragments = max(8, partitions(docs.sparkSession))
    width = -(-(1 << _BITS) // fragments)

    def send(batches):
        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, ends = tokens.buffers(batch.column("values"))
            flat, ends = flat[ends[0] : ends[-1]].view(np.uint64), (ends - ends[0]) // 8
            # stretches by their bytes (which settle the rest): name, how many strings start in it, places
            held: dict[bytes, list] = {}
            size = 0
            for i, j, data, bounds in _slices(batch):
                start, name, _, _ = names(data, bounds, noted, piece)
                row = np.searchsorted(bounds, start, "right") - 1
                listed = flat[ends[i] : ends[j]]
                wanted, first = np.unique((np.repeat(np.arange(j - i), np.diff(ends[i : j + 1])).astype(np.uint64) << U(_BITS)) | (listed & U((1 << _BITS) - 1)), return_index=True)
                split = listed[first] >= U(_FLAG)
                if not len(wanted) or not len(start):
                    continue
                asked = (row.astype(np.uint64) << U(_BITS)) | name
                at = np.minimum(np.searchsorted(wanted, asked), len(wanted) - 1)
                some = wanted[at] == asked
                start, row, asked, split = start[some], row[some], asked[some] & U((1 << _BITS) - 1), split[at[some]]
                if not len(start):
                    continue
                if split.any():
                    asked[split] = _spread(asked[split] ^ second_names(data, bounds, start[split], noted, piece))
                first = np.flatnonzero(np.r_[True, (asked[1:] != asked[:-1]) | (start[1:] != start[:-1] + 1) | (row[1:] != row[:-1])])
                last = np.r_[first[1:], len(start)] - 1
                raw = data.tobytes()
                for a, b, m, n, r in zip(start[first].tolist(), np.minimum(start[last] + span, bounds[row[first] + 1]).tolist(), (last - first + 1).tolist(), asked[first].tolist(), row[first].tolist()):
                    got = held.get(text := raw[a:b])
                    if got is None:
                        held[text] = got = [n, m, []]
                        size += len(text)
                    got[2].append((int(keys[i + r]), int(a - bounds[r])))
                if size > HELD:
                    yield put(held)
                    held, size = {}, 0
            yield put(held)

    def put(held: dict[bytes, list]) -> pa.RecordBatch:
        by: dict[tuple[int, int], list] = {}
        for text, (name, own, places) in held.items():
            f = name // width
            by.setdefault((f, len(places) > 1), []).append((*places[0], name, len(text), own, text))
            for doc, at in places if len(places) > 1 else ():
                by.setdefault((f, 2), []).append((doc, at, name, len(text), own, b""))
        out = {name: [] for name in _SENT_ARROW.names}
        for (f, kind), rows in by.items():
            d, s, n, z, o, t = zip(*rows)
            for name, y in zip(out, (f, int(kind), *(pack_keys(np.array(x, np.int64)) for x in (d, s, n, z, o)), b"".join(t))):
                out[name].append(y)
        return pa.RecordBatch.from_pydict(out, schema=_SENT_ARROW)

    def sort(group: pa.Table) -> pa.Table:
        """kind 0: stretches of one place; 1: that stand for several places of a batch; 2: those places."""
        docs_, ranges = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        held: dict[bytes, list] = {}

        def put(doc: np.ndarray, at: np.ndarray, edges: np.ndarray, flag: int) -> None:
            """edges: first and last start + 1, from each of the places at."""
            low = (at[:, None] + edges[None, :, 0]).ravel()
            docs_.append(np.repeat(doc, len(edges)))
            ranges.append(flag | (low << 31) | (at[:, None] + edges[None, :, 1]).ravel())

        for kind, *packed, text in zip(*(group.column(c).to_pylist() for c in _SENT_ARROW.names[1:])):
            doc, at, name, size, starts = (unpack_keys(x) for x in packed)
            if kind == 2:
                for flag, wide in zip(flags, spans):
                    n = np.minimum(size - wide + 1, starts)
                    docs_.append(doc[n > 0])
                    ranges.append((flag | (at << 31) | (at + n))[n > 0])
                continue
            ends = np.cumsum(size)
            for d, s, n, m, a, b in zip(doc.tolist(), at.tolist(), name.tolist(), starts.tolist(), (ends - size).tolist(), ends.tolist()):
                got = held.setdefault(text[a:b], [n, m, 0, []])
                got[2] += 1 + kind
                if not kind:
                    got[3].append((d, s))
        # a stretch that stands in several places, and is the only one of its name, is known to repeat as a whole
        kinds = Counter(name for name, *_ in held.values())
        pieces = sorted((t for t, (name, _, times, _) in held.items() if times == 1 or kinds[name] > 1), key=lambda t: held[t][0])
        marks = in_shards(pieces, np.array([held[t][0] for t in pieces], np.int64), [held[t][1] for t in pieces], spans, shard)
        alone = [t for t, (name, _, times, _) in held.items() if times > 1 and kinds[name] == 1]
        for text, own in chain(zip(pieces, marks), zip(alone, repeat(((),) * len(spans)))):
            _, starts, times, places = held[text]
            if not places:
                continue
            doc, at = np.array(places, np.int64).T
            for flag, wide, some in zip(flags, spans, own):
                n = min(len(text) - wide + 1, starts)
                if n > 0:
                    put(doc, at, np.array([[0, n]]) if times > 1 else np.flatnonzero(np.diff(np.r_[False, some[:n], False].astype(np.int8))).reshape(-1, 2), flag)
        return pa.table(dict(zip(_MET.names, by_bucket(np.concatenate(docs_), np.concatenate(ranges), fragments))), schema=_MET)

    rows = docs.select(F.col(key).cast("long").alias(key), "text").join(by_document(met, key), key)
    # few bytes are much work here, so partitions must not be joined by size
    return rows.mapInArrow(send, _SENT).repartition(fragments, "fragment").groupBy("fragment").applyInArrow(sort, "bucket int, docs binary, values binary")


def remove(docs: DataFrame, found: DataFrame, key: str, span: int = SPAN, noted: int | None = None) -> DataFrame:
    """Per document: key, n_bytes, n_removed, n_spans, kept (the bytes that stay); with `noted`, n_repeated (bytes in repeated strings of that length)."""
    further = [] if noted is None else ["n_repeated"]
    noted = noted or span

    def cut(batches):
        for batch in batches:
            lists = batch.column("values")
            n_bytes, n_removed, n_spans, n_repeated, kept = [], [], [], [], []
            data, offsets = tokens.buffers(batch.column("text"))
            for r in range(len(offsets) - 1):
                own = data[offsets[r] : offsets[r + 1]]
                n_bytes.append(len(own))
                ranges = lists[r].as_py()
                if not ranges:
                    n_removed.append(0)
                    n_spans.append(0)
                    n_repeated.append(0)
                    kept.append(own.tobytes())
                    continue
                edges = np.frombuffer(ranges, np.int64)
                short, edges = edges >= _FLAG, edges & (_FLAG - 1)
                begin, end = edges >> 31, edges & ((1 << 31) - 1)
                gone = tokens.covered(begin[~short], end[~short] + span - 1, len(own))
                n_repeated.append(int(tokens.covered(begin[short], end[short] + noted - 1, len(own)).sum()))
                n_removed.append(int(gone.sum()))
                n_spans.append(int((np.diff(np.r_[False, gone].astype(np.int8)) == 1).sum()))
                kept.append(own[~gone].tobytes())
            counts = [n_bytes, n_removed, n_spans, n_repeated][: 3 + len(further)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(x, pa.int64()) for x in counts), pa.array(kept, pa.binary())], [key, "n_bytes", "n_removed", "n_spans", *further, "kept"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").join(by_document(found, key), key, "left").mapInArrow(cut, f"{key} {kind}, n_bytes long, n_removed long, n_spans long, {''.join(f'{c} long, ' for c in further)}kept binary")


def deduplicate(docs: DataFrame, work: Work, key: str = "doc_id", span: int = SPAN, noted: int | None = None, piece: int = PIECE, shard: int = SHARD, common: int = COMMON) -> DataFrame:
    """noted: a further length to be counted, at most `span` and no less than `piece`."""
    met = work.save(shared_names(docs, key, noted or span, piece, common), "names")
    found = work.save(repeats(docs, met, key, span, noted, piece, shard), "repeats")
    return remove(docs, found, key, span, noted)
