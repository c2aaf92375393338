"""Integers packed to few bytes, for columns that tasks send each other."""

from __future__ import annotations

import numpy as np


def pack(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value."""
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(raw: bytes, width: int) -> np.ndarray:
    got = np.frombuffer(raw, np.uint8).reshape(-1, width)
    out = np.zeros((len(got), 8), np.uint8)
    out[:, :width] = got
    return out.reshape(-1).view(np.uint64)


def pack_keys(values: np.ndarray) -> bytes:
    """Any 64-bit integers, as differences from the least in as few bytes as the greatest needs."""
    if not len(values):
        return b""
    low = values.min()
    rise = values.astype(np.int64).view(np.uint64) - np.int64(low).astype(np.uint64)
    width = max(1, (int(rise.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.int64(low).tobytes() + pack(rise, width)


def unpack_keys(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    low = np.frombuffer(raw, np.int64, 1, 1)[0]
    return (unpack(raw[9:], raw[0]) + np.int64(low).astype(np.uint64)).view(np.int64)


def by_bucket(docs: np.ndarray, values: np.ndarray, buckets: int) -> tuple[list[int], list[bytes], list[bytes]]:
    """Pairs of a document and a value, packed into one row for each bucket of documents."""
    bucket = docs % buckets
    order = np.lexsort((docs, bucket))
    bucket, docs, values = bucket[order], docs[order], values[order]
    begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
    ends = np.r_[begin[1:], len(bucket)]
    return bucket[begin].tolist(), [pack_keys(docs[a:b]) for a, b in zip(begin, ends)], [pack_keys(values[a:b].astype(np.int64)) for a, b in zip(begin, ends)]


def by_document(rows, key: str):
    """Rows (bucket, docs, values) as one row for each document: key, values (its values as 64-bit integers)."""
    import pyarrow as pa

    def gather(group: pa.Table) -> pa.Table:
        docs = np.concatenate([unpack_keys(x.as_py()) for x in group.column("docs")])
        values = np.concatenate([unpack_keys(x.as_py()) for x in group.column("values")])
        order = np.argsort(docs, kind="stable")
        docs, values = docs[order], values[order]
        begin = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]][: len(docs)])
        ends = np.r_[begin, len(docs)]
        return pa.table({key: docs[begin], "values": pa.array([values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())})

    return rows.select("bucket", "docs", "values").groupBy("bucket").applyInArrow(gather, f"{key} long, values binary")
