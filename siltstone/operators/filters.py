"""Filters of fixed size: which hashes are surely not among given ones. They spare shuffles; what they let through is joined."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Bits of a filter, 4 MB; where keys fill it, it lets more through.
BITS = 1 << 25
_PIECE = 1 << 15


def of(keys: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Two bits for each 64-bit hash of a column, in pieces that tasks fill; `bits` in all, a power of two, however many hashes there are."""
    both = F.array(F.pmod(column, F.lit(bits)), F.pmod(F.shiftrightunsigned(column, 32), F.lit(bits)))
    at = keys.select(F.explode(both).alias("bit")).distinct()

    def fill(group: pa.Table) -> pa.Table:
        own = np.zeros(_PIECE, bool)
        own[group["bit"].to_numpy() % _PIECE] = True
        return pa.table({"piece": [group["bit"][0].as_py() // _PIECE], "mask": pa.array([np.packbits(own).tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    for r in at.withColumn("p", F.expr(f"bit div {_PIECE}")).groupBy("p").applyInArrow(fill, "piece long, mask binary").toLocalIterator():
        out[r["piece"] * _PIECE // 8 : (r["piece"] + 1) * _PIECE // 8] = np.frombuffer(r["mask"], np.uint8)
    return out


def has(mask: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False where a hash is surely not among the filter's."""

    def on(bit: np.ndarray) -> np.ndarray:
        return ((mask[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1).astype(bool)

    out = on(hashes & (8 * len(mask) - 1))
    some = np.flatnonzero(out)
    out[some] = on((hashes[some].view(np.uint64) >> np.uint64(32)).view(np.int64) & (8 * len(mask) - 1))
    return out
