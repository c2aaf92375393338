"""Mixing of sources to target weights by Pfair scheduling.

Each source's documents, in a hashed order, fill units of equal size, half a block each. In the fluid mix every source that
has units left is served at a rate in proportion to its weight, so that after t slots t units are served; T(x) is the slot at
which the fluid mix has served x units of a source. Its unit i is released at slot floor(T(i)) and due by slot ceil(T(i + 1));
each slot takes the released unit that is due first.

This is done in two levels. The slots are cut into periods, at most `PERIODS` of them and two for each source's end, so that
all rates stay as they are within one. The driver takes for each period as many units as it has slots, due first, first; a cut then
has each source within one unit of the fluid mix, and one bit tells on which side. Inside a period, where a source's units
are now whole, a task schedules these alone by releases and deadlines, within one unit of a line between its cuts. So
at any slot a source has had less than two units, one block, more or less than what the fluid mix gave it. All is in whole numbers from the
weights as given, so nothing is rounded and nothing drifts. When a source has no more units, the rates of the others go up,
and every document is placed once and none is dropped or repeated. What the driver does and sends is bounded by periods and
sources, however many units there are.

Offsets within a source are sums within hashed chunks and, over the chunks, of their sums; no task takes a whole source.

Defined results: every source is scheduled by itself, null as one more; sources without a given weight share what
is left of 1, or a hundredth of the least weight; weights of 0 or below come last, by size; empty and null texts have one
byte; a text longer than a unit stands at the unit it begins in; repeated rows follow each other; further columns stay.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections import OrderedDict
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from siltstone.llm.work import partitions

#: Bytes of a block.
BLOCK = 1 << 16
#: Periods that the driver looks at, at most.
PERIODS = 1 << 16
#: Slots of a period, at least; 16 times the sources, if that is more.
PERIOD = 1 << 12
#: Periods whose slots a task remembers.
REMEMBERED = 32
#: Default weights are the sources' bytes to this power.
POWER = 0.7
#: The name of null.
POOL = "\x00pool"


def schedule(own: list[int]) -> list[list[int]]:
    """The slots of each source's units in one period: of the released units the one due first, then of the first source."""
    period = sum(own)
    slots: list[list[int]] = [[] for _ in own]
    waiting = [(0, k) for k in range(len(own)) if own[k]]
    ready: list[tuple[int, int]] = []
    heapq.heapify(waiting)
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[k]) + 1) * period // own[k]), k))
        _, k = heapq.heappop(ready)
        slots[k].append(slot)
        if len(slots[k]) < own[k]:
            heapq.heappush(waiting, (len(slots[k]) * period // own[k], k))
    return slots


class Plan:
    """The slots of sources' units; each has at least one, and a weight above 0."""

    def __init__(self, units: list[int], weights: list[float], start: int = 0):
        exact = [Fraction(w) for w in weights]
        scale = math.lcm(*(w.denominator for w in exact))
        self.units, self.own, self.start, self.total = units, [int(w * scale) for w in exact], start, sum(units)
        # a source ends when the fluid time, units by weight, is its own last; then some units were of ended sources, and some weight is left
        order = sorted(range(len(units)), key=lambda k: Fraction(units[k], self.own[k]))
        self.ends = [Fraction(units[k], self.own[k]) for k in order]
        self.place = {k: j for j, k in enumerate(order)}
        self.ended, self.left = [0], [sum(self.own)]
        for k in order:
            self.ended.append(self.ended[-1] + units[k])
            self.left.append(self.left[-1] - self.own[k])
        self.kinks = [n + w * end for n, w, end in zip(self.ended, self.left, self.ends)]
        step = max(PERIOD, 16 * len(units), -(-self.total // PERIODS))
        bends = {f(k) for k in self.kinks for f in (math.floor, math.ceil)}
        self.cuts = sorted({*range(0, self.total, step), self.total, *bends})
        self.up = self._rounded()
        self._starts: dict[int, np.ndarray] = {}
        self._inside: OrderedDict[int, list[np.ndarray]] = OrderedDict()

    def _served(self, t: int, k: int, ended: int) -> tuple[int, bool]:
        """Whole units of a source that the fluid mix has served before slot t, and whether it has begun another."""
        if self.place[k] < ended:
            return self.units[k], False
        whole, rest = divmod(self.own[k] * (t - self.ended[ended]), self.left[ended])
        return whole, rest > 0

    def _due(self, k: int, x: int) -> int:
        at = bisect.bisect_left(self.ends, Fraction(x, self.own[k]))
        return self.ended[at] - (-x * self.left[at] // self.own[k])

    def _rounded(self) -> np.ndarray:
        """For each cut and source, in bits: whether the unit that the fluid mix has begun stands before the cut."""
        up = np.zeros((len(self.cuts), len(self.units)), bool)
        now = [0] * len(self.units)
        for c, t in enumerate(self.cuts):
            ended = bisect.bisect_right(self.kinks, t)
            served = [self._served(t, k, ended) for k in range(len(now))]
            now = [max(had, whole) for had, (whole, _) in zip(now, served)]
            begun = [(self._due(k, whole + 1), k) for k, (whole, more) in enumerate(served) if more and now[k] == whole]
            for _, k in heapq.nsmallest(t - sum(now), begun):
                now[k] += 1
            up[c] = [n > whole for n, (whole, _) in zip(now, served)]
        return np.packbits(up, axis=1)

    def _had(self, c: int, k: int) -> int:
        t = self.cuts[c]
        return self._served(t, k, bisect.bisect_right(self.kinks, t))[0] + int(self.up[c, k >> 3] >> (7 - k % 8) & 1)

    def _period(self, c: int) -> list[np.ndarray]:
        if c not in self._inside:
            every = range(len(self.units))
            self._inside[c] = [np.array(s, np.int64) for s in schedule([self._had(c + 1, k) - self._had(c, k) for k in every])]
            if len(self._inside) > REMEMBERED:
                self._inside.popitem(last=False)
        self._inside.move_to_end(c)
        return self._inside[c]

    def slots(self, k: int, units: np.ndarray) -> np.ndarray:
        """The slots of a source's units, in any order."""
        if k not in self._starts:
            self._starts[k] = np.array([self._had(c, k) for c in range(len(self.cuts))], np.int64)
        before = self._starts[k]
        periods = np.searchsorted(before, units, "right") - 1
        out = np.empty(len(units), np.int64)
        for c in np.unique(periods):
            here = periods == c
            out[here] = self.start + self.cuts[c] + self._period(int(c))[k][units[here] - before[c]]
        return out


def phases(units: dict[str, int], weights: dict[str, float]) -> tuple[dict[str, tuple[Plan, int]], int]:
    """Each source's plan and its number there, and the slots in all: sources with a weight, and after them, by size, the others."""
    some = {s: n for s, n in sorted(units.items()) if n > 0}
    above = [s for s in some if weights.get(s, 0) > 0]
    out, start = {}, 0
    for names, own in ((above, weights), ([s for s in some if s not in set(above)], some)):
        if names:
            plan = Plan([some[s] for s in names], [own[s] for s in names], start)
            out |= {s: (plan, k) for k, s in enumerate(names)}
            start += plan.total
    return out, start


def target_weights(sizes: dict[str, int], given: dict[str, float] | None) -> dict[str, float]:
    if given is None:
        return {s: float(n) ** POWER for s, n in sizes.items()}
    rest = [s for s in sizes if s not in given]
    above = [w for s, w in given.items() if s in sizes and w > 0]
    share = max(1 - sum(above), 0.01 * min(above, default=1.0)) / max(len(rest), 1)
    return {s: given.get(s, share) for s in sizes}


def mix(docs: DataFrame, weights: dict[str, float] | None = None, key: str = "doc_id", source: str = "source", block: int = BLOCK) -> tuple[DataFrame, int]:
    """Rows (row: the document, pool, offset, block, slot: its half block's) and the slots in all. Their order is slot, offset, then the key."""
    rows = docs.select(F.struct("*").alias("row")).withColumn("bytes", F.greatest(F.coalesce(F.octet_length("row.text"), F.lit(1)), F.lit(1)).cast("long"))
    name = F.col(f"row.{source}").cast("string")
    pool = F.coalesce(name, F.lit(POOL))
    chunks = max(1, int(np.ceil(np.sqrt(docs.count()))))
    rows = rows.withColumn("pool", pool).withColumn("chunk", F.pmod(F.xxhash64(f"row.{key}"), F.lit(chunks)))
    sums = rows.groupBy("pool", "chunk").agg(F.sum("bytes").alias("own"))
    before = sums.withColumn("before", F.sum("own").over(Window.partitionBy("pool").orderBy("chunk")) - F.col("own"))
    sizes = {r["pool"]: r["n"] for r in sums.groupBy("pool").agg(F.sum("own").alias("n")).collect()}  # one of each source
    unit = max(1, block // 2)
    plans, total = phases({s: -(-n // unit) for s, n in sizes.items()}, target_weights(sizes, weights))

    # sent to tasks: a bit for each period and source
    @F.pandas_udf("long")
    def slot(pools: pd.Series, units: pd.Series) -> pd.Series:
        out = np.empty(len(pools), np.int64)
        for name, at in pools.groupby(pools).indices.items():
            plan, k = plans[name]
            out[at] = plan.slots(k, units.to_numpy()[at])
        return pd.Series(out)

    within = Window.partitionBy("pool", "chunk").orderBy(f"row.{key}", "bytes").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(before.select("pool", "chunk", "before"), ["pool", "chunk"])
    placed = placed.withColumn("offset", F.col("before") + F.sum("bytes").over(within) - F.col("bytes"))
    return placed.select("row", "pool", "offset", F.expr(f"offset div {block}").alias("block"), slot("pool", F.expr(f"offset div {unit}")).alias("slot")), total


def in_mix_order(docs: DataFrame, weights: dict[str, float] | None = None, key: str = "doc_id", source: str = "source", block: int = BLOCK) -> DataFrame:
    """The documents, in partitions that follow each other and are sorted by their place in the mix."""
    rows, total = mix(docs, weights, key, source, block)
    n = partitions(docs.sparkSession)
    part = F.expr(f"cast(slot * {n} div {max(total, 1)} as int)")
    return rows.withColumn("part", part).repartitionById(n, F.col("part")).sortWithinPartitions("part", "slot", "offset", f"row.{key}").select("row.*")
