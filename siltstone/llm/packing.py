"""Best-fit packing of documents into sequences, by swap-based local search.

Tasks tokenize whole texts: words between ASCII blanks are independent of each other, so each distinct word of a slice is
tokenized once. A document's ids and an end id are cut into pieces only where they are longer than a sequence. Full pieces
are sequences; the others are dealt by a hash of their row into groups of bounded size. A group starts from best fit of
falling lengths; then underfull bins give to fuller ones by moving a piece, exchanging one for one or two for one, each
step increasing the sum of squared fills, until the emptiest bins are empty or nothing fits better. A group that isn't the
last settles all bins but the emptiest eighth of them, whose pieces meet those of other groups in the next round.

Defined results: null and empty texts are the end id alone; equal and repeated rows are packed each by itself; ties in
length go by row; a table without rows gives none. Null ids stay; further columns don't enter. A text longer than any
sequence is tokenized whole, in its task.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from siltstone.llm.work import Work

#: Tokens of a sequence.
CAPACITY = 4096
#: The id after each document.
END = 1
#: Pieces that a group has, about.
GROUP = 4096
#: Emptiest bins that are tried in a row without emptying one before a group's search ends.
PATIENCE = 24
#: Ids of known words that a task keeps.
KEPT = 4_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """Ids of words, each tokenized once while it is kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All kept ids, and where each word's begin and end."""
        if self.ends[-1] > KEPT:
            self.forget()
        new = [w for w in words if w not in self.at]
        if new:
            flat: list[int] = []
            sizes: list[int] = []
            for k in range(0, len(new), 10_000):
                for got in self.tokenizer.encode_batch_fast(new[k : k + 10_000], add_special_tokens=False):
                    own = got.ids
                    flat += own
                    sizes.append(len(own))
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            self.ids = np.concatenate([self.ids, np.array(flat, np.uint32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        return self.ids, self.ends[at], self.ends[at + 1]


@lru_cache(2)
def known(path: str) -> Words:
    return Words(path)


def token_ids(texts: pa.Array, path: str, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids, each with the end id, and where each text's begin (with an end)."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    own = parts.flatten().dictionary_encode()
    ids, begin, stop = known(path).lookup(own.dictionary.to_pylist())
    at = own.indices.to_numpy(zero_copy_only=False)
    begin, size = begin[at], (stop - begin)[at]
    words = np.r_[0, np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]
    upto = np.r_[0, np.cumsum(size)]
    # each text has one id more than its words
    first = upto[words] + np.arange(len(words))
    out = np.full(first[-1], end, np.uint32)
    into = np.arange(upto[-1]) + np.repeat(np.repeat(np.arange(len(texts)), np.diff(words)), size)
    out[into] = ids[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
    return out, first


def _runs(column: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about so many bytes, one row at least."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + size, "right")))
        yield i, min(j, len(column))
        i = j


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """key, piece, start, length, crc: the pieces of each document, in order."""
    path = path or default_vocabulary()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in _runs(batch.column("text")):
                ids, first = token_ids(batch.column("text").slice(i, j - i), path, end)
                lengths = np.diff(first)
                per = -(-lengths // capacity)
                row = np.repeat(np.arange(j - i), per)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
                start = piece * capacity
                length = np.minimum(lengths[row] - start, capacity)
                low = first[:-1][row] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(low.tolist(), (low + length).tolist())]
                keys = batch.column("key").slice(i, j - i).take(pa.array(row))
                yield pa.RecordBatch.from_pydict({"key": keys, "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "crc": pa.array(crc, pa.int64())})

    return rows.mapInArrow(task, f"key {rows.schema['key'].dataType.simpleString()}, piece int, start long, length long, crc long")


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of items, longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin with room for r
    for item in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        size = lengths[item]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = open_[room].pop()
            if not open_[room]:
                rooms &= ~(1 << room)
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
        if room > size:
            open_[room - size].append(at)
            rooms |= 1 << (room - size)
    return bins


class Search:
    """Local search over bins: pieces go from emptier to fuller bins, so that the sum of squared fills only grows."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int = CAPACITY):
        self.lengths, self.capacity, self.bins = lengths, capacity, bins
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.least = -(-sum(self.fill) // capacity)

    def sizes(self, b: int) -> tuple[Counter, int, int]:
        """Lengths in a bin, and as bits those of one piece and the sums of two."""
        own = Counter(self.lengths[i] for i in self.bins[b])
        one = sum(1 << s for s in own)
        two = 0
        for s, n in own.items():
            two |= (one if n > 1 else one & ~(1 << s)) << s
        return own, one, two

    def best(self, a: int, b: int, given: tuple[Counter, int, int]) -> tuple[list[int], list[int]] | None:
        """Lengths that go from a to b and those that come back: a move, one for one, two for one or one for two that raises b's fill most."""
        room, (own, one, two) = self.capacity - self.fill[b], given
        held, _, pairs = self.sizes(b)
        won: tuple[int, int, int, bool] | None = None
        for back in (0, *held):
            for many, bits in ((False, one), (True, two)):
                most = (bits & ((1 << (back + room + 1)) - 1)).bit_length() - 1
                if most > back and (won is None or most - back > won[0]):
                    won = (most - back, most, back, many)
        rest = pairs
        while rest and (won is None or won[0] < room):
            back = rest.bit_length() - 1
            rest &= ~(1 << back)
            most = (one & ((1 << (back + room + 1)) - 1)).bit_length() - 1
            if most > back and (won is None or most - back > won[0]):
                won = (most - back, most, -back, False)
        if won is None:
            return None
        _, give, back, many = won
        return self.parts(own, give, many), self.parts(held, abs(back), back < 0) if back else []

    @staticmethod
    def parts(own: Counter, total: int, two: bool) -> list[int]:
        if not two:
            return [total]
        return next([s, total - s] for s in own if total - s in own and (total != 2 * s or own[s] > 1))

    def exchange(self, a: int, b: int, give: list[int], back: list[int]) -> None:
        for source, to, sizes in ((a, b, give), (b, a, back)):
            for size in sizes:
                at = next(k for k, i in enumerate(self.bins[source]) if self.lengths[i] == size)
                self.bins[to].append(self.bins[source].pop(at))
                self.fill[source] -= size
                self.fill[to] += size

    def empty(self, a: int) -> bool:
        """Gives from a until it is empty or a whole turn over the other bins, fullest first, gains nothing."""
        gained = True
        while gained and self.bins[a]:
            gained = False
            for _, b in sorted((-f, k) for k, f in enumerate(self.fill) if 0 < f < self.capacity and k != a):
                # only towards the fuller one does the sum of squares grow
                while self.bins[a] and self.fill[a] <= self.fill[b] < self.capacity and (got := self.best(a, b, self.sizes(a))):
                    self.exchange(a, b, *got)
                    gained = True
                if not self.bins[a]:
                    break
        return not self.bins[a]

    def run(self, patience: int = PATIENCE) -> list[list[int]]:
        tried: set[int] = set()
        while sum(map(bool, self.bins)) > self.least and len(tried) < patience:
            left = [(f, k) for k, f in enumerate(self.fill) if 0 < f < self.capacity and k not in tried]
            if not left:
                break
            a = min(left)[1]
            if self.empty(a):
                tried.clear()
            else:
                tried.add(a)
        return [b for b in self.bins if b]


def pack(docs: DataFrame, work: Work, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end: int = END, group: int = GROUP) -> DataFrame:
    """key, piece, start, length, crc, sequence (the row of its first piece), offset."""
    stored = work.save(pieces(docs, key, text, path, capacity, end).withColumn("id", F.monotonically_increasing_id()), "pieces")
    done = [stored.filter(F.col("length") == capacity).select("*", F.col("id").alias("sequence"), F.lit(0).cast("long").alias("offset"))]
    rest, turn = stored.filter(F.col("length") < capacity), 0
    kind = stored.schema["key"].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, crc long, id long, sequence long, offset long, settled boolean"
    while n := rest.count():
        groups = -(-n // group)
        last = groups == 1

        def fit(own: pa.Table) -> pa.Table:
            own = own.sort_by("id")
            lengths, ids = own["length"].to_pylist(), own["id"].to_pylist()
            bins = Search(best_fit(lengths, capacity), lengths, capacity).run()
            fills = [sum(lengths[i] for i in b) for b in bins]
            under = sorted((f, k) for k, f in enumerate(fills) if f < capacity)
            onward = set() if last else {k for _, k in under[: -(-len(bins) // 8)]}
            order = [i for b in bins for i in b]
            out = {c: own[c].take(pa.array(order, pa.int64())) for c in ("key", "piece", "start", "length", "crc", "id")}
            offsets = [at for b in bins for at in np.cumsum([0, *(lengths[i] for i in b[:-1])]).tolist()]
            return pa.table(out | {"sequence": pa.array([ids[b[0]] for b in bins for _ in b], pa.int64()), "offset": pa.array(offsets, pa.int64()), "settled": pa.array([k not in onward for k, b in enumerate(bins) for _ in b], pa.bool_())})

        dealt = rest.select("key", "piece", "start", "length", "crc", "id", F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(groups)).alias("g"))
        placed = work.save(dealt.groupBy("g").applyInArrow(fit, schema), f"round-{turn}")
        done.append(placed.filter("settled").drop("settled"))
        rest, turn = placed.filter("not settled"), turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("id").withColumnRenamed("key", key)


def sequences(docs: DataFrame, placed: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end: int = END) -> DataFrame:
    """sequence, input_ids, keys, offsets: the sequences' ids in whole, and which document begins where. Needs keys that are unique and not null."""
    path = path or default_vocabulary()
    wanted = placed.groupBy(F.col(key).alias("key")).agg(F.collect_list(F.struct("start", "length", "sequence", "offset")).alias("own"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(wanted, "key")
    kind = rows.schema["key"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in _runs(batch.column("text")):
                ids, first = token_ids(batch.column("text").slice(i, j - i), path, end)
                own = [(k, p) for k, ps in enumerate(batch.column("own").slice(i, j - i).to_pylist()) for p in ps]
                yield pa.RecordBatch.from_pydict({
                    "key": batch.column("key").slice(i, j - i).take(pa.array([k for k, _ in own], pa.int64())), "sequence": pa.array([p["sequence"] for _, p in own], pa.int64()),
                    "offset": pa.array([p["offset"] for _, p in own], pa.int64()), "ids": pa.array([ids[first[k] + p["start"] : first[k] + p["start"] + p["length"]].astype(np.int32) for k, p in own], pa.list_(pa.int32())),
                })

    parts = rows.mapInArrow(cut, f"key {kind}, sequence long, offset long, ids array<int>")
    held = parts.groupBy("sequence").agg(F.sort_array(F.collect_list(F.struct("offset", "key", "ids"))).alias("own"))
    return held.select("sequence", F.flatten("own.ids").alias("input_ids"), F.col("own.key").alias("keys"), F.col("own.offset").alias("offsets"))
