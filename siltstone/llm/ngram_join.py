"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

The order of n-grams is cut into fragments, so a long set is never needed in one piece: each fragment counts how much
two sets share in it, and the counts are summed per pair. Before that, two exact bounds leave few pairs to count. Linked
sets share at least three quarters of either, so (1) of a document's n-grams in the first fragments only a quarter of
the whole set may be without another document, which needs counts by n-gram and no pairs; only texts that pass are read
a second time; and (2) the rarest n-grams of
linked sets, a quarter of each set and one, have one in common. Within the documents of one rare n-gram, pairs are
formed with the most central document first; whatever these links join needs no further pair, and the rest is formed
exactly. Equal sets are one class from the start.

An n-gram is known by 52 bits of its fingerprint; two different ones in a pair of sets agree with a chance of about
|a| * |b| / 2**52.

Defined results: null and empty texts and texts without words have the empty set, which is linked with nothing; texts
of fewer words are one n-gram; rows repeated under one doc_id with one text are answered alike, each in its own row;
rows with a null doc_id are linked with nothing; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siltstone.llm import tokens
from siltstone.llm.graph import components
from siltstone.llm.packed import by_bucket, pack, unpack, unpack_keys
from siltstone.llm.tokens import U
from siltstone.llm.work import Work, partitions

WORDS = 5
#: Linked when 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
#: Bits of an n-gram's fingerprint that name it.
BITS = 52
#: Share of the n-gram order whose fragments bound (1) looks at.
FIRST = 0.4
#: Bits of the filter that keeps texts without a possible link out of the second pass's shuffle.
SIEVE = 1 << 25
#: Fragments of the order in which partial overlaps are counted.
FRAGMENTS = 8
_LIMIT = int(FIRST * (1 << BITS))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, i: int, j: int, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Row (from 0) and id of the distinct n-grams of rows i to j-1, in order of row and id."""
    w = tokens.words(data, offsets, i, j, tokens.BLANK_SPLIT, fold=True)
    row, _, print_ = w.windows(k, whole=True)
    both = np.sort((row.astype(np.uint64) << U(BITS)) | (print_ >> U(64 - BITS)))
    both = both[np.r_[True, both[1:] != both[:-1]][: len(both)]]
    return (both >> U(BITS)).astype(np.int64), both & U((1 << BITS) - 1)


def set_sizes(docs: DataFrame, key: str, k: int = WORDS) -> DataFrame:
    """Per row: key, n (its set's size)."""

    def size(batches):
        for batch in batches:
            data, offsets = tokens.buffers(batch.column("text"))
            n = [np.bincount(shingle_sets(data, offsets, i, j, k)[0], minlength=j - i) for i, j in tokens.slices(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.concatenate([np.zeros(0, np.int64), *n]), pa.int64())], [key, "n"])

    return docs.select(F.col(key).cast("long").alias(key), "text").mapInArrow(size, f"{key} long, n long")


def document_counts(docs: DataFrame, key: str, k: int = WORDS) -> DataFrame:
    """Per row with a key: key, n (its set's size), first (how many of them are in the first fragments), shared (how many of those another document has too; summed by key).

    Tasks send each fragment's n-grams packed, once per n-gram and batch: where several documents of a batch have one,
    they are counted there, and one of them stands for all. So what meets in a fragment is bounded by batches.
    """
    fragments = max(8, partitions(docs.sparkSession))
    width = -(-_LIMIT // fragments)

    def send(batches):
        for batch in batches:
            keys = np.asarray(batch.column(key).to_numpy(zero_copy_only=False), np.int64)
            if not len(keys):
                continue
            data, offsets = tokens.buffers(batch.column("text"))
            rows, ids = [np.zeros(0, np.int32)], [np.zeros(0, U)]
            sizes, firsts = np.zeros(len(keys), np.int32), np.zeros(len(keys), np.int32)
            for i, j in tokens.slices(offsets):
                row, id_ = shingle_sets(data, offsets, i, j, k)
                sizes[i:j] = np.bincount(row, minlength=j - i)
                early = id_ < U(_LIMIT)
                rows.append((row[early] + i).astype(np.int32))
                firsts[i:j] = np.bincount(row[early], minlength=j - i)
                ids.append(id_[early])
            row, id_ = np.concatenate(rows), np.concatenate(ids)
            order = np.argsort(id_, kind="stable")
            row, id_ = row[order], id_[order]
            new = np.r_[True, id_[1:] != id_[:-1]][: len(id_)]
            begin = np.flatnonzero(new)
            several = np.diff(np.r_[begin, len(id_)]) > 1
            met = several[np.cumsum(new) - 1] if len(begin) else np.zeros(0, bool)
            known = np.bincount(row[met], minlength=len(keys)).astype(np.int32)
            # a row without n-grams: what is known of the batch's documents
            out = {"fragment": [int(keys[0] % fragments)], "docs": [keys.tobytes()], "at": [np.concatenate([known, sizes, firsts]).tobytes()], "ids": [b""]}
            row, id_ = row[begin], id_[begin]
            cuts = np.searchsorted((id_ // U(width)).astype(np.int64), np.arange(fragments + 1))
            for f in range(fragments):
                a, b = cuts[f], cuts[f + 1]
                if a < b:
                    own, place = np.unique(row[a:b], return_inverse=True)
                    # the top bit marks documents that were counted where they came from
                    kind, top = (np.uint32, 31) if len(own) > 0x7FFF else (np.uint16, 15)
                    out["fragment"].append(f)
                    out["docs"].append(keys[own].tobytes())
                    out["at"].append((place.astype(kind) | (several[a:b].astype(kind) << kind(top))).tobytes())
                    out["ids"].append(pack(id_[a:b] - U(f * width), 6))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("fragment", pa.int32()), ("docs", pa.binary()), ("at", pa.binary()), ("ids", pa.binary())]))

    def count(group: pa.Table) -> pa.Table:
        """kind 0: documents and what they share; 1: documents, a row of the input each, with n and first."""
        docs_, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        sized, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        all_docs, all_ids, marks, owners, base = [], [], [], [], 0
        for d, a, x in zip(*(group.column(c).to_pylist() for c in ("docs", "at", "ids"))):
            own = np.frombuffer(d, np.int64)
            if not x:
                known, n, first = np.frombuffer(a, np.int32).astype(np.int64).reshape(3, -1)
                docs_.append(own[known > 0])
                counts.append(known[known > 0])
                sized.append(own)
                sizes.append((n << 32) | first)
                continue
            id_ = unpack(x, 6)
            kind, top = (np.uint32, 31) if len(a) == 4 * len(id_) else (np.uint16, 15)
            at = np.frombuffer(a, kind).astype(np.int64)
            marks.append(at >> top == 1)
            all_ids.append(id_)
            all_docs.append((at & ((1 << top) - 1)) + base)
            owners.append(own)
            base += len(own)
        if all_ids:
            id_, doc, known = np.concatenate(all_ids), np.concatenate(all_docs), np.concatenate(marks)
            order = np.argsort(id_, kind="stable")
            id_, doc, known = id_[order], doc[order], known[order]
            same = id_[1:] == id_[:-1]
            met = np.r_[False, same][: len(id_)] | np.r_[same, False][: len(id_)]
            got = np.bincount(doc[met & ~known], minlength=base)
            docs_.append(np.concatenate(owners)[got > 0])
            counts.append(got[got > 0])
        parts = [(0, by_bucket(np.concatenate(docs_), np.concatenate(counts), fragments)), (1, by_bucket(np.concatenate(sized), np.concatenate(sizes), fragments))]
        rows = [(kind, *row) for kind, columns in parts for row in zip(*columns)]
        return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate((("kind", pa.int32()), ("bucket", pa.int32()), ("docs", pa.binary()), ("values", pa.binary())))})

    def add(group: pa.Table) -> pa.Table:
        got = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for kind, d, v in zip(*(group.column(c).to_pylist() for c in ("kind", "docs", "values"))):
            got[2 * kind].append(unpack_keys(d))
            got[2 * kind + 1].append(unpack_keys(v))
        doc, count_, sized, sizes = (np.concatenate(x) for x in got)
        own, at = np.unique(doc, return_inverse=True)
        sums = np.r_[np.bincount(at, count_, len(own)).astype(np.int64), 0]
        place = np.searchsorted(own, sized)
        place = np.where(np.r_[own, -1][place] == sized, place, len(own)) if len(own) else np.zeros(len(sized), np.int64)
        return pa.table({key: sized, "n": sizes >> 32, "first": sizes & 0x7FFFFFFF, "shared": sums[place]})

    sent = docs.select(F.col(key).cast("long").alias(key), "text").filter(F.col(key).isNotNull()).mapInArrow(send, "fragment int, docs binary, at binary, ids binary")
    return sent.groupBy("fragment").applyInArrow(count, "kind int, bucket int, docs binary, values binary").groupBy("bucket").applyInArrow(add, f"{key} long, n long, first long, shared long")


def maybe_in(keys: DataFrame, key: str, bits: int = SIEVE) -> Callable[[Column], Column]:
    """A test of keys by a Bloom filter of fixed size, which passes all of `keys` and few others, or more where they are many: it saves work and decides nothing."""
    places = lambda c: [F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(bits)) for seed in (1, 2)]
    words = keys.select(F.explode(F.array(*places(F.col(key)))).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()  # bits / 64 rows at most
    table = np.zeros(bits // 64, np.uint64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)

    @F.pandas_udf("boolean")
    def test(a: pd.Series, b: pd.Series) -> pd.Series:
        held = [(table[p.to_numpy() >> 6] >> (p.to_numpy() & 63).astype(np.uint64)) & U(1) for p in (a, b)]
        return pd.Series((held[0] & held[1]).astype(bool))

    return lambda column: test(*places(column))


def bounded_sets(docs: DataFrame, able: DataFrame, key: str, similarity: int = SIMILARITY, k: int = WORDS) -> DataFrame:
    """Per document of `able` (key, shared): key, n (its set's size), and, only where bound (1) leaves a link possible, ids and two digests of them."""

    def cut(batches):
        for batch in batches:
            data, offsets = tokens.buffers(batch.column("text"))
            shared = batch.column("shared").to_numpy()
            for i, j in tokens.slices(offsets):
                row, id_ = shingle_sets(data, offsets, i, j, k)
                n = np.bincount(row, minlength=j - i)
                first = np.bincount(row[id_ < U(_LIMIT)], minlength=j - i)
                # a linked set lacks at most this many
                lacks = n - -(-similarity * n // 100)
                stays = (n > 0) & (first - lacks <= shared[i:j])
                begin = np.searchsorted(row, np.arange(j - i + 1))
                sums = [np.concatenate([np.zeros(1, U), np.cumsum(tokens.mix(id_ ^ U(salt)))]) for salt in (0, 0x5DEECE66D1234567)]
                digest = [(s[begin[1:]] - s[begin[:-1]]).view(np.int64) for s in sums]
                kept = stays[row] if len(row) else np.zeros(0, bool)
                ends = np.r_[0, np.cumsum(np.where(stays, n, 0))]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(id_[kept].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(i, j - i), pa.array(n, pa.int64()), pa.array(digest[0]), pa.array(digest[1]), lists], [key, "n", "s", "t", "ids"])

    rows = docs.select(F.col(key).cast("long").alias(key), "text")
    rows = rows.filter(maybe_in(able, key)(F.col(key))).join(able, key)
    return rows.mapInArrow(cut, f"{key} long, n long, s long, t long, ids array<long>")


def overlaps(pairs: DataFrame, sets: DataFrame, fragments: int = FRAGMENTS) -> DataFrame:
    """a, b, o: how many n-grams the sets of each pair share, counted fragment by fragment and summed."""
    width = (1 << BITS) // fragments + 1
    cut = sets.select("doc", F.posexplode(F.transform(F.array(*[F.lit(f) for f in range(fragments)]), lambda f: F.filter("ids", lambda x: (x >= f * width) & (x < (f + 1) * width)))).alias("f", "part")).filter(F.size("part") > 0)
    left = cut.select(F.col("doc").alias("a"), "f", F.col("part").alias("pa"))
    right = cut.select(F.col("doc").alias("b"), "f", F.col("part").alias("pb"))
    partial = pairs.select("a", "b").join(left, "a").join(right, ["b", "f"]).select("a", "b", F.size(F.array_intersect("pa", "pb")).alias("o"))
    return partial.groupBy("a", "b").agg(F.sum("o").alias("o"))


def _hubs(counted: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc, hub, in_hub: of the sets that each was counted against (or itself), the one that most were, and what it has of it."""
    both = counted.select("a", "b", "o").unionByName(counted.select(F.col("b").alias("a"), F.col("a").alias("b"), "o"))
    fame = both.groupBy(F.col("b").alias("hub")).agg(F.count("*").alias("fame"))
    own = sizes.join(fame, sizes["doc"] == fame["hub"]).select("doc", "hub", F.col("n").cast("long").alias("in_hub"), "fame")
    met = both.select(F.col("a").alias("doc"), F.col("b").alias("hub"), F.col("o").alias("in_hub")).join(fame, "hub").select("doc", "hub", "in_hub", "fame")
    return met.unionByName(own).groupBy("doc").agg(F.max(F.struct("fame", "hub", "in_hub")).alias("h")).select("doc", "h.hub", "h.in_hub")


class Join:
    """The join's outputs: `sizes` (key, n for every row), `members` (key, rep), `labels` (node, component), and `links` (a, b, o between representatives), which only span each component: `all_links` has every one."""

    def __init__(self, docs: DataFrame, work: Work, key: str = "doc_id", similarity: int = SIMILARITY, k: int = WORDS):
        self.key, self.work, self.similarity = key, work, similarity
        counts = work.save(document_counts(docs, key, k), "counts")
        self.sizes = counts.select(key, "n").unionByName(set_sizes(docs.filter(F.col(key).isNull()), key, k))
        able = work.save(counts.filter(F.expr(f"n > 0 and first - n + ceil({similarity} * n / 100) <= shared")).groupBy(key).agg(F.max("shared").alias("shared")), "able")
        self.sets = work.save(bounded_sets(docs, able, key, similarity, k), "sets")
        work.drop("able")
        able = self.sets.filter(F.size("ids") > 0)
        classes = able.groupBy("n", "s", "t").agg(F.min(F.struct(F.col(key).alias("doc"), "ids")).alias("r"))
        reps = work.save(classes.select("r.doc", "n", "s", "t", "r.ids"), "reps")
        self.members = able.join(reps.select("n", "s", "t", F.col("doc").alias("rep")), ["n", "s", "t"]).select(key, "rep").distinct()
        terms = reps.select("doc", "n", F.explode("ids").alias("id"))
        counts = terms.groupBy("id").agg(F.count("*").alias("df")).filter("df > 1")
        own = terms.join(counts, "id").groupBy("doc", "n").agg(F.sort_array(F.collect_list(F.struct("df", "id"))).alias("by"), F.sum("df").alias("weight"))
        # bound (2): n-grams that no other set has come first in the order, and use up part of the quarter
        rare = own.withColumn("take", F.col("n") - F.ceil(F.col("n") * similarity / 100) + 1 - (F.col("n") - F.size("by"))).filter("take > 0")
        rare = rare.select("doc", "n", F.size("by").alias("met"), (F.col("weight") / F.col("n")).alias("central"), F.posexplode(F.slice("by", 1, F.col("take").cast("int"))).alias("place", "x")).select("doc", "n", "met", "central", (F.col("n") - F.col("met") + F.col("place") + 1).alias("place"), "x.id")
        rare = work.save(rare, "rare")
        self.reps, self.rare = reps, rare
        # what two sets share is no more than either shares with any, which bounds the similarity for their sizes
        fits = F.expr(f"100 * least(met, other) >= {similarity} * (n + m - least(met, other))")
        self.links = None
        checked = None
        for turn, rank in enumerate(("central", "hash(doc)", None)):
            if turn == 0:
                left = rare
            else:
                # only n-grams whose documents are not yet one component
                labelled = rare.join(self.labels.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
                split = labelled.groupBy("id").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("id")
                left = labelled.join(split, "id")
                left = work.save(left if rank else left.join(hubs, "doc", "left"), f"left-{turn}")
            if rank:
                heads = left.groupBy("id").agg(F.max(F.struct(F.expr(rank).alias("rank"), "doc", "n", "met")).alias("h")).select("id", F.col("h.doc").alias("head"), F.col("h.n").alias("m"), F.col("h.met").alias("other"))
                heads = work.save(heads, f"heads-{turn}")  # apart, so that Spark can split an n-gram of many documents in the join
                pairs = left.join(heads, "id").filter((F.col("doc") != F.col("head")) & fits).select(F.least("doc", "head").alias("a"), F.greatest("doc", "head").alias("b"))
            else:
                other = left.select("id", F.col("doc").alias("b"), F.col("n").alias("m"), F.col("met").alias("other"), F.col("component").alias("theirs"), F.col("place").alias("their_place"), F.col("hub").alias("their_hub"), F.col("in_hub").alias("theirs_in_hub"))
                # two sets share at most what the one with less of a common hub has of it, and of what both have beside it and share with any
                share = "least(in_hub, theirs_in_hub) + least(met - in_hub, other - theirs_in_hub)"
                # the first n-gram that both have stands before the last of each that leaves room for what they must share
                must = f"ceil({similarity} * (n + m) / {100 + similarity})"
                early = F.expr(f"place <= n - {must} + 1 and their_place <= m - {must} + 1")
                near = early & F.expr(f"coalesce(hub != their_hub or 100 * ({share}) >= {similarity} * (n + m - ({share})), true)")
                pairs = left.join(other, "id").filter((F.col("doc") < F.col("b")) & (F.col("component") != F.col("theirs")) & fits & near).select(F.col("doc").alias("a"), "b")
            pairs = pairs.distinct()
            if checked is not None:
                pairs = pairs.join(checked, ["a", "b"], "left_anti")
            pairs = work.save(pairs, f"pairs-{turn}")
            sizes = reps.select("doc", "n")
            counted = overlaps(pairs, reps).join(sizes.select(F.col("doc").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("doc").alias("b"), F.col("n").alias("nb")), "b")
            if turn == 0:
                counted = work.save(counted, "counted")
                hubs = _hubs(counted, sizes)
            found = work.save(counted.filter(F.expr(f"100 * o >= {similarity} * (na + nb - o)")).select("a", "b", "o"), f"links-{turn}")
            checked = pairs if checked is None else checked.unionByName(pairs)
            if turn and found.isEmpty():
                continue
            self.links = found if self.links is None else self.links.unionByName(found)
            self.labels = components(self.links, work, f"components-{turn}")

    def all_links(self) -> DataFrame:
        """a, b, o: every two linked representatives, also those within one component, by prefix and position filters and partial overlaps."""
        other = self.rare.select("id", F.col("doc").alias("b"), F.col("n").alias("m"), F.col("met").alias("other"), F.col("place").alias("their_place"))
        must = f"ceil({self.similarity} * (n + m) / {100 + self.similarity})"
        near = F.expr(f"doc < b and least(met, other) >= {must} and place <= n - {must} + 1 and their_place <= m - {must} + 1")
        pairs = self.work.save(self.rare.join(other, "id").filter(near).select(F.col("doc").alias("a"), "b").distinct(), "all-pairs")
        sizes = self.reps.select("doc", "n")
        counted = overlaps(pairs, self.reps).join(sizes.select(F.col("doc").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("doc").alias("b"), F.col("n").alias("nb")), "b")
        return counted.filter(F.expr(f"100 * o >= {self.similarity} * (na + nb - o)")).select("a", "b", "o")

    def degrees(self, links: DataFrame) -> DataFrame:
        """key, links: how many other documents each document is linked with, equal ones included; `links` from all_links."""
        key = self.key
        own = self.members.groupBy("rep").agg(F.count("*").alias("own"))
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.join(own, both["b"] == own["rep"]).groupBy(F.col("a").alias("rep")).agg(F.sum("own").alias("near"))
        of = self.members.join(own, "rep").join(near, "rep", "left").groupBy(key).agg(F.max(F.col("own") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
        return self.sizes.select(key).distinct().join(of, key, "left").select(key, F.coalesce("links", F.lit(0)).alias("links"))

    def components(self) -> DataFrame:
        """Per document: key, n_shingles, component_id (the smallest key that links lead to, itself included)."""
        key = self.key
        of = self.members.join(self.labels.select(F.col("node").alias("rep"), "component"), "rep", "left").groupBy(key).agg(F.min(F.coalesce("component", "rep")).alias("component"))
        return self.sizes.select(key, "n").join(of, key, "left").select(key, F.col("n").alias("n_shingles"), F.coalesce("component", key).alias("component_id"))


def near_duplicates(docs: DataFrame, work: Work, key: str = "doc_id", similarity: int = SIMILARITY, k: int = WORDS) -> DataFrame:
    return Join(docs, work, key, similarity, k).components()
