"""Benchmark decontamination over a distributed positional inverted index.

The index holds the postings (term, document, positions) of the training text. A test phrase is answered from its
rarest terms: their lists are shifted by the terms' offsets and intersected, so a start survives only where all of them
agree; the remaining words are then compared in place. Terms that no phrase ranks among its rarest have no list.

Defined results: null or empty texts and texts without words have no words and no hits; null item texts and items
without words have no windows; repeated items with one id count once; equal windows of several items hit for each;
repeated documents are answered alike; documents without an id are answered by their texts; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from siltstone.llm import tokens
from siltstone.llm.work import Work

#: Consecutive words of a window.
WINDOW = 10
#: Terms of a phrase whose postings are intersected.
RAREST = 3
#: Test terms that one pass over the training text looks for; 8 bytes each. More take more passes.
TERMS_A_PASS = 1 << 21


def _slices(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, int, tokens.Words]]:
    data, offsets = tokens.buffers(batch.column(name))
    for i, j in tokens.slices(offsets):
        yield i, j, tokens.words(data, offsets, i, j, tokens.ALNUM, fold=True)


def phrases(tests: DataFrame, key: str = "item_id", k: int = WINDOW) -> DataFrame:
    """The distinct k-word windows of test texts: wid, terms (hashes in order), items (ids as strings)."""

    def cut(batches):
        for batch in batches:
            keys = np.array([str(x) for x in batch.column(key).to_pylist()], object)
            for i, j, w in _slices(batch):
                row, at, wid = w.windows(k, whole=True)
                size = np.minimum(w.counts[row], k)
                hashes = w.hash.view(np.int64)
                yield pa.RecordBatch.from_pydict({"wid": wid.view(np.int64), "terms": pa.array([hashes[a : a + n] for a, n in zip(at, size)], pa.list_(pa.int64())), "item": pa.array(keys[i:j][row], pa.string())})

    windows = tests.select(F.col(key).cast("string").alias(key), "text").filter(F.col(key).isNotNull()).mapInArrow(cut, "wid long, terms array<long>, item string")
    return windows.groupBy("wid").agg(F.first("terms").alias("terms"), F.sort_array(F.collect_set("item")).alias("items"))


def term_counts(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """Occurrences of the given sorted term hashes in all documents: term, n."""

    def count(batches):
        for batch in batches:
            total = np.zeros(len(terms), np.int64)
            for _, _, w in _slices(batch):
                at = np.searchsorted(terms, w.hash)
                at[at == len(terms)] = 0
                total += np.bincount(at[terms[at] == w.hash], minlength=len(terms))
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"term": terms[seen].view(np.int64), "n": total[seen]})

    return docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, terms: np.ndarray, key: str = "doc_id") -> DataFrame:
    """The index's lists of the given sorted term hashes: term, document key, positions (ascending)."""
    kind = docs.schema[key].dataType.simpleString()

    def post(batches):
        for batch in batches:
            keys = batch.column(key)
            for i, j, w in _slices(batch):
                at = np.searchsorted(terms, w.hash)
                at[at == len(terms)] = 0
                word = np.flatnonzero(terms[at] == w.hash)
                row, term = w.row[word], at[word]
                order = np.lexsort((word, term, row))
                row, term, word = row[order], term[order], word[order]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (term[1:] != term[:-1])][: len(row)])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(row)], pa.int32()), pa.array((word - w.first[row]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(terms[term[new]].view(np.int64)), keys.take(pa.array(row[new] + i)), lists], ["term", key, "positions"])

    return docs.select(key, "text").filter(F.col(key).isNotNull()).mapInArrow(post, f"term long, {key} {kind}, positions array<int>")


class PositionalIndex:
    """Stored postings of the terms that a set of test phrases looks up."""

    def __init__(self, docs: DataFrame, tests: DataFrame, work: Work, key: str = "doc_id", tests_key: str = "item_id", k: int = WINDOW, rarest: int = RAREST):
        self.key, self.docs, self.work = key, docs, work
        self.phrases = work.save(phrases(tests, tests_key, k), "phrases")
        words = self.phrases.select(F.explode("terms").alias("term")).distinct()
        counted = self._passes(words, lambda terms: term_counts(docs, terms))
        if counted is None:
            counted = words.select("term", F.lit(0).cast("long").alias("n"))
        counted = work.save(words.join(counted, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n")), "terms")
        # every phrase's terms by rarity; a phrase with a term that occurs nowhere has no match at all
        at = self.phrases.select("wid", F.posexplode("terms").alias("place", "term")).join(counted, "term")
        ranked = at.groupBy("wid").agg(F.sort_array(F.collect_list(F.struct("n", "place", "term"))).alias("by")).filter(F.col("by")[0]["n"] > 0)
        self.anchors = work.save(ranked.select("wid", F.size(F.slice("by", 1, rarest)).alias("lists"), F.explode(F.slice("by", 1, rarest)).alias("a")).select("wid", "lists", "a.place", "a.term"), "anchors")
        lists = self._passes(self.anchors.select("term").distinct(), lambda terms: postings(docs, terms, key))
        self.postings = None if lists is None else work.save(lists, "postings")

    def _passes(self, terms: DataFrame, run):
        """`run` over blocks of terms small enough to send to every task."""
        n = terms.count()
        parts = -(-n // TERMS_A_PASS)
        found = None
        for part in range(parts):
            own = terms if parts == 1 else terms.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == part)
            hashes = np.sort(own.toPandas()["term"].to_numpy(np.int64).view(np.uint64))
            if len(hashes):
                found = run(hashes) if found is None else found.unionByName(run(hashes))
        return found

    def starts(self) -> DataFrame:
        """Places where the shifted lists of a phrase's rarest terms meet: wid, document, start."""
        kind = self.docs.schema[self.key].dataType.simpleString()
        if self.postings is None:
            return self.work.spark.createDataFrame([], f"wid long, {self.key} {kind}, start int")
        met = self.postings.join(self.anchors, "term").select("wid", "lists", self.key, "place", F.explode("positions").alias("position"))
        met = met.select("wid", "lists", self.key, (F.col("position") - F.col("place")).alias("start")).filter("start >= 0")
        return met.groupBy("wid", "lists", self.key, "start").count().filter("count >= lists").select("wid", self.key, "start")

    def phrase_matches(self) -> DataFrame:
        """Per document with candidates: finds array<struct<start, terms, items>>; every listed start is yet to be compared."""
        found = self.starts().join(self.phrases, "wid")
        return found.groupBy(self.key).agg(F.collect_list(F.struct("start", "terms", "items")).alias("finds"))


def proximity_matches(docs: DataFrame, terms: list[str], span: int, key: str = "doc_id") -> DataFrame:
    """Documents in which all the words stand, in any order, within `span` consecutive words: key, start, width of the narrowest such stretch (the first of equals).

    Of a list that names no word no document is an answer; null texts and documents without an id are none either; repeated words of the list are one.
    """
    kind = docs.schema[key].dataType.simpleString()
    terms = [t for t in terms if t]
    data, offsets = tokens.buffers(pa.array(terms))
    wanted = np.unique(tokens.words(data, offsets, 0, len(terms), tokens.ALNUM, fold=True).hash) if terms else np.empty(0, np.uint64)
    if not len(wanted):
        return docs.sparkSession.createDataFrame([], f"{key} {kind}, start int, width int")
    placed = postings(docs, wanted, key).select(key, "term", F.explode("positions").alias("position"))
    size = len(wanted)

    def narrowest(batches):
        for batch in batches:
            out = {key: [], "start": [], "width": []}
            for who, pairs in zip(batch.column(key).to_pylist(), batch.column("pairs").to_pylist()):
                last: dict[int, int] = {}
                best = None
                for p in pairs:
                    last[p["term"]] = p["position"]
                    if len(last) == size:
                        low = min(last.values())
                        width = p["position"] - low + 1
                        if width <= span and (best is None or width < best[1]):
                            best = (low, width)
                if best:
                    for name, x in zip(out, (who, *best)):
                        out[name].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(key, batch.schema.field(key).type), ("start", pa.int32()), ("width", pa.int32())]))

    lists = placed.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("position", "term"))).alias("pairs"))
    return lists.mapInArrow(narrowest, f"{key} {kind}, start int, width int")


def decontaminate(docs: DataFrame, tests: DataFrame, work: Work, key: str = "doc_id", tests_key: str = "item_id", k: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Per document: key, the columns in `keep`, n_words, n_hit (words inside a test window), items (ids, sorted)."""
    keep = [c for c in keep or [] if c != key]
    nameless = docs.filter(F.col(key).isNull())
    if nameless.isEmpty():  # the files' statistics know, if all have an id
        return _compared(docs, tests, work, key, tests_key, k, keep)
    own = "text_hash"
    while own in docs.columns:
        own += "_"
    by_text = nameless.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias(own), *dict.fromkeys([key, *keep, "text"]))
    answers = _compared(by_text, tests, Work(work.spark, "nameless"), own, tests_key, k, [key, *keep]).drop(own)
    return _compared(docs.filter(F.col(key).isNotNull()), tests, work, key, tests_key, k, keep).unionByName(answers)


def _compared(docs: DataFrame, tests: DataFrame, work: Work, key: str, tests_key: str, k: int, keep: list[str]) -> DataFrame:
    index = PositionalIndex(docs, tests, work, key, tests_key, k)
    fields = [docs.schema[c] for c in (key, *keep)]
    schema = T.StructType([*fields, *T._parse_datatype_string("n_words long, n_hit long, items array<string>")])
    finds = index.phrase_matches()

    def compare(batches):
        for batch in batches:
            found = batch.column("finds")
            n_words, n_hit, items = [], [], []
            for i, j, w in _slices(batch):
                hashes = w.hash.view(np.int64)
                for r in range(j - i):
                    own = hashes[w.first[r] : w.first[r + 1]]
                    hit, ids = np.zeros(len(own), bool), set()
                    for x in found[i + r].as_py() or ():
                        a, terms = x["start"], x["terms"]
                        if a + len(terms) <= len(own) and (own[a : a + len(terms)] == terms).all():
                            hit[a : a + len(terms)] = True
                            ids.update(x["items"])
                    n_words.append(len(own))
                    n_hit.append(int(hit.sum()))
                    items.append(sorted(ids))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))], [*(f.name for f in fields), "n_words", "n_hit", "items"])

    names = list(dict.fromkeys([key, *keep, "text"]))
    return docs.select(*names).join(finds, key, "left").mapInArrow(compare, schema)


def digest(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    return hits.select(key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def items_sha256(items: list[str]) -> str:
    """The digest's last column for given ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
