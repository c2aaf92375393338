"""Scores of texts under a causal self-attention model of subword ids, trained in numpy.

A text is its words (A-Z lower-cased) and one end. Each word is its ids under a given byte-level vocabulary. All ids of a
text and its end go through the attention model: windows of the sequence of ids overlap, each position is scored once, in
the window where it has most context; masked attention over the window gives a context vector, this gates EXPERTS
distributions over ids, and their mixture is the probability. How a word goes on after its first id has a second source,
the exact count of the word among all training words with the same first id; the two are mixed (Witten-Bell), so words that
training doesn't have are scored by attention alone. All probabilities of a step add up to 1 at most.

Training: word counts of all training texts are summed by word; the words' counts give those of ids. All but one of the
EXPERTS start from random shares of each id and part in ROUNDS rounds over all windows of all training texts, one starts
from the ids that stand later in words; all are refined with the attention in one more round: tasks send sums of the experts'
part in each id, and their gate weights, which are added up by id. The table of words that every task needs is bounded: it
keeps the words that make up at least one part in TABLE of all counts; rarer words' counts, which are exact too, meet their
documents by hash ranges.

Defined results: null and empty texts are the end alone; without training texts the counts are 0 and all ids are equally
likely; repeated rows are scored alike, and each counts in training; rows with a null key are scored like others; further
columns are ignored.
"""

from __future__ import annotations

import base64
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from siltstone.llm import tokens
from siltstone.llm.packed import by_bucket, pack_keys, unpack_keys
from siltstone.llm.tokens import U
from siltstone.llm.work import Work, partitions

#: The vocabulary file (ranks of byte strings); only the driver reads it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
EXPERTS = 12
WINDOW = 32
STRIDE = 24
#: How far each key (columns) of a window lies behind each scored position (rows); below 0: ahead of it.
GAP = np.arange(WINDOW - STRIDE, WINDOW)[:, None] - np.arange(WINDOW)[None, :]
#: Exponents are clipped to this, either way.
MOST = 60
#: So many windows at a time stay in a core's cache; which they are changes no result.
PART = 256
#: Rounds over all training windows in which the experts part.
ROUNDS = 4
#: A table keeps entries of at least a TABLE-th of all counts, so it has TABLE entries at most.
TABLE = 1 << 19
#: A fixed value: how the vocabulary parts text before it merges bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_M = (1 << 64) - 1


@dataclass
class Vocabulary:
    raw: bytes

    def __post_init__(self):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in self.raw.splitlines() if line)}
        self.size = max(ranks.values()) + 1
        self.bytes = np.zeros(self.size, np.int64)
        for piece, rank in ranks.items():
            self.bytes[rank] = len(piece)
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __reduce__(self):
        return Vocabulary, (self.raw,)

    def word(self, form: bytes) -> list[int]:
        return self.encode(" " + form.decode("utf-8", "replace"))

    def words(self, forms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has: as `word`, in one call for all."""
        return self.joined(b"".join(b" " + f for f in forms), np.cumsum([1 + len(f) for f in forms], dtype=np.int64))

    def joined(self, raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `words`; raw: a space and a word each, ends: where each word ends in it."""
        whole = raw.decode("utf-8", "replace")
        # other spaces stand in words, and may be parted together with the next word's; what isn't UTF-8 has other lengths in ids
        if len(whole.split()) != len(ends) or "\ufffd" in whole:
            each = [self.word(raw[a + 1 : b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            return np.array([x for own in each for x in own], np.int64), np.array([len(own) for own in each], np.int64)
        ids = np.array(self.encode(whole), np.int64)
        begins = np.cumsum(self.bytes[ids]) - self.bytes[ids]
        return ids, np.bincount(np.searchsorted(ends, begins, "right"), minlength=len(ends))


def read_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary(f.read())


def _words(batch: pa.RecordBatch):
    data, offsets = tokens.buffers(batch.column("text"))
    for i, j in tokens.slices(offsets):
        yield i, j, tokens.words(data, offsets, i, j, tokens.BLANK_SPLIT, fold=True)


def spaced(w: tokens.Words, at: np.ndarray) -> tuple[bytes, np.ndarray]:
    """A space and a word (A-Z lower-cased) each, of the words at these places, and where each ends."""
    size = w.end[at] - w.start[at] + 1
    ends = np.cumsum(size)
    place = np.arange(int(size.sum())) + np.repeat(w.start[at] - 1 - (ends - size), size)
    raw = tokens._FOLD.astype(np.uint8)[w.data[place]]
    raw[ends - size] = 32
    return raw.tobytes(), ends


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), form (bytes, A-Z lower-cased), c: how often each word occurs."""

    def count(batches):
        ids, counts, forms = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, object)

        def put():
            return pa.RecordBatch.from_pydict({"word": ids.view(np.int64), "form": pa.array(forms, pa.binary()), "c": counts})

        for batch in batches:
            for _, _, w in _words(batch):
                order = np.argsort(w.hash)
                begin = np.flatnonzero(np.r_[True, w.hash[order[1:]] != w.hash[order[:-1]]][: len(order)])
                own, first, n = w.hash[order[begin]], order[begin], np.diff(np.r_[begin, len(order)])
                at = np.searchsorted(ids, own)
                known = ids[np.minimum(at, max(len(ids) - 1, 0))] == own if len(ids) else np.zeros(len(own), bool)
                counts[at[known]] += n[known]
                new = np.flatnonzero(~known)
                if len(new):
                    raw = w.data.tobytes()
                    added = np.array([raw[a:b].lower() for a, b in zip(w.start[first[new]].tolist(), w.end[first[new]].tolist())] + [None], object)[:-1]
                    ids = np.insert(ids, at[new], own[new])
                    counts = np.insert(counts, at[new], n[new])
                    forms = np.insert(forms, at[new], added)
            if len(ids) > 1 << 19:
                yield put()
                ids, counts, forms = ids[:0], counts[:0], forms[:0]
        yield put()

    return docs.select("text").mapInArrow(count, "word long, form binary, c long").groupBy("word").agg(F.min("form").alias("form"), F.sum("c").alias("c"))


def piece_counts(counts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """id, first and kinds (tokens and distinct words that begin with it), further (how often it stands later in a word)."""
    sent = counts.sparkSession.sparkContext.broadcast(vocabulary)

    def cut(batches):
        v = sent.value
        sums = np.zeros((3, v.size), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, n = v.words(batch.column("form").to_pylist())
            c = batch.column("c").to_numpy()
            begin = np.cumsum(n) - n
            times = np.repeat(c, n)
            times[begin] = 0
            for row, at, weights in ((0, ids[begin], c), (1, ids[begin], np.ones(len(c))), (2, ids, times)):
                sums[row] += np.bincount(at, weights, sums.shape[1]).astype(np.int64)
        at = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_pydict({"id": at, "first": sums[0, at], "kinds": sums[1, at], "further": sums[2, at]})

    return counts.select("form", "c").mapInArrow(cut, "id long, first long, kinds long, further long").groupBy("id").agg(*(F.sum(c).alias(c) for c in ("first", "kinds", "further")))


@dataclass
class Spelling:
    """How words go on after their first ids. total, kinds: training words and distinct ones, by first id."""

    total: np.ndarray
    kinds: np.ndarray

    def log10(self, first: np.ndarray, spelled: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Of words with these first ids and training counts; spelled: log10 share of their further ids by attention."""
        total, kinds = self.total[first], self.kinds[first]
        known = np.log10(np.maximum(count + kinds * 10.0 ** np.maximum(spelled, -300), 1e-300) / np.maximum(total + kinds, 1))
        rare = spelled + np.log10(np.where(kinds > 0, kinds / np.maximum(total + kinds, 1), 1.0))
        return np.where(count > 0, known, rare)


class Forms:
    """Ids of word forms; remembered within a task up to a bound."""

    def __init__(self, vocabulary: Vocabulary, most: int = 1_000_000):
        self.vocabulary, self.most = vocabulary, most
        self.forget()

    def forget(self) -> None:
        # by hash: where a word's ids begin, and how many there are
        self.hash, self.begin, self.n, self.ids = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def of(self, w: tokens.Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of a slice, one after the other, and how many each word has."""
        if not len(w.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(w.hash)
        new = np.r_[True, w.hash[order[1:]] != w.hash[order[:-1]]]
        one, own = order[new], w.hash[order[new]]
        if len(self.hash) > self.most:
            self.forget()
        at = np.searchsorted(self.hash, own)
        fresh = np.flatnonzero(self.hash[np.minimum(at, len(self.hash) - 1)] != own) if len(self.hash) else np.arange(len(own))
        if len(fresh):
            ids, n = self.vocabulary.joined(*spaced(w, one[fresh]))
            self.hash = np.insert(self.hash, at[fresh], own[fresh])
            self.begin = np.insert(self.begin, at[fresh], len(self.ids) + np.cumsum(n) - n)
            self.n = np.insert(self.n, at[fresh], n)
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            at = np.searchsorted(self.hash, own)
        begin, n = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        of = np.cumsum(new) - 1
        begin[order], n[order] = self.begin[at][of], self.n[at][of]
        place = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.ids[place].astype(np.int64), n


def by_text(w: tokens.Words, n: np.ndarray) -> np.ndarray:
    """How many ids each text has whose words have n."""
    return np.bincount(w.row, n, len(w.counts)).astype(np.int64)


@dataclass
class Attention:
    """experts: probabilities of ids (rows: experts); the vocabulary's size is the end. profile: each id's share by expert."""

    experts: np.ndarray
    profile: np.ndarray
    pairs: np.ndarray
    far: np.ndarray
    own: np.ndarray
    context: np.ndarray
    bias: np.ndarray

    def __post_init__(self):
        self.by_id = np.ascontiguousarray(self.experts.T, np.float32)
        # profiles in order of ids (or each look-up copies the table), with a one beside them: products with it are sums
        self.table = np.ascontiguousarray(np.pad(self.profile, ((0, 0), (0, 1)), constant_values=1))

    @staticmethod
    def start(experts: np.ndarray) -> Attention:
        k = len(experts)
        return Attention(experts, Attention.profile_of(experts, np.full(k, 1 / k)), np.eye(k, dtype=np.float32), np.zeros(WINDOW, np.float32), np.zeros((k, k), np.float32), 3 * np.eye(k, dtype=np.float32), np.zeros(k, np.float32))

    @staticmethod
    def profile_of(experts: np.ndarray, weight: np.ndarray) -> np.ndarray:
        joint = (experts * weight[:, None]).T
        # the start of a text is one more id, of even profile
        return np.concatenate([joint / joint.sum(1, keepdims=True), np.full((1, len(experts)), 1 / len(experts))]).astype(np.float32)

    def weights(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.pairs, self.far, self.own, self.context, self.bias)])

    def with_weights(self, flat: np.ndarray) -> Attention:
        out, at = copy(self), 0  # the experts' tables are shared
        for name in ("pairs", "far", "own", "context", "bias"):
            x = getattr(self, name)
            setattr(out, name, flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return out

    def attend(self, logits: np.ndarray) -> np.ndarray:
        """Shares of the attention, times any positive factor by position, in place of logits; what lies ahead has none."""
        far = self.far[np.maximum(GAP, 0)]
        # profiles add up to 1, so this bounds all exponents; they are clipped only where they can be beyond it
        if np.abs(self.pairs).max() + np.abs(self.far).max() > MOST:
            logits += far
            np.exp(np.clip(logits, -MOST, MOST, out=logits), out=logits)
            far = np.zeros_like(far)
        else:
            np.exp(logits, out=logits)
        logits *= np.where(GAP >= 0, np.exp(far), np.float32(0))
        return logits

    def forward(self, inputs: np.ndarray, live: np.ndarray, targets: np.ndarray):
        """Probabilities of targets (windows * STRIDE) and what the gradient needs. inputs, live (one run in each window): windows * WINDOW."""
        e = np.take(self.table, inputs, axis=0)
        k = e.shape[2] - 1
        ones = np.ones(k, np.float32)  # products with it are sums
        q = e[:, -STRIDE:, :k].reshape(-1, k)  # one product for all windows
        if len(part := np.flatnonzero(~(live[:, 0] & live[:, -1]))):
            e[part] *= live[part, :, None]  # without their one, they are in no sum
        across = np.ascontiguousarray(e.transpose(0, 2, 1))
        weights = self.attend(np.matmul((q @ self.pairs).reshape(-1, STRIDE, k), across[:, :k]))
        context = np.matmul(weights, e).reshape(-1, k + 1)
        scale = 1 / np.maximum(context[:, k:], np.float32(1e-30))
        context *= scale  # and a one beside it, for the bias
        gate = q @ self.own
        gate += context @ np.concatenate([self.context, self.bias[None]])
        if sum(np.abs(x).max() for x in (self.own, self.context, self.bias)) > MOST:
            np.clip(gate, -MOST, MOST, out=gate)
        np.exp(gate, out=gate)
        gate /= (gate @ ones)[:, None]
        joint = np.take(self.by_id, targets.ravel(), axis=0)
        joint *= gate
        return (joint @ ones).reshape(-1, STRIDE), joint, gate, context, scale, weights, q, e, across

    def gradient(self, inputs: np.ndarray, live: np.ndarray, targets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ascent direction of the mean log probability of positions that count, and the experts' parts in each."""
        sums, parts = zip(*(self.ascent(*(x[a : a + PART] for x in (inputs, live, targets, counts))) for a in range(0, len(inputs), PART)))
        return sum(sums) / max(counts.sum(), 1), np.concatenate(parts)

    def ascent(self, inputs: np.ndarray, live: np.ndarray, targets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `gradient`, but of the sum."""
        p, joint, gate, context, scale, attention, q, e, across = self.forward(inputs, live, targets)
        k = q.shape[1]
        joint /= np.maximum(p, np.float32(1e-30)).reshape(-1, 1)
        d = np.subtract(joint, gate, out=gate)
        d[np.flatnonzero(~counts.ravel())] = 0
        # the mean of d_attention under the attention is d_context by the context; the one beside the profiles takes it off
        d_context = d @ np.concatenate([self.context.T, np.zeros((k, 1), np.float32)], 1)
        d_context[:, k] = -((d_context * context) @ np.ones(k + 1, np.float32))
        d_context *= scale
        d_logits = np.matmul(d_context.reshape(-1, STRIDE, k + 1), across)
        d_logits *= attention
        d_pairs = q.T @ np.matmul(d_logits, e).reshape(-1, k + 1)[:, :k]
        d_far = np.bincount(np.maximum(GAP, 0).ravel(), np.ones(len(d_logits), np.float32) @ d_logits.reshape(len(d_logits), -1), WINDOW)
        out = [d_pairs, d_far, q.T @ d, context.T @ d]  # the last has the bias below
        return np.concatenate([x.ravel() for x in out]), joint.reshape(*p.shape, k)


def blocks(ids: np.ndarray, counts: np.ndarray, size: int, most: int):
    """Inputs, live, targets, counting positions and row of the windows of rows with `counts` ids each, `most` at a time; `size`: the end's id."""
    n = len(counts)
    length = counts + 1
    begin = np.cumsum(length) - length
    x, y = np.full(int(length.sum()), size + 1), np.full(int(length.sum()), size)
    at = np.arange(len(ids)) + np.repeat(np.arange(n), counts)
    x[at + 1] = ids
    x[begin] = size + 1
    y[at] = ids
    per = -(-length // STRIDE)
    row = np.repeat(np.arange(n), per)
    m = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    for a in range(0, len(row), most):
        r = row[a : a + most]
        at = m[a : a + most, None] * STRIDE + np.arange(STRIDE - WINDOW, STRIDE)[None, :]
        live = (at >= 0) & (at < length[r][:, None])
        place = np.where(live, begin[r][:, None] + at, 0)
        yield np.take(x, place), live, np.take(y, place[:, -STRIDE:]), live[:, -STRIDE:], r


def windows(ids: np.ndarray, counts: np.ndarray, size: int):
    """All `blocks` as one."""
    return next(blocks(ids, counts, size, 1 << 62))


def scored(ids: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What the windows of these rows score, in order, and where the part of each window begins in it (with an end)."""
    length = counts + 1
    y = np.full(int(length.sum()), size)
    y[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    per = -(-length // STRIDE)
    row = np.repeat(np.arange(len(counts)), per)
    m = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    return y, np.r_[(np.cumsum(length) - length)[row] + m * STRIDE, len(y)]


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """ids (of the words of a slice of texts, packed), counts (ids of each text, packed)."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def cut(batches):
        forms = Forms(sent.value)
        for batch in batches:
            for _, _, w in _words(batch):
                ids, n = forms.of(w)
                yield pa.RecordBatch.from_pydict({"ids": pa.array([pack_keys(ids)], pa.binary()), "counts": pa.array([pack_keys(by_text(w, n))], pa.binary())})

    return docs.select("text").mapInArrow(cut, "ids binary, counts binary")


def _slices(batches):
    """Ids of all texts, and how many each has, of the slices that `encoded` gave."""
    for batch in batches:
        for ids, counts in zip(batch.column("ids").to_pylist(), batch.column("counts").to_pylist()):
            yield unpack_keys(ids), unpack_keys(counts)


def start(slices: DataFrame, size: int, unigram: np.ndarray, further: np.ndarray) -> Attention:
    """Experts from sums over all windows of all training texts, beside `further`; they begin with random shares of each id, so they differ at any size."""
    topics = EXPERTS - 1
    names = [f"e{k}" for k in range(topics)]
    experts = unigram * np.random.default_rng(7).gamma(1.0, size=(topics, len(unigram)))
    experts /= experts.sum(1, keepdims=True)
    weight = np.full(topics, 1 / topics)
    for _ in range(ROUNDS):
        sent = slices.sparkSession.sparkContext.broadcast((np.concatenate([np.log(np.ascontiguousarray(experts.T)), np.zeros((1, topics))]).astype(np.float32), np.log(weight + 1e-6).astype(np.float32)))

        def run(batches, sent=sent):
            by_id, prior = sent.value
            sums = np.zeros((topics, len(by_id) - 1))
            for ids, counts in _slices(batches):
                y, begin = scored(ids, counts, size)
                # windows of one length, filled up with an id beyond the last, whose row is 0
                at = begin[:-1, None] + np.arange(STRIDE)
                ids = np.where(at < begin[1:, None], np.take(y, at, mode="clip"), len(by_id) - 1)
                parts = np.empty((topics, len(ids)))
                for a in range(0, len(ids), 4096):
                    score = np.ones(STRIDE, np.float32) @ np.take(by_id, ids[a : a + 4096], axis=0) + prior
                    own = np.exp(0.5 * (score - score.max(1, keepdims=True)))
                    parts[:, a : a + 4096] = (own / own.sum(1, keepdims=True)).T
                for k in range(topics):
                    sums[k] += np.bincount(ids.ravel(), np.repeat(parts[k], STRIDE), len(by_id))[:-1]
            at = np.flatnonzero(sums.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(sums[k, at]) for k in range(topics))], ["id", *names])

        got = slices.mapInArrow(run, "id long, " + ", ".join(f"{n} double" for n in names)).groupBy("id").agg(*(F.sum(n).alias(n) for n in names)).toArrow()  # one of each id
        if not len(got):
            return Attention.start(np.tile(unigram, (EXPERTS, 1)))
        sums = np.zeros_like(experts)
        sums[:, got.column("id").to_numpy()] = np.stack([got.column(n).to_numpy() for n in names])
        experts = sums + 20 * unigram
        experts /= experts.sum(1, keepdims=True)
        weight = sums.sum(1) / sums.sum()
    return Attention.start(np.concatenate([experts, further[None]]))


def refined(model: Attention, sums: np.ndarray, unigram: np.ndarray) -> Attention:
    experts = sums + 20 * unigram
    weight = sums.sum(1) + 1
    experts = experts / experts.sum(1, keepdims=True)
    return Attention(experts, Attention.profile_of(experts, weight / weight.sum()), *(getattr(model, n) for n in ("pairs", "far", "own", "context", "bias")))


def refine(slices: DataFrame, model: Attention, size: int, unigram: np.ndarray) -> Attention:
    """One round over every window of all training texts; within a task, Adam over batches of windows."""
    sent = slices.sparkSession.sparkContext.broadcast(model)
    names = [f"e{k}" for k in range(EXPERTS)]

    def run(batches):
        model = sent.value
        sums, own, seen, m, v, t = np.zeros((EXPERTS, len(model.experts[0]))), model, 0, 0.0, 0.0, 0
        most = 16 * 512 * STRIDE
        met, parts_of, n = np.zeros(most, np.int64), np.zeros((EXPERTS, most)), 0  # what is not yet in the sums

        def add():
            for k in range(EXPERTS):
                sums[k] += np.bincount(met[:n], parts_of[k, :n], sums.shape[1] + 1)[:-1]

        for ids, per in _slices(batches):
            for x, live, y, counts, _ in blocks(ids, per, size, 512):
                g, parts = own.gradient(x, live, y, counts)
                t += 1
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                own = own.with_weights(own.weights() + 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8))
                seen += len(x)
                if n + y.size > most:
                    add()
                    n = 0
                met[n : n + y.size] = np.where(counts, y, sums.shape[1]).ravel()  # what doesn't count goes beyond the last id
                parts_of[:, n : n + y.size] = parts.reshape(-1, EXPERTS).T
                n += y.size
        add()
        at = np.flatnonzero(sums.any(0))
        flat = own.weights()
        # weights come as ids below 0: value times windows, and the windows
        ids = np.concatenate([at, -1 - np.arange(len(flat))])
        columns = [np.concatenate([sums[k, at], flat * seen if k == 0 else np.full(len(flat), float(seen)) if k == 1 else np.zeros(len(flat))]) for k in range(EXPERTS)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c) for c in columns)], ["id", *names])

    got = slices.mapInArrow(run, "id long, " + ", ".join(f"{n} double" for n in names)).groupBy("id").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    ids = got.column("id").to_numpy()
    table = np.stack([got.column(n).to_numpy() for n in names])
    sums = np.zeros_like(model.experts)
    sums[:, ids[ids >= 0]] = table[:, ids >= 0]
    flat = model.weights()
    own = ids < 0
    if own.any() and (table[1, own] > 0).all():
        flat[-1 - ids[own]] = table[0, own] / table[1, own]
    return refined(model.with_weights(flat), sums, unigram) if sums.sum() else model


@dataclass
class Model:
    vocabulary: Vocabulary
    attention: Attention
    spelling: Spelling
    #: Hashes and training counts of words that make up at least a TABLE-th of the training words.
    frequent: np.ndarray
    counts: np.ndarray
    words: int
    #: Counts below this are not in the table.
    least: float

    def count(self, words: np.ndarray) -> np.ndarray:
        """Training counts of words by their hashes; 0 where they are not in the table."""
        if not len(self.frequent) or not len(words):
            return np.zeros(len(words), np.int64)
        order = np.argsort(words)  # in order, neighbours lie close in the table
        at = np.minimum(np.searchsorted(self.frequent, words[order]), len(self.frequent) - 1)
        out = np.empty(len(words), np.int64)
        out[order] = np.where(self.frequent[at] == words[order], self.counts[at], 0)
        return out

    def logs(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of each id of each text, and of the text's end after them. counts: ids of each text."""
        got = [np.zeros(0)]
        for x, live, y, scores, _ in blocks(ids, counts, self.vocabulary.size, PART):
            got.append(np.log10(np.maximum(self.attention.forward(x, live, y)[0][scores], 1e-37)).astype(float))
        return np.concatenate(got)

    def score(self, w: tokens.Words, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each text of a slice, of its words' first ids and its end; first id of each word; log10 share of its further ids."""
        counts = by_text(w, n)
        logs = self.logs(ids, counts)
        own = logs[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)]
        begin = np.cumsum(n) - n
        spelled = np.minimum(np.add.reduceat(own, begin) - own[begin], 0) if len(n) else np.zeros(0)
        return np.bincount(w.row, own[begin], len(counts)) + logs[np.cumsum(counts + 1) - 1], ids[begin], spelled


def train(docs: DataFrame, work: Work, vocabulary: Vocabulary | None = None) -> tuple[Model, int, int]:
    """The model, and the tokens (ends included) and distinct tokens of all training texts."""
    vocabulary = vocabulary or read_vocabulary()
    counts = work.save(word_counts(docs), "words")
    texts = docs.count()
    words, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = words / TABLE
    by, size = piece_counts(counts, vocabulary).toArrow(), vocabulary.size + 1  # one of each id
    sums = np.zeros((3, size))
    sums[:, by.column("id").to_numpy()] = np.stack([by.column(c).to_numpy() for c in ("first", "kinds", "further")])
    unigram = sums[0] + sums[2] + 0.5
    unigram[-1] += texts
    unigram /= unigram.sum()
    further = sums[2] + 20 * unigram
    frequent = counts.filter(F.col("c") >= least).select("word", "c").toArrow()
    work.drop("words")
    slices = work.save(encoded(docs, vocabulary), "slices")
    attention = refine(slices, start(slices, vocabulary.size, unigram, further / further.sum()), vocabulary.size, unigram)
    work.drop("slices")
    hashes = frequent.column("word").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return Model(vocabulary, attention, Spelling(sums[0], sums[1]), hashes[order], frequent.column("c").to_numpy()[order], int(words), float(least)), int(words) + texts, int(kinds) + (texts > 0)


_SENT = "fragment int, at long, {key} {kind}, n_words long, n_known long, logs double, score double, rests double, docs binary, times binary, words binary, rows binary, firsts binary, spelled binary"


def score(docs: DataFrame, training: Column, work: Work, key: str = "doc_id", vocabulary: Vocabulary | None = None) -> DataFrame:
    """Trains on the rows that `training` selects and scores all: key, n_tokens, n_known, train_tokens, base_score, score, rest_score (the part of `score` that words' further ids and ends have)."""
    model, total, kinds = train(docs.filter(training), work, vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # TABLE entries, and EXPERTS * vocabulary
    ends = docs.filter(training).count()
    fragments = max(8, partitions(docs.sparkSession))
    width = -(-(1 << 64) // fragments)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        model = sent.value
        forms = Forms(model.vocabulary)
        # each row has a number of its own
        upto = TaskContext.get().partitionId() << 40
        for batch in batches:
            schema = pa.schema([("fragment", pa.int32()), ("at", pa.int64()), (key, batch.schema.field(key).type), ("n_words", pa.int64()), ("n_known", pa.int64()), *((c, pa.float64()) for c in ("logs", "score", "rests")), *((c, pa.binary()) for c in ("docs", "times", "words", "rows", "firsts", "spelled"))])
            keys = upto + np.arange(batch.num_rows)
            upto += batch.num_rows
            teaches = batch.column("training").to_numpy(zero_copy_only=False)
            parts, rare = [np.zeros((5, 0))], []
            for i, j, w in _words(batch):
                row = w.row
                texts, first, spelled = model.score(w, *forms.of(w))
                c = model.count(w.hash)
                known = c > 0
                c = c[known]
                logs = np.bincount(row[known], np.log10(c + 0.5), j - i)
                goes_on = np.bincount(row[known], model.spelling.log10(first[known], spelled[known], c), j - i)
                parts.append(np.stack([w.counts, np.bincount(row[known], minlength=j - i), logs, texts, goes_on]))
                rest = ~known
                rare.append((w.hash[rest], row[rest] + i, first[rest], spelled[rest]))
            n_words, n_known, logs, scores, rests = np.concatenate(parts, 1)
            none = pa.nulls(len(n_words), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n_words), -1, np.int32)), pa.array(keys), batch.column(key), pa.array(n_words.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(logs), pa.array(scores), pa.array(rests), *[none] * 6], schema=schema)
            if not rare:
                continue
            word, row, first, spelled = (np.concatenate(x) for x in zip(*rare))
            order = np.lexsort((row, word))
            word, row, first, spelled = word[order], row[order], first[order], spelled[order]
            new = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (row[1:] != row[:-1])][: len(word)])
            times = np.diff(np.r_[new, len(word)])
            upon = np.r_[new, len(word)]
            word, row, first = word[new], row[new], first[new]
            times = np.where(teaches[row], times, -times)
            cuts = np.searchsorted((word // U(width)).astype(np.int64), np.arange(fragments + 1))
            out = []
            for f, a, b in zip(range(fragments), cuts[:-1], cuts[1:]):
                if a < b:
                    # each word of the batch once, with the number of its rows
                    head = a + np.flatnonzero(np.r_[True, word[a + 1 : b] != word[a : b - 1]])
                    out.append((f, pack_keys(keys[row[a:b]]), pack_keys(times[a:b]), word[head].tobytes(), pack_keys(np.diff(np.r_[head, b])), pack_keys(first[head]), spelled[upon[a] : upon[b]].astype(np.float32).tobytes()))
            if out:
                f, *packed = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), *(pa.nulls(len(f), x.type) for x in list(schema)[1:8]), *(pa.array(c, pa.binary()) for c in packed)], schema=schema)

    def meet(group: pa.Table) -> pa.Table:
        """Counts of rare words in a range of hashes, and how they go on, summed for each document. times: below 0 in documents that don't teach."""
        doc, times, word, rows, first, spelled = (np.concatenate([f(x.as_py()) for x in group.column(c)]) for c, f in (("docs", unpack_keys), ("times", unpack_keys), ("words", lambda x: np.frombuffer(x, U)), ("rows", unpack_keys), ("firsts", unpack_keys), ("spelled", lambda x: np.frombuffer(x, np.float32))))
        own, one, at = np.unique(word, return_index=True, return_inverse=True)
        at = np.repeat(at, rows)
        count = np.bincount(at, np.maximum(times, 0))
        # each time that a word stands in a document it goes on by itself
        each = np.repeat(np.arange(len(times)), np.abs(times))
        goes_on = np.bincount(each, sent.value.spelling.log10(first[one][at[each]], spelled.astype(float), count[at[each]]), len(times))
        c, word = count[at], own[at]
        order = np.lexsort((word, doc))  # sums in one order, however the parts arrive
        doc, times, c, goes_on = doc[order], np.abs(times[order]), c[order], goes_on[order]
        who, row = np.unique(doc, return_inverse=True)
        known, logs, rest = np.bincount(row, times * (c > 0)).astype(np.int64), np.bincount(row, times * np.log10(c + 0.5)), np.bincount(row, goes_on)
        bucket, docs_, known = by_bucket(who, known, fragments)
        parts = {"bucket": bucket, "docs": docs_, "known": known, "logs": by_bucket(who, logs.view(np.int64), fragments)[2], "rests": by_bucket(who, rest.view(np.int64), fragments)[2]}
        return pa.table({c: pa.array(x, pa.int32() if c == "bucket" else pa.binary()) for c, x in parts.items()})

    def add(group: pa.Table) -> pa.Table:
        doc, known, logs, rest = (np.concatenate([unpack_keys(x.as_py()) for x in group.column(c)]) for c in ("docs", "known", "logs", "rests"))
        order = np.lexsort((rest, logs, doc))  # sums in one order, however the parts arrive
        doc, known, logs, rest = doc[order], known[order], logs[order].view(np.float64), rest[order].view(np.float64)
        who, row = np.unique(doc, return_inverse=True)
        return pa.table({"at": pa.array(who, pa.int64()), "rare_known": np.bincount(row, known).astype(np.int64), "rare_logs": np.bincount(row, logs), "rare_rests": np.bincount(row, rest)})

    rows = docs.select(key, "text", F.coalesce(training, F.lit(False)).alias("training"))
    got = work.save(rows.mapInArrow(run, _SENT.format(key=key, kind=kind)), "scores")
    rare = got.filter("fragment >= 0").select("fragment", "docs", "times", "words", "rows", "firsts", "spelled").groupBy("fragment").applyInArrow(meet, "bucket int, docs binary, known binary, logs binary, rests binary")
    rare = rare.groupBy("bucket").applyInArrow(add, "at long, rare_known long, rare_logs double, rare_rests double")
    # the end is a token: of count `ends`, known where there is a training text
    scale = float(np.log10(total + 0.5 * (kinds + 1)))
    out = got.filter("fragment < 0").join(rare, "at", "left")
    n, rest = F.col("n_words") + 1, F.col("rests") + F.coalesce("rare_rests", F.lit(0.0))
    return out.select(
        key, n.alias("n_tokens"), (F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) + F.lit(float(np.log10(ends + 0.5))) - n * scale).alias("base_score"), (F.col("score") + rest).alias("score"), rest.alias("rest_score"),
    )
