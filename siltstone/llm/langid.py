"""Language identification of mixed text: script ranges narrow the candidates, Viterbi labels the words.

The model has one table: log probabilities of the byte trigrams of words with their ends, by language, learnt from all
training documents by counting. Each word gets a score by language; a path over the
document's words pays a penalty for each switch of language, and its runs of one language are the labelled spans.

Defined results: null texts and texts without a letter are `und` with score 0 and no span; training rows with null
text or language teach nothing; with no training rows every text is `und`; ties go to the language that comes first in
order of name; repeated rows are answered alike; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from siltstone.llm import tokens

#: Hash buckets of the trigrams; the table is BUCKETS * languages floats, whatever the input.
BITS = 16
BUCKETS = 1 << BITS
#: Log-probability units that a switch of language costs.
SWITCH = 8.0
#: Languages a model may have, which bounds its table; more raise an error.
MOST_LANGUAGES = 100
#: Code point ranges of scripts (first, last).
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x531, 0x58F)],
    "hebrew": [(0x5D0, 0x5EA)],
    "arabic": [(0x620, 0x64A), (0x66E, 0x6D3), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x963), (0x970, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "thai": [(0xE01, 0xE3A), (0xE40, 0xE4E)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7A3)],
    "kana": [(0x3041, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
_NAMES = [*SCRIPTS, "other"]


def _script_of() -> np.ndarray:
    """Script of each code point: the index of its range, `other` for any other letter, 255 for what is no letter."""
    out = np.full(0x110000, 255, np.uint8)
    out[[c for c in range(0x110000) if chr(c).isalpha()]] = len(SCRIPTS)
    for k, ranges in enumerate(SCRIPTS.values()):
        for low, high in ranges:
            out[low : high + 1] = k
    return out


_SCRIPT = _script_of()
#: Bytes of words of letters: A-Z, a-z and everything beyond ASCII.
_LETTERS = tokens.ALNUM & ~np.isin(np.arange(256), np.arange(0x30, 0x3A))
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[~_LETTERS] = 0


def code_points(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first bytes of UTF-8 characters, and their code points."""
    at = np.flatnonzero((b & 0xC0) != 0x80)
    ext = np.concatenate([b, np.zeros(3, np.uint8)]).astype(np.int32)
    c = ext[at]
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        own = np.flatnonzero((c >= low) & (c < high))
        if len(own):
            value = c[own] & mask
            for k in range(1, more + 1):
                value = (value << 6) | (ext[at[own] + k] & 0x3F)
            c[own] = np.minimum(value, 0x10FFFF)
    return at, c


def script_bits(w: tokens.Words) -> np.ndarray:
    """Bits of the scripts of each word's letters; 0 for a word without a letter."""
    at, c = code_points(w.data)
    kind = _SCRIPT[c]
    bits = np.zeros(len(w.data), np.int64)
    bits[at] = np.where(kind == 255, 0, 1 << np.minimum(kind, 62).astype(np.int64))
    # each word's bytes are followed by bytes without a bit, so sums over start..next start see the word alone
    bits[~_LETTERS[w.data]] = 0
    return np.bitwise_or.reduceat(bits, w.start) if len(w.start) else np.zeros(0, np.int64)


def features(w: tokens.Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of all words, each word with its two ends, and the index of each word's first."""
    b = np.concatenate([np.zeros(1, np.uint32), _LOWER[w.data], np.zeros(1, np.uint32)])
    size = w.end - w.start
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first - w.start, size) + 1
    own = np.repeat(np.arange(len(size)), size)
    before, after = b[at - 1], b[at + 1]
    before[at - 1 == w.start[own]] = 0
    after[at == w.end[own]] = 0
    gram = (before << np.uint32(16)) | (b[at] << np.uint32(8)) | after
    return ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64), first


@dataclass
class Model:
    languages: list[str]
    #: Log probability of each bucket, by language.
    table: np.ndarray
    #: Bits of the scripts that make up at least a hundredth of a language's training words.
    scripts: np.ndarray


def train(docs: DataFrame, rows: Column, lang: str = "lang") -> Model:
    """Counts features over all rows that `rows` selects. Only sums by language and bucket, a fixed number, reach the driver."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(lang).to_pylist(), object)
            data, offsets = tokens.buffers(batch.column("text"))
            for i, j in tokens.slices(offsets):
                w = tokens.words(data, offsets, i, j, _LETTERS, fold=True)
                gram, first = features(w)
                bits, row = script_bits(w), w.row
                for name in set(names[i:j]):
                    mine = (names[i:j] == name)[row]
                    own = sums.setdefault(name, np.zeros(BUCKETS + len(_NAMES) + 1))
                    own[:BUCKETS] += np.bincount(gram[np.repeat(mine, w.end - w.start)], minlength=BUCKETS)
                    for k in range(len(_NAMES)):
                        own[BUCKETS + k] += ((bits >> k) & 1)[mine].sum()
                    own[-1] += mine.sum()
        for name, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(own[at], pa.float64())})

    picked = docs.filter(rows & F.col(lang).isNotNull() & F.col("text").isNotNull()).select("text", F.col(lang).cast("string").alias(lang))
    sums = picked.mapInArrow(count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("sums"))
    got = packed.limit(MOST_LANGUAGES + 1).toArrow()
    if len(got) > MOST_LANGUAGES:
        raise ValueError(f"a model takes at most {MOST_LANGUAGES} languages")
    rows_ = sorted(zip(got.column("lang").to_pylist(), got.column("sums")))
    table = np.zeros((BUCKETS, len(rows_)), np.float32)
    scripts = np.zeros(len(rows_), np.int64)
    for k, (_, sums_) in enumerate(rows_):
        flat = sums_.values
        own = np.zeros(BUCKETS + len(_NAMES) + 1)
        own[flat.field("bucket").to_numpy()] = flat.field("n").to_numpy()
        n = own[:BUCKETS]
        table[:, k] = np.log((n + 0.1) / (n.sum() + 0.1 * BUCKETS))
        scripts[k] = sum(1 << s for s in range(len(_NAMES)) if own[BUCKETS + s] >= 0.01 * own[-1])
    return Model([x for x, _ in rows_], table, scripts)


def word_scores(model: Model, w: tokens.Words, bits: np.ndarray) -> np.ndarray:
    """Half the log probability of each word's trigrams, by language; languages of other scripts are ruled out if any fits."""
    gram, first = features(w)
    out = 0.5 * np.add.reduceat(model.table[gram], first, axis=0).astype(np.float64)
    fits = (bits[:, None] & model.scripts[None, :]) != 0
    return out - np.where(fits | ~fits.any(1, keepdims=True), 0.0, 20.0)


def viterbi(scores: np.ndarray, first: np.ndarray, length: np.ndarray, penalty: float) -> np.ndarray:
    """The best path over the words (rows of scores) of each text, paying `penalty` for each switch of language (column).

    Texts start at `first` and have `length` words; all are taken a word further at a time, the longest first.
    """
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    k = scores.shape[1]
    back = np.zeros(scores.shape, np.int16)
    own = np.arange(k, dtype=np.int16)
    best = scores[first].copy()
    live = np.searchsorted(-length, -np.arange(1, int(length.max()) + 1), "right")  # texts of more than t words
    for t in range(1, int(length.max())):
        n = live[t]
        at, now = first[:n] + t, best[:n]
        top = now.argmax(1)
        switch = now[np.arange(n), top] - penalty
        back[at] = np.where(now >= switch[:, None], own, top[:, None])
        best[:n] = np.maximum(now, switch[:, None]) + scores[at]
    path = np.zeros(len(scores), np.int64)
    state = best.argmax(1)
    for t in range(int(length.max()) - 1, -1, -1):
        n = live[t]
        at = first[:n] + t
        path[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return path


def may_switch(scores: np.ndarray, row: np.ndarray, total: np.ndarray, penalty: float) -> np.ndarray:
    """Rows whose best path may leave their best language; all others have no switch.

    Against the language of the greatest total, a path gains what its stretches in others gain and pays for as many
    switches as it has such stretches (one less if it never is in that language). So it can't gain if no stretch of one
    language gains over a penalty, nor the best beginning and the best end together.
    """
    n = len(total)
    lead = scores[np.arange(len(row)), total.argmax(1)[row]]
    first = np.searchsorted(row, np.arange(n))
    some = np.bincount(row, minlength=n) > 0
    out = np.zeros(n, bool)
    begins, ends = np.zeros(n), np.zeros(n)
    for c in range(scores.shape[1]):
        gain = scores[:, c] - lead
        sums = np.cumsum(gain)
        before = sums - gain
        jump = 2 * (np.abs(gain).sum() + 1.0) * row  # each row starts far below the last
        rise = sums - jump - np.minimum.accumulate(before - jump)
        out[row[rise > penalty * (1 - 1e-9)]] = True
        high = np.maximum.reduceat(sums, first[some]) - before[first[some]]
        last = np.r_[first[some][1:], len(row)] - 1
        low = sums[last] - np.minimum.reduceat(before, first[some])
        begins[some] = np.maximum(begins[some], high)
        ends[some] = np.maximum(ends[some], low)
    return out | (begins + ends > penalty * (1 - 1e-9))


def label(model: Model, data: np.ndarray, offsets: np.ndarray, i: int, j: int, penalty: float = SWITCH, spans: bool = False):
    """Language index (-1: und), score and optionally spans [(from byte, to byte, language)] of rows i to j-1."""
    n, k = j - i, len(model.languages)
    pred, score, runs = np.full(n, -1), np.zeros(n), [[] for _ in range(n)]
    w = tokens.words(data, offsets, i, j, _LETTERS, fold=True)
    if not len(w.hash) or not k:
        return pred, score, runs
    bits = script_bits(w)
    has = bits != 0
    row, at = w.row[has], np.flatnonzero(has)
    if not len(row):
        return pred, score, runs
    scores = word_scores(model, w, bits)[has]
    letters = (w.end - w.start)[has].astype(float)
    total = np.stack([np.bincount(row, scores[:, c], n) for c in range(k)], 1)
    first = np.searchsorted(row, np.arange(n + 1))
    path = total.argmax(1)[row]
    mixed = np.flatnonzero(may_switch(scores, row, total, penalty))
    if len(mixed):
        found = viterbi(scores, first[mixed], first[mixed + 1] - first[mixed], penalty)
        own = np.isin(row, mixed)
        path[own] = found[own]
    share = np.stack([np.bincount(row, letters * (path == c), n) for c in range(k)], 1)
    some = first[1:] > first[:-1]
    pred[some] = share[some].argmax(1)
    # certainty of the words on the winning language's spans, times its share of the letters
    own = path == pred[row]
    size = np.bincount(row, own, n)
    mean = np.stack([np.bincount(row, scores[:, c] * own, n) for c in range(k)], 1) / np.maximum(size, 1)[:, None]
    odds = np.exp(np.minimum(size, 20)[:, None] * (mean - mean.max(1, keepdims=True)))
    score[some] = ((odds.max(1) / odds.sum(1)) * share.max(1) / np.maximum(share.sum(1), 1))[some]
    if spans:
        low = offsets[i : j + 1] - offsets[i]
        edge = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (path[1:] != path[:-1])])
        for a, b in zip(edge, np.r_[edge[1:], len(row)]):
            r = row[a]
            runs[r].append((int(w.start[at[a]] - low[r]), int(w.end[at[b - 1]] - low[r]), model.languages[path[a]]))
    return pred, score, runs


def identify(docs: DataFrame, model: Model, keep: list[str], penalty: float = SWITCH, spans: bool = False) -> DataFrame:
    """The columns in `keep`, lang_pred, score, and with `spans` the labelled byte ranges."""
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, *T._parse_datatype_string("lang_pred string, score double" + ", spans array<struct<start: int, end: int, lang: string>>" * spans)])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * languages floats

    def run(batches):
        model = sent.value
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            data, offsets = tokens.buffers(batch.column("text"))
            got = [label(model, data, offsets, i, j, penalty, spans) for i, j in tokens.slices(offsets)]
            if not got:
                continue
            pred = np.concatenate([x[0] for x in got])
            out = [*(batch.column(f.name) for f in fields), pa.array(names[pred], pa.string()), pa.array(np.concatenate([x[1] for x in got]))]
            if spans:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                out.append(pa.array([[dict(zip(("start", "end", "lang"), s)) for s in r] for x in got for r in x[2]], kind))
            yield pa.RecordBatch.from_arrays(out, [*(f.name for f in fields), "lang_pred", "score", *["spans"] * spans])

    names = list(dict.fromkeys([*keep, "text"]))
    return docs.select(*names).mapInArrow(run, schema)
