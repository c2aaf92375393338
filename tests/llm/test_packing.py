"""Packing: ids as the tokenizer has them, every piece once, no gap, and few sequences."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from siltstone.llm import packing
from siltstone.llm.work import Work

SCHEMA = "doc_id long, text string, key string, id long, g int, sequence long, offset long, own string, crc long"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_vocabulary())


def make_rows():
    rng = random.Random(3)
    odd = [None, "", " \t\n", "It's  Über naïve\x0bvertical\x0cfeed\x85next", "日本語 テキスト " * 30, "é ́x cafe\ńs", "x" * 20_000, "<|endoftext|> a<|startoftext|>b", "don't 12345 !!!???", "ΑΣ ΟΔΟΣ İI", "\x1c\x1d a b", "z " * 9000]
    texts = odd + [" ".join(rng.choice(["word", "Wörter", "le", "Supercalifragilistic", "x9", "…"]) for _ in range(int(rng.paretovariate(0.8) * 20) % 6000)) for _ in range(150)]
    texts += [texts[20]] * 30 + [""] * 40
    return [(k if k != 7 else None, t, "k", 5, 1, 2, 3, "o", 4) for k, t in enumerate(texts)]


def check(rows, got, tokenizer, capacity, end=1):
    """Every document's ids are there once, in pieces that only longer ones are cut into, in sequences without gaps."""
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    total = 0
    for k, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        total += len(ids)
        want = [(p, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for p, s in enumerate(range(0, len(ids), capacity))]
        assert sorted((r["piece"], r["start"], r["length"], r["crc"]) for r in by[k]) == want
    assert len(got) == sum(-(-(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) // capacity) for _, t, *_ in rows)
    held = {}
    for r in got:
        held.setdefault(r["sequence"], []).append((r["offset"], r["length"]))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), -(-total // capacity)


@pytest.mark.parametrize("capacity,group", [(4096, 4096), (100, 4096), (100, 40), (7, 50)])
def test_pack(spark, tokenizer, capacity, group):
    """Null, empty, blank and very long texts, null ids, equal rows, special tokens' strings, clashing columns, several rounds."""
    rows = make_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    n, least = check(rows, packing.pack(docs, Work(spark, "t13"), capacity=capacity, group=group).collect(), tokenizer, capacity)
    assert n <= least * 1.02 + 1


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), Work(spark, "t13")).count() == 0


def test_sequences_hold_the_documents(spark, tokenizer):
    rows = [r for r in make_rows() if r[0] is not None]
    docs = spark.createDataFrame(rows, SCHEMA)
    work = Work(spark, "t13s")
    placed = work.save(packing.pack(docs, work, capacity=200), "placed")
    got = packing.sequences(docs, placed).collect()
    parts = {}
    for r in got:
        ends = [*r["offsets"][1:], len(r["input_ids"])]
        for key, a, b in zip(r["keys"], r["offsets"], ends):
            parts[key, r["sequence"], a] = r["input_ids"][a:b]
    for p in placed.collect():
        whole = [*tokenizer.encode(rows_by(rows, p["doc_id"]) or "", add_special_tokens=False).ids, 1]
        assert parts.pop((p["doc_id"], p["sequence"], p["offset"])) == whole[p["start"] : p["start"] + p["length"]]
    assert not parts


def rows_by(rows, key):
    return next(r[1] for r in rows if r[0] == key)


def test_words_are_kept_within_a_bound(monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 50)
    texts = pa.array([" ".join(f"word{k} other{k % 7}" for k in range(n)) for n in (1, 40, 0, 90, 3)])
    direct = Tokenizer.from_file(packing.default_vocabulary())
    for _ in range(3):
        ids, first = packing.token_ids(texts, packing.default_vocabulary())
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [[*direct.encode(t, add_special_tokens=False).ids, 1] for t in texts.to_pylist()]


@pytest.mark.parametrize("seed", range(6))
def test_search_only_gains(seed):
    """Every exchange raises the sum of squares; bins keep their pieces and their bound; no more bins than best fit."""
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 99), rng.randint(30, 45), 34, 33]) for _ in range(300)]
    start = packing.best_fit(lengths, 100)
    search = packing.Search([list(b) for b in start], lengths, 100)
    squares = [sum(f * f for f in search.fill)]
    plain = search.exchange
    search.exchange = lambda *a: (plain(*a), squares.append(sum(f * f for f in search.fill)))
    bins = search.run()
    assert all(a < b for a, b in zip(squares, squares[1:]))
    assert sorted(i for b in bins for i in b) == list(range(300)) and all(sum(lengths[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= len(start)


def test_search_empties_bins_that_best_fit_leaves():
    """Three pieces that fill a bin each time: exchanges win back bins that falling best fit spends."""
    rng = random.Random(1)
    lengths = []
    for _ in range(20):
        a = rng.randint(380, 490)
        b = rng.randint(250, (1000 - a) // 2)
        lengths += [a, b, 1000 - a - b]
    start = packing.best_fit(lengths, 1000)
    assert len(packing.Search([list(b) for b in start], lengths, 1000).run()) < len(start)


@pytest.mark.parametrize("a,b,gain", [([40], [50], 40), ([60], [50, 30], 10), ([30, 30], [50, 35], 10), ([45], [25, 18, 44], 2), ([70], [60, 20], 10)])
def test_exchanges(a, b, gain):
    """A move, one for one, two for one, one for two: the most that fits goes over."""
    s = packing.Search([list(range(len(a))), list(range(len(a), len(a) + len(b)))], a + b, 100)
    give, back = s.best(0, 1, s.sizes(0))
    assert sum(give) - sum(back) >= gain and sum(b) + sum(give) - sum(back) <= 100
    s.exchange(0, 1, give, back)
    assert sorted(i for own in s.bins for i in own) == list(range(len(a + b))) and s.fill == [sum(s.lengths[i] for i in own) for own in s.bins]
