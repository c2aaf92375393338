"""The operators against brute force, on invented texts with all the odd cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import decontaminate, imatch, langid, lm, mixing, ngram_join, quality, queries, sharding, substring_dedup, suffix_array, suffix_dedup, tokens
from siltstone.llm.graph import components
from siltstone.llm.packed import pack_keys, unpack_keys
from siltstone.llm.work import Work

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, values string, row string, n string, place int, bucket int, score double"


def make_docs() -> list[tuple]:
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base = prose(90), prose(120).split()
    texts = [None, "", "   \n\t", "one", "A b", "!!! ???", "x\x85y z w", "日本 " * 30, "same words here now", "SAME words here now"]
    texts += [prose(rng.randint(1, 80)) for _ in range(20)]
    texts += [prose(20) + " " + passage + " " + prose(20) for _ in range(6)]
    for k in range(14):  # near copies, some linked only through others
        w = list(base)
        for _ in range(k % 7):
            w[rng.randrange(len(w))] = rng.choice(vocab) + str(k)
        texts.append(" ".join(w))
    texts += [texts[25]] * 4 + [passage * 3, "to " * 700, prose(9000), passage.upper()]
    rng.shuffle(texts)
    return [(k * 3, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", "c", None]), 0, "v", "r", "n", 1, 2, 0.5) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t, fold=False):
    return BLANK.findall((t or "").translate(FOLD) if fold else t or "")


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


# 3


def expected_hits(rows, items):
    wins = defaultdict(set)
    for item, t in items:
        w = ALNUM.findall((t or "").translate(FOLD))
        for k in range(max(1, len(w) - 9)) if w else []:
            wins[tuple(w[k : k + 10])].add(str(item))
    out = {}
    for d, t, *_ in rows:
        w = ALNUM.findall((t or "").translate(FOLD))
        hit, ids = set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in wins:
                    hit.update(range(k, k + size))
                    ids |= wins[tuple(w[k : k + size])]
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


def test_decontaminate(spark, rows, docs, empty):
    long = max((t for _, t, *_ in rows if t), key=len)
    items = [(1, long[500:1200]), (10, None), (2, "..."), (3, "Same, words!"), (20, "same words"), (4, "never seen words in any text"), (5, " ".join(long.split()[40:49])), (6, "日本 " * 12), (6, "日本 " * 12)]
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.digest(decontaminate.decontaminate(docs, tests, Work(spark, "t3"))))
    want = expected_hits(rows, items)
    assert {d: tuple(g[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for d, g in got.items()} == want and sum(w[4] for w in want.values()) > 3
    assert decontaminate.digest(decontaminate.decontaminate(empty, tests, Work(spark, "t3"))).count() == 0
    none = decontaminate.digest(decontaminate.decontaminate(docs, tests.limit(0), Work(spark, "t3")))
    assert none.filter("contaminated").count() == 0 and none.count() == len(rows)


def test_terms_in_passes(spark, rows, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "TERMS_A_PASS", 5)
    items = [(1, max((t for _, t, *_ in rows if t), key=len)[500:700])]
    hits = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), Work(spark, "t3"))
    assert {r["doc_id"]: r["n_hit"] for r in hits.collect()} == {d: w[1] for d, w in expected_hits(rows, items).items()}


def test_documents_without_an_id(spark, rows):
    """They are found by their texts, several of them and clashing names included."""
    long = max((t for _, t, *_ in rows if t), key=len)
    items = [(1, long[500:700]), (2, "same words here now")]
    odd = [(None, long), (None, "same words here now"), (None, None), (None, "clean"), (None, "clean"), (7, long), (8, "clean")]
    df = spark.createDataFrame([(d, t, t) for d, t in odd], "doc_id long, text string, text_hash string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(df, tests, Work(spark, "t3"), keep=["text_hash"]).collect()
    want = [(d, t, *expected_hits([(0, t)], items)[0][:2]) for d, t in odd]
    assert sorted(((r["doc_id"], r["text_hash"], r["n_words"], r["n_hit"]) for r in got), key=repr) == sorted(want, key=repr) and sum(w[3] > 0 for w in want) == 3


def test_proximity(spark):
    df = spark.createDataFrame([(1, "a x x b c"), (2, "a b"), (3, "c b a"), (4, None)], "doc_id long, text string")
    assert {r["doc_id"]: (r["start"], r["width"]) for r in decontaminate.proximity_matches(df, ["A", "b", "c"], 5).collect()} == {1: (0, 5), 3: (0, 3)}
    assert decontaminate.proximity_matches(df, ["a", "b", "c"], 4).count() == 1
    for none in ([], ["", None], ["...", "!"]):
        assert decontaminate.proximity_matches(df, none, 4).collect() == []
    assert decontaminate.proximity_matches(df, ["b", "B"], 1).count() == 3


# 4


def expected_components(rows):
    sets = {}
    for d, t, *_ in rows:
        w = words(t, True)
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_ngram_join(spark, rows, docs, empty):
    got = by_id(ngram_join.near_duplicates(docs, Work(spark, "t4")))
    want = expected_components(rows)
    assert {d: (g["n_shingles"], g["component_id"]) for d, g in got.items()} == want
    assert len({c for _, c in want.values()}) < len(want) - 5
    assert ngram_join.near_duplicates(empty, Work(spark, "t4")).count() == 0


def test_ngram_join_of_a_drifting_family(spark):
    """Neighbours are linked, distant ones are not, and no text is near all."""
    rng = random.Random(3)
    w = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    family = []
    for k in range(40):
        family.append((k, " ".join(w)))
        for _ in range(2):
            w[rng.randrange(200)] = f"n{k}x{rng.randrange(10**6)}"
    df = spark.createDataFrame(family, "doc_id long, text string")
    got = by_id(ngram_join.near_duplicates(df, Work(spark, "t4")))
    assert {d: (g["n_shingles"], g["component_id"]) for d, g in got.items()} == expected_components(family)


@pytest.mark.parametrize("n", [2, 50])
def test_components(spark, n):
    path = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(900, 901)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(path, Work(spark, "cc"), "c").collect()} == {**dict.fromkeys(range(n + 1), 0), 900: 900, 901: 900}


# 5


def expected_substrings(rows):
    first = {}
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), d)
    out = {}
    for d, t, *_ in rows:
        w = words(t)
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < d for p in range(k, k + 13)}
        out[d] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_substring_dedup(spark, rows, docs, empty, batches):
    got = by_id(substring_dedup.deduplicate(docs, Work(spark, "t5"), batches=batches))
    want = expected_substrings(rows)
    assert {d: (g["n_words"], g["n_removed"], g["kept"]) for d, g in got.items()} == want and sum(w[1] for w in want.values()) > 300
    assert substring_dedup.deduplicate(empty, Work(spark, "t5"), batches=batches).count() == 0


def test_index_runs_are_compacted(spark, docs):
    index = substring_dedup.FingerprintIndex(Work(spark, "t5"))
    for k in range(4):
        index.append(docs.filter(f"doc_id % 4 = {k}"))
        index.compact()
    assert [r[0] for r in index.runs] == [2]
    assert index.append(docs.filter("doc_id < 0")).count() == 0


# 6


def test_imatch(spark, rows, docs, empty):
    lex = imatch.lexicon(docs, Work(spark, "t6"))
    terms = Counter()
    for _, t, *_ in rows:
        terms.update(set(ALNUM.findall((t or "").translate(FOLD))))
    low, high = imatch.BAND
    assert len(lex) == sum(low * len(rows) <= n <= high * len(rows) for n in terms.values())
    got = by_id(imatch.compare_edited(docs, lex, Work(spark, "t6")))
    order = sorted(rows, key=lambda r: -r[0])
    for k, (d, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        assert got[d]["edited_sha256"] == hashlib.sha256((t[: len(t) - third] + after[:third]).encode()).hexdigest() and got[d]["n_chars"] == len(t)
        assert 0 <= got[d]["near_edited"] <= 1 and 0 <= got[d]["near_next"] <= 1
    prints = defaultdict(set)
    for d, t, *_ in rows:
        prints[t or ""].add(got[d]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    alone = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(docs, lex).collect()}
    assert all(alone[d] == got[d]["fingerprint"] for d in got)
    assert imatch.compare_edited(empty, lex, Work(spark, "t6")).count() == 0 and len(imatch.lexicon(empty, Work(spark, "t6"))) == 0
    one = imatch.compare_edited(docs.filter("doc_id = 30"), lex, Work(spark, "t6")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


# 7


def test_quality_learns_interactions():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9
    assert quality.fit(x, np.ones(len(x))).score(x).min() > 0.99 and quality.fit(x[:0], y[:0]).score(x).tolist() == [0.5] * len(x)


def test_quality(spark, sf, docs, empty):
    got = by_id(queries.op7_quality(spark, "/root/testdata/sf0.01"))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(got[d]["held_out"] for d in held) and np.mean([got[d]["predicted"] == labels[d] for d in held]) > 0.9
    model = quality.fit(np.random.default_rng(0).random((50, len(quality.FEATURES))), np.arange(50) % 2)
    assert quality.score(docs, model).count() == docs.count() and quality.score(empty, model).count() == 0


# 8


def test_lm_counts(spark, rows, docs, empty):
    ids = {d: zlib.crc32(str(d).encode()) % 5 != 1 for d, *_ in rows}
    got = by_id(lm.score(docs, queries.fold("doc_id", 5) != 1, Work(spark, "t8")))
    counts, own = Counter(), {d: [*words(t, True), "\0end"] for d, t, *_ in rows}
    for d, w in own.items():
        if ids[d]:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    for d, w in own.items():
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (got[d]["n_tokens"], got[d]["n_known"], got[d]["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert got[d]["base_score"] == pytest.approx(base) and got[d]["score"] < 0
    assert lm.score(empty, queries.fold("doc_id", 5) != 1, Work(spark, "t8")).count() == 0


def test_attention_is_causal_and_adds_up():
    rng = np.random.default_rng(2)
    experts = rng.random((3, 11))
    model = lm.Attention.start(experts / experts.sum(1, keepdims=True))
    model = model.with_weights(model.weights() + rng.normal(0, 0.3, len(model.weights())))
    first = rng.integers(0, 10, 60)
    x, live, y, counts, _ = lm.windows(first, np.array([60]), 10)
    assert counts.sum() == 61  # each token once, and the end
    total = sum(model.forward(x, live, np.full_like(y, s))[0] for s in range(11))
    assert np.allclose(total, 1, atol=1e-4)
    changed = first.copy()
    changed[30:] = 0
    p, q = (model.forward(*lm.windows(f, np.array([60]), 10)[:3])[0].ravel() for f in (first, changed))
    assert np.allclose(p[:30], q[:30])


def test_gradient():
    rng = np.random.default_rng(4)
    experts = rng.random((3, 6))
    model = lm.Attention.start(experts / experts.sum(1, keepdims=True))
    x, live, y, counts, _ = lm.windows(rng.integers(0, 5, 40), np.array([25, 15]), 5)
    flat = model.weights().astype(float)
    g, _ = model.gradient(x, live, y, counts)

    def mean(w):
        return np.log(model.with_weights(w).forward(x, live, y)[0][counts]).mean()

    for k in rng.integers(0, len(flat), 12):
        step = np.zeros(len(flat))
        step[k] = 1e-2
        assert g[k] == pytest.approx((mean(flat + step) - mean(flat - step)) / 2e-2, abs=2e-3)


@pytest.mark.parametrize("times", [1, 30, 90])  # beyond 60, exponents are clipped
def test_attention_against_loops(times):
    rng = np.random.default_rng(6)
    experts = rng.random((3, 8))
    model = lm.Attention.start(experts / experts.sum(1, keepdims=True))
    model = model.with_weights(rng.normal(0, 1, len(model.weights())) * times)
    x, live, y, counts, _ = lm.windows(rng.integers(0, 7, 70), np.array([0, 3, 40, 27]), 7)
    got = model.forward(x, live, y)[0]
    clipped = lambda z: np.exp(np.clip(z, -60, 60))
    for w, i in zip(*np.nonzero(counts)):
        here = lm.WINDOW - lm.STRIDE + i
        q, keys = model.profile[x[w, here]].astype(float), [j for j in range(here + 1) if live[w, j]]
        share = np.array([clipped(q @ model.pairs @ model.profile[x[w, j]] + model.far[here - j]) for j in keys])
        context = share @ model.profile[x[w, keys]] / share.sum()
        gate = clipped(q @ model.own + context @ model.context + model.bias)
        assert got[w, i] == pytest.approx(gate @ model.experts[:, y[w, i]] / gate.sum(), rel=1e-5 * times)


def test_windows_do_not_copy_the_tables():
    """What a few windows allocate follows them and not the vocabulary."""
    experts = np.random.default_rng(3).random((lm.EXPERTS, 50_001))
    model = lm.Attention.start(experts / experts.sum(1, keepdims=True))
    x, live, y, counts, _ = lm.windows(np.arange(60), np.array([60]), 50_000)
    model.gradient(x, live, y, counts)
    tracemalloc.start()
    model.gradient(x, live, y, counts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < model.profile.nbytes // 4


def test_scored_are_the_windows_targets():
    rng = np.random.default_rng(4)
    counts = np.array([0, 1, 23, 24, 25, 100, 0, 48])
    first = rng.integers(0, 9, counts.sum())
    _, _, y, live, _ = lm.windows(first, counts, 9)
    flat, begin = lm.scored(first, counts, 9)
    assert [x.tolist() for x in np.split(flat, begin[1:-1])] == [a[b].tolist() for a, b in zip(y, live)]


def test_words_ids():
    vocabulary = lm.read_vocabulary()
    assert vocabulary.encode(" hello") == vocabulary.word(b"hello")
    for forms in (["hello", "größe", "don't", "x" * 300, "a.b,c", "日本語", "'s", "12ab"], ["a\u00a0", "\u00a0b", "hello\u3000"], [chr(k) for k in range(33, 600) if not chr(k).isspace()]):
        ids, n = vocabulary.words([f.encode() for f in forms])
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [vocabulary.word(f.encode()) for f in forms]
    own = lm.Forms(vocabulary)
    for texts in (["hello größe hello", "", "x" * 300 + " don't"], ["größe 12ab hello"]):
        data, offsets = tokens.buffers(pa.array(texts))
        w = tokens.words(data, offsets, 0, len(texts), tokens.BLANK_SPLIT, fold=True)
        ids, n = own.of(w)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [vocabulary.word(f.encode()) for t in texts for f in t.split()]
        assert lm.by_text(w, n).tolist() == [sum(len(vocabulary.word(f.encode())) for f in t.split()) for t in texts]


def test_goings_on_add_up():
    """Shares of the training words of a first id and of all that attention gives to what follows it."""
    s = lm.Spelling(np.array([9.0, 0.0]), np.array([2.0, 0.0]))
    spelled = np.log10([0.5, 0.1, 0.15])  # the word ends, or two others go on
    p = 10 ** s.log10(np.zeros(3, np.int64), spelled, np.array([5, 4, 0]))
    left = 2 / 11 * (1 - (10**spelled).sum())  # of words that training doesn't have
    assert p.sum() + left == pytest.approx(1)
    assert s.log10(np.ones(1, np.int64), np.array([-400.0]), np.zeros(1))[0] == -400.0


def test_lm_scores_all_ids(spark, rows, docs):
    """Against the model's own steps, text by text: each id once by attention, and each word's count."""
    teaches = queries.fold("doc_id", 5) != 1
    got = by_id(lm.score(docs, teaches, Work(spark, "t8s")))
    model, total, _ = lm.train(docs.filter(teaches), Work(spark, "t8t"))
    counts = Counter(x for d, t, *_ in rows if zlib.crc32(str(d).encode()) % 5 != 1 for x in words(t, True))
    beside, ours = 0.0, 0.0
    shares = Counter(x for w, c in counts.items() for x in model.vocabulary.word(w.encode()) * c)
    for d, t, *_ in rows:
        own = [model.vocabulary.word(w.encode()) for w in words(t, True)]
        ids = np.array([x for w in own for x in w], np.int64)
        logs = model.logs(ids, np.array([len(ids)])).tolist()
        assert len(logs) == len(ids) + 1
        want = logs.pop()
        at = 0
        for w, n in zip(words(t, True), map(len, own)):
            want += logs[at] + model.spelling.log10(ids[at : at + 1], np.array([sum(logs[at + 1 : at + n])]), np.array([counts[w]]))[0]
            at += n
        assert got[d]["score"] == pytest.approx(want, rel=1e-3, abs=1e-2)
        if zlib.crc32(str(d).encode()) % 5 == 1:
            beside += sum(math.log10((shares[x] + 0.5) / (sum(shares.values()) + 0.5 * model.vocabulary.size)) for x in ids.tolist())
            ours += got[d]["score"]
    assert ours > beside or not beside


# 9


@pytest.mark.parametrize("text", [b"banana", b"aaaaaaaaaaaaaaaaaaaaa", b"ab" * 40 + b"\xff" + b"ab" * 39, bytes(np.random.default_rng(0).integers(97, 99, 500).astype(np.uint8)), b"a"])
def test_suffix_array(text):
    t = np.frombuffer(text, np.uint8)
    order = suffix_array.suffix_array(t)
    want = sorted(range(len(text)), key=lambda i: text[i:])
    assert order.tolist() == want
    shared = suffix_array.common_prefixes(t, order)
    for a, b in zip(want, want[1:]):
        n = 0
        while a + n < len(text) and b + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        assert shared[b] == n
    assert shared[want[0]] == 0


def expected_bytes(rows, span):
    raw = {d: (t or "").encode() for d, t, *_ in rows}
    times = Counter(b[k : k + span] for b in raw.values() for k in range(len(b) - span + 1))
    out = {}
    for d, b in raw.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - span + 1):
            if times[b[k : k + span]] > 1:
                gone[k : k + span] = True
        out[d] = (len(b), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize(("span", "noted", "shard", "common"), [(400, 250, 1 << 19, 256), (100, 100, 600, 0), (150, 70, 600, 1)])
def test_suffix_dedup(spark, rows, docs, empty, span, noted, shard, common):
    got = by_id(suffix_dedup.deduplicate(docs, Work(spark, "t9"), span=span, noted=noted, shard=shard, common=common))
    want = expected_bytes(rows, span)
    assert {d: g["n_repeated"] for d, g in got.items()} == {d: w[1] for d, w in expected_bytes(rows, noted).items()}
    assert {d: (g["n_bytes"], g["n_removed"], g["n_spans"], bytes(g["kept"])) for d, g in got.items()} == want and sum(w[1] for w in want.values()) > 2000
    alone = by_id(suffix_dedup.deduplicate(docs, Work(spark, "t9"), span=span, shard=shard, common=common))
    assert {d: (g["n_bytes"], g["n_removed"], g["n_spans"], bytes(g["kept"])) for d, g in alone.items()} == want and all("n_repeated" not in g for g in alone.values())
    assert suffix_dedup.deduplicate(empty, Work(spark, "t9")).count() == 0


# 10


def test_viterbi():
    rng = np.random.default_rng(1)
    for _ in range(60):
        length = rng.integers(1, 30, 5)
        scores = rng.normal(0, 3, (length.sum(), 4))
        scores[:, 0] += rng.choice([0, 1.5, 3])
        first, row = np.r_[0, np.cumsum(length)], np.repeat(np.arange(5), length)
        total = np.stack([np.bincount(row, scores[:, c], 5) for c in range(4)], 1)
        found, mixed = langid.viterbi(scores, first[:-1], length, 8.0), langid.may_switch(scores, row, total, 8.0)
        for r in range(5):
            s = scores[first[r] : first[r + 1]]
            path = found[first[r] : first[r + 1]]
            value = lambda p: s[np.arange(len(s)), p].sum() - 8.0 * (np.diff(p) != 0).sum()
            best = s[0]
            for t in range(1, len(s)):
                best = np.maximum(best, best.max() - 8.0) + s[t]
            assert value(path) == pytest.approx(best.max())
            if not mixed[r]:
                assert total[r].max() == pytest.approx(best.max())


def test_langid(spark, docs, empty):
    got = by_id(queries.op10_langid(spark, "/root/testdata/sf0.01"))
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [d for d in langs if zlib.crc32(str(d).encode()) % 4 == 2]
    assert np.mean([got[d]["lang_pred"] == langs[d] for d in held]) > 0.97
    en, fr = "the house and the garden with this tree", "le jardin et la maison avec cet arbre"
    taught = spark.createDataFrame([(1, en, "en"), (2, fr, "fr"), (3, "дом и сад", "ru"), (4, None, "de"), (5, "x", None)], "doc_id long, text string, lang string")
    model = langid.train(taught, queries.fold("doc_id", 1) == 0)
    assert model.languages == ["en", "fr", "ru"]
    asked = spark.createDataFrame([(1, f"{en}. {fr}."), (2, "123 !!"), (3, None), (4, "сад"), (5, ""), (6, fr.upper())], "doc_id long, text string")
    out = by_id(langid.identify(asked, model, ["doc_id"], spans=True))
    assert [s["lang"] for s in out[1]["spans"]] == ["en", "fr"] and (f"{en}. {fr}."[out[1]["spans"][1]["start"] : out[1]["spans"][1]["end"]]) == fr
    assert [out[k]["lang_pred"] for k in (2, 3, 4, 5, 6)] == ["und", "und", "ru", "und", "fr"] and out[2]["score"] == 0
    assert langid.identify(empty, model, ["doc_id"]).count() == 0
    nothing = langid.train(empty, queries.fold("doc_id", 1) == 0)
    assert {r["lang_pred"] for r in langid.identify(docs, nothing, ["doc_id"]).collect()} == {"und"}


# 2


@pytest.mark.parametrize("own", [[1], [500, 500], [5, 3, 2], [0, 7, 0, 1], [490, *[10] * 51], [900, 50, 30, 20]])
def test_schedule_deviates_less_than_a_unit(own):
    slots = mixing.schedule(own)
    period = sum(own)
    assert sorted(s for t in slots for s in t) == list(range(period))
    for a, t in zip(own, slots):
        had = np.cumsum(np.bincount(np.array(t, int), minlength=period))
        assert np.abs(had - a * np.arange(1, period + 1) / period).max() < 1


def test_mixing(spark, rows, docs, empty):
    placed, total = mixing.mix(docs, {"a": 0.2, "b": 0.5}, block=500)
    got = placed.select("row.doc_id", "pool", "offset", "block", "slot").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, *_ in rows) and all(0 <= r["slot"] < total for r in got)
    slots = {}
    for r in got:
        assert slots.setdefault(r["slot"], (r["pool"], r["block"])) == (r["pool"], r["block"]) and r["block"] == r["offset"] // 500
    assert mixing.mix(empty)[0].count() == 0
    twice = docs.unionByName(docs)
    assert mixing.mix(twice)[0].count() == 2 * len(rows)
    ordered = mixing.in_mix_order(docs, block=500)
    assert ordered.columns == docs.columns and ordered.count() == len(rows)


def test_phases_place_every_unit_once():
    units = {"a": 1000, "b": 3, "c": 77, "d": 0, "e": 40, "f": 9}
    plans, total = mixing.phases(units, {"a": 0.1, "b": 0.6, "c": 0.3, "d": 1, "e": 0, "f": -1})
    assert set(plans) == set("abcef") and total == 1129
    at = {s: plan.slots(k, np.arange(units[s])) for s, (plan, k) in plans.items()}
    assert sorted(np.concatenate(list(at.values())).tolist()) == list(range(total))
    assert min(at["e"].min(), at["f"].min()) == 1080
    assert mixing.phases({"d": 0}, {}) == ({}, 0)


# 1


def test_sharding(spark, rows, docs, empty, tmp_path):
    docs.write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    store = sharding.Store(spark, str(tmp_path / "store"), target=200_000)
    assert store.append(stored, 2) == 1 and store.append(docs, 1) == 2
    before = {r["file"] for r in store.manifest().collect()}
    version = store.compact(docs.schema)
    assert version == 3 and store.version() == 3
    after = store.manifest().collect()
    assert len(after) < len(before) and sum(r["rows"] for r in after) == 2 * len(rows)
    got = store.rows(docs.schema).select("row.*")
    assert got.columns == docs.columns
    both = docs.unionByName(docs)
    assert got.exceptAll(both).isEmpty() and both.exceptAll(got).isEmpty()
    assert store.compact(docs.schema) == 3  # nothing left to merge
    with pytest.raises(RuntimeError, match="another writer"):
        store.commit(store.manifest(), 2)
    assert store.version() == 3 and store.manifest().count() == len(after)
    # readers of older versions keep their files until those versions are vacuumed
    assert store.rows(docs.schema, 2).count() == 2 * len(rows) and store.rows(docs.schema, 1).count() == len(rows)
    (tmp_path / "store" / "data" / "half-done").mkdir()
    (tmp_path / "store" / "data" / "half-done" / "part.parquet").write_bytes(b"of a lost driver")
    assert store.rows(docs.schema).count() == 2 * len(rows)
    store.vacuum(keep=1)
    assert store.versions() == [3] and store.rows(docs.schema).count() == 2 * len(rows)
    left = {str(f.relative_to(tmp_path / "store" / "data")) for f in (tmp_path / "store" / "data").rglob("*.parquet")}
    assert left == {r["file"] for r in after} | {"half-done/part.parquet"}
    store.vacuum(keep=1)
    assert store.append(docs, 1) == 4
    few = sharding.Store(spark, str(tmp_path / "few"))
    small = docs.limit(9).coalesce(1)
    assert few.append(small, 4) == 1 and few.manifest().count() == 4 and few.compact(docs.schema) == 2 and few.manifest().count() == 1
    none = sharding.Store(spark, str(tmp_path / "none"))
    assert none.append(empty) == 1 and none.compact(empty.schema) == 1 and none.rows(empty.schema).count() == 0


# common parts


def test_words_match_the_patterns(rows):
    column = pa.array([t for _, t, *_ in rows])
    data, offsets = tokens.buffers(column)
    for kind, fold, pattern in ((tokens.BLANK_SPLIT, False, BLANK), (tokens.BLANK_SPLIT, True, BLANK), (tokens.ALNUM, True, ALNUM)):
        same = {}
        for i, j in tokens.slices(offsets, 2000):
            w = tokens.words(data, offsets, i, j, kind, fold)
            raw = w.data.tobytes()
            for r in range(j - i):
                t = rows[i + r][1] or ""
                own = [raw[a:b].decode() for a, b in zip(w.start[w.first[r] : w.first[r + 1]], w.end[w.first[r] : w.first[r + 1]])]
                assert [x.translate(FOLD) if fold else x for x in own] == pattern.findall(t.translate(FOLD) if fold else t)
                for x, h in zip(own, w.hash[w.first[r] : w.first[r + 1]].tolist()):
                    assert same.setdefault(x.translate(FOLD) if fold else x, h) == h
        assert len(set(same.values())) == len(same)


def test_packed_keys():
    for x in ([], [5], [-(1 << 63), (1 << 63) - 1, 0], [7, 7, 9]):
        assert unpack_keys(pack_keys(np.array(x, np.int64))).tolist() == x
