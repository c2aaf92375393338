"""Corpus operators over whole tables: every text teaches, every source is mixed by itself, every link is kept."""

import numpy as np


def test_every_window_teaches(spark):
    """No text is passed over, whatever its key, length or row, and the experts differ from the start."""
    from siltstone.llm import lm
    from siltstone.llm.packed import pack_keys

    size, v = 40, 41
    unigram = np.full(v, 1 / v)
    further = np.arange(1.0, v + 1) / np.arange(1.0, v + 1).sum()

    def table(texts):
        rows = [(pack_keys(np.array(t, np.int64)), pack_keys(np.array([len(t)], np.int64))) for t in texts]
        return spark.createDataFrame(rows, "ids binary, counts binary").coalesce(1)

    texts = [[k] * 5 + [k + 20] * 5 for k in range(20)]
    slices = table(texts)
    began = lm.start(slices, size, unigram, further)
    assert np.abs(began.experts[0] - began.experts[1]).max() > 0.01 and (began.experts[-1] == further).all()
    model = lm.refine(slices, began, size, unigram)
    # what the experts have of each id, in all, is how often it occurs: the sums miss no window
    more = lm.refine(table(texts + [[3] * 200]), began, size, unigram)
    assert (model.profile[:size].sum(1) > 0).all() and not np.allclose(model.experts[:, 3], more.experts[:, 3])
    seen = []
    refined = lm.refined
    lm.refined = lambda m, sums, u: seen.append(sums.sum(0)) or refined(m, sums, u)
    try:
        lm.refine(slices, began, size, unigram)
    finally:
        lm.refined = refined
    assert np.allclose(seen[0], np.r_[np.full(size, 5.0), 20.0], rtol=1e-3)


def test_goings_on_against_brute_force(spark, monkeypatch):
    """rest_score is that of all training counts, whether words are in the table that tasks have or meet their documents."""
    from collections import Counter

    from siltstone.llm import lm
    from siltstone.llm.work import Work

    rows = [(k, " ".join(["believe", "Believers", f"rare{k % 17}", "zzyzx" * (k % 3), "x" * (k % 5 * 90)]), k % 4 > 0) for k in range(60)] + [(60, None, True), (61, "", False), (62, "unseen believes rarest", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, teaches boolean")
    got = []
    for table in (1 << 19, 4):
        monkeypatch.setattr(lm, "TABLE", table)
        out = lm.score(docs, docs["teaches"], Work(spark, "t"))
        got.append({r["doc_id"]: r for r in out.collect()})
    words = {k: (t or "").lower().split() for k, t, _ in rows}
    model, _, _ = lm.train(docs.filter("teaches"), Work(spark, "tm"))
    v = model.vocabulary
    counts = Counter(w for k, _, teaches in rows if teaches for w in words[k])
    ids = {w: v.word(w.encode()) for own in words.values() for w in own}
    total, kinds = Counter(), Counter()
    for w, c in counts.items():
        total[ids[w][0]] += c
        kinds[ids[w][0]] += 1

    def goes_on(own):
        """What the further ids of a text's words get: attention's shares of them, mixed with the words' counts."""
        flat = np.array([x for w in own for x in ids[w]], np.int64)
        logs, at, out = model.logs(flat, np.array([len(flat)])), 0, 0.0
        for w in own:
            spelled, first = logs[at + 1 : at + len(ids[w])].sum(), ids[w][0]
            at += len(ids[w])
            t, k = total[first], kinds[first]
            out += np.log10((counts[w] + k * 10.0**spelled) / (t + k)) if counts[w] else spelled + (np.log10(k / (t + k)) if k else 0)
        return out

    for own in got:
        assert len(own) == len(rows)
        for k, t in words.items():
            assert abs(own[k]["rest_score"] - goes_on(t)) < 1e-4 * (1 + len(t)) + 1e-5 * abs(own[k]["rest_score"])
    assert all(abs(got[0][k]["score"] - got[1][k]["score"]) < 1e-3 for k in words)
    assert any(c > 1 for c in kinds.values()) and any(not counts[w] for own in words.values() for w in own)


def lag(units, weights):
    """The most that a source is before or after the fluid mix of the exact weights, in units; the fluid mix is made slot by slot."""
    from fractions import Fraction

    from siltstone.llm import mixing

    plan = mixing.Plan(units, weights)
    at = [plan.slots(k, np.arange(n)) for k, n in enumerate(units)]
    assert (np.sort(np.concatenate(at)) == np.arange(sum(units))).all() and all((np.diff(a) > 0).all() for a in at)
    had = [np.cumsum(np.bincount(a, minlength=sum(units))) for a in at]
    own, left, most = [Fraction(w) for w in weights], [Fraction(n) for n in units], 0
    for t in range(sum(units)):
        room = Fraction(1)
        while room:  # all that are left are served by weight until one ends
            rate = sum(w for w, n in zip(own, left) if n)
            time = min([room / rate, *(n / w for w, n in zip(own, left) if n)])
            left = [n - w * time if n else n for w, n in zip(own, left)]
            room -= time * rate
        most = max(most, *(abs(int(h[t]) - (n - rest)) for h, n, rest in zip(had, units, left)))
    return most


def test_mix_keeps_to_the_given_weights(monkeypatch):
    """Less than one block, two units, from the exact weights at every slot: with one period and with many, for small weights, ends of sources, and many sources."""
    from siltstone.llm import mixing

    rng = np.random.default_rng(11)
    for period in (1, 3, 16, 1 << 12):
        monkeypatch.setattr(mixing, "PERIOD", period)
        for _ in range(12):
            n = rng.integers(1, 9)
            units = [int(x) for x in rng.integers(1, rng.choice([3, 60]), n)]
            assert lag(units, [float(rng.choice([rng.random(), 1e-9 + 1e-4 * rng.random(), 1.0])) for _ in units]) < 2
    monkeypatch.setattr(mixing, "PERIOD", 1)
    assert lag([200, *[3] * 60], [0.5, 1e-5, *[0.49999 / 59] * 59]) < 2


def test_mix_of_a_hundred_terabytes_is_planned_in_bounds():
    """3.2 billion units: the plan's size is that of its periods, and units far in have their own slots, in order."""
    from siltstone.llm import mixing

    units = [400_000_000 + 7 * k for k in range(8)]
    plan = mixing.Plan(units, [0.5, 0.2, 0.1, 0.1, 0.05, 0.03, 0.019, 0.001])
    assert len(plan.cuts) <= mixing.PERIODS + 1 + 2 * len(units) and plan.up.nbytes <= len(plan.cuts)
    at = plan.slots(1, np.arange(100_000_000, 100_000_500))
    assert (np.diff(at) > 0).all() and abs(at - (np.arange(100_000_000, 100_000_500) / 0.2)).max() < 2 / 0.2 + 2


def test_every_source_is_mixed_by_itself(spark):
    from siltstone.llm import mixing

    rows = [(k, "x" * 900, f"s{k % 250}" if k % 251 else None) for k in range(1000)]
    placed, total = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=500)
    got = placed.select("row.source", "pool", "slot").collect()
    assert len(got) == 1000 and all(r["pool"] == (r["source"] or mixing.POOL) and 0 <= r["slot"] < total for r in got)


def test_all_links_of_a_family(spark):
    """Every two linked documents, also of one component, against brute force."""
    from siltstone.llm import ngram_join
    from siltstone.llm.work import Work

    rng = np.random.default_rng(5)
    texts = []
    for family in range(4):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for copy in range(9):
            own = list(base)
            for at in rng.integers(0, 120, copy // 2):
                own[at] = f"edit{rng.integers(0, 10**6)}"
            texts.append(" ".join(own))
    texts += [texts[3], "a b", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    join = ngram_join.Join(docs, Work(spark, "t4"))
    links = join.all_links()
    sets = {d: {tuple((t or "").split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))} - {()} for d, t in enumerate(texts)}
    reps = {r["doc_id"]: r["rep"] for r in join.members.collect()}
    linked = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    want = {(a, b): o for (a, b), o in linked.items() if reps[a] == a and reps[b] == b and sets[a] != sets[b]}
    assert {(r["a"], r["b"]): r["o"] for r in links.collect()} == want
    assert len(want) > join.links.distinct().count()
    assert dict(join.degrees(links).collect()) == {d: sum(d in p for p in linked) for d in sets}
