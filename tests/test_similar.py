"""Near duplicates, nearest vectors and dense groups against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.operators import dense, near, neighbours
from siltstone.plans import registry
from siltstone.sources.tables import Folder


def texts():
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(400)]
    rows = [None, "", " \n ", "one two", "One  TWO", "a b c d e f g h i j", "a b c d e f g h i j k"]
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 200))]
        for copy in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(copy * len(base) // 160):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append(" ".join(own))
    drift = [rng.choice(vocab) for _ in range(150)]
    for k in range(20):  # each like the next, the last unlike the first
        drift[7 * k : 7 * k + 3] = [f"new{k}", "x", "y"]
        rows.append(" ".join(drift))
    return rows + [rows[10].upper()] * 5 + ["the " * 3000, " ".join(rng.choice(vocab) for _ in range(9000))]


def brute(rows, least):
    """doc: (words, shingles, class, component) by comparing every two."""
    sets, words = {}, {}
    for d, t, lang in rows:
        w = (t or "").lower().split()
        words[d] = len(w)
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} - {()}
    langs = {d: lang for d, _, lang in rows}
    fit = [d for d in sorted(sets) if words[d] >= max(1, least)]
    root = {d: d for d in fit}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first, links = {}, 0
    for i, a in enumerate(fit):
        for b in fit[:i]:
            if langs[a] == langs[b]:
                both = len(sets[a] & sets[b])
                if both >= 0.75 * (len(sets[a]) + len(sets[b]) - both):
                    links += 1
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
                if sets[a] == sets[b]:
                    first.setdefault(a, b)
    return {d: (words[d], len(sets[d]), d in root, first.get(d, d) if d in root else None, find(d) if d in root else None) for d in sets}, links


@pytest.mark.parametrize("least,block", [(10, 2048), (0, 3)])
def test_near_duplicates(spark, least, block):
    """Copies, chains, null, empty, short and long texts, languages apart, null keys, clashing columns."""
    rows = [(k * 2, t, "en" if k % 23 else None) for k, t in enumerate(texts())]
    wide = [(*r, "x", 1, 2, "y") for r in rows] + [(None, "a b c d e f g h i j", "en", "x", 1, 2, "y")]
    docs = spark.createDataFrame(wide, "doc_id long, text string, lang string, key string, n long, own long, band string").repartition(3)
    got = near.duplicates(docs, Folder(spark, "t"), least=least, block=block).collect()
    want, links = brute(rows, least)
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(rows) and links > 60


def test_near_duplicates_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert near.duplicates(docs, Folder(spark, "t")).count() == 0


def test_stars_leave_no_link_out(spark):
    """Texts that share keys with a first text they are unlike are compared with each other, in blocks."""
    rng = np.random.default_rng(3)
    short = rng.integers(0, 256, (40, near.HASHES), dtype=np.uint8)
    short[20:] = short[:20]
    short[20:, :20] += 1
    rows = [(7, k, k % 20 if k < 30 else 100 + k, short[k].tobytes()) for k in range(40)]
    for block in (3, 100):
        got = near.across(spark.createDataFrame(rows, "band long, node long, component long, short binary"), block)
        assert {tuple(r) for r in got.collect()} == {(k - 20, k) for k in range(30, 40)}


def test_recall_of_bands(spark, sf):
    """Of the pairs that an exact join finds, at least 0.9 are candidates of the keys alone."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["key"]: r for r in near.signed(docs, "doc_id", "text", [], 10).filter("sames is not null").collect()}
    own = near.sets(docs, "doc_id", "text", docs.select(F.col("doc_id").alias("key"))).collect()
    sets = {r["key"]: set(np.frombuffer(r["own"], np.uint64).tolist()) for r in own if r["key"] in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])]
    found = sum(bool({*rows[a]["bands"]} & {*rows[b]["bands"]}) for a, b in pairs)
    assert pairs and found >= 0.9 * len(pairs)


def test_generator_follows_the_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    own = near.profile(docs)
    assert own["texts"] == docs.count() and 0 <= own["copies"] < 1 and near.generator(own) == "trigrams"
    large = {"texts": 10**6, "words": 300.0, "copies": 0.2}
    assert near.generator(large) == "minhash" and near.generator(large | {"copies": 0.01}) == "simhash" and near.generator(large | {"words": 3.0}) == "trigrams"
    assert near.generator({"texts": 0, "words": 0.0, "copies": 0.0}) == "trigrams"


def vectors(n=300, d=24):
    rng = np.random.default_rng(9)
    x = np.concatenate([c + rng.normal(0, 0.25, (n // 4, d)) for c in rng.normal(size=(4, d))]).astype(np.float32).tolist()
    odd = [None, [], [0.0] * d, [1.0] * (d - 1), [None] + [1.0] * (d - 1), [float("nan")] * d, [float("inf")] + [0.0] * (d - 1)]
    return [(k, v, 1, "r", 2) for k, v in enumerate(x + odd + x[:3] * 20)] + [(None, x[0], 1, "r", 2)]


SCHEMA = "vec_id long, embedding array<float>, rank int, rep string, copies int"


def test_nearest(spark):
    """Recall over 0.9 by brute force over classes; cosines and copies are exact; buckets are cut without loss."""
    rows = vectors()
    good = [(k, np.array(v, float)) for k, v, *_ in rows if k is not None and v is not None and len(v) == 24 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    first = {}
    for k, v in good:
        first.setdefault(v.tobytes(), [k, v / np.linalg.norm(v), 0])[2] += 1
    reps = {r: (u, n) for r, u, n in first.values()}
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for part in (8192, 5):
        got = neighbours.nearest(table, Folder(spark, "t"), 6, F.col("key") % 5 == 0, part=part).collect()
        by = {}
        for r in got:
            by.setdefault(r["vec_id"], []).append(r)
        assert set(by) == {k for k, _ in good if k % 5 == 0}
        hits = wanted = 0
        for k, v in good:
            if k % 5 == 0:
                own = first[v.tobytes()][0]
                like = sorted(((round(float(u @ (v / np.linalg.norm(v))), 12), -r) for r, (u, _) in reps.items() if r != own), reverse=True)[:6]
                hits += len({-r for _, r in like} & {r["neighbour"] for r in by[k]})
                wanted += 6
                for r in by[k]:
                    u, n = reps[r["neighbour"]]
                    assert r["copies"] == n and abs(r["cosine"] - u @ (v / np.linalg.norm(v))) < 1e-6
                assert [r["rank"] for r in sorted(by[k], key=lambda r: (-r["cosine"], r["neighbour"]))] == list(range(1, len(by[k]) + 1))
        assert hits >= 0.9 * wanted


def test_probes_are_the_nearest_codes():
    index = neighbours.Index(np.random.default_rng(0).normal(size=(2, 6, 5)), 9)
    sides = index.sides(np.random.default_rng(1).normal(size=(4, 5)))
    own, probed = index.codes(sides), index.probed(sides)
    for i in range(4):
        for t in range(2):
            cost = {m: sum(sides[i, t, b] ** 2 for b in range(6) if m >> b & 1) for m in range(64)}
            assert sorted(probed[i, t]) == sorted(int(own[i, t]) ^ m for m in sorted(cost, key=cost.get)[:9]) and probed.shape == (4, 2, 9)


def test_registered_recall(spark, sf):
    got = registry.QUERIES["x38_nearest_vectors"](spark, sf).toPandas()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.stack(table["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = table["vec_id"].to_numpy()
    hits = []
    for i in np.flatnonzero(ids % 50 == 0):
        like = x @ x[i]
        like[i] = -2
        hits.append(len({*ids[np.argsort(-like)[:10]]} & {*got[got["vec_id"] == ids[i]]["neighbour"]}) / 10)
    assert len(hits) == 10 and np.mean(hits) >= 0.9


def test_no_vectors(spark):
    table = spark.createDataFrame([(1, None, 1, "r", 2)], SCHEMA)
    assert neighbours.nearest(table, Folder(spark, "t")).count() == 0
    assert dense.clustered(table, Folder(spark, "t")).count() == 0


def plain(x, least, members):
    """HDBSCAN over all pairs of points, by cutting at each weight: set of clusters."""
    n = len(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.maximum(1 - np.round(u @ u.T, 12), 0)
    np.fill_diagonal(d, np.inf)
    core = np.sort(d, 1)[:, least - 1]
    w = np.maximum(d, np.maximum(core[:, None], core[None, :]))

    def parts(nodes, cut):
        left, out = set(nodes), []
        while left:
            todo = [left.pop()]
            own = set(todo)
            while todo:
                i = todo.pop()
                new = {j for j in left if w[i, j] <= cut}
                left -= new
                own |= new
                todo += new
            out.append(frozenset(own))
        return out

    def best(nodes, birth, cuts):
        """Stability of a cluster and the clusters chosen in it."""
        stability, alive = 0.0, nodes
        for k in range(len(cuts) - 1, -1, -1):
            below = [p for p in parts(alive, cuts[k - 1])] if k else []
            big = [p for p in below if len(p) >= members]
            if len(big) == 1:
                stability += (len(alive) - len(big[0])) * (1 / cuts[k] - birth)
                alive = big[0]
                continue
            stability += len(alive) * (1 / cuts[k] - birth)
            inner = [best(p, 1 / cuts[k], cuts[:k]) for p in big]
            total = sum(s for s, _ in inner)
            return (stability, [nodes]) if stability >= total else (total, [c for _, cs in inner for c in cs])
        return stability, [nodes]

    tree, seen = [], {0}
    while len(seen) < n:
        i, j = min(((i, j) for i in seen for j in range(n) if j not in seen), key=lambda e: w[e])
        seen.add(j)
        tree.append(w[i, j])
    cuts = sorted(set(tree))
    out = []
    for root in parts(range(n), cuts[-1]):
        alive = root
        for k in range(len(cuts) - 1, 0, -1):  # the root itself is never chosen
            big = [p for p in parts(alive, cuts[k - 1]) if len(p) >= members]
            if len(big) != 1:
                out += [c for p in big for c in best(p, 1 / cuts[k], cuts[:k])[1]]
                break
            alive = big[0]
    return {c for c in out}


@pytest.mark.parametrize("seed", [1, 2])
def test_dense_clusters(spark, seed):
    """Against cutting the whole graph of all pairs at each weight."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(1, 6)) * 3 + rng.normal(0, s, (14, 6)) for s in (0.3, 0.5, 0.2)] + [rng.normal(size=(8, 6)) * 3])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    like = np.round(u @ u.T, 12)
    rows = [(i, r + 1, int(j), float(max(1 - like[i, j], 0))) for i in range(len(x)) for r, j in enumerate([j for j in np.argsort(-like[i], kind="stable") if j != i])]
    graph = spark.createDataFrame(rows, "node long, rank int, other long, distance double")
    nodes = spark.createDataFrame([(i, 1) for i in range(len(x))], "node long, copies long")
    got = dense.clusters_of(graph, nodes, Folder(spark, "t"), least=3, members=5, most_levels=100).collect()
    groups = {}
    for r in got:
        if r["cluster"] is not None:
            groups.setdefault(r["cluster"], set()).add(r["node"])
    want = plain(x, 3, 5)
    assert {frozenset(g) for g in groups.values()} == want and len(want) >= 2 and all(min(g) == c for c, g in groups.items()) and len(got) == len(x)


def test_forest_is_minimal(spark):
    """Boruvka's rounds against Kruskal's, with ties, in two parts."""
    rng = random.Random(4)
    links = sorted({(*sorted(rng.sample(range(40), 2)),) for _ in range(150)} | {(a + 100, b + 100) for a in range(8) for b in range(a)})
    links = [(min(a, b), max(a, b), float(rng.randint(1, 9))) for a, b in links]
    got = [tuple(r) for r in dense.forest(spark.createDataFrame(links, "a long, b long, weight double"), Folder(spark, "t")).collect()]
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    total, n = 0.0, 0
    for a, b, w in sorted(links, key=lambda e: (e[2], e[0], e[1])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            total, n = total + w, n + 1
    assert len(got) == len(set(got)) == n and sum(w for _, _, w in got) == total


def test_vectors_without_structure_go_to_parts_once(spark):
    """Where probing would compare all vectors, each goes to all parts instead: fewer rows, and exact."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 24))
    own = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "rep long, vector array<double>, copies long")
    index = neighbours.fit(own, 5, fill=128)
    assert len(index.planes) * index.probes == 1
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    like = np.round(unit @ unit.T, 12)
    np.fill_diagonal(like, -2)
    want = {(a, int(b)) for a in range(0, 1200, 50) for b in np.argsort(-like[a], kind="stable")[:5]}
    got = neighbours.nearest(own, Folder(spark, "n"), 5, F.col("key") % 50 == 0, key="rep", column="vector", index=index, part=500)
    assert {(r["rep"], r["neighbour"]) for r in got.collect()} == want


def test_words_and_groups_cost_no_call_of_their_own(spark):
    words = pa.array(["a", "b", "ab", "ba", "é", "aé", "", "x" * 5000, "x" * 5001, "a\x00"], pa.large_string())
    assert len(set(near.hashed(words).tolist())) == len(words) and (near.hashed(words.slice(2, 3)) == near.hashed(words)[2:5]).all()
    rows = spark.createDataFrame([(1, 1, 1, bytes(near.HASHES)), (1, 2, 2, bytes(near.HASHES))], "band long, node long, component long, short binary")
    assert "FlatMapGroups" not in near.across(rows)._jdf.queryExecution().executedPlan().toString()


def clusters_by(got) -> dict:
    groups = {}
    for r in got:
        if r["cluster"] is not None:
            groups.setdefault(r["cluster"], set()).add(r["node"])
    return groups


@pytest.mark.parametrize("seed", [3, 5])
def test_every_weight_is_a_level(spark, seed):
    """More weights than are looked at at once, with nothing set apart, against cutting at each weight."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(1, 6)) * 3 + rng.normal(0, s, (14, 6)) for s in (0.1, 0.5, 0.2, 0.4)] + [rng.normal(size=(14, 6)) * 3])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    like = np.round(u @ u.T, 12)
    rows = [(i, r + 1, int(j), float(max(1 - like[i, j], 0))) for i in range(len(x)) for r, j in enumerate([j for j in np.argsort(-like[i], kind="stable") if j != i])]
    graph = spark.createDataFrame(rows, "node long, rank int, other long, distance double")
    nodes = spark.createDataFrame([(i, 1) for i in range(len(x))], "node long, copies long")
    groups = clusters_by(dense.clusters_of(graph, nodes, Folder(spark, "t"), least=3).collect())
    assert {frozenset(g) for g in groups.values()} == plain(x, 3, 5) and all(min(g) == c for c, g in groups.items())


def test_bands_lose_no_level(spark):
    """Bands of few edges, and one weight with more edges than a band has, give what one band gives; copies from 0 on, ties, a vector alone."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4, 4))[rng.integers(0, 4, 60)] * 2 + rng.normal(0, 0.4, (60, 4)) * rng.choice([0.2, 1, 2], 60)[:, None]
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) * 4) / 4 + 0.25
    np.fill_diagonal(d, np.inf)
    graph = spark.createDataFrame([(i, r + 1, int(j), float(d[i, j])) for i in range(60) for r, j in enumerate(np.argsort(d[i], kind="stable")[:6])], "node long, rank int, other long, distance double")
    nodes = spark.createDataFrame([(i, int(c)) for i, c in enumerate(rng.choice([0, 1, 1, 1, 2, 7], 60))] + [(99, 9)], "node long, copies long")
    folder = Folder(spark, "t")
    tree = folder.save(dense.forest(dense.edges(graph, 3), folder), "tree")
    first, most = tree.selectExpr("min(weight)").first()[0], max(r["count"] for r in tree.groupBy("weight").count().collect())
    seen, given = set(), []
    for part, at_once in ((2048, 24), (4, 2)):
        own = Folder(spark, "t")
        rows, ports, single = dense.bands(tree, nodes, at_once, part, own)
        sizes = {r["band"]: (r["n"], r["kinds"]) for r in rows.groupBy("band").agg(F.count("*").alias("n"), F.countDistinct("weight").alias("kinds")).collect()}
        assert all(n <= part or kinds == 1 for n, kinds in sizes.values()) and {b for b, (n, _) in sizes.items() if n > part} == set(single)
        seen.add((len(sizes) > 1, len(single) > 0))
        points, found = dense.condensed(rows, ports, single, 4, first, own)
        named = {r["node"]: r["cluster"] for r in points.collect()}
        groups = {}
        for node, cluster in named.items():
            groups.setdefault(cluster, set()).add(node)
        known = {r["cluster"]: r for r in found.collect()}
        given.append({frozenset(groups[c]): (frozenset(groups.get(r["parent"], ())), r["shut"], r["shut"] and round(r["stability"], 9)) for c, r in known.items() if c in groups})
    assert most > 4 and seen == {(False, False), (True, True)} and given[0] == given[1] and len(given[0]) > 3


def test_long_chains_of_clusters_are_folded(spark):
    """A tree of clusters that no task may hold, as deep as it is long, against adding up from below."""
    rng = random.Random(2)
    parent = {f"c{k}": f"c{k + 1}" for k in range(14)} | {"c14": None} | {f"l{k}": f"c{k}" for k in range(0, 15, 3)} | {"a": None}
    stability = {c: float(rng.randint(0, 9)) for c in parent}

    def best(c):
        return max(stability[c], below(c))

    def below(c):
        return sum(best(p) for p in parent if parent[p] == c)

    clusters = spark.createDataFrame([(c, p, stability[c], 1.0) for c, p in parent.items()], "cluster string, parent string, stability double, shut double")
    assert dict(dense.excess(clusters, 2, Folder(spark, "t")).select("cluster", "best").collect()) == {c: best(c) for c in parent}

    def outermost(c):
        up = [c]
        while parent[up[-1]]:
            up.append(parent[up[-1]])
        return next((x for x in reversed(up) if parent[x] and stability[x] >= below(x)), None)

    want = {c: outermost(c) for c in parent if outermost(c)}
    assert dict(dense.chosen(clusters, 100, Folder(spark, "t")).collect()) == want and len(set(want.values())) > 1
