"""Density clusters (HDBSCAN) over a neighbour graph, as joins.

Core distances come from the graph: how far a vector's LEAST-th neighbour is. An edge weighs the most of its length and
both ends' core distances. A minimum spanning forest is found by Boruvka's rounds: each component takes its least edge out,
and what they link becomes one. Every weight of the forest is a level. Its edges are cut by weight into bands of at most PART,
where components of all cuts are found at once, in one graph of (vector, cut); a band's edges then link components of the
cut below it, so a task goes through the levels of its band by itself. Bands that are still too large are cut again; where one
weight alone has more edges, its components are met by joins. What a band begins, goes on with and ends is put together by
links from band to band. How long each cluster stays and which of a branch is chosen by the excess of mass is found on the tree of
clusters, from which leaves are taken off and chains are folded until a task can hold it.

Defined results: vectors of no chosen cluster are outliers, with a null cluster; a tree's root is never chosen, so one even
cloud has no clusters; equal vectors stand in one class and are counted with its copies; ties of weight go by the edge's
ends; what `neighbours` leaves out isn't in the result. Tables without rows give none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.operators import evidence, neighbours
from siltstone.sources.tables import Folder

#: Neighbours that make a core, and members that make a cluster.
LEAST = 5
#: Cuts between bands that are looked at at once.
LEVELS = 24
#: Edges of a band, and clusters, that meet in one task.
PART = 16384
_TINY = 1e-12


def edges(graph: DataFrame, least: int) -> DataFrame:
    """a, b, weight of a neighbour graph (node, rank, other, distance): mutual reachability, each edge once."""
    core = graph.filter(F.col("rank") <= least).groupBy("node").agg(F.max("distance").alias("core"))
    both = graph.join(core, "node").join(core.select(F.col("node").alias("other"), F.col("core").alias("far")), "other", "left")
    rows = both.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), F.greatest("distance", "core", "far").alias("weight"))
    return rows.groupBy("a", "b").agg(F.min("weight").alias("weight"))


def forest(links: DataFrame, folder: Folder) -> DataFrame:
    """The minimum spanning forest's edges (a, b, weight), by Boruvka's rounds; a component at least halves their number in each."""
    links, turn, chosen = folder.save(links, "links"), 0, None
    out = links.select("a", "b", "weight", F.col("a").alias("u"), F.col("b").alias("v"))  # u, v: the components of the ends
    while True:
        side = out.select(F.col("u").alias("c"), F.struct("weight", "a", "b", "u", "v").alias("e")).union(out.select(F.col("v"), F.struct("weight", "a", "b", "u", "v")))
        taken = folder.save(side.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct(), f"taken-{turn}")
        if taken.isEmpty():
            return chosen if chosen is not None else links
        found = taken.select("a", "b", "weight")
        chosen = found if chosen is None else chosen.unionByName(found)
        label = evidence.components(taken.select(F.col("u").alias("a"), F.col("v").alias("b")), folder.path)
        ends = out.join(label.select(F.col("node").alias("u"), F.col("component").alias("x")), "u", "left").join(label.select(F.col("node").alias("v"), F.col("component").alias("y")), "v", "left")
        moved = ends.select("a", "b", "weight", F.coalesce("x", "u").alias("u"), F.coalesce("y", "v").alias("v")).filter("u != v")
        out, turn = folder.save(moved, f"out-{turn}"), turn + 1


def _cuts(least: float, most: float, n: int, quantiles: list[float], part: int) -> list[float]:
    """Weights that end a band: some quantiles, each below the greatest weight; one that comes twice has a band of its own."""
    wanted = math.ceil(n / part)
    if wanted <= len(quantiles):
        quantiles = [quantiles[k * len(quantiles) // wanted] for k in range(1, wanted)]
    out = {q if q < most else math.nextafter(most, -math.inf) for q in quantiles}
    out |= {math.nextafter(q, -math.inf) for q in quantiles if quantiles.count(q) > 1 and q > least}
    return sorted(out)


def bands(tree: DataFrame, nodes: DataFrame, most_levels: int, part: int, folder: Folder) -> tuple[DataFrame, DataFrame, list[int]]:
    """Edges (band, u, v, weight), the ports they link (band, name, size), and the bands of one weight with more than `part` edges.

    Bands rise with weight, and equal weights are in one. A port is a component of all lighter edges, named by its least node.
    """
    rows = folder.save(tree.select(F.lit(0).cast("long").alias("band"), F.col("a").alias("u"), F.col("b").alias("v"), "weight"), "edges-0")
    held = nodes.select(F.lit(0).cast("long").alias("band"), F.col("node").alias("name"), F.col("copies").alias("size"))
    wide, turn = 2 * most_levels + 2, 0
    shares = F.array(*[F.lit((k + 1) / (most_levels + 1)) for k in range(most_levels)])
    while True:
        # as many rows as there are bands
        full = rows.groupBy("band").agg(F.count("*").alias("n"), F.min("weight").alias("least"), F.max("weight").alias("most"), F.percentile_approx("weight", shares).alias("q")).filter(F.col("n") > part).collect()
        cuts = [(r["band"], _cuts(r["least"], r["most"], r["n"], r["q"], part)) for r in full if r["least"] < r["most"]]
        if not cuts:
            ends = rows.select("band", F.col("u").alias("name")).union(rows.select("band", "v")).distinct()
            return rows, folder.save(ends.join(held, ["band", "name"]), "ports"), [r["band"] for r in full]
        turn += 1
        table = F.broadcast(rows.sparkSession.createDataFrame(cuts, "band long, cuts array<double>"))
        at = rows.join(table, "band", "left").withColumn("sub", F.coalesce(F.array_size(F.filter("cuts", lambda c: c < F.col("weight"))), F.lit(0)))
        at = folder.save(at.withColumn("n", F.coalesce(F.array_size("cuts"), F.lit(0))).drop("cuts"), f"cut-{turn}")
        each = at.filter("sub < n").withColumn("sub", F.explode(F.sequence(F.col("sub"), F.col("n") - 1)))
        found = evidence.components(each.select(F.struct("band", "sub", F.col("u").alias("name")).alias("a"), F.struct("band", "sub", F.col("v").alias("name")).alias("b")), folder.path)
        # the components below a band are those of the cut before it
        label = folder.save(found.select(F.col("node.band").alias("band"), (F.col("node.sub") + 1).alias("sub"), F.col("node.name").alias("name"), F.col("component.name").alias("to")), f"label-{turn}")
        one, two = (label.select("band", "sub", F.col("name").alias(c), F.col("to").alias(f"{c}_")) for c in ("u", "v"))
        moved = at.join(one, ["band", "sub", "u"], "left").join(two, ["band", "sub", "v"], "left")
        own = F.col("band") * wide + F.col("sub")
        rows = folder.save(moved.select(own.alias("band"), F.coalesce("u_", "u").alias("u"), F.coalesce("v_", "v").alias("v"), "weight", F.col("band").alias("was")), f"edges-{turn}")
        sums = label.join(held, ["band", "name"]).groupBy(own.alias("band"), F.col("to").alias("name")).agg(F.sum("size").alias("sum"))
        ends = rows.select("band", "was", F.col("u").alias("name")).union(rows.select("band", "was", "v")).distinct()
        before = held.select(F.col("band").alias("was"), "name", "size")
        held = folder.save(ends.join(sums, ["band", "name"], "left").join(before, ["was", "name"], "left").select("band", "name", F.coalesce("sum", "size").alias("size")), f"held-{turn}")
        rows = rows.drop("was")


def _density(weight: Column) -> Column:
    return 1 / F.greatest(weight, F.lit(_TINY))


def _spans(kind: str) -> str:
    """What a band does with a port, or begins: a span of a cluster's life, or a port too small for one.

    A span (at, name) goes from weight `low` to `high`, where it has `size`; `area` is the sum of its size over density. It either
    is shut at a weight, `into` the span it is a part of, or goes on as `top`. A small port ends in a span `into`, or goes on as `top`.
    """
    return f"band long, at int, name {kind}, span boolean, low double, high double, size long, area double, shut double, top {kind}, into_at int, into {kind}"


def walk(members: int, first: float, kind: str):
    """Goes through a band's edges (band, u, v, weight, n_u, n_v, new_u, new_v) by weight; equal weights at once."""

    def density(w):
        return 1 / max(w, _TINY)

    def task(group: pa.Table) -> pa.Table:
        group = group.sort_by("weight")
        n = group.num_rows
        names, at = np.unique(np.concatenate([group[c].to_numpy() for c in ("u", "v")]), return_inverse=True)
        ends, weight = at.reshape(-1).tolist(), group["weight"].to_pylist()
        size, new = [0] * len(names), [False] * len(names)
        for k, s, f in zip(ends, group["n_u"].to_pylist() + group["n_v"].to_pylist(), group["new_u"].to_pylist() + group["new_v"].to_pylist()):
            size[k], new[k] = s, f
        root, own, loose, spans, small = list(range(len(names))), [None] * len(names), [[k] for k in range(len(names))], [], []

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def grown(span, w):
            span["area"] += span["size"] * (density(span["high"]) - density(w))
            span["high"] = w
            return span

        def begun(at, name, w, size):
            spans.append({"at": at, "name": name, "low": w, "high": w, "size": size, "area": 0.0, "shut": None, "top": None, "into_at": None, "into": None})
            return spans[-1]

        i = born = 0
        while i < n:
            w, j = weight[i], i
            while j < n and weight[j] == w:
                j += 1
            parts = {find(k) for e in range(i, j) for k in (ends[e], ends[n + e])}
            for e in range(i, j):
                x, y = sorted((find(ends[e]), find(ends[n + e])))
                root[y] = x
            wholes: dict[int, list[int]] = {}
            for k in parts:
                wholes.setdefault(find(k), []).append(k)
            for top, some in wholes.items():
                for k in some:
                    # a vector of many copies counts from the least weight on
                    if own[k] is None and size[k] >= members and not (new[k] and w == first):
                        own[k] = begun(0, k, first if new[k] else w, size[k])
                big = [own[k] for k in some if own[k] is not None]
                rest = sorted((loose[k] for k in some if own[k] is None), key=len, reverse=True)
                size[top] = sum(size[k] for k in some)
                if size[top] < members:
                    loose[top] = rest[0]
                    for more in rest[1:]:
                        rest[0].extend(more)
                    continue
                if len(big) == 1:
                    span = grown(big[0], w)
                    span["size"] = size[top]
                else:
                    born += 1
                    span = begun(born, top, w, size[top])
                    for part in big:
                        grown(part, w).update(shut=w, into_at=born, into=top)
                small += [(k, None, span["at"], span["name"]) for more in rest for k in more]
                own[top], loose[top] = span, []
            i = j
        for k in range(len(names)):
            if root[k] == k and own[k] is not None:
                own[k]["top"] = k
            elif root[k] == k:
                small += [(m, k, None, None) for m in loose[k]]

        def named(some):
            return pa.array([None if k is None else names[k] for k in some], group.schema.field("u").type)

        none = [None] * len(small)
        return pa.table({
            "band": pa.array([group["band"][0].as_py()] * (len(spans) + len(small)), pa.int64()),
            "at": pa.array([s["at"] for s in spans] + [0] * len(small), pa.int32()), "name": named([s["name"] for s in spans] + [s[0] for s in small]),
            "span": pa.array([True] * len(spans) + [False] * len(small), pa.bool_()),
            **{c: pa.array([s[c] for s in spans] + none, pa.int64() if c == "size" else pa.float64()) for c in ("low", "high", "size", "area", "shut")},
            "top": named([s["top"] for s in spans] + [s[1] for s in small]), "into_at": pa.array([s["into_at"] for s in spans] + [s[2] for s in small], pa.int32()), "into": named([s["into"] for s in spans] + [s[3] for s in small]),
        })

    return task


def flat(rows: DataFrame, ports: DataFrame, members: int, first: float, folder: Folder) -> DataFrame:
    """What `walk` gives, for bands of one weight (band, u, v, weight): each component's ports meet at once, however many. ports: band, name, size, new."""
    found = evidence.components(rows.select(F.struct("band", F.col("u").alias("name")).alias("a"), F.struct("band", F.col("v").alias("name")).alias("b")), folder.path)
    label = found.select("node.*", F.col("component.name").alias("whole")).join(F.broadcast(rows.groupBy("band").agg(F.first("weight").alias("w"))), "band")
    of = label.join(ports, ["band", "name"]).withColumn("big", (F.col("size") >= members) & ~(F.col("new") & (F.col("w") == first)))
    of = folder.save(of, "flat")
    whole = of.groupBy("band", "whole", "w").agg(F.sum("size").alias("total"), F.count_if("big").alias("n"), F.max(F.when(F.col("big"), F.col("name"))).alias("one"))
    each = of.join(whole.drop("w"), ["band", "whole"])
    alone = F.col("n") == 1
    none, zero = F.lit(None), F.lit(0)
    tall = F.when(F.col("big") & F.col("new"), F.col("size") * (_density(F.lit(first)) - _density(F.col("w")))).when(F.col("big"), 0.0)
    shut, goes_on = F.col("big") & ~alone, (F.col("total") < members) | (F.col("big") & alone)
    went = each.select(
        "band", zero.alias("at"), "name", F.col("big").alias("span"), F.when(F.col("big"), F.when(F.col("new"), F.lit(first)).otherwise(F.col("w"))).alias("low"), F.when(F.col("big"), F.col("w")).alias("high"),
        F.when(F.col("big"), F.when(alone, F.col("total")).otherwise(F.col("size"))).alias("size"), tall.alias("area"), F.when(shut, F.col("w")).alias("shut"), F.when(goes_on, F.col("whole")).alias("top"),
        F.when(~goes_on, F.when(alone, 0).otherwise(1)).alias("into_at"), F.when(~goes_on, F.when(alone, F.col("one")).otherwise(F.col("whole"))).alias("into"),
    )
    born = whole.filter((F.col("total") >= members) & ~alone).select("band", F.lit(1).alias("at"), F.col("whole").alias("name"), F.lit(True).alias("span"), F.col("w").alias("low"), F.col("w").alias("high"), F.col("total").alias("size"), F.lit(0.0).alias("area"), none.cast("double").alias("shut"), F.col("whole").alias("top"), none.cast("int").alias("into_at"), none.alias("into"))
    return went.union(born)


def ends(links: DataFrame, folder: Folder, name: str) -> DataFrame:
    """id, end of links (id, next), one for an id: what is reached by following them. Ways double in each round."""
    turn = 0
    links = folder.save(links.select("id", "next"), f"{name}-0")
    while True:
        turn += 1
        further = links.select(F.col("id").alias("next"), F.col("next").alias("beyond"))
        got = folder.save(links.join(further, "next", "left").select("id", F.coalesce("beyond", "next").alias("next"), F.col("beyond").isNotNull().alias("moved")), f"{name}-{turn}")
        links = got.select("id", "next")
        if got.filter("moved").isEmpty():
            return links.withColumnRenamed("next", "end")


def condensed(rows: DataFrame, ports: DataFrame, single: list[int], members: int, first: float, folder: Folder) -> tuple[DataFrame, DataFrame]:
    """Vectors (node, cluster) and clusters (cluster, parent, stability, shut: the weight it ends at) of what `bands` gives, where a vector has the least cluster."""
    name = Window.partitionBy("name").orderBy("band")
    ports = folder.save(ports.withColumn("new", F.lag("band").over(name).isNull()).withColumn("later", F.lead("band").over(name)), "occurrences")
    kind = ports.schema["name"].dataType.simpleString()
    one, two = (ports.select("band", F.col("name").alias(c), F.col("size").cast("long").alias(f"n_{c}"), F.col("new").alias(f"new_{c}")) for c in ("u", "v"))
    many = F.col("band").isin(single)
    edges = rows.filter(~many).join(one, ["band", "u"]).join(two, ["band", "v"]).select("band", "u", "v", "weight", "n_u", "n_v", "new_u", "new_v")
    got = edges.groupBy("band").applyInArrow(walk(members, first, kind), _spans(kind))
    if single:
        got = got.union(flat(rows.filter(many), ports.filter(many), members, first, folder))
    key = lambda *c: F.concat_ws(":", *c)
    later = ports.select("band", F.col("name").alias("top"), "later")
    got = got.join(later, ["band", "top"], "left").withColumn("id", key("band", "at", "name")).withColumn("whole", F.when(F.col("into").isNotNull(), key("band", "into_at", "into")))
    on = F.when(F.col("span") & F.col("shut").isNotNull(), None).otherwise(F.coalesce("whole", F.when(F.col("later").isNotNull(), key("later", F.lit(0), "top"))))
    got = folder.save(got.select("id", "span", "low", "high", "size", "area", "shut", F.when(F.col("span"), F.col("whole")).alias("whole"), on.alias("next")), "spans")
    end = ends(got.filter("next is not null"), folder, "ends")
    spans = got.filter("span")
    over = spans.select(F.col("id").alias("next"), F.col("low").alias("to"))
    spans = spans.join(over, "next", "left").withColumn("area", F.col("area") + F.when(F.col("to").isNotNull(), F.col("size") * (_density(F.col("high")) - _density(F.col("to")))).otherwise(0.0))
    own = spans.join(end, "id", "left").groupBy(F.coalesce("end", "id").alias("cluster")).agg(F.sum("area").alias("stability"), F.max("shut").alias("shut"), F.max("whole").alias("whole"))
    up = own.join(end.select(F.col("id").alias("whole"), F.col("end").alias("up")), "whole", "left")
    clusters = folder.save(up.select("cluster", F.coalesce("up", "whole").alias("parent"), "stability", "shut"), "clusters")
    began = ports.filter("new").select(F.col("name").alias("node"), key("band", F.lit(0), "name").alias("id"))
    points = began.join(end, "id", "left").select("node", F.coalesce("end", "id").alias("cluster"))
    return points, clusters


def _settled(group: pa.Table) -> pa.Table:
    """best of each cluster of a whole tree (cluster, parent, a, b): the greater of a and b with what its parts have."""
    names, parents, a, b = (group[c].to_pylist() for c in ("cluster", "parent", "a", "b"))
    at = {c: k for k, c in enumerate(names)}
    up = [at.get(p) for p in parents]
    left = [0] * len(names)
    for p in up:
        if p is not None:
            left[p] += 1
    todo, best = [k for k, n in enumerate(left) if not n], [0.0] * len(names)
    while todo:
        k = todo.pop()
        best[k] = max(a[k], b[k])
        if (p := up[k]) is not None:
            b[p] += best[k]
            left[p] -= 1
            if not left[p]:
                todo.append(p)
    return pa.table({"cluster": pa.array(names, pa.string()), "best": pa.array(best, pa.float64())})


def excess(clusters: DataFrame, part: int, folder: Folder) -> DataFrame:
    """cluster, best: the greater of a cluster's stability and what its parts have together.

    A cluster's best is max(a, b + its parts' best). In each round clusters without parts are settled and added to b of the one
    they are part of; and where one has a single part that has a single part, half of such links are folded into one, by coins.
    What is left goes to one task when it has at most `part` clusters.
    """
    waiting, turn, done, folded = clusters.select("cluster", "parent", F.col("stability").alias("a"), F.lit(0.0).alias("b")), 0, [], []
    while waiting.count() > part:
        turn += 1
        parts = waiting.filter("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.lit(True).alias("has"))
        known = folder.save(waiting.join(parts, "cluster", "left"), f"known-{turn}")
        leaves = known.filter("has is null").select("cluster", "parent", F.greatest("a", "b").alias("best"))
        done.append(leaves.select("cluster", "best"))
        sums = leaves.groupBy(F.col("parent").alias("cluster")).agg(F.sum("best").alias("s"))
        rest = known.filter("has").join(sums, "cluster", "left").select("cluster", "parent", "a", (F.col("b") + F.coalesce("s", F.lit(0.0))).alias("b"))
        rest = folder.save(rest, f"rest-{turn}")
        alone = rest.groupBy(F.col("parent").alias("cluster")).agg(F.count("*").alias("n"), F.min("cluster").alias("part")).filter("n = 1").drop("n")
        chain = folder.save(rest.join(alone, "cluster").withColumn("coin", F.xxhash64("cluster", F.lit(turn)) % 2 == 0), f"chain-{turn}")
        lower = chain.filter("not coin").select(F.col("cluster").alias("part"), F.col("a").alias("a_"), F.col("b").alias("b_"), F.col("part").alias("below"))
        pairs = folder.save(chain.filter("coin").join(lower, "part").select("cluster", "part", "a", "b", "a_", "b_", "below"), f"pairs-{turn}")
        folded.append(pairs.select(F.col("part").alias("cluster"), F.col("a_").alias("a"), F.col("b_").alias("b"), "below"))
        upper = pairs.select("cluster", F.greatest(F.col("a"), F.col("b") + F.col("a_")).alias("na"), (F.col("b") + F.col("b_")).alias("nb"))
        moved = pairs.select(F.col("below").alias("cluster"), F.col("cluster").alias("up"))
        left = rest.join(pairs.select(F.col("part").alias("cluster")), "cluster", "left_anti").join(upper, "cluster", "left").join(moved, "cluster", "left")
        waiting = folder.save(left.select("cluster", F.coalesce("up", "parent").alias("parent"), F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b")), f"waiting-{turn}")
    best = waiting.groupBy(F.lit(0).alias("all")).applyInArrow(_settled, "cluster string, best double")
    for some in done:
        best = best.unionByName(some)
    best = folder.save(best, "excess")
    for k, some in reversed([*enumerate(folded)]):
        more = some.join(best.select(F.col("cluster").alias("below"), F.col("best").alias("under")), "below")
        best = best.unionByName(folder.save(more.select("cluster", F.greatest(F.col("a"), F.col("b") + F.col("under")).alias("best")), f"unfolded-{k}"))
    return best


def chosen(clusters: DataFrame, part: int, folder: Folder) -> DataFrame:
    """cluster, pick: of a cluster and those around it the outermost whose stability is not below what its parts have together, roots aside."""
    best = excess(clusters, part, folder)
    inner = clusters.join(best, "cluster").filter("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.sum("best").alias("below"))
    taken = F.col("parent").isNotNull() & (F.col("stability") >= F.coalesce("below", F.lit(0.0)))
    way = folder.save(clusters.join(inner, "cluster", "left").select("cluster", F.when(taken, F.col("cluster")).alias("pick"), F.col("parent").alias("next")), "way-0")
    turn = 0
    while not way.filter("next is not null").isEmpty():
        turn += 1
        over = way.select(F.col("cluster").alias("next"), F.col("pick").alias("outer"), F.col("next").alias("beyond"))
        way = folder.save(way.join(over, "next", "left").select("cluster", F.coalesce("outer", "pick").alias("pick"), F.col("beyond").alias("next")), f"way-{turn}")
    return way.filter("pick is not null").select("cluster", "pick")


def ranks(tree: DataFrame, folder: Folder) -> DataFrame:
    """weight, level: its place among all distinct weights, from 0."""
    some = folder.save(tree.select("weight").distinct().orderBy("weight").select("weight", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("k")), "weights")
    sizes = some.groupBy("p").agg(F.count("*").alias("n"), F.min("k").alias("least"))
    # as many rows as there are partitions
    sizes = F.broadcast(sizes.withColumn("before", F.sum("n").over(Window.orderBy("p")) - F.col("n")))
    return some.join(sizes, "p").select("weight", (F.col("k") - F.col("least") + F.col("before")).cast("int").alias("level"))


def clusters_of(graph: DataFrame, nodes: DataFrame, folder: Folder, least: int = LEAST, members: int = LEAST, most_levels: int = LEVELS, part: int = PART) -> DataFrame:
    """node, cluster (its least node, null for outliers), born (the level it parts from another at, of all the forest's weights).

    graph: node, rank, other, distance; nodes: node, copies (whole numbers from 0 on).
    """
    tree = folder.save(forest(edges(graph, least), folder), "tree")
    first = tree.agg(F.min("weight")).first()[0]
    if first is None:
        return nodes.select("node", F.lit(None).cast(nodes.schema["node"].dataType).alias("cluster"), F.lit(None).cast("int").alias("born"))
    points, found = condensed(*bands(tree, nodes, most_levels, part, folder), members, first, folder)
    # of a vector's chosen clusters the outermost has it
    picks = chosen(found, part, folder)
    own = folder.save(points.join(picks, "cluster").select("node", "pick"), "own")
    label = own.groupBy("pick").agg(F.min("node").alias("cluster"))
    level = ranks(tree, folder).select(F.col("weight").alias("shut"), (F.col("level") - 1).alias("born"))
    label = label.join(found.select(F.col("cluster").alias("pick"), "shut"), "pick").join(level, "shut")
    return nodes.select("node").join(own.join(label, "pick").select("node", "cluster", "born"), "node", "left")


def clustered(vectors: DataFrame, folder: Folder, key: str = "vec_id", column: str = "embedding", k: int = 2 * LEAST, **how) -> DataFrame:
    """key, cluster, born, copies of each vector: over the k nearest classes of each."""
    near = neighbours.nearest(vectors, folder, k, key=key, column=column)
    rows, own = neighbours.classes(vectors, key, column)
    members = folder.save(rows.join(own, "vector").select("key", "rep", "copies"), "members")
    nodes = members.select(F.col("rep").alias("node"), "copies").distinct()
    graph = near.join(nodes.select(F.col("node").alias(key)), key, "left_semi")
    graph = folder.save(graph.select(F.col(key).alias("node"), "rank", F.col("neighbour").alias("other"), F.greatest(1 - F.col("cosine"), F.lit(0.0)).alias("distance")), "graph")
    got = clusters_of(graph, nodes, folder, **how)
    return members.join(got, members["rep"] == got["node"]).select(F.col("key").alias(key), "cluster", "born", "copies")
