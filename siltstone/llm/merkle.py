"""A Merkle manifest of a table: one tree of 8 children a node for each language, their roots under one more tree.

Leaves are ranked in sorted ranges, so a leaf's place is its range's offset and its row. A tree is cut into aligned blocks
of 8**depth leaves: tasks reduce each block to its root, the roots are the next round's leaves, until each tree has one.
On the way down each block gets the proof of its own root, and a task walks the block by fractal traversal: of each level
it keeps the existing subtree, the run that the current path goes through, and the desired one, the run after it, which
takes one leaf a step. So every leaf's path within the block comes out in order while only some nodes a level are held;
the proof from above is appended.

Defined results: a null field is `-`, an empty one `0:`; a null language is a tree of its own, before all others; null ids
come first; rows of one id stand in order of their hashes, and of equal rows each has its own leaf; a tree of one leaf is
that leaf, with an empty proof; a table without rows has none. Further columns don't enter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.llm.work import Work

#: Children of a node.
FAN = 8
#: Levels of a block: tasks take 8**LEVELS leaves at once.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(fields: list[Column]) -> Column:
    """SHA-256 over the fields, each `-` if null, else its bytes' number, a colon and its value."""
    texts = [c.cast("string") for c in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def digest(nodes: list[bytes]) -> bytes:
    """The parent of nodes in hex."""
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


class Treehash:
    """Takes nodes one by one and holds those of a run that isn't whole, up to the nodes of level `top`."""

    def __init__(self, top: int):
        self.top, self.runs = top, [[] for _ in range(top + 1)]

    def add(self, node: bytes) -> None:
        self.runs[0].append(node)
        level = 0
        while level < self.top and len(self.runs[level]) == FAN:
            self.runs[level + 1].append(digest(self.runs[level]))
            self.runs[level] = []
            level += 1

    def end(self) -> list[bytes]:
        """The nodes of level `top`, after the last leaf: runs that aren't whole become nodes too."""
        for level in range(self.top):
            if self.runs[level]:
                self.runs[level + 1].append(digest(self.runs[level]))
                self.runs[level] = []
        return self.runs[self.top]


def height(n: int, levels: int) -> int:
    """Levels above the nodes of a block in a tree that has n of them."""
    h = 0
    while h < levels and n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def top(nodes: list[bytes], levels: int) -> bytes:
    tree = Treehash(levels)
    for node in nodes:
        tree.add(node)
    return tree.end()[0]


def paths(nodes: list[bytes], levels: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """For each node in order, by level: its ancestor's place in the run and the run. Stacked subtrees, one run a level."""
    existing, desired = [], [Treehash(level) for level in range(levels)]
    for level in range(levels):
        first = Treehash(level)
        for node in nodes[: FAN ** (level + 1)]:
            first.add(node)
        existing.append(first.end())
    for i in range(len(nodes)):
        for level in range(levels):
            width = FAN ** (level + 1)
            if i and i % width == 0:
                existing[level] = desired[level].end()
                desired[level] = Treehash(level)
            if i + width < len(nodes):
                desired[level].add(nodes[i + width])
        yield [(i // FAN**level % FAN, existing[level]) for level in range(levels)]


def packed(path: list[tuple[int, list[bytes]]]) -> bytes:
    """A path as bytes: by level the place, the number of siblings and the siblings."""
    return b"".join(bytes([at, len(run) - 1]) + b"".join(bytes.fromhex(x.decode()) for k, x in enumerate(run) if k != at) for at, run in path)


def unpacked(path: bytes) -> list[tuple[int, list[bytes]]]:
    """By level the place and the siblings in hex."""
    out, i = [], 0
    while i < len(path):
        at, n = path[i], path[i + 1]
        out.append((at, [path[k : k + 32].hex().encode() for k in range(i + 2, i + 2 + 32 * n, 32)]))
        i += 2 + 32 * n
    return out


def folded(node: bytes, path: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a leaf in hex and its siblings give."""
    for at, siblings in path:
        node = digest([*siblings[:at], node, *siblings[at:]])
    return node


def ranked(rows: DataFrame, tree: str, order: list[str], work: Work, name: str) -> DataFrame:
    """Adds pos, the place among the tree's rows in that order, and n, how many the tree has."""
    stored = work.save(rows.withColumn("_tie", F.monotonically_increasing_id()), f"{name}-rows")
    by = [tree, *order, "_tie"]
    sorted_ = stored.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    placed = work.save(sorted_.withColumn("_part", F.shiftright("_at", 33)), f"{name}-sorted")
    work.drop(f"{name}-rows")
    runs = placed.groupBy("_part", F.col(tree).alias("_tree")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    all_ = Window.partitionBy("_tree")
    # a tree has a run in each range at most
    runs = runs.withColumn("n", F.sum("_n").over(all_)).withColumn("_before", F.sum("_n").over(all_.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.select(F.col("_part").alias("_p"), "_tree", "n", (F.coalesce("_before", F.lit(0)) - F.col("_first")).alias("_shift"))
    got = placed.join(runs, (F.col("_part") == F.col("_p")) & F.col(tree).eqNullSafe(F.col("_tree")))
    out = work.save(got.withColumn("pos", F.col("_at") + F.col("_shift")).select(*rows.columns, "pos", "n"), name)
    work.drop(f"{name}-sorted")
    return out


class Forest:
    """Trees over nodes (tree, pos, n, hash): levels[0] are the nodes, each next level the roots of the last one's blocks."""

    def __init__(self, nodes: DataFrame, work: Work, name: str, depth: int = LEVELS):
        self.work, self.name, self.levels, self.depth, self.width = work, name, [nodes], depth, FAN**depth
        while (nodes.agg(F.max("n")).first()[0] or 1) > 1:
            nodes = work.save(self.reduced(nodes), f"{name}-{len(self.levels)}")
            self.levels.append(nodes)

    def blocks(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("block", F.expr(f"pos div {self.width}"))

    def reduced(self, nodes: DataFrame) -> DataFrame:
        depth, width = self.depth, self.width

        def root(group: pa.Table) -> pa.Table:
            group = group.sort_by("pos")
            n = group["n"][0].as_py()
            got = top([x.hex().encode() for x in group["hash"].to_pylist()], height(n, depth))
            return pa.table({"tree": group["tree"][:1], "pos": group["block"][:1], "n": pa.array([-(-n // width)], pa.int64()), "hash": pa.array([bytes.fromhex(got.decode())], pa.binary())})

        return self.blocks(nodes.select("tree", "pos", "n", "hash")).groupBy("tree", "block").applyInArrow(root, "tree string, pos long, n long, hash binary")

    @property
    def roots(self) -> DataFrame:
        return self.levels[-1].select("tree", "hash")

    def down(self, level: int, above: DataFrame) -> DataFrame:
        """tree, pos, path, root of a level's nodes. above: the same of their blocks' roots."""
        depth = self.depth

        def walk(group: pa.Table, upper: pa.Table) -> pa.Table:
            group, rest = group.sort_by("pos"), upper["path"][0].as_py()
            own = [packed(p) + rest for p in paths([x.hex().encode() for x in group["hash"].to_pylist()], height(group["n"][0].as_py(), depth))]
            return pa.table({"tree": group["tree"], "pos": group["pos"], "path": pa.array(own, pa.binary()), "root": pa.array([upper["root"][0].as_py()] * len(own), pa.binary())})

        nodes = self.blocks(self.levels[level].select("tree", "pos", "n", "hash")).groupBy("tree", "block")
        return nodes.cogroup(above.groupBy("tree", "pos")).applyInArrow(walk, "tree string, pos long, path binary, root binary")

    def block_paths(self, above: DataFrame) -> DataFrame:
        """tree, pos, path, root of level 1, the roots of blocks of leaves. above: those of the trees' roots."""
        for level in range(len(self.levels) - 1, 1, -1):
            above = self.work.save(self.down(level - 1, above), f"{self.name}-paths-{level - 1}")
        return above


def manifest(docs: DataFrame, work: Work, claimed: Column | None = None, tree: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, with_paths: bool = False, depth: int = LEVELS) -> DataFrame:
    """key, leaf, subroot, root, proof (hash over the siblings up to the root), folded (the root from the claimed leaf), all in hex, and path with with_paths.

    depth: levels of a block. claimed: the hash of a leaf as someone states it; without one the leaf itself, as where it is null.
    """
    own = leaf([F.col(c) for c in fields])
    hashed = docs.select(F.col(tree).cast("string").alias("tree"), F.col(key).alias("key"), own.alias("hash"), (F.lit(None).cast("binary") if claimed is None else claimed).alias("claimed"))
    leaves = ranked(hashed, "tree", ["key", "hash", "claimed"], work, "leaves")
    trees = Forest(leaves, work, "tree", depth)
    subroots = trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("own"), "hash")
    over = Forest(ranked(subroots, "tree", ["own"], work, "subroots"), work, "top", depth)
    last = over.roots.first()
    root = last["hash"].hex() if last else ""
    above = over.roots.select("tree", F.lit(0).cast("long").alias("pos"), F.lit(b"").alias("path"), F.col("hash").alias("root"))
    if len(over.levels) > 1:
        above = over.down(0, over.block_paths(above))
    named = over.levels[0].select("tree", "pos", "own", "hash").join(above.drop("root"), ["tree", "pos"])
    above = work.save(named.select(F.col("own").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("hash").alias("root")), "above")
    above = trees.block_paths(above)

    def proofs(group: pa.Table, upper: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        rest, subroot = upper["path"][0].as_py(), upper["root"][0].as_py().hex()
        higher = unpacked(rest)
        tail = b"".join(x for _, siblings in higher for x in siblings)
        leaves = [x.hex().encode() for x in group["hash"].to_pylist()]
        proof, got, path = [], [], []
        for node, said, steps in zip(leaves, group["claimed"].to_pylist(), paths(leaves, height(group["n"][0].as_py(), depth))):
            siblings = [(at, run[:at] + run[at + 1 :]) for at, run in steps]
            proof.append(hashlib.sha256(b"".join(x for _, own in siblings for x in own) + tail).hexdigest())
            got.append(folded(node if said is None else said.hex().encode(), siblings + higher).decode())
            if with_paths:
                path.append(packed(steps) + rest)
        out = {"key": group["key"], "leaf": [x.decode() for x in leaves], "subroot": [subroot] * len(leaves), "proof": proof, "folded": got}
        return pa.table(out | ({"path": pa.array(path, pa.binary())} if with_paths else {}))

    kind = leaves.schema["key"].dataType.simpleString()
    schema = f"key {kind}, leaf string, subroot string, proof string, folded string" + ", path binary" * with_paths
    rows = trees.blocks(leaves).groupBy("tree", "block").cogroup(above.groupBy("tree", "pos")).applyInArrow(proofs, schema)
    return rows.select(F.col("key").alias(key), "leaf", "subroot", F.lit(root).alias("root"), *[c for c in rows.columns if c not in ("key", "leaf", "subroot")])
