"""The manifest against a tree built node by node."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from siltstone.llm import merkle
from siltstone.llm.work import Work

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, n long, hash string, key int"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    text = row[1].translate(LOWER) if lower and row[1] is not None else row[1]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)])


def climb(level):
    """Each node's siblings by level, and the root."""
    steps, at = [[] for _ in level], [[k] for k in range(len(level))]
    while len(level) > 1:
        after, below = [], []
        for i in range(0, len(level), 8):
            run = level[i : i + 8]
            for k in range(len(run)):
                for x in at[i + k]:
                    steps[x].append((k, run[:k] + run[k + 1 :]))
            after.append(h(*run))
            below.append([x for k in range(len(run)) for x in at[i + k]])
        level, at = after, below
    return steps, level[0]


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    grown = {}
    for t in order:
        own = sorted(trees[t], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        grown[t] = (own, *climb([leaf(r) for r in own]))
    tails, root = climb([grown[t][2] for t in order])
    out = []
    for t, tail in zip(order, tails):
        for r, steps in zip(grown[t][0], grown[t][1]):
            node = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for k, others in steps + tail:
                node = h(*others[:k], node, *others[k:])
            out.append((r[0], leaf(r), grown[t][2], root, h(*[x for _, others in steps + tail for x in others]), node))
    return sorted(out, key=repr)


def manifest(docs, spark, **more):
    lowered = merkle.leaf([F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if c == "text" else F.col(c) for c in merkle.FIELDS])
    return merkle.manifest(docs, Work(spark, "t11"), F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lowered), **more)


def make_rows(n):
    rng = random.Random(n)
    langs = ["en", "en", "en", "fr", None, "é", "", *[f"l{k}" for k in range(9)]]
    rows = [(k * 7 % 997, rng.choice([None, "", "Aé " * rng.randint(1, 9), "plain"]), rng.choice(langs) if k else "alone", rng.choice(["s", None]), rng.choice([0, None, -5]), "t", 1, 2, "h", 3) for k in range(n)]
    return rows if n == 1 else rows + rows[:5] + [(None, "No id", "en", "s", 1, "t", 1, 2, "h", 3)] * 3 + [(rows[1][0], "Other text", rows[1][2], None, 2, "t", 1, 2, "h", 3)]


@pytest.mark.parametrize("n,levels", [(1, 3), (40, 1), (700, 1), (700, 2)])
def test_manifest(spark, n, levels):
    """Null fields, languages and ids, equal rows, one id with two texts, blocks of several sizes, clashing further columns."""
    rows = make_rows(n)
    got = manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), spark, depth=levels)
    assert sorted(map(tuple, got.select("doc_id", "leaf", "subroot", "root", "proof", "folded").collect()), key=repr) == brute(rows)


def test_paths_verify(spark):
    """What a row's stored path folds to is the root, and no other leaf's is."""
    rows = make_rows(90)
    got = manifest(spark.createDataFrame(rows, SCHEMA), spark, with_paths=True).collect()
    for r in got:
        path = merkle.unpacked(bytes(r["path"]))
        assert merkle.folded(r["leaf"].encode(), path).decode() == r["root"]
        assert merkle.folded(h("x").encode(), path).decode() != r["root"]
        assert hashlib.sha256(b"".join(x for _, own in path for x in own)).hexdigest() == r["proof"]


def test_empty(spark):
    assert manifest(spark.createDataFrame([], SCHEMA), spark).count() == 0


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 511, 512])
def test_traversal_holds_few_nodes(n):
    """Paths against whole levels, and never more nodes held than two runs a level and the pending ones below them."""
    nodes = [h(str(k)).encode() for k in range(n)]
    levels = merkle.height(n, 3)
    whole = [nodes]
    for _ in range(levels):
        whole.append([merkle.digest(whole[-1][i : i + 8]) for i in range(0, len(whole[-1]), 8)])
    assert merkle.top(nodes, levels) == whole[-1][0]
    for i, path in enumerate(merkle.paths(nodes, levels)):
        assert path == [(i // 8**k % 8, whole[k][i // 8 ** (k + 1) * 8 :][:8]) for k in range(levels)]
    hash_tree = merkle.Treehash(3)
    for node in nodes:
        hash_tree.add(node)
        assert sum(map(len, hash_tree.runs)) <= 4 * 8
