"""Near duplicates by MinHash signatures in bands, and the choice of what makes candidates.

A text is the set of its shingles, runs of SHINGLE words. Texts of one set and one precondition (language, kind) are one
class and only its first text goes on, so copies cost nothing. A signature has HASHES least values; BANDS runs of them are
keys, and texts that share a key are candidates. Each is compared with the first text of its key, so a key of many near
copies costs one comparison a text; components of what that links are found; only where a key still has texts of several
components are those compared with each other, by signature in blocks of bounded size, wherever the two can reach the
threshold. What the signatures leave is verified on the whole sets, so no false link is in the result; a pair at the
threshold is missed with a probability below 2e-4, and less above it. Of two components that meet in one key, pairs that the
signatures keep are all verified: two large groups just below the threshold cost the product of their sizes.

Defined results: texts without words, of fewer words than asked for, and null ones are not eligible and have neither class nor component;
a text of fewer words than a shingle is one shingle; a null precondition equals null; rows of one key are linked to what
any of them is linked to, and have the greatest of their numbers; null keys are left out. Tables without rows give none; further columns don't enter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, functions as F

from siltstone.operators import evidence, filters
from siltstone.sources.tables import Folder

SHINGLE = 5
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
THRESHOLD = 0.75
#: Signatures agree in a share that differs from the similarity by 0.034 in the mean at the threshold; four times that is allowed for.
SLACK = 0.14
#: Texts of one key that a task compares with as many others.
BLOCK = 2048
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_STEPS = mixed(np.arange(1, 2 * HASHES + 1, dtype=U) * U(0x9E3779B97F4A7C15))
_TIMES, _PLUS = _STEPS[:HASHES] | U(1), _STEPS[HASHES:]
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(64)], U)


def hashed(words: pa.LargeStringArray) -> np.ndarray:
    """A number for each word, of all its bytes and their places."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    at = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], np.diff(offsets))
    return np.add.reduceat(np.r_[mixed(mixed(at.astype(U) + U(1)) + data), U(0)], offsets[:-1] - offsets[0])


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, where each text's begin (with an end), and the texts' numbers of words. Words are runs without ASCII blanks, in lower case."""
    parts = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat = parts.flatten().dictionary_encode()
    own = hashed(flat.dictionary) if len(flat.dictionary) else np.zeros(0, U)
    at = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    blank = pc.equal(pc.binary_length(flat.dictionary), 0).to_numpy(zero_copy_only=False)
    if blank.any():  # before the first and after the last word
        at, row = at[~blank[at]], row[~blank[at]]
    n = np.bincount(row, minlength=len(texts))
    first = np.cumsum(n) - n
    per = np.where((n > 0) & (n < size), 1, np.maximum(n - size + 1, 0))
    of = np.repeat(np.arange(len(texts)), per)
    begin = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per) + first[of]
    hashes = np.r_[own[at], np.zeros(size, U)]
    values = np.zeros(len(of), U)
    left = np.minimum(n[of], size)
    for k in range(size):
        values += np.where(k < left, hashes[begin + k] * _POWERS[k], U(0))
    values = mixed(values + left.astype(U))
    for a, b in zip(np.cumsum(per) - per, np.cumsum(per)):
        values[a:b].sort()
    keep = np.r_[True, (of[1:] != of[:-1]) | (values[1:] != values[:-1])][: len(of)]
    of, values = of[keep], values[keep]
    return values, np.searchsorted(of, np.arange(len(texts) + 1)), n


def signatures(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Least values under HASHES mixes, by text; each has a shingle."""
    out, own = np.empty((len(begin) - 1, HASHES), np.uint32), np.empty_like(values)
    for k in range(HASHES):
        np.multiply(values, _TIMES[k], out=own)
        np.add(own, _PLUS[k], out=own)
        out[:, k] = np.minimum.reduceat(own, begin[:-1]) >> U(32)
    return out


def _runs(column: pa.Array, size: int = 2 << 20) -> Iterator[tuple[int, int]]:
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + size, "right")))
        yield i, min(j, len(column))
        i = j


def signed(docs: DataFrame, key: str, text: str, same: list[str], least: int) -> DataFrame:
    """key, group (the precondition), n_words, n (shingles), sames (a hash of the set), bands (keys), short (signature, 8 bits each) of each text; the last three null where it has too few words."""
    group = F.to_json(F.struct(*[F.col(c) for c in same]), {"ignoreNullFields": "false"}) if same else F.lit("")
    rows = docs.select(F.col(key).alias("key"), group.alias("group"), F.col(text).alias("text")).filter("key is not null")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in _runs(batch.column("text")):
                part = batch.slice(i, j - i)
                values, begin, words = shingles(part.column("text"))
                fit = np.flatnonzero((words >= max(1, least)) & (np.diff(begin) > 0))
                n = np.diff(begin)
                signature = np.zeros((len(n), HASHES), np.uint32)
                if len(fit):
                    taken = np.concatenate([values[a:b] for a, b in zip(begin[fit], begin[fit + 1])])
                    signature[fit] = signatures(taken, np.r_[0, np.cumsum(n[fit])])
                keys = reduce(lambda h, c: mixed(h * U(31) + c.astype(U)), signature.reshape(len(n), BANDS, ROWS).transpose(2, 0, 1), np.arange(BANDS, dtype=U)[None, :] + np.zeros((len(n), 1), U))
                sums = np.r_[U(0), np.cumsum(mixed(values))]
                whole = mixed(sums[begin[1:]] - sums[begin[:-1]] + n.astype(U))
                eligible = np.isin(np.arange(len(n)), fit)
                hide = lambda xs: [x if e else None for x, e in zip(xs, eligible)]
                yield pa.RecordBatch.from_pydict({
                    "key": part.column("key"), "group": part.column("group"), "n_words": pa.array(words.astype(np.int64)), "n": pa.array(n.astype(np.int64)), "sames": pa.array(hide(whole.view(np.int64).tolist()), pa.int64()),
                    "bands": pa.array(hide(keys.view(np.int64)), pa.list_(pa.int64())), "short": pa.array(hide([x.tobytes() for x in signature.astype(np.uint8)]), pa.binary()),
                })

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(task, f"key {kind}, group string, n_words long, n long, sames long, bands array<long>, short binary")


def sets(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """key, own: the sets of the texts whose keys are in `wanted`, and of some more that its filter of fixed size lets through. Only these are shuffled."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key is not null").withColumn("h", F.xxhash64("key"))
    mask = filters.of(wanted.select(F.xxhash64("key").alias("h")), "h")
    sent = docs.sparkSession.sparkContext.broadcast(mask)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(filters.has(sent.value, batch.column("h").to_numpy())))
            for i, j in _runs(batch.column("text")):
                values, begin, _ = shingles(batch.column("text").slice(i, j - i))
                raw = values.tobytes()
                yield pa.RecordBatch.from_pydict({"key": batch.column("key").slice(i, j - i), "own": pa.array([raw[8 * a : 8 * b] for a, b in zip(begin[:-1], begin[1:])], pa.binary())})

    return rows.mapInArrow(task, f"key {rows.schema['key'].dataType.simpleString()}, own binary")


def agreed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places of signatures (rows of a by rows of b); 8 bits agree by chance once in 256."""
    out = np.zeros((len(a), len(b)), np.uint8)  # HASHES fit in it
    for k in range(HASHES):
        out += (a[:, k, None] == b[None, :, k]).view(np.uint8)
    return (out / HASHES - 1 / 256) / (1 - 1 / 256)


def verified(pairs: DataFrame, reps: DataFrame, texts: tuple[DataFrame, str, str], threshold: float, folder: Folder, name: str) -> DataFrame:
    """Those of distinct pairs (a, b) of representatives whose sets reach the threshold. Signatures decide first; of what they leave, b's set is sent to a's, which is there once."""
    short = reps.select("key", "short", "n")
    both = pairs.join(short.toDF("a", "sa", "na"), "a").join(short.toDF("b", "sb", "nb"), "b").filter(F.least("na", "nb") >= F.greatest("na", "nb") * threshold)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sa", "sb"))
                share = ((x == y).mean(1) - 1 / 256) / (1 - 1 / 256)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(share >= threshold - SLACK))

    kind = reps.schema["key"].dataType.simpleString()
    left = folder.save(both.select("a", "b", "sa", "sb").mapInArrow(near, f"a {kind}, b {kind}"), f"{name}-near")
    wide = folder.save(sets(*texts, left.select(F.col("a").alias("key")).union(left.select("b")).distinct()), f"{name}-sets")
    # salted: the pairs of one text are dealt over tasks, and each has the text once, before what is compared with it
    part = F.pmod(F.xxhash64("b"), F.lit(16)).alias("part")
    sent = left.select("a", part, "b").join(wide.toDF("b", "own"), "b").select("a", "part", "b", "own")
    once = left.select("a", part).distinct().join(wide.toDF("a", "own"), "a").select("a", "part", F.lit(None).cast(kind).alias("b"), "own")
    rows = once.unionByName(sent).repartition("a", "part").sortWithinPartitions("a", "part", "b")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []  # one, but for rows of one key
        for batch in batches:
            keep = []
            for a, part, b, own in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b", "own"))):
                y = np.frombuffer(own, U)
                if b is None:
                    held = [*held, y] if at == (a, part) else [y]
                    at = a, part
                    keep.append(False)
                    continue
                common = [len(np.intersect1d(x, y, assume_unique=True)) for x in held]
                keep.append(any(c >= threshold * (len(x) + len(y) - c) for x, c in zip(held, common)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(exact, f"a {kind}, b {kind}")


def together(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    return pa.Table.from_batches(parts).combine_chunks().to_batches() if parts else []


def across(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct pairs (a, b) of one band key, of different components, whose signatures are near the threshold. rows: band, node, component, short. Keys of more than `block` texts are cut, and each two parts meet in a task."""
    sizes = rows.groupBy("band").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    cut = rows.join(sizes.select("band", F.ceil(F.col("m") / block).alias("parts")), "band").withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")))
    other = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    met = cut.withColumn("q", F.explode(other)).select("band", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "p", "node", "component", "short")

    def compare(group: pa.RecordBatch) -> pa.RecordBatch:
        x = np.frombuffer(b"".join(group["short"].to_pylist()), np.uint8).reshape(-1, HASHES)
        component, p = group["component"].to_numpy(), group["p"].to_numpy()
        first, second = np.flatnonzero(p == group["i"][0].as_py()), np.flatnonzero(p == group["j"][0].as_py())
        a, b = [np.zeros(0, int)], [np.zeros(0, int)]
        for k in range(0, len(first), 256):
            part = first[k : k + 256]
            hit = (agreed(x[part], x[second]) >= THRESHOLD - SLACK) & (component[part, None] != component[None, second])
            at = np.nonzero(hit)
            a.append(part[at[0]])
            b.append(second[at[1]])
        node = group["node"]
        return pa.RecordBatch.from_arrays([node.take(pa.array(np.concatenate(a))), node.take(pa.array(np.concatenate(b)))], ["x", "y"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Most keys have a few texts, so groups are cut from sorted rows; the last one of a batch may go on in the next."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.Table.from_batches([held, batch] if held else [batch]).combine_chunks().to_batches()[0]
            by = np.stack([batch.column(c).to_numpy() for c in ("band", "i", "j")])
            begin = np.r_[0, 1 + np.flatnonzero((by[:, 1:] != by[:, :-1]).any(0))]
            yield from together([compare(batch.slice(a, b - a)) for a, b in zip(begin[:-1], begin[1:])])
            held = batch.slice(begin[-1])
        if held:
            yield compare(held)

    kind = rows.schema["node"].dataType.simpleString()
    found = met.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(task, f"x {kind}, y {kind}")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def duplicates(docs: DataFrame, folder: Folder, key: str = "doc_id", text: str = "text", same: tuple[str, ...] = ("lang",), least: int = 10, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """key, n_words, n_shingles, eligible, class_id (least key of texts with its set), component_id (least key that links reach).

    same: columns that must be equal for two texts to be compared; least: words that a text must have.
    """
    stored, texts = folder.save(signed(docs, key, text, list(same), least), "signed"), (docs, key, text)
    fit = stored.filter("sames is not null")
    classes = fit.groupBy("group", "sames").agg(F.min("key").alias("rep"))
    members = folder.save(fit.select("key", "group", "sames").join(classes, ["group", "sames"]).select("key", "rep"), "members")
    reps = folder.save(fit.drop("n_words").join(members.filter("key = rep").select("key"), "key", "left_semi").dropDuplicates(["key"]), "reps")
    bands = folder.save(reps.select("key", F.explode(F.transform("bands", lambda b: F.xxhash64(b, F.col("group")))).alias("band")), "bands")
    # one comparison a text and key: with the least text of the key
    firsts = bands.groupBy("band").agg(F.min("key").alias("a"), F.count("*").alias("m")).filter("m > 1").select("band", "a")
    stars = bands.join(firsts, "band").filter("a < key").select("a", F.col("key").alias("b")).distinct()
    linked = folder.save(verified(stars, reps, texts, threshold, folder, "stars"), "stars")
    known = evidence.components(linked, folder.path)
    labelled = reps.select(F.col("key").alias("node"), "short").join(known, "node", "left").select("node", "short", F.coalesce("component", "node").alias("component"))
    # of a key with one component every two texts are linked already, directly or through others
    shared = bands.join(firsts.select("band"), "band").withColumnRenamed("key", "node")
    open_ = shared.join(labelled.select("node", "component"), "node")
    mixed_ = open_.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("band")
    rest = folder.save(open_.join(mixed_, "band").join(labelled.select("node", "short"), "node").select("band", "node", "component", "short"), "rest")
    more = folder.save(verified(across(rest, block).join(linked, ["a", "b"], "left_anti"), reps, texts, threshold, folder, "more"), "more")
    final = (known if more.isEmpty() else evidence.components(linked.unionByName(more), folder.path)).withColumnRenamed("node", "rep")
    placed = members.join(final, "rep", "left").groupBy("key").agg(F.min("rep").alias("class_id"), F.min(F.coalesce("component", "rep")).alias("component_id"))
    rows = stored.groupBy("key").agg(F.max("n_words").alias("n_words"), F.max("n").alias("n_shingles"))
    out = rows.join(placed, "key", "left")
    return out.select(F.col("key").alias(key), "n_words", "n_shingles", F.col("class_id").isNotNull().alias("eligible"), "class_id", "component_id")


#: What makes candidates, by corpus: from how many texts, and from which share of texts that have a copy, a method is worth its cost.
POLICY = {"trigrams": (0, 0.0), "simhash": (5_000, 0.0), "minhash": (50_000, 0.1)}


def profile(docs: DataFrame, text: str = "text") -> Row:
    """Of a corpus: texts, mean words, and the share of texts that are copies of others."""
    own = docs.filter(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h"), F.size(F.split(text, r"\s+")).alias("w"))
    by = own.groupBy("h").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("texts"), F.coalesce(F.sum("w") / F.sum("n"), F.lit(0.0)).alias("words"), F.coalesce(1 - F.count("*") / F.sum("n"), F.lit(0.0)).alias("copies")).first()


def generator(corpus: Row, policy: dict[str, tuple[int, float]] | None = None, short: int = 3 * SHINGLE) -> str:
    """The last method of the policy whose texts and copies the corpus has; texts too short for shingles are left to trigrams."""
    fits = [name for name, (texts, copies) in (policy or POLICY).items() if corpus["texts"] >= texts and corpus["copies"] >= copies and (name != "minhash" or corpus["words"] >= short)]
    return fits[-1] if corpus["words"] >= SHINGLE or not fits else fits[0]
