"""Columns over plain text: tokens, similarities, fingerprints, segments, identities."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.functions import urls
from siltstone.sources.tables import Folder

#: Tokens that name no one.
GENERIC = ["and", "app", "blog", "cloud", "com", "community", "data", "for", "forum", "io", "news", "online", "org", "platform", "site", "the", "tools", "web"]


def tokens(text: Column) -> Column:
    """Distinct [a-z0-9]+ tokens of two characters or more, in order of appearance."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: F.length(t) >= 2))


def names(text: Column) -> Column:
    return F.array_except(tokens(text), F.array(*map(F.lit, GENERIC)))


def jaccard(a: Column, b: Column) -> Column:
    """0 for two empty sets."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def confidence(label: Column, evidence: Column) -> Column:
    """Share of a label's naming tokens that the evidence has; 0 for a label without any."""
    own = names(label)
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, tokens(evidence))) / F.size(own))


def coverage(text: Column, keywords: list[str]) -> Column:
    """Share of keywords that occur in the text, to four places, half to even."""
    found = F.size(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower(text), k)))
    return F.bround(found / len(keywords), 4)


def trigrams(text: Column) -> Column:
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def content_hash(body: Column) -> Column:
    """SHA-256 in hex; null for an empty body."""
    return F.when(F.octet_length(body) > 0, F.sha2(body, 256))


def reference(body: Column, limit: int = 16_384) -> Column:
    """Where a body is kept: inline up to the limit, else in a file by its hash."""
    return F.when(F.octet_length(body) == 0, None).when(F.octet_length(body) <= limit, F.concat(F.lit("inline:"), F.sha2(body, 256))).otherwise(F.concat(F.sha2(body, 256), F.lit(".bin")))


def inline(body: Column) -> Column:
    return F.translate(F.base64(body), "\r\n", "")


def idempotency_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def token_hash(token: Column) -> Column:
    """60 bits of MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 15), 16, 10).cast("long")


def simhash(docs: DataFrame, key: str, text: Column, bits: int = 60) -> DataFrame:
    """key, simhash: each bit by majority over the distinct tokens' hashes (a tie is 1); texts without tokens have none."""
    rows = docs.select(key, F.explode(tokens(text)).alias("token")).select(key, token_hash(F.col("token")).alias("h"))
    sums = rows.groupBy(key).agg(*[F.sum(F.when(F.shiftright("h", b).bitwiseAND(1) == 1, 1).otherwise(-1)).alias(f"b{b}") for b in range(bits)])
    value = sum((F.when(F.col(f"b{b}") >= 0, F.lit(1 << b)).otherwise(F.lit(0)) for b in range(bits)), F.lit(0)).cast("long")
    return sums.select(key, value.alias("simhash"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def minhash(docs: DataFrame, key: str, text: Column, hashes: int = 8) -> DataFrame:
    """key, m0..: least of each of several mixes of the distinct tokens' hashes."""
    rows = docs.select(key, F.explode(tokens(text)).alias("token")).select(key, (token_hash(F.col("token")) % 2147483647).alias("h"))
    return rows.groupBy(key).agg(*[F.min(F.expr(f"(h * {2 * k + 1} + {k * 7919}) % 2147483647")).alias(f"m{k}") for k in range(hashes)])


#: A term is frequent from this share of the documents on; of those there are at most as many as a document has on average, times the reciprocal.
FREQUENT = 1 / 1000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def counted(rows: DataFrame, text: Column, only: list[str] | None = None) -> DataFrame:
    """Adds dl, the number of words, and terms, array<struct<term, tf>>, in order of terms (`only` some); a sorted text's runs are counted in its row, without a shuffle. Texts without words are left out."""
    own = F.col("_w") if only is None else F.filter("_w", lambda w: w.isin(only))
    rows = rows.withColumn("_w", words(text)).filter("size(_w) > 0").withColumn("dl", F.size("_w").cast("long")).withColumn("_s", F.sort_array(own)).drop("_w")
    begins = F.filter(F.transform("_s", lambda w, i: F.when((i == 0) | (w != F.get("_s", i - 1)), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_at", begins)
    runs = F.transform("_at", lambda p, j: F.struct(F.get("_s", p).alias("term"), (F.coalesce(F.get("_at", j + 1), F.size("_s")) - p).cast("long").alias("tf")))
    return rows.withColumn("terms", runs).drop("_s", "_at")


def term_weights(docs: DataFrame, key: str, text: Column, folder: Folder, only: list[str] | None = None, frequent: float = FREQUENT) -> DataFrame:
    """key, term, tf, df, n, dl, avgdl (of `only` some terms). Rows of one key are one document; null keys have no rows, but count.

    Frequent terms, which most rows have, meet their counts where the documents are; only rows of the others are shuffled.
    """
    rows = docs.select(key, text.alias("_t"))
    several = rows.groupBy(key).count().filter("count > 1").select(F.col(key).alias("_k"))
    if several.isEmpty():
        own = counted(rows, F.col("_t"), only).select(key, "dl", "terms")
    else:
        same = F.col(key).eqNullSafe(F.col("_k"))
        alone = counted(rows.join(several, same, "left_anti"), F.col("_t"), only).select(key, "dl", "terms")
        parts = folder.save(counted(rows.join(several, same, "left_semi"), F.col("_t"), only).select(key, "dl", "terms"), "several")
        merged = parts.select(key, F.explode("terms").alias("x")).groupBy(key, "x.term").agg(F.sum("x.tf").alias("tf")).groupBy(key).agg(F.collect_list(F.struct("term", "tf")).alias("terms"))
        length = parts.groupBy(F.col(key).alias("_k")).agg(F.sum("dl").alias("dl"))
        own = alone.unionByName(length.join(merged, same, "left").select(F.col("_k").alias(key), "dl", "terms"))
    own = folder.save(own, "counted")
    n, total = own.agg(F.count("*"), F.sum("dl")).first()
    tf = own.select(key, "dl", F.explode("terms").alias("x")).select(key, "dl", "x.term", "x.tf")
    df = folder.save(tf.groupBy("term").agg(F.count("*").alias("df")), "df")
    most = F.col("df") >= n * frequent
    fit = tf.filter(F.col(key).isNotNull())
    there = fit.join(F.broadcast(df.filter(most)), "term")
    others = fit.join(F.broadcast(df.filter(most).select("term")), "term", "left_anti").join(df.filter(~most), "term")
    return there.unionByName(others).select(key, "term", "tf", "df", F.lit(n).cast("long").alias("n"), "dl", F.lit(total / n if n else None).cast("double").alias("avgdl"))


def bm25(weights: DataFrame, key: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return weights.filter(F.col("term").isin(query)).groupBy(key).agg(F.sum(part).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def segments(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, sequence, start_offset, end_offset, segment, segment_hash: lines of the text with their places in it."""
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("sequence", "segment"))
    before = Window.partitionBy(key).orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("segment") + 1).over(before), F.lit(0))
    return rows.withColumn("start_offset", start).withColumn("end_offset", F.col("start_offset") + F.length("segment")).withColumn("segment_hash", F.sha2("segment", 256))


#: Frequent words that tell languages apart, in order of the languages' codes.
STOP_WORDS = {"de": ["der", "die", "und", "von", "zu"], "en": ["the", "of", "and", "to", "in"], "es": ["de", "que", "el", "los", "y"], "fr": ["le", "la", "les", "des", "et"]}


def _among(own: list[str]):
    return lambda word: word.isin(own)


def language(text: Column, least: int = 20) -> Column:
    """The language with most frequent words in the text, the first of equals; unknown for short texts and those without any."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))
    counts = [F.size(F.filter(words, _among(own))) for own in STOP_WORDS.values()]
    most = F.greatest(*counts)
    out = F.when(F.coalesce(F.length(text) < least, F.lit(True)) | (most == 0), "unknown")
    for code, n in zip(STOP_WORDS, counts):
        out = out.when(n == most, code)
    return out


def target_shape(url: Column, label: Column, seen: Column, threshold: float = 0.6) -> Column:
    """Why a page is taken for what a label names, or not."""
    guarded = urls.guard(url)
    return F.when(~F.coalesce(F.lower(urls.part(url, 1)) == "https", F.lit(False)), "https_required").when(guarded.isNotNull(), guarded).when(confidence(label, seen) >= threshold, "confidence_passed").otherwise("confidence_below_threshold")


def near_hashes(hashes: DataFrame, column: str, most: int, blocks: list[tuple[int, int]]) -> DataFrame:
    """Ordered pairs (column, other) of distinct hashes that differ in `most` bits at most. blocks: first bit and bits; what differs in `most` of them leaves the rest equal.

    Both sides are shuffled: a hash has a row for each key, which Spark's estimate leaves out, so that it would collect all of them for a broadcast.
    """
    keys = []
    for k, kept in enumerate(combinations(blocks, len(blocks) - most)):
        value = sum((F.shiftleft(F.shiftright(column, low).bitwiseAND((1 << size) - 1), at * size) for at, (low, size) in enumerate(kept)), F.lit(0).cast("long"))
        keys.append(F.struct(F.lit(k).alias("k"), value.alias("v")))
    rows = hashes.select(column, F.explode(F.array(*keys)).alias("x")).select(column, "x.k", "x.v")
    pairs = rows.hint("merge").join(rows.withColumnRenamed(column, "other"), ["k", "v"]).filter((F.col(column) != F.col("other")) & (hamming(F.col(column), F.col("other")) <= most))
    return pairs.select(column, "other").distinct()
