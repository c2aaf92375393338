"""Which sources are independent of each other, what evidence is worth by that, and whether it suffices to decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.operators import evidence
from siltstone.sources.tables import Folder

#: Parts in which what a tie has in common is looked at, so that none meets in one task.
PARTS = 16
#: Names of what limits research.
LIMITATIONS = ("source_unavailable", "language_coverage_limited", "recency_limited", "single_platform_bias", "duplicate_heavy_corpus", "insufficient_pricing_data", "insufficient_user_voice")
#: Names of the ten gates.
GATES = ("intents_covered", "independent_enough", "few_duplicates", "counter_evidence_sought", "recent_enough", "access_undistorted", "no_critical_gap", "languages_covered", "fits_maturity", "limits_harmless")


def ties(rows: DataFrame, node: Column, kinds: dict[str, Column]) -> DataFrame:
    """(node, kind, hub) of all values that nodes may share. A column holds a value, or an array of them, for each row.

    Null and empty values tie nothing; nodes must be strings and not null. Values are kept as hashes of 32 bytes.
    """
    schema = dict(rows.select(*[c.alias(k) for k, c in kinds.items()]).dtypes)

    def named(kind: str, c: Column) -> Column:
        values = F.coalesce(c, F.array().cast("array<string>")) if schema[kind].startswith("array") else F.array(c)
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    out = rows.filter(node.isNotNull()).select(node.alias("node"), F.explode(F.concat(*[named(k, c) for k, c in kinds.items()])).alias("tie"))
    return out.filter(F.length("tie.value") > 0).select("node", "tie.kind", F.unhex(F.sha2("tie.value", 256)).alias("hub"))


def groups(tied: DataFrame, folder: Folder) -> tuple[DataFrame, DataFrame]:
    """(node, independence: the least node that ties reach) of nodes that are tied to any other, and (independence, kinds) of the kinds that tie it.

    Nodes of a hub are tied to the least of their part, and that to the hub's least, so edges are as many as ties and no
    pairs are made; a hub that a third of all nodes share is counted in parts before it meets.
    """
    tied = folder.save(tied.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int")), "ties")
    parts = tied.groupBy("kind", "hub", "part").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    hubs = parts.groupBy("kind", "hub").agg(F.min("low").alias("least"), F.max("high").alias("most")).filter("least < most").drop("most")
    shared = folder.save(parts.join(hubs, ["kind", "hub"]).select("kind", "hub", "part", "low", "least"), "shared")
    edges = tied.join(shared, ["kind", "hub", "part"]).select(F.col("node").alias("a"), F.col("low").alias("b")).union(shared.select("low", "least")).filter("a != b")
    found = evidence.components(edges, folder.path).withColumnRenamed("component", "independence")
    kinds = shared.select(F.col("least").alias("node"), "kind").distinct().join(found, "node").groupBy("independence").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    return found, kinds


def limitations(p: dict[str, Column], least_languages: int = 2, least_recent: float = 0.2, most_duplicates: float = 0.5, most_blocked: float = 0.3, least_voices: int = 1) -> Column:
    """Names of what limits the evidence of a profile, given as columns by name."""
    checks = (p["blocked"] > most_blocked * p["claims"], p["languages"] < least_languages, p["recent"] < least_recent * p["claims"], p["platforms"] < 2, p["duplicate_ratio"] >= most_duplicates, p["priced"] == 0, p["direct"] < least_voices)
    return evidence.flags(**dict(zip(LIMITATIONS, checks)))


def profile(claims: DataFrame, by: str, now: Column, platforms: list[str], recent: int = 10, older: int = 20) -> DataFrame:
    """The ten figures of the evidence of each group of claims, and how many claims, sources, languages and so on are behind them.

    claims: node, independence, family, platform, language, at, polarity, direct, engagement, blocked, priced. A source
    counts once for its node, and once with all that it depends on for its independence; engagement isn't compared across platforms.
    Null flags are false, claims without a time are of the oldest.
    """
    age = lambda days: F.col("at") >= now - F.make_dt_interval(F.lit(days))
    out = claims.groupBy(by).agg(
        F.count("*").alias("claims"), F.countDistinct("node").alias("sources"), F.countDistinct("independence").alias("independent_source_count"), F.countDistinct("family").alias("independent_source_families"),
        F.count_if(age(recent)).alias("recent"), F.count_if(~age(recent) & age(older)).alias("aging"), F.countDistinct("platform").alias("platforms"), F.countDistinct("language").alias("languages"), F.count_if("direct").alias("direct"),
        F.struct(*[F.avg(F.when(F.col("platform") == p, F.col("engagement"))).alias(p) for p in platforms]).alias("engagement_context"),
        F.count_if(F.col("polarity") > 0).alias("supporting"), F.count_if(F.col("polarity") < 0).alias("challenging"), F.count_if("blocked").alias("blocked"), F.count_if("priced").alias("priced"),
    )
    out = out.withColumn("duplicate_ratio", 1 - F.col("independent_source_count") / F.col("claims"))
    out = out.withColumn("recency_distribution", F.struct("recent", "aging", (F.col("claims") - F.col("recent") - F.col("aging")).alias("old")))
    return out.withColumn("data_limitations", limitations({c: F.col(c) for c in out.columns}))


def sufficient(p: DataFrame, intents: Column, critical: Column, needed: Column, harmful: tuple[str, ...], independent: int, intents_least: int, languages: int = 2, recent: float = 0.2, duplicates: float = 0.5, blocked: float = 0.3) -> DataFrame:
    """The ten gates of a profile, sufficient if all hold, and the names of those that don't.

    intents: intents that have evidence; critical: whether all critical data is there; needed: the claims that a market of
    its maturity should have; harmful: limitations that bear on the thesis. A null makes its gate fail.
    """
    rules = (
        intents >= intents_least, F.col("independent_source_count") >= independent, F.col("duplicate_ratio") < duplicates, F.col("challenging") > 0, F.col("recent") >= recent * F.col("claims"), F.col("blocked") <= blocked * F.col("claims"),
        critical, F.col("languages") >= languages, F.col("claims") >= needed, ~F.arrays_overlap("data_limitations", F.array(*map(F.lit, harmful))),
    )
    out = evidence.gates(p, dict(zip(GATES, rules)))
    return out.withColumn("failed", evidence.flags(**{g: ~F.col(g) for g in GATES}))
