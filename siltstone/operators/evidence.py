"""Evidence: eligibility, independence, gates, decisions, counterfactuals."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F


def components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """node, component (smallest node) of undirected edges (a, b): nodes and their parents hook to the smallest grandparent nearby until nothing changes."""
    spark = edges.sparkSession
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        folder = tempfile.mkdtemp()
    base, turn = f"{folder.rstrip('/')}/components-{uuid.uuid4().hex}", 0

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    both = kept(edges.select("a", "b").union(edges.select("b", "a")).filter("a is not null and b is not null").distinct(), "edges")
    parent = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("parent")), "0")
    while True:
        turn += 1
        up = parent.join(parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand")), "parent")
        near = both.join(up.select(F.col("node").alias("b"), "grand"), "b").groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("low"))
        met = up.join(near, "node").select("node", "parent", F.least("grand", "low").alias("low"))
        offers = met.select("node", "low", "parent").union(met.select("parent", "low", F.lit(None)))
        after = kept(offers.groupBy("node").agg(F.least(F.min("low"), F.max("parent")).alias("parent"), F.max("parent").alias("before")), str(turn))
        parent = after.select("node", "parent")
        if after.filter("parent < before").isEmpty():
            return parent.withColumnRenamed("parent", "component")


def eligible(rows: DataFrame, by: list[str], score: str, key: str, k: int) -> DataFrame:
    """Top k of each group; the rest stay with the reason."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), key))
    return rows.withColumn("rank", rank).withColumn("eligible", F.col("rank") <= k).withColumn("reason", F.when(F.col("rank") > k, "beyond_quota"))


def state(supporting: Column, challenging: Column) -> Column:
    return F.when((supporting > 0) & (challenging > 0), "mixed").when(supporting > 0, "supporting").when(challenging > 0, "challenging").otherwise("insufficient")


def profile(claims: DataFrame, by: str) -> DataFrame:
    """Per cluster: claims, independent groups, platforms, sides, state."""
    up, down = F.count_if(F.col("polarity") > 0), F.count_if(F.col("polarity") < 0)
    return claims.groupBy(by).agg(
        F.count("*").alias("claims"), F.countDistinct("independence").alias("independent"), F.countDistinct("platform").alias("platforms"), up.alias("supporting"), down.alias("challenging"), state(up, down).alias("state")
    )


def gates(metrics: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One boolean column for each gate, and sufficient: all of them."""
    out = metrics.select("*", *[F.coalesce(c, F.lit(False)).alias(name) for name, c in rules.items()])
    return out.withColumn("sufficient", sum((F.col(n).cast("int") for n in rules), F.lit(0)) == len(rules))


def decision(sufficient: Column, problem: Column, counter: Column, alternatives_suffice: Column, difference: Column, feasible: Column, narrow: Column) -> Column:
    """In this order: the gate, the strict case for stopping, the case for building, modification, more research."""
    return (
        F.when(~sufficient, "investigate_more").when((problem < 0) & alternatives_suffice & ~difference & (counter > 0), "kill")
        .when((problem > 0) & (counter < problem) & difference & feasible & ~narrow, "build_to_validate").when((problem > 0) & (narrow | ~feasible | ~difference), "modify").otherwise("investigate_more")
    )


def without_one(claims: DataFrame, by: str, weight: str) -> DataFrame:
    """For each claim: its group's total, the total without it, and whether the sign flips."""
    total = F.sum(weight).over(Window.partitionBy(by))
    return claims.withColumn("total", total).withColumn("without", F.col("total") - F.col(weight)).withColumn("flips", F.signum("total") != F.signum("without"))


def without_each(claims: DataFrame, by: str, distinct: dict[str, str], counts: dict[str, Column], tops: dict[str, str]) -> DataFrame:
    """What a group's figures are, and what they would be without one of its claims, for all claims at once.

    distinct: name and column of figures that count distinct values; counts: name and condition; tops: name and column of greatest
    values. A row for each kind of claim of a group (`by`), as claims of one kind leave the same behind: copies (how many there are),
    n and each name with the group's figures, and `without_` each. Distinct counts fall where a claim is the only one of its value, as a table of
    multiplicities tells; the greatest falls to the next where only one claim has it. Null values aren't counted, as by SQL; a
    null group is a group.
    """
    flags = {name: F.coalesce(c, F.lit(False)).alias(f"_{name}") for name, c in counts.items()}
    rows = claims.select(F.col(by).alias("_by"), *[F.col(c).alias(f"_{n}") for n, c in {**distinct, **tops}.items()], *flags.values())
    same = lambda other, *names: [F.col(n).eqNullSafe(F.col(f"{other}{n}")) for n in names]
    all_ = rows.groupBy("_by").agg(F.count("*").alias("n"), *[F.count_if(f"_{c}").alias(c) for c in counts], *[F.max(f"_{t}").alias(t) for t in tops])
    for d in distinct:
        times = rows.filter(F.col(f"_{d}").isNotNull()).groupBy("_by", f"_{d}").agg(F.count("*").alias("_m"))
        own = times.groupBy(F.col("_by").alias("x_by")).agg(F.count("*").alias(d))
        all_ = all_.join(own, same("x", "_by")[0], "left").drop("x_by").withColumn(d, F.coalesce(d, F.lit(0)))
        alone = times.filter("_m = 1").select(F.col("_by").alias("x_by"), F.col(f"_{d}").alias(f"x_{d}"), F.lit(True).alias(f"_alone_{d}"))
        rows = rows.join(alone, (F.col("_by").eqNullSafe(F.col("x_by"))) & (F.col(f"_{d}") == F.col(f"x_{d}")), "left").drop("x_by", f"x_{d}")
    rows = rows.join(all_.withColumnRenamed("_by", "x_by"), F.col("_by").eqNullSafe(F.col("x_by"))).drop("x_by")
    kind = [*[F.coalesce(f"_alone_{d}", F.lit(False)).alias(f"_alone_{d}") for d in distinct], *[F.col(f"_{c}") for c in counts], *[F.coalesce(F.col(f"_{t}") == F.col(t), F.lit(False)).alias(f"_top_{t}") for t in tops]]
    figures = ["n", *distinct, *counts, *tops]
    kinds = rows.select("_by", *figures, *kind).groupBy("_by", *figures, *[f"_alone_{d}" for d in distinct], *[f"_{c}" for c in counts], *[f"_top_{t}" for t in tops]).agg(F.count("*").alias("copies"))
    for t in tops:
        under = rows.filter(F.col(f"_{t}") < F.col(t)).groupBy(F.col("_by").alias("x_by")).agg(F.max(f"_{t}").alias(f"_next_{t}"))
        most = rows.filter(F.col(f"_{t}") == F.col(t)).groupBy(F.col("_by").alias("y_by")).agg(F.count("*").alias(f"_most_{t}"))
        kinds = kinds.join(under, F.col("_by").eqNullSafe(F.col("x_by")), "left").join(most, F.col("_by").eqNullSafe(F.col("y_by")), "left").drop("x_by", "y_by")
    out = {"n": F.col("n") - 1} | {d: F.col(d) - F.col(f"_alone_{d}").cast("int") for d in distinct} | {c: F.col(c) - F.col(f"_{c}").cast("int") for c in counts}
    out |= {t: F.when(F.col(f"_top_{t}") & (F.col(f"_most_{t}") == 1), F.col(f"_next_{t}")).otherwise(F.col(t)) for t in tops}
    return kinds.select(F.col("_by").alias(by), "copies", *figures, *[c.alias(f"without_{name}") for name, c in out.items()])


def stability(flips: Column) -> Column:
    return F.when(flips == 0, "stable").when(flips <= 2, "sensitive").otherwise("fragile")


def priority(severity: Column, gain: Column, fit: Column, independence: Column, freshness: Column, cost: Column, redundancy: Column) -> Column:
    return severity * gain * fit * independence * freshness - cost - redundancy


def value_of_information(impact: Column, flip: Column, verifiable: Column, cost: Column, time: Column, limits: Column, repeated: Column) -> Column:
    return impact * flip * verifiable / (1 + cost + time + limits) / (1 + repeated)


def flags(**checks: Column) -> Column:
    """Names of the checks that hold, in the given order."""
    return F.array_compact(F.array(*[F.when(c, name) for name, c in checks.items()]))


def readiness(product: Column, user: Column, problem: Column, niche: Column) -> Column:
    """Intake: nothing known, the core without a niche, or all."""
    core = product & user & problem
    return F.when(~(product | user | problem), "needs_clarification").when(core & niche, "ready").when(core, "broad_but_continue").otherwise("needs_clarification")


def bound(claims: DataFrame, segments: DataFrame) -> DataFrame:
    """Citations against segments of the same id: valid only if hash and version match and the quote stands where it says."""
    joined = claims.join(segments, "segment_id", "left")
    there = F.substring(F.col("segment"), F.col("quote_start") + 1, F.length("quote")) == F.col("quote")
    return joined.withColumn(
        "binding",
        F.when(F.col("segment").isNull(), "source_removed").when((F.col("claim_hash") != F.col("segment_hash")) & F.contains("segment", "quote"), "stale_binding").when(F.coalesce(there, F.lit(False)), "valid").otherwise("invalid"),
    )


def scoped(rows: DataFrame, tenant: str) -> DataFrame:
    """A tenant's rows; tables without tenants have none to give."""
    if "tenant_id" not in rows.columns:
        raise ValueError("the table has no tenant_id")
    return rows.filter(F.col("tenant_id") == tenant)


def reusable(artifacts: DataFrame, policies: DataFrame, kind: str, collected: str, at: Column) -> DataFrame:
    """Adds reusable and the reason against it. policies: kind, days, licensed; a row for each kind of source."""
    own = artifacts.join(policies, kind, "left")
    expired = F.expr(f"{collected} + make_dt_interval(days)") < at
    reason = F.when(F.col("days").isNull(), "no_policy").when(~F.col("licensed"), "licence").when(expired, "expired")
    return own.withColumn("reason", reason).withColumn("reusable", F.col("reason").isNull())


def domain_signal(answers: Column, registered: Column, certified: Column, alike: Column) -> Column:
    """The most that was seen of a domain."""
    return F.when(answers, "active_website_signal").when(registered, "registered_domain_signal").when(certified, "historical_certificate_signal").when(alike, "brand_collision_candidate").otherwise("not_verified")


def pillar_status(sources: Column, supporting: Column, challenging: Column) -> Column:
    return F.when(sources < 2, "insufficient").when(supporting > 2 * challenging, "strong").when(supporting > challenging, "mixed").otherwise("weak")


def maturity(competitors: Column, sightings: Column, since: Column, fresh: Column) -> Column:
    """existing, resegmented, emerging, new or unknown."""
    return F.when(sightings < 5, "unknown").when(competitors <= 2, "new").when(fresh > 0.6, "emerging").when((since <= 1994) & (fresh < 0.2), "existing").otherwise("resegmented")


def gap_rounds(rounds: DataFrame, gap: str, turn: str, found: str, target: float, least: float, most: int) -> DataFrame:
    """Adds coverage, why a round is the last (stop), and whether it runs: no round before it was the last."""
    w = Window.partitionBy(gap).orderBy(turn)
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    c = rounds.withColumn("coverage", F.sum(found).over(upto) / F.sum(found).over(Window.partitionBy(gap)))
    c = c.withColumn("gain", F.col("coverage") - F.coalesce(F.lag("coverage").over(w), F.lit(0)))
    c = c.withColumn("stop", F.when(F.col("coverage") >= target, "target_reached").when(F.col("gain") < least, "no_new_evidence").when(F.col(turn) >= most, "budget_exhausted"))
    return c.withColumn("runs", F.count("stop").over(earlier) == 0)


def dense(labelled: DataFrame, least: int) -> DataFrame:
    """node, group: the component of nodes whose component has `least` nodes; null for the rest."""
    sizes = labelled.groupBy("component").agg(F.count("*").alias("n"))
    return labelled.join(sizes, "component").select("node", F.when(F.col("n") >= least, F.col("component")).alias("group"))
