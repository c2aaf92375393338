"""Accounting of acquisition: outcomes, circuits, leases, budgets, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OUTCOMES = ["succeeded", "no_results", "challenge", "source_unavailable", "rate_limited", "blocked_by_policy", "invalid_output", "partial", "failed", "not_applicable", "cancelled", "unresolved_official_origin"]


def error_class(status: Column, network_error: Column) -> Column:
    return (
        F.when(network_error, "TransientProvider").when(status == 429, "RateLimited").when(status.isin(401, 403), "AuthenticationError")
        .when(status >= 500, "TransientProvider").when(status >= 400, "PermanentSource").when(status == 202, "PolicyBlocked")
    )


def outcome(status: Column, network_error: Column) -> Column:
    return (
        F.when(network_error | (status >= 500), "source_unavailable").when(status == 429, "rate_limited").when(status.isin(202, 401, 403), "challenge")
        .when(status >= 400, "failed").otherwise("succeeded")
    )


def circuit(tx: DataFrame, by: str, order: list[str], limit: int = 3) -> DataFrame:
    """Adds run (consecutive transient errors), opens and suppressed (stands after an opening).

    A hard status opens at once, the `limit`-th transient error in a row opens too, and any other status starts the run anew.
    """
    w = Window.partitionBy(by).orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    transient = F.coalesce(F.col("network_error") | (F.col("status") >= 500), F.lit(False))
    hard = F.coalesce(F.col("status").isin(202, 401, 403, 429), F.lit(False))
    rows = tx.withColumn("transient", transient.cast("int")).withColumn("island", F.sum(1 - F.col("transient")).over(upto))
    inner = Window.partitionBy(by, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum("transient").over(inner)).withColumn("opens", hard | (F.col("run") >= limit))
    return rows.withColumn("suppressed", F.coalesce(F.max("opens").over(before), F.lit(False))).drop("transient", "island")


def leases(requests: DataFrame, key: str, requested: str, budget: int, per_range: int = 100_000) -> DataFrame:
    """Greedy leases in order of key: what is requested, as far as the budget goes. One row a key.

    Keys are cut into ranges of some `per_range` at hashed keys; a running sum is over a range, beside the sum of the ranges before.
    """
    step = F.lit(per_range).cast("long")
    bounds = requests.filter(F.pmod(F.xxhash64(key), step) == 0).agg(F.array_sort(F.collect_set(key)).alias("bounds"))
    ranged = requests.withColumn("_bounds", bounds.scalar()).withColumn("_range", F.size(F.filter("_bounds", lambda b: b <= F.col(key)))).drop("_bounds")
    sums = ranged.groupBy("_range").agg(F.sum(requested).alias("_sum"))
    offsets = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    before = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.col("_offset") + F.coalesce(F.sum(requested).over(before), F.lit(0))
    return ranged.join(offsets, "_range").withColumn("lease", F.greatest(F.lit(0), F.least(F.col(requested), F.lit(budget) - taken))).select(*requests.columns, "lease")


def merged_candidates(rows: DataFrame, url: str, canonical: str, order: str, lineage: list[str]) -> DataFrame:
    """One row for each canonical URL: the first row's fields, and every lineage value once, in order of appearance."""
    key = F.coalesce(F.nullif(F.col(canonical), F.lit("")), F.col(url))
    lists = [
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("v")))), lambda x: x["v"])).alias(c + "s") for c in lineage
    ]
    return rows.groupBy(key.alias("key")).agg(F.min_by(url, order).alias(url), F.count("*").alias("n"), *lists)


def first_in(rows: DataFrame, by: list[str], order: list[str], n: int = 1) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")


def not_seen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def method_rates(methods: DataFrame, key: str = "method_id") -> DataFrame:
    """Per method: records, records by outcome, sum of transactions, share that succeeded."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    return methods.groupBy(key).agg(F.count("*").alias("records"), *counts, F.sum("transactions").alias("transactions"), F.bround(F.avg((F.col("outcome") == "succeeded").cast("int")), 4).alias("success"))


def method_status(outcomes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """What a method's outcomes amount to: results, else the first challenge or rate limit, else a policy, else none."""
    first_hard = F.min(F.when(F.col("outcome").isin("challenge", "rate_limited"), F.struct(*order, "outcome")))
    return outcomes.groupBy(key).agg(
        F.when(F.count_if(F.col("candidates") > 0) > 0, "succeeded").when(first_hard.isNotNull(), first_hard["outcome"])
        .when(F.count_if(F.col("outcome") == "blocked_by_policy") > 0, "blocked_by_policy")
        .when(F.count_if(F.col("outcome") != "succeeded") == 0, "no_results").otherwise("source_unavailable").alias("status")
    )


def reported(sources: DataFrame, sites: DataFrame, key: str) -> DataFrame:
    """All sources with their report; those without one say so."""
    return sources.join(sites, key, "left").withColumn("outcome", F.coalesce("outcome", F.lit("not_reported"))).withColumn("stop_reason", F.coalesce("stop_reason", F.lit("missing_from_input_report")))


def freshest(requests: DataFrame, artifacts: DataFrame, key: str, at: str, collected: str, seconds: int) -> DataFrame:
    """Requests with the latest artifact of the same key not after them and at most `seconds` older, the greatest id of equals.

    Both sides are read once in order of time. A key is cut into spans of `seconds`, and an artifact stands in its own span
    and the next, so that what one task orders is a key's rows of two spans. Requests without a key or time have none.
    """
    kind = artifacts.schema[collected].dataType

    def span(time):
        return F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast(kind), time) / seconds)

    some = artifacts.filter(F.col(key).isNotNull() & F.col(collected).isNotNull())
    seen = some.select(F.col(key).alias("k"), F.col(collected).alias("t"), F.col("artifact_id").alias("a"), F.explode(F.array(span(F.col(collected)), span(F.col(collected)) + 1)).alias("span"))
    asked = requests.select(F.col(key).alias("k"), F.col(at).alias("t"), span(F.col(at)).alias("span"), F.struct(*requests.columns).alias("r"))
    both = seen.unionByName(asked, allowMissingColumns=True)
    # a request follows the artifacts of its own moment
    w = Window.partitionBy("k", "span").orderBy("t", F.col("r").isNotNull(), "a").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("a").isNotNull(), F.struct("t", "a")), ignorenulls=True).over(w)
    out = both.withColumn("last", last).filter("r is not null")
    return out.select("r.*", F.when(F.col("last.t") >= F.col("t") - F.expr(f"INTERVAL {seconds} SECONDS"), F.col("last.a")).alias("artifact_id"))


def redirects(starts: DataFrame, hops: DataFrame, most: int = 3) -> DataFrame:
    """url, final, hops: follows a table (url, target) `most` times at most; each hop is one join."""
    out = starts.select("url", F.col("url").alias("final"), F.lit(0).alias("hops"))
    for _ in range(most):
        step = hops.select(F.col("url").alias("final"), "target")
        out = out.join(step, "final", "left").select("url", F.coalesce("target", "final").alias("final"), (F.col("hops") + F.col("target").isNotNull().cast("int")).alias("hops"))
    return out


def ledger(rows: DataFrame, by: str, order: list[str], amount: str, soft: float, hard: float, exact: bool = True) -> DataFrame:
    """Running balance of reservations, and whether each crosses the soft limit or is beyond the hard one.

    Amounts are added as decimals of ten places, so that a balance on a limit is on it whatever the order of adding; from the
    first amount on that those can't hold, a group's balances are sums of doubles. Unless `exact`, amounts are added in turn as they are.
    """
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if not exact:
        return rows.withColumn("balance", F.sum(amount).over(w)).withColumns({"warns": F.col("balance") > soft, "admitted": F.col("balance") <= hard})
    whole = F.col(amount).try_cast("decimal(28,10)")
    other = F.coalesce(F.bool_or(F.col(amount).isNotNull() & F.coalesce(whole.cast("double") != F.col(amount).cast("double"), F.lit(True))).over(w), F.lit(False))
    out = rows.withColumn("_exact", F.sum(whole).over(w)).withColumn("_other", F.when(other, F.sum(F.col(amount).cast("double")).over(w)))

    def either(f):
        return F.when(F.col("_other").isNotNull(), f(F.col("_other"))).otherwise(f(F.col("_exact")))

    limit = lambda x: F.lit(str(x)).cast("decimal(28,10)")
    balance = F.coalesce("_other", F.col("_exact").cast("double"))
    return out.withColumns({"balance": balance, "warns": either(lambda b: b > limit(soft)), "admitted": either(lambda b: b <= limit(hard))}).drop("_exact", "_other")


def second_pass(sources: DataFrame, first: DataFrame, key: str) -> DataFrame:
    """Adds what to fetch of each source (key, official_origin) next, from the outcomes of its first pass (key, method, outcome)."""
    found = first.groupBy(key).agg(F.bool_or((F.col("method") == "rss_link_discovery") & (F.col("outcome") == "succeeded")).alias("rss_signal"), F.max(F.when(F.col("method") == "root_html", F.col("outcome"))).alias("root_outcome"))
    known = F.col("official_origin").isNotNull()
    none = F.array().cast("array<string>")
    return sources.join(found, key, "left").withColumns({
        "selected": F.when(known, F.array(*map(F.lit, ("robots_preflight", "root_html", "sitemap_xml")))).otherwise(none), "conditional": F.when(known, F.array(F.lit("rss_feed"))).otherwise(none),
        "rss_signal": F.coalesce("rss_signal", F.lit(False)), "root_outcome": F.coalesce("root_outcome", F.lit("not_reported")), "stop_reason": F.when(known, "adaptive_core_selected").otherwise("unresolved_official_origin"),
    })


def apart(records: DataFrame, stopped: Column) -> tuple[DataFrame, DataFrame]:
    """Records that went out, and those that policy stopped before; none is in both."""
    is_stopped = F.coalesce(stopped, F.lit(False))
    return records.filter(~is_stopped), records.filter(is_stopped)
