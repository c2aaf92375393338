"""Queries over whole tables, where rows outside the ids of the first forms decide."""

from datetime import datetime

import pandas as pd

from siltstone.plans import registry
from tests import oracle


def stored(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_status_counts_every_event(spark, tmp_path):
    at = datetime(2024, 1, 1)
    sf = stored(spark, tmp_path, events=([(7, at, 1, "view", 10.0), (8, at, 1, "view", 90.0), (9, at, 2, "signup", 110.0)], "event_id long, ts timestamp, user_id long, event_type string, value double"))
    got = dict(registry.QUERIES["f13_method_status"](spark, sf).collect())
    assert got == {1: "succeeded", 2: "rate_limited"}


def test_prices_and_plan_take_every_key(spark, sf):
    whole = registry.QUERIES["w12_price_history"](spark, sf)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").filter("l_quantity > 0").count()
    assert whole.groupBy().sum("n").first()[0] == lines
    fits = spark.read.parquet(f"{sf}/supplier.parquet").select("s_nationkey").toPandas()["s_nationkey"]
    regions = spark.read.parquet(f"{sf}/region.parquet").select("r_regionkey", "r_name").collect()
    got = {r["intent"]: r["sources"] for r in registry.QUERIES["j11_j12_query_plan"](spark, sf).collect()}
    assert got == {r["r_name"]: int(((fits + r["r_regionkey"]) % 3 == 0).sum()) for r in regions}


def test_groups_keep_nodes_apart(spark, tmp_path):
    rows = [(3, 5), (7, 5), (403, 405), (503, 805), (9, 1)]
    sf = stored(spark, tmp_path, orders=(rows, "o_orderkey long, o_custkey long"))
    got = dict(registry.QUERIES["g01_g03_independence_groups"](spark, sf).collect())
    groups = {}
    for o, c in rows:
        groups.setdefault(c, {2 * c}).add(2 * o + 1)
    assert got == {node: min(g) for g in groups.values() for node in g}


def test_names_against_brute_force(spark, tmp_path):
    words = "red blue green azure misty olive pale dark navy tan".split()
    names = [f"{words[i % 10]} {words[i * 7 % 9]} {'Steel' if i % 4 else 'steel rod'}" for i in range(60)]
    rows = [(400 + i, n) for i, n in enumerate([*names, "ab", "ab", "abc", "", None])]
    sf = stored(spark, tmp_path, part=(rows, "p_partkey long, p_name string"))
    got = registry.QUERIES["j15_fuzzy_names"](spark, sf).toPandas()
    grams = {n.lower(): {f"  {n.lower()} "[k : k + 3] for k in range(len(n) + 1)} for _, n in rows if n is not None}
    want = {(a, b): round(len(grams[a] & grams[b]) / len(grams[a] | grams[b]), 6) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.6}
    pairs = got[pd.notna(got["other"])]
    assert {(r.name_, r.other): r.similarity for r in pairs.rename(columns={"name": "name_"}).itertuples()} == want and len(want) > 20 and len(pairs) == len(want)
    members = got[pd.isna(got["other"])]
    assert sorted(zip(members["p_partkey"], members["name"])) == sorted((k, n.lower()) for k, n in rows if n is not None)


def test_balances_on_a_limit_are_those_of_sql(spark, tmp_path):
    """Amounts that are 500 or 1000 together, but a bit more or less as doubles; an amount that is infinite, and none."""
    own = [
        [70.98, 138.32, 9.52, 72.65, 143.49, 65.04, 500.0], [162.47, 76.38, 113.28, 75.66, 71.7, 0.51, 0.0], [245.57, 56.67, 287.68, 333.21, 70.74, 6.13], [282.89, 13.65, 147.71, 11.71, 260.39, 283.65],
        [None, 250.0, None, 250.0, 500.0], [1.0, float("inf"), 2.0],
    ]
    rows = [(10 * u + k, datetime(2024, 1, 1), u, "view", v) for u, amounts in enumerate(own) for k, v in enumerate(amounts)]
    sf = stored(spark, tmp_path, events=(rows, "event_id long, ts timestamp, user_id long, event_type string, value double"))
    name = "w08_ledger_balance"
    assert oracle.differences(spark, oracle.connect(sf), registry.QUERIES[name], registry.SQL[name], sf) == ""
    got = {r["event_id"]: (r["warns"], r["admitted"]) for r in registry.QUERIES[name](spark, sf).collect()}
    assert (got[5], got[15], got[25], got[35]) == ((True, True), (False, True), (True, False), (True, True))
