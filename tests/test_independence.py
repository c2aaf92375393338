"""Independence by several kinds of ties against union-find, profiles and gates against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.operators import independence
from siltstone.sources.tables import Folder


def reached(rows):
    """The least node of each that shares a value of a kind with another, by union-find."""
    up = {n: n for n, *_ in rows}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    first = {}
    for n, kind, value in rows:
        a, b = top(n), top(first.setdefault((kind, value), n))
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in up}


def tie(spark, rows):
    schema = "id string, publisher string, quotes array<string>, other string"
    return independence.ties(spark.createDataFrame(rows, schema), F.col("id"), {"publisher": F.col("publisher"), "quote": F.col("quotes")})


def test_groups_against_union_find(spark):
    rng = random.Random(3)
    for hot in (False, True):  # one publisher of a third of all
        rows = [(f"n{k:03}", "hot" if hot and k % 3 == 0 else rng.choice([None, "", f"p{rng.randrange(300)}"]), [f"q{rng.randrange(500)}" for _ in range(rng.randrange(3))], "x") for k in range(300)]
        rows += rows[:7] + [("n900", None, None, None), (None, "p1", ["q1"], "x"), ("n901", "p1", [None, "", "q1", "q1"], "x")]
        found, kinds = independence.groups(tie(spark, rows), Folder(spark, "t"))
        values = [(n, k, v) for n, p, q, _ in rows if n for k, v in [("publisher", p), *(("quote", x) for x in q or [])] if v]
        want = reached(values)
        sizes = {r: sum(x == r for x in want.values()) for r in want.values()}
        assert {r["node"]: r["independence"] for r in found.collect()} == {n: r for n, r in want.items() if sizes[r] > 1}
        named = {}
        for n, kind, v in values:
            if len({m for m, k, w in values if (k, w) == (kind, v)}) > 1:
                named.setdefault(want[n], set()).add(kind)
        assert {r["independence"]: set(r["kinds"]) for r in kinds.collect()} == named


def test_same_value_of_two_kinds_ties_nothing(spark):
    rows = [("a", "v", None, ""), ("b", None, ["v"], ""), ("c", None, ["w", "v"], "")]
    found, _ = independence.groups(tie(spark, rows), Folder(spark, "t"))
    assert {tuple(r) for r in found.collect()} == {("b", "b"), ("c", "b")}
    assert independence.groups(tie(spark, rows[:1]), Folder(spark, "t"))[0].count() == 0
    assert tie(spark, [("a", "", [], "x")]).count() == 0


CLAIMS = "cluster int, node string, independence string, family string, platform string, language string, at timestamp, polarity int, direct boolean, engagement double, blocked boolean, priced boolean"
NOW = datetime(2024, 1, 31)


def claim(cluster, k, **other):
    base = dict(node=f"n{k}", independence=f"i{k // 2}", family=f"f{k % 3}", platform=("web", "forum")[k % 2], language=("en", "fr")[k % 2], at=NOW - timedelta(days=k), polarity=1, direct=k == 0, engagement=float(k), blocked=False, priced=k == 1)
    return (cluster, *{**base, **other}.values())


@pytest.fixture(scope="module")
def profiled(spark):
    rows = [claim(1, k, polarity=-1 if k == 5 else 1) for k in range(30)] + [claim(2, 0, independence=None, at=None, platform=None, language=None, polarity=None, direct=None, engagement=None, blocked=None, priced=None)] + [claim(None, k, independence="one", blocked=True) for k in range(4)]
    return independence.profile(spark.createDataFrame(rows, CLAIMS), "cluster", F.lit(NOW), ["web", "forum"], 10, 20)


def test_profile(profiled):
    got = {r["cluster"]: r for r in profiled.collect()}
    one = got[1]
    assert (one["claims"], one["sources"], one["independent_source_count"], one["independent_source_families"], one["platforms"], one["direct"]) == (30, 30, 15, 3, 2, 1)
    assert tuple(one["recency_distribution"]) == (11, 10, 9) and tuple(one["engagement_context"]) == (14, 15)
    assert one["duplicate_ratio"] == 0.5 and one["data_limitations"] == ["duplicate_heavy_corpus"]
    assert (one["supporting"], one["challenging"]) == (29, 1)
    assert tuple(got[2]["recency_distribution"]) == (0, 0, 1) and got[2]["direct"] == 0 and got[2]["engagement_context"]["web"] is None
    assert got[2]["data_limitations"] == ["language_coverage_limited", "recency_limited", "single_platform_bias", "duplicate_heavy_corpus", "insufficient_pricing_data", "insufficient_user_voice"]
    assert got[None]["blocked"] == 4 and "source_unavailable" in got[None]["data_limitations"]


@pytest.mark.parametrize("gate", independence.GATES)
def test_each_gate_alone_fails_a_decision(profiled, gate):
    """Ten gates hold, and with one figure changed its own fails and no other."""
    p = profiled.filter("cluster = 1").withColumn("duplicate_ratio", F.lit(0.1)).withColumn("data_limitations", F.array(F.lit("recency_limited")))
    change = {"independent_enough": ("independent_source_count", 1), "few_duplicates": ("duplicate_ratio", 0.9), "counter_evidence_sought": ("challenging", 0), "recent_enough": ("recent", 1), "access_undistorted": ("blocked", 29), "languages_covered": ("languages", 1)}
    columns = dict(intents=F.lit(5), critical=F.lit(True), needed=F.lit(30), harmful=("single_platform_bias",))
    for name in (None, gate):
        q = p
        if name in change:
            q = p.withColumn(change[name][0], F.lit(change[name][1]))
        elif name:
            columns |= {"intents_covered": {"intents": F.lit(4)}, "no_critical_gap": {"critical": F.lit(None).cast("boolean")}, "fits_maturity": {"needed": F.lit(31)}, "limits_harmless": {"harmful": ("recency_limited",)}}[name]
        row = independence.sufficient(q, independent=10, intents_least=5, **columns).first()
        assert row["failed"] == ([name] if name else []) and row["sufficient"] == (name is None)
