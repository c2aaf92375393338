"""Rebound quotes, jobs with timers and counterfactuals against brute force."""

import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import evidence, filters, rebinding
from siltstone.plans import registry
from siltstone.sources.tables import Folder
from siltstone.streaming import jobs, progress


@pytest.mark.parametrize("most", [2, 32])
def test_rebound(spark, most):
    """Quotes at ends of segments, over their borders, of other documents, short, repeated, null and empty; null documents and segments."""
    rng = random.Random(6)
    letters = "ab é日"
    texts = {d: ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 12))] for d in range(25)}
    texts[3] = ["same same same"] * 40
    segments = [(d, k, s) for d, own in texts.items() for k, s in enumerate(own)] + [(90, 0, None)]
    quotes = [(d, own[k][a : a + rng.randint(1, 50)]) for d, own in texts.items() for k in range(len(own)) for a in (0, 3, max(0, len(own[k]) - 5))]
    quotes += [((d + 1) % 25, q) for d, q in quotes[::3]] + [(d, q + "x") for d, q in quotes[::4]] + [(3, "same same")] * 6 + [(0, None), (0, ""), (None, "a"), (77, "a"), (90, "a")]
    bindings = [(k, d, q, "old") for k, (d, q) in enumerate(quotes)]
    table = spark.createDataFrame(bindings, "citation_id long, document_id long, quote string, binding_status string").repartition(3)
    new = spark.createDataFrame(segments, "document_id long, sequence int, segment string").repartition(4)
    got = rebinding.rebound(table, new, Folder(spark, "t"), "2", most).collect()
    assert len(got) == len(quotes)
    seen = Counter()
    for r in got:
        d, q = quotes[r["citation_id"]]
        if d is None or not q:
            want = ("invalid", None, None, 0)
        elif d not in texts and d != 90:
            want = ("source_removed", None, None, 0)
        else:
            hits = [(k, s.index(q)) for k, s in enumerate(texts.get(d, [])) if q in s]
            want = ("valid", *hits[0], len(hits)) if hits else ("stale_binding", None, None, 0)
        seen[want[0]] += 1
        assert (r["binding_status"], r["sequence"], r["quote_start"], r["places"]) == want and r["normalization_version"] == "2"
    assert min(seen[s] for s in ("valid", "stale_binding", "source_removed", "invalid")) > 0 and seen["stale_binding"] > 20


def test_rebound_nothing(spark):
    none = spark.createDataFrame([], "citation_id long, document_id long, quote string")
    new = spark.createDataFrame([(1, 0, "a")], "document_id long, sequence int, segment string")
    assert rebinding.rebound(none, new, Folder(spark, "t"), "2").count() == 0
    one = spark.createDataFrame([(1, 1, "a")], none.schema)
    assert rebinding.rebound(one, new.limit(0), Folder(spark, "t"), "2").first()["binding_status"] == "source_removed"


def test_filter_has_every_anchor(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("anchor"))
    mask = filters.of(keys, "anchor", 1 << 18)
    bits = [b % (1 << 18) for r in keys.collect() for b in (r["anchor"], (r["anchor"] % (1 << 64)) >> 32)]
    assert filters.has(mask, np.array([r["anchor"] for r in keys.collect()])).all() and int(sum(bin(x).count("1") for x in mask)) == len(set(bits))
    others = np.array([r[0] for r in spark.range(10**6, 10**6 + 5000).select(F.xxhash64("id")).collect()])
    assert filters.has(mask, others).mean() < 0.01


def jobs_by_hand(events, limit, budget, days, upto):
    out, state = Counter(), {}
    for origin, event, ts, failed, ends in sorted(events, key=lambda e: (e[2], e[1])):
        s = state.setdefault(origin, {"deadline": ts + timedelta(days=days), "run": 0, "done": 0, "open": False, "end": None})
        if s["end"] is None and ts >= s["deadline"]:
            s["end"] = "cancelled"
        if s["end"]:
            out[origin, event, "late", None] += 1
        elif s["open"]:
            out[origin, event, "suppressed", "origin_circuit_open"] += 1
        elif s["done"] >= budget:
            out[origin, event, "suppressed", "budget_exhausted"] += 1
        else:
            s["done"] += 1
            s["run"] = s["run"] + 1 if failed else 0
            s["open"] = s["run"] >= limit
            out[origin, event, "done", None] += 1
            if ends:
                s["end"] = "completed"
    for origin, s in state.items():
        end = s["end"] or ("cancelled" if s["deadline"] <= upto else None)
        if end:
            out[origin, None, end, "origin_job_timeout" if end == "cancelled" else None] += 1
    return out


@pytest.fixture()
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, jobs.ROCKSDB)
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("limit,budget,days", [(3, 40, 20), (2, 5, 3)])
def test_jobs_stream_and_table(spark, sf, tmp_path, rocksdb, limit, budget, days):
    """Files of events in order of time, one a batch: timers, budget, circuit and ends give what the whole table and a loop give."""
    rows = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id").toPandas()
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(5):
        rows.iloc[k * len(rows) // 5 : (k + 1) * len(rows) // 5].to_parquet(folder / f"events-{k}.parquet", coerce_timestamps="us")
    failed, ends = F.expr("event_type = 'error'"), F.expr("event_type = 'purchase' AND value > 150")
    source = progress.read_events(spark, str(folder)).withColumn("origin", F.col("user_id"))
    for _ in range(2):  # a second run finds nothing new
        progress.to_table(jobs.stream(source, failed, ends, limit=limit, budget=budget, days=days), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = Counter(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("origin", "event_id", "status", "reason").collect()))
    upto = rows["ts"].max().to_pydatetime() - timedelta(hours=1)
    events = [(u, e, t.to_pydatetime(), k == "error", k == "purchase" and v > 150) for e, t, u, k, v in zip(rows["event_id"], rows["ts"], rows["user_id"], rows["event_type"], rows["value"])]
    want = jobs_by_hand(events, limit, budget, days, upto)
    table = spark.read.parquet(f"{sf}/events.parquet").withColumn("origin", F.col("user_id"))
    batch = Counter(map(tuple, jobs.batch(table, failed, ends, F.lit(upto), limit, budget, days).collect()))
    assert batch == want
    # the watermark is in whole milliseconds and an hour behind the newest event
    assert got == want
    assert {s for _, _, s, _ in want} >= {"done", "suppressed", "late", "cancelled"}


def test_jobs_need_their_store(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        jobs.stream(spark.createDataFrame([(1, 2, datetime(2024, 1, 1))], "origin long, event_id long, ts timestamp"), F.lit(False), F.lit(False))


def test_sliding_windows_and_sessions(spark, sf, tmp_path):
    """Streams equal their batch forms for all windows and sessions that have closed."""
    spark.read.parquet(f"{sf}/events.parquet").coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source = lambda: progress.read_events(spark, str(tmp_path / "in"), "*.parquet")
    end = batch.agg(F.max("ts") - F.expr("INTERVAL 1 HOUR")).first()[0]
    cases = (
        (progress.windowed(source(), "2 days", "12 hours"), batch.groupBy(F.window("ts", "2 days", "12 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), ["w.start", "w.end", "event_type", "n"]),
        (progress.sessions(source(), "10 hours"), batch.groupBy("user_id", F.session_window("ts", "10 hours").alias("w")).agg(F.count("*").alias("n")), ["user_id", "w.start", "w.end", "n"]),
    )
    for k, (stream, table, columns) in enumerate(cases):
        progress.to_table(stream, str(tmp_path / f"out{k}"), str(tmp_path / f"state{k}")).awaitTermination()
        got = spark.read.parquet(str(tmp_path / f"out{k}")).select([c.split(".")[-1] for c in columns if k or c != "w.end"])
        # ends are compared here: Spark would take such a filter below the merging of sessions
        want = [tuple(x for c, x in zip(columns, r) if k or c != "w.end") for r in table.select(columns).collect() if r["end"] <= end]
        assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50


def test_without_each(spark):
    """Against taking out each claim in turn; ties, only ones, nulls and a null group."""
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["a", "b", "c", None, f"x{k}"]), rng.choice([5, 6, None]), rng.choice([1.0, 2.0, 9.0, None, float(k)]), rng.choice([True, False, None])) for k in range(70)] + [(8, "a", 5, 1.0, True), (9, None, None, None, None)]
    table = spark.createDataFrame(rows, "g int, v string, p int, x double, b boolean").repartition(3)
    got = Counter()
    for r in evidence.without_each(table, "g", {"voices": "v", "places": "p"}, {"yes": F.col("b")}, {"most": "x"}).collect():
        got[tuple(r[c] for c in ("g", "n", "voices", "places", "yes", "most", "without_n", "without_voices", "without_places", "without_yes", "without_most"))] += r["copies"]

    def figures(own):
        xs = [r[3] for r in own if r[3] is not None]
        return len(own), len({r[1] for r in own} - {None}), len({r[2] for r in own} - {None}), sum(bool(r[4]) for r in own), max(xs, default=None)

    want = Counter()
    for i, r in enumerate(rows):
        own = [(k, o) for k, o in enumerate(rows) if o[0] == r[0]]
        want[(r[0], *figures([o for _, o in own]), *figures([o for k, o in own if k != i]))] += 1
    assert got == want


def test_registered_rows_vary(spark, sf):
    kinds = {name: {r[0] for r in registry.QUERIES[name](spark, sf).select(column).distinct().collect()} for name, column in (("j17_rebound_quotes", "binding_status"), ("r04_r06_jobs", "status"), ("g06_a22_counterfactuals", "decision"))}
    assert kinds["j17_rebound_quotes"] == {"valid", "stale_binding", "source_removed"} and len(kinds["r04_r06_jobs"]) >= 4


def test_only_segments_with_an_anchor_are_sent(spark):
    texts = [(k % 40, k, f"{k % 7} words of {k} " * (k % 5)) for k in range(400)] + [(None, 0, "of"), (3, 401, None)]
    asked = sorted({(k % 50, t) for k in range(200) for t in (f"words of {k} ", "absent everywhere", "of")})
    new = spark.createDataFrame(texts, "document_id long, sequence long, segment string")
    keyed = rebinding.anchors(spark.createDataFrame(asked, "document_id long, quote string"), 8).localCheckpoint()
    got = rebinding.places(new, keyed, sorted(r[0] for r in keyed.select("length").distinct().collect())).collect()
    heads = {(d, q[: 1 << min(3, len(q).bit_length() - 1)]) for d, q in asked}
    want = sorted((d, k) for d, k, t in texts if t for h in {h for of, h in heads if of == d} if h in t)
    assert sorted((r["document_id"], r["sequence"]) for r in got) == want and want
