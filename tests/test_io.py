import json

import pytest
from pyspark.sql import functions as F

from siltstone.sources import sinks, stored
from siltstone.streaming import progress


def source(k, **more):
    return {"source_id": f"s{k}", "display_name": f"S{k}", "resolution_status": "resolved_official_origin", "official_origin": f"https://s{k}.example", "api_endpoints": [], **more}


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"schema_version": "1", "manifest_id": "m", "expected_unique_sources": 2, "sources": [source(1), source(2)]}))
    assert stored.manifest(spark, str(path)).count() == 2
    path.write_text(json.dumps({"manifest_id": "m", "expected_unique_sources": 2, "sources": [source(1), source(1)]}))
    with pytest.raises(ValueError, match="1 names"):
        stored.manifest(spark, str(path))


def test_report_keeps_sites_without_methods(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"run_id": "r", "sites": [{"source_id": "a", "outcome": "failed", "methods": []}, {"source_id": "b", "methods": [{"method_id": "m1", "candidates": []}, {"method_id": "m2"}]}]}))
    assert {(r["site"], r["method_id"]) for r in stored.report_methods(spark, str(path)).collect()} == {("a", None), ("b", "m1"), ("b", "m2")}



def test_bullets(spark, tmp_path):
    path = tmp_path / "l.md"
    path.write_text("# T\n- One\n- Two\ntext\n- One\n")
    assert sorted(r["name"] for r in stored.bullets(spark, str(path)).collect()) == ["One", "Two"]


def test_robots_rules(spark):
    rules = stored.robots_rules(spark.createDataFrame([("o", "Disallow: /before\nUser-agent: *\nDisallow: /private # x\nAllow: /\nUser-agent: bot\nDisallow: /")], "origin string, body string"))
    asks = spark.createDataFrame([("o", "/private/a"), ("o", "/b"), ("p", "/")], "origin string, path string")
    assert {(r["origin"], r["path"]): r["allowed"] for r in stored.may_fetch(asks, rules).collect()} == {("o", "/private/a"): False, ("o", "/b"): True, ("p", "/"): True}


def test_feed_and_list(spark):
    feeds = spark.createDataFrame([("s", "<rss><item><title>A</title><link>l1</link></item><item><title>B</title></item></rss>")], "source_id string, body string")
    assert [(r["title"], r["link"]) for r in stored.feed_items(feeds).orderBy("place").collect()] == [("A", "l1"), ("B", None)]
    lists = spark.createDataFrame([("s", '[1, "x", true, null, {"a": 1}, 2]')], "source_id string, body string")
    assert [r["id"] for r in stored.list_ids(lists, 5).collect()] == ["1", "x"]


def test_bodies_are_added_once(spark, tmp_path):
    store = str(tmp_path / "store")
    df = spark.createDataFrame([(b"a",), (b"b",), (b"a",), (b"",)], "content binary")
    assert sinks.add_bodies(df, store) == 2 and sinks.add_bodies(df, store) == 0
    assert spark.read.parquet(store).filter(F.sha2("content", 256) != F.col("sha256")).count() == 0


def test_checkpoint_and_markdown(spark, tmp_path):
    path = str(tmp_path / "c.json")
    for payload in ({"b": 1, "a": 2}, {"z": 1}):
        sinks.checkpoint_json(spark, path, payload)
        assert json.loads(open(path).read()) == payload
    text = sinks.markdown("T", spark.createDataFrame([("x|y", 1)], "name string, n int"))
    assert "| x\\|y | 1 |" in text
    odd = spark.createDataFrame([("a" * 200, (1, 2))], "long string, pair struct<b: int, a: int>")
    cells = odd.select(sinks.cell(odd, "long").alias("long"), sinks.cell(odd, "pair").alias("pair")).first()
    assert cells["long"] == "a" * 119 + "…" and cells["pair"] == '{"a":2,"b":1}'


@pytest.fixture(scope="module")
def doubled(spark, sf, tmp_path_factory):
    """Two files with the same events: everything is delivered twice."""
    folder = tmp_path_factory.mktemp("events")
    for k in (1, 2):
        spark.read.parquet(f"{sf}/events.parquet").coalesce(1).write.parquet(str(folder / f"d{k}"))
    import shutil

    flat = folder / "flat"
    flat.mkdir()
    for k in (1, 2):
        f = next((folder / f"d{k}").glob("part-*.parquet"))
        shutil.copy(f, flat / f"events-{k}.parquet")
    return str(flat)


def _run(spark, stream, tmp_path, mode="append"):
    q = progress.to_table(stream, str(tmp_path / "out"), str(tmp_path / "check"), mode)
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_once(spark, sf, doubled, tmp_path):
    out = _run(spark, progress.once(progress.read_events(spark, doubled), late="60 days"), tmp_path)
    assert out.count() == out.select("event_id").distinct().count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_windows_close(spark, sf, doubled, tmp_path):
    out = _run(spark, progress.windowed(progress.read_events(spark, doubled, "events-1*")), tmp_path)
    batch = spark.read.parquet(f"{sf}/events.parquet")
    days = {str(r["d"]): r["n"] for r in batch.groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n")).collect()}
    got = {str(r["d"]): r["n"] for r in out.groupBy(F.to_date("start").alias("d")).agg(F.sum("n").alias("n")).collect()}
    assert got and all(days[d] == n for d, n in got.items()) and len(days) - len(got) <= 2  # the last windows stay open


def test_circuits(spark, sf, doubled, tmp_path):
    q = progress.circuits(progress.read_events(spark, doubled, "events-1*")).writeStream.format("memory").queryName("circuits").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["user_id"]: (r["done"], r["dropped"], r["open"]) for r in spark.sql("SELECT * FROM circuits").collect()}
    rows = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id").collect()
    want = {}
    for r in rows:
        done, dropped, opened, run = want.get(r["user_id"], (0, 0, False, 0))
        if opened:
            dropped += 1
        else:
            done, run = done + 1, run + 1 if r["event_type"] == "error" else 0
            opened = run >= 3
        want[r["user_id"]] = (done, dropped, opened, run)
    assert got == {u: w[:3] for u, w in want.items()}


def test_partial_results_are_kept(spark, sf, tmp_path):
    events = progress.read_events(spark, sf)
    for _ in range(2):  # the second run finds nothing new
        progress.keep_partial(events, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert spark.read.parquet(f"{tmp_path}/out/rows").count() == n and f'"rows": {n}' in open(f"{tmp_path}/out/partial.json").read()


def test_partial_counts_of_a_batch_that_runs_again(spark, doubled, tmp_path):
    """The stream forgets its last batch, which then runs again: the summary counts it once."""
    events = progress.read_events(spark, doubled)
    progress.keep_partial(events, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    before = open(f"{tmp_path}/out/partial.json").read()
    for f in (tmp_path / "state" / "commits").glob("*1*"):
        f.unlink()
    progress.keep_partial(progress.read_events(spark, doubled), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    n = spark.read.parquet(f"{tmp_path}/out/rows").count()
    assert open(f"{tmp_path}/out/partial.json").read() == before and json.loads(before)["rows"] == n and json.loads(before)["batches"] == 2


def test_sessions_close(spark, sf, doubled, tmp_path):
    """Sessions of the stream are those of the table, but for those that the watermark leaves open."""
    out = _run(spark, progress.sessions(progress.read_events(spark, doubled, "events-1*")), tmp_path)
    rows = sorted((r["user_id"], r["ts"].timestamp()) for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts")).collect())
    want = []
    for user, ts in rows:
        if want and want[-1][0] == user and ts < want[-1][2] + 7200:
            want[-1][2:] = ts, want[-1][3] + 1
        else:
            want.append([user, ts, ts, 1])
    got = {(r["user_id"], r["start"].timestamp(), r["end"].timestamp(), r["n"]) for r in out.collect()}
    want = {(u, a, b + 7200, n) for u, a, b, n in want}
    last = max(ts for _, ts in rows)
    assert got <= want and all(w[2] > last - 3600 - 60 for w in want - got) and len(got) > 100


def test_sliding_windows(spark, sf, doubled, tmp_path):
    out = _run(spark, progress.windowed(progress.read_events(spark, doubled, "events-1*"), "2 days", "1 day"), tmp_path)
    batch = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.window(F.col("ts").cast("timestamp"), "2 days", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    want = {(str(r["start"]), r["event_type"]): r["n"] for r in batch.select("w.start", "event_type", "n").collect()}
    got = {(str(r["start"]), r["event_type"]): r["n"] for r in out.collect()}
    starts = sorted({s for s, _ in want})
    assert got.items() <= want.items() and {s for s, _ in want.keys() - got.keys()} <= set(starts[-3:]) and len(got) > 50
