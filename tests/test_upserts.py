import hashlib
import random

import pytest
from pyspark.sql import functions as F

from siltstone.sources.upserts import HashMismatch, Snapshots

SCHEMA = "transaction_id string, number long, final boolean, sha256 string, content binary, extra int"


def row(name, number, final, content, extra=0):
    return name, number, final, None if content is None else hashlib.sha256(content).hexdigest(), content, extra


def expected(rows):
    out = {}
    for r in rows:
        rank = (bool(r[2]), r[1] is not None, r[1] or 0, r[3] is not None, r[3] or "")
        if r[0] not in out or rank > out[r[0]][0]:
            out[r[0]] = rank, r
    return {k: r for k, (_, r) in out.items()}


def held(store, version=None):
    return {r[0]: (*r[:4], None if r[4] is None else bytes(r[4]), r[5]) for r in store.rows(version).collect()}


def test_batches_against_brute_force(spark, tmp_path):
    rng, store, rows = random.Random(3), Snapshots(spark, str(tmp_path), SCHEMA, buckets=5), []
    for n in range(4):
        batch = [row(f"t{rng.randrange(30)}", rng.choice([None, rng.randrange(9)]), rng.choice([True, False, None]), rng.choice([None, b"", b"%d" % rng.randrange(99)])) for _ in range(0 if n == 2 else 25)]
        batch += batch[:3]  # equal rows
        rows += batch
        df = spark.createDataFrame(batch, SCHEMA)
        assert store.upsert(df, n)
        state = store.state()
        assert not store.upsert(df, n) and store.state() == state  # a batch that runs again
        assert held(store) == expected(rows)
    assert store.versions() == [1, 2, 3, 4] and held(store, 1) != held(store)
    assert store.upsert(spark.createDataFrame([row("t1", 10, True, b"z")], SCHEMA), 0, "another")  # each stream has its own count
    want = held(store)
    assert want["t1"][4] == b"z" and store.vacuum() > 0 and held(store) == want


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path), SCHEMA, buckets=8)
    store.upsert(spark.createDataFrame([row(f"t{k}", 0, False, b"a") for k in range(60)], SCHEMA), 0)
    before = store.state()["folders"]
    store.upsert(spark.createDataFrame([row("t5", 1, True, b"b")], SCHEMA), 1)
    after = store.state()["folders"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1


def test_hashes_are_checked_three_times(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path), SCHEMA, buckets=1)
    bad = ("t", 0, False, "0" * 64, b"a", 0)
    with pytest.raises(HashMismatch, match="arriving"):
        store.upsert(spark.createDataFrame([bad], SCHEMA), 0)
    with pytest.raises(ValueError, match="without transaction_id"):
        store.upsert(spark.createDataFrame([row(None, 0, False, b"a")], SCHEMA), 0)
    assert store.versions() == [] and store.upsert(spark.createDataFrame([row("t", 0, False, b"a")], SCHEMA), 0)
    folder = store.state()["folders"]["0"]
    spark.createDataFrame([bad], SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/{folder}/bucket=0")  # the store is spoiled
    with pytest.raises(HashMismatch, match="existing"):
        store.upsert(spark.createDataFrame([row("u", 0, False, b"a")], SCHEMA), 1)
    assert store.versions() == [1]


def test_two_writers(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path), SCHEMA)
    store.upsert(spark.createDataFrame([row("t", 0, False, b"a")], SCHEMA), 0)
    with pytest.raises(Exception, match="FileAlreadyExists"):
        store._commit({**store.state(), "streams": {"": 9}})  # a version that another has committed
    assert store.state()["streams"] == {"": 0}


def test_stream_equals_table(spark, sf, tmp_path):
    """Events delivered twice, the stream's own memory lost in between: the store has them as a table would."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    content = F.to_json(F.struct("value", "props")).cast("binary")
    rows = events.select(F.concat_ws("-", "user_id", "event_type").alias("transaction_id"), F.col("event_id").alias("number"), (F.col("event_type") == "purchase").alias("final"), F.sha2(content, 256).alias("sha256"), content.alias("content"), F.lit(1).alias("extra"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    store = Snapshots(spark, f"{tmp_path}/store", SCHEMA, buckets=4)
    for k in range(2):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        store.follow(stream, f"{tmp_path}/check{k}").awaitTermination()
        if not k:
            state = store.state()
    assert store.state() == state and state["version"] == 3 and state["streams"] == {"stream": 2}
    whole = Snapshots(spark, f"{tmp_path}/whole", SCHEMA, buckets=4)
    whole.upsert(spark.read.parquet(f"{tmp_path}/in"), 0)
    assert held(store) == held(whole) and len(held(store)) == rows.select("transaction_id").distinct().count()
