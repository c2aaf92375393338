import random
from datetime import datetime, timedelta

import pytest

from siltstone.operators import acquisition


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_freshest(spark, kind):
    rng, start = random.Random(1), datetime(1969, 12, 31, 23, 58)
    time = lambda: rng.choice([None, *[start + timedelta(seconds=rng.randrange(400), microseconds=rng.choice([0, 500000]))] * 9])
    key = lambda: rng.choice([None, *"aaaab"])
    requests = [(k, key(), time()) for k in range(150)] + [(7, "a", start)] * 2
    artifacts = [(rng.choice([None, *range(40)]), key(), time(), "x") for _ in range(150)]
    r = spark.createDataFrame(requests, f"id int, who string, ts {kind}")
    a = spark.createDataFrame(artifacts, f"artifact_id int, who string, collected {kind}, ts string")
    got = acquisition.freshest(r, a, "who", "ts", "collected", 30)
    assert got.columns == ["id", "who", "ts", "artifact_id"]

    def best(who, ts):
        fits = [(t, i) for i, w, t, _ in artifacts if None not in (i, w, t, who, ts) and w == who and timedelta(0) <= ts - t <= timedelta(seconds=30)]
        return max(fits, default=(None, None))[1]

    want = [(*x, best(*x[1:])) for x in requests]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and sum(w[3] is not None for w in want) > 30
    assert acquisition.freshest(r, a.limit(0), "who", "ts", "collected", 30).filter("artifact_id is not null").count() == 0
