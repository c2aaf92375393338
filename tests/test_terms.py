"""Counts and weights of terms against whole texts."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone.functions import texts
from siltstone.plans import registry
from siltstone.sources.tables import Folder


def weighed(docs):
    own = {}
    for key, text in docs:
        own.setdefault(key, Counter()).update(re.findall("[a-z0-9]+", (text or "").lower()))
    own = {k: c for k, c in own.items() if c}
    df = Counter(w for c in own.values() for w in c)
    mean = sum(c.total() for c in own.values()) / max(1, len(own))
    return {(k, w, tf, df[w], len(own), c.total(), mean) for k, c in own.items() if k is not None for w, tf in c.items()}


DOCS = [(k, " ".join(f"w{k % m}" for m in (1, 2, 3, 5, 7, 11)) + f" Only{k}") for k in range(40)] + [(50, "a A b"), (51, ""), (52, None), (53, "?!"), (None, "w0 lost")]
TWICE = [(50, "b c"), (50, "a"), (51, "late"), (None, "w0")]


@pytest.mark.parametrize("docs", [DOCS, DOCS + TWICE, []])
@pytest.mark.parametrize("frequent", [0.0, 0.2, 2.0])
def test_term_weights(spark, docs, frequent):
    df = spark.createDataFrame(docs, "k long, t string")
    got = texts.term_weights(df, "k", F.col("t"), Folder(spark, "terms"), frequent=frequent).collect()
    assert len(got) == len({r[:2] for r in got}) and {tuple(r) for r in got} == weighed(docs)
    some = texts.term_weights(df, "k", F.col("t"), Folder(spark, "terms"), only=["w0", "a", "none"], frequent=frequent).collect()
    assert {tuple(r) for r in some} == {x for x in weighed(docs) if x[1] in ("w0", "a", "none")}


@pytest.mark.parametrize("name", ["x34_bm25", "x34_tfidf"])
def test_frequent_terms_meet_counts_where_documents_are(spark, sf, name):
    assert "strategy=broadcast" in registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
