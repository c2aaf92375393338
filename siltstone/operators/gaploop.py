"""A bounded loop that searches for what is missing, turn by turn, each gap until one of six rules ends it.

A turn takes the queries proposed for the gaps still open, drops those that a gap asked before, searches with the rest and
counts the independent evidence that the gap didn't have. What was asked and found, and how each gap stands, is written by
turn; one small document says how many turns are whole. A loop that is started again over the same folder goes on after
the last whole turn, and a turn that broke off writes over its own rows alone.

Rules, the first that holds: target_reached, no_source_left (nothing proposed), repeating (more than a share of what is
proposed was asked before), no_new_evidence, budget_exhausted (queries asked in all), limit_reached (turns).

Defined results: null gaps, queries and evidence count for nothing; a null target is never reached; repeated proposals of a
turn are one; proposals for gaps that ended or don't exist are dropped; of gaps named twice the greatest target holds.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltstone.sources.sinks import checkpoint_json

COUNTS = ("proposed", "asked", "gained")


class Loop:
    """gaps: gap, target. propose(turn, open gaps): gap, query. search(new queries: gap, query): gap, evidence."""

    def __init__(self, spark: SparkSession, path: str, gaps: DataFrame, propose: Callable[[int, DataFrame], DataFrame], search: Callable[[DataFrame], DataFrame], least: int = 1, repeated: float = 0.5, budget: int = 1000, most: int = 6):
        self.spark, self.path, self.propose, self.search = spark, path.rstrip("/"), propose, search
        self.gaps = gaps.filter("gap is not null").groupBy("gap").agg(F.max("target").alias("target"))
        self.least, self.repeated, self.budget, self.most = least, repeated, budget, most

    def turns(self) -> int:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/loop.json")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return 0
        return json.loads(self.spark.read.text(f"{self.path}/loop.json", wholetext=True).first()[0])["turns"]

    def rows(self, name: str, turns: int | None = None) -> DataFrame | None:
        """asked (gap, query), found (gap, evidence) or status, of whole turns, with their turn."""
        turns = self.turns() if turns is None else turns
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/turn={k}" for k in range(1, turns + 1)]) if turns else None

    def _put(self, rows: DataFrame, name: str, turn: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/turn={turn}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}/turn={turn}")

    def step(self) -> bool:
        """One turn; whether there was a gap left for it."""
        before = self.turns()
        turn = before + 1
        status = self.rows("status", before)
        open_ = self.gaps.withColumn("covered", F.lit(0).cast("long")).withColumn("spent", F.lit(0).cast("long"))
        if status is not None:
            last = status.filter(F.col("turn") == before).filter("stop is null").select("gap", "covered", "spent")
            open_ = self.gaps.join(last, "gap")
        if turn > self.most or open_.isEmpty():
            return False
        proposed = self.propose(turn, open_).select("gap", "query").filter("query is not null").join(open_.select("gap"), "gap", "left_semi").distinct()
        proposed = self._put(proposed, "proposed", turn)
        asked = self._put(self._unknown(proposed, "asked", "query", before), "asked", turn)
        evidence = self.search(asked).select("gap", "evidence").filter("evidence is not null").join(open_.select("gap"), "gap", "left_semi").distinct()
        found = self._put(self._unknown(evidence, "found", "evidence", before), "found", turn)
        now = open_
        for name, rows in zip(COUNTS, (proposed, asked, found)):
            now = now.join(rows.groupBy("gap").agg(F.count("*").alias(name)), "gap", "left").withColumn(name, F.coalesce(name, F.lit(0)))
        now = now.withColumn("covered", F.col("covered") + F.col("gained")).withColumn("spent", F.col("spent") + F.col("asked"))
        rules = {
            "target_reached": F.col("covered") >= F.col("target"), "no_source_left": F.col("proposed") == 0, "repeating": F.col("proposed") - F.col("asked") > self.repeated * F.col("proposed"),
            "no_new_evidence": F.col("gained") < self.least, "budget_exhausted": F.col("spent") >= self.budget, "limit_reached": F.lit(turn >= self.most),
        }
        stop = F.coalesce(*[F.when(rule, name) for name, rule in rules.items()])
        self._put(now.withColumn("stop", stop), "status", turn)
        checkpoint_json(self.spark, f"{self.path}/loop.json", {"turns": turn})
        return True

    def _unknown(self, rows: DataFrame, name: str, column: str, turns: int) -> DataFrame:
        known = self.rows(name, turns)
        return rows if known is None else rows.join(known.select("gap", column), ["gap", column], "left_anti")

    def run(self) -> DataFrame:
        """How each gap stood after each of its turns; the last has why it ended."""
        while self.step():
            pass
        status = self.rows("status")
        return status if status is not None else self.gaps.select("gap", "target", *[F.lit(0).cast("long").alias(c) for c in ("covered", "spent", *COUNTS)], F.lit("").alias("stop"), F.lit(0).alias("turn")).filter("false")
