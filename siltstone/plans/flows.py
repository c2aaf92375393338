"""Queries over transactions, ledgers, evidence and decisions, with the same in DuckDB's SQL.

The tables of a run are made from the given ones: a transaction is an event (origin: user, status by type), a cost a
lineitem, a source a supplier or customer, a claim an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from siltstone.operators import acquisition, evidence, gaploop, rebinding
from siltstone.plans.web import table
from siltstone.sources.tables import Folder
from siltstone.sources.upserts import Snapshots
from siltstone.streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_STATUS = "CASE event_type WHEN 'error' THEN CASE WHEN value < 5 THEN NULL ELSE 503 END WHEN 'signup' THEN CASE WHEN value > 100 THEN 429 WHEN value > 60 THEN 403 ELSE 200 END ELSE 200 END"
_TX = f"WITH tx AS (SELECT event_id, ts, user_id, 'u' || user_id origin, event_type method_id, value, {_STATUS} status, event_type = 'error' AND value < 5 network_error FROM events)"


def transactions(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", F.concat(F.lit("u"), "user_id").alias("origin"), F.col("event_type").alias("method_id"), "value", F.expr(_STATUS).alias("status"), ((F.col("event_type") == "error") & (F.col("value") < 5)).alias("network_error"))


_CLASS = "CASE WHEN network_error THEN 'TransientProvider' WHEN status = 429 THEN 'RateLimited' WHEN status IN (401, 403) THEN 'AuthenticationError' WHEN status >= 500 THEN 'TransientProvider' WHEN status >= 400 THEN 'PermanentSource' WHEN status = 202 THEN 'PolicyBlocked' END"
_OUT = "CASE WHEN network_error OR status >= 500 THEN 'source_unavailable' WHEN status = 429 THEN 'rate_limited' WHEN status IN (202, 401, 403) THEN 'challenge' WHEN status >= 400 THEN 'failed' ELSE 'succeeded' END"


def _outcome():
    return acquisition.outcome(F.col("status"), F.col("network_error"))


@query(f"{_TX} SELECT event_id, {_CLASS} error_class, {_OUT} outcome FROM tx")
def f11_f12_outcomes(spark, sf_dir):
    return transactions(spark, sf_dir).select("event_id", acquisition.error_class(F.col("status"), F.col("network_error")).alias("error_class"), _outcome().alias("outcome"))


@query(f"""{_TX}, a AS (SELECT *, (coalesce(network_error OR status >= 500, false))::INT tr, coalesce(status IN (202, 401, 403, 429), false) hard FROM tx), b AS (SELECT *, sum(1 - tr) OVER (PARTITION BY origin ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) isl FROM a),
 c AS (SELECT *, sum(tr) OVER (PARTITION BY origin, isl ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) run FROM b), d AS (SELECT *, hard OR run >= 3 opens FROM c)
SELECT event_id, run::BIGINT run, opens, coalesce(max(opens) OVER (PARTITION BY origin ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) suppressed FROM d""")
def f10_w03_w04_circuit(spark, sf_dir):
    return acquisition.circuit(transactions(spark, sf_dir), "origin", ["ts", "event_id"]).select("event_id", "run", "opens", "suppressed")


@query(f"""{_TX} SELECT method_id, count(*) records, {", ".join(f"count_if({_OUT} = '{o}')::BIGINT {o}" for o in acquisition.OUTCOMES)}, sum(length(origin))::BIGINT transactions, round_even(avg(({_OUT} = 'succeeded')::INT), 4) success FROM tx GROUP BY 1""")
def a01_method_rates(spark, sf_dir):
    return acquisition.method_rates(transactions(spark, sf_dir).withColumn("outcome", _outcome()).withColumn("transactions", F.length("origin").cast("long")))


@query(f"""{_TX}, o AS (SELECT *, {_OUT} outcome FROM tx) SELECT user_id, CASE WHEN count_if(outcome = 'succeeded' AND value > 60) > 0 THEN 'succeeded' WHEN count_if(outcome IN ('challenge', 'rate_limited')) > 0 THEN arg_min(outcome, event_id) FILTER (outcome IN ('challenge', 'rate_limited'))
 WHEN count_if(outcome <> 'succeeded') = 0 THEN 'no_results' ELSE 'source_unavailable' END status FROM o GROUP BY 1""")
def f13_method_status(spark, sf_dir):
    """Every event counts."""
    return _statuses(transactions(spark, sf_dir))


def _statuses(tx) -> DataFrame:
    tx = tx.withColumn("outcome", _outcome())
    tx = tx.withColumn("candidates", ((F.col("outcome") == "succeeded") & (F.col("value") > 60)).cast("int"))
    return acquisition.method_status(tx, "user_id", ["event_id"])


@query(f"""{_TX}, r AS (SELECT origin, count(*) requested FROM tx GROUP BY 1) SELECT origin, requested, greatest(0, least(requested, 3000 - coalesce(sum(requested) OVER (ORDER BY origin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT lease FROM r""")
def w01_a06_leases(spark, sf_dir):
    requests = transactions(spark, sf_dir).groupBy("origin").agg(F.count("*").alias("requested"))
    return acquisition.leases(requests, "origin", "requested", 3000)


@query(f"""{_TX} SELECT event_id, row_number() OVER (PARTITION BY origin ORDER BY ts, event_id) seq, coalesce(date_diff('microsecond', lag(ts) OVER (PARTITION BY origin ORDER BY ts, event_id), ts) < 1500000, false) too_soon FROM tx""")
def w02_w05_sequence_and_gaps(spark, sf_dir):
    w = Window.partitionBy("origin").orderBy("ts", "event_id")
    gap = F.expr("timestampdiff(MICROSECOND, before, ts)")
    return transactions(spark, sf_dir).withColumn("seq", F.row_number().over(w).cast("long")).withColumn("before", F.lag("ts").over(w)).select("event_id", "seq", F.coalesce(gap < 1_500_000, F.lit(False)).alias("too_soon"))


@query("""WITH c AS (SELECT page_id, url, regexp_extract(url, '^([^?#]*)', 1) canonical, page_id % 3 arm, page_id % 5 q FROM pages UNION ALL SELECT page_id + 100000, url, regexp_extract(url, '^([^?#]*)', 1), 3, page_id % 5 FROM pages WHERE page_id % 2 = 0),
 k AS (SELECT coalesce(nullif(canonical, ''), url) k, * FROM c), l AS (SELECT k, arm, min(page_id) f FROM k GROUP BY 1, 2), m AS (SELECT k, q, min(page_id) f FROM k GROUP BY 1, 2)
SELECT k.k AS "key", arg_min(url, page_id) url, count(*) n, (SELECT string_agg(arm, ',' ORDER BY f) FROM l WHERE l.k = k.k) arms, (SELECT string_agg(q, ',' ORDER BY f) FROM m WHERE m.k = k.k) queries FROM k GROUP BY k.k""")
def a02_u01_w06_merged_candidates(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    one = p.select("page_id", "url", F.regexp_extract("url", "^([^?#]*)", 1).alias("canonical"), (F.col("page_id") % 3).alias("arm"), (F.col("page_id") % 5).alias("query"))
    two = one.filter("page_id % 2 = 0").withColumn("page_id", F.col("page_id") + 100000).withColumn("arm", F.lit(3).cast("long"))
    got = acquisition.merged_candidates(one.unionByName(two), "url", "canonical", "page_id", ["arm", "query"])
    return got.select("key", "url", "n", F.array_join("arms", ",").alias("arms"), F.array_join("querys", ",").alias("queries"))


@query("""WITH a AS (SELECT (doc_id % 2)::INT arm, count(DISTINCT source) sources, round_even(avg(contains(lower(text), 'hand')::INT), 4) cover FROM documents GROUP BY 1) SELECT b.sources > a.sources OR b.cover > a.cover improves, a.cover base, b.cover other FROM a, a b WHERE a.arm = 0 AND b.arm = 1""")
def a04_strict_improvement(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    arms = d.groupBy((F.col("doc_id") % 2).alias("arm")).agg(F.countDistinct("source").alias("sources"), F.bround(F.avg(F.contains(F.lower("text"), F.lit("hand")).cast("int")), 4).alias("cover"))
    one = arms.agg(*[F.max(F.when(F.col("arm") == k, F.col(c))).alias(f"{c}{k}") for k in (0, 1) for c in ("sources", "cover")])
    return one.select(((F.col("sources1") > F.col("sources0")) | (F.col("cover1") > F.col("cover0"))).alias("improves"), F.col("cover0").alias("base"), F.col("cover1").alias("other"))


@query(f"""{_TX} SELECT origin, method_id, count(*) used, sum(length(origin))::BIGINT bytes FROM tx GROUP BY ROLLUP (origin, method_id)""")
def a05_a07_a08_budget_rollup(spark, sf_dir):
    return transactions(spark, sf_dir).rollup("origin", "method_id").agg(F.count("*").alias("used"), F.sum(F.length("origin")).alias("bytes"))


@query("""SELECT l_returnflag category, l_linestatus phase, round(sum(l_extendedprice), 2) reserved, round(sum(l_extendedprice * (1 - l_discount)), 2) actual, count(*) n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def a24_cost_ledger(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("ledger_lines")
    return spark.sql("""SELECT l_returnflag category, l_linestatus phase, round(sum(l_extendedprice), 2) reserved, round(sum(l_extendedprice * (1 - l_discount)), 2) actual, count(*) n FROM ledger_lines GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")


@query(f"""{_TX}, s AS (SELECT s_suppkey user_id, s_name FROM supplier), r AS (SELECT user_id, max_by({_OUT}, event_id) outcome, max_by(method_id, event_id) stop_reason FROM tx WHERE method_id = 'signup' GROUP BY 1) SELECT s_name, coalesce(outcome, 'not_reported') outcome, coalesce(stop_reason, 'missing_from_input_report') stop_reason FROM s LEFT JOIN r USING (user_id)""")
def j01_j03_reported(spark, sf_dir):
    sites = transactions(spark, sf_dir).filter("method_id = 'signup'").groupBy("user_id").agg(F.max_by(_outcome(), "event_id").alias("outcome"), F.max_by("method_id", "event_id").alias("stop_reason"))
    return acquisition.reported(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), "s_name"), sites, "user_id").select("s_name", "outcome", "stop_reason")


@query("""SELECT c_custkey, CASE WHEN n_name IS NOT NULL THEN 'resolved_official_origin' ELSE 'unresolved_official_origin' END status, coalesce(n_name, c_name) origin FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3""")
def j02_overlay(spark, sf_dir):
    found = table(spark, sf_dir, "nation").filter("n_regionkey < 3")
    c = table(spark, sf_dir, "customer").join(found, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.select("c_custkey", F.when(F.col("n_name").isNotNull(), "resolved_official_origin").otherwise("unresolved_official_origin").alias("status"), F.coalesce("n_name", "c_name").alias("origin"))


@query("""WITH l AS (SELECT n_nationkey, lower(n_name) label FROM nation), b AS (SELECT DISTINCT c_nationkey, upper('nation_' || c_nationkey) label, c_mktsegment website, c_custkey % 4 item FROM customer)
SELECT l.label, count(item) candidates, count(DISTINCT website) websites, CASE WHEN count(DISTINCT website) > 1 THEN 'ambiguous_multiple_websites' WHEN count(item) > 1 THEN 'ambiguous_multiple_entities' WHEN count(item) = 1 THEN 'target_validation_not_live' ELSE 'no_exact_match' END reason FROM l LEFT JOIN b ON l.label = lower(b.label) GROUP BY 1""")
def j04_j05_j06_a11_resolution(spark, sf_dir):
    labels = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("label"))
    b = table(spark, sf_dir, "customer").select(F.lower(F.upper(F.concat(F.lit("nation_"), "c_nationkey"))).alias("label"), F.col("c_mktsegment").alias("website"), (F.col("c_custkey") % 4).alias("item")).distinct()
    g = labels.join(b, "label", "left").groupBy("label").agg(F.count("item").alias("candidates"), F.countDistinct("website").alias("websites"))
    reason = F.when(F.col("websites") > 1, "ambiguous_multiple_websites").when(F.col("candidates") > 1, "ambiguous_multiple_entities").when(F.col("candidates") == 1, "target_validation_not_live").otherwise("no_exact_match")
    return g.withColumn("reason", reason)


@query("SELECT page_id, url FROM pages WHERE page_id % 2 = 1 AND regexp_extract(url, '^([^?#]*)', 1) NOT IN (SELECT regexp_extract(url, '^([^?#]*)', 1) FROM pages WHERE page_id % 2 = 0)")
def j08_j09_u02_not_seen(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("canonical", F.regexp_extract("url", "^([^?#]*)", 1))
    return acquisition.not_seen(p.filter("page_id % 2 = 1"), p.filter("page_id % 2 = 0"), "canonical").select("page_id", "url")


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'source_policy_denied' ELSE 'allowed' END policy FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey")
def f05_j10_policy(spark, sf_dir):
    allowed = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("ok"))
    return table(spark, sf_dir, "orders").join(allowed, "o_custkey", "left").select("o_orderkey", F.when(F.col("ok"), "allowed").otherwise("source_policy_denied").alias("policy"))


@query("""WITH r AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), a AS (SELECT event_id artifact_id, user_id, ts collected FROM events WHERE event_type = 'view')
SELECT r.event_id, arg_max(a.artifact_id, (a.collected, a.artifact_id)) artifact_id FROM r LEFT JOIN a ON a.user_id = r.user_id AND a.collected <= r.ts AND a.collected >= r.ts - INTERVAL 86400 SECOND GROUP BY 1""")
def j07_s17_freshest_artifact(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    r = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    a = e.filter("event_type = 'view'").select(F.col("event_id").alias("artifact_id"), "user_id", F.col("ts").alias("collected"))
    return acquisition.freshest(r, a, "user_id", "ts", "collected", 86400).select("event_id", "artifact_id")


@query("""WITH plan AS (SELECT r_name intent, n_name seed, s_suppkey source FROM region, nation, supplier WHERE (s_nationkey + r_regionkey) % 3 = 0 AND n_nationkey % 4 = r_regionkey % 4), g AS (SELECT intent, count(*) queries, count(DISTINCT source) sources FROM plan GROUP BY 1)
SELECT r_name intent, coalesce(queries, 0) queries, coalesce(sources, 0) sources, queries IS NULL gap FROM region LEFT JOIN g ON r_name = intent""")
def j11_j12_query_plan(spark, sf_dir):
    """Seeds meet intents and sources through a compatibility key each; the three dimensions are lists of a plan, not data."""
    return _plan(spark, sf_dir, table(spark, sf_dir, "supplier"))


def _plan(spark, sf_dir, suppliers: DataFrame) -> DataFrame:
    r = table(spark, sf_dir, "region").withColumn("k", F.col("r_regionkey") % 4)
    n = table(spark, sf_dir, "nation").select("n_name", (F.col("n_nationkey") % 4).alias("k"))
    s = suppliers.select("s_suppkey", (F.col("s_nationkey") % 3).alias("fit"))
    plan = r.join(n, "k").withColumn("fit", (3 - F.col("r_regionkey") % 3) % 3).join(s, "fit")
    g = plan.groupBy("r_name").agg(F.count("*").alias("queries"), F.countDistinct("s_suppkey").alias("sources"))
    return r.join(g, "r_name", "left").select(F.col("r_name").alias("intent"), F.coalesce("queries", F.lit(0)).alias("queries"), F.coalesce("sources", F.lit(0)).alias("sources"), F.col("queries").isNull().alias("gap"))


@query("SELECT md5(text) identity, min(doc_id) kept, count(*) n FROM documents GROUP BY 1 HAVING count(*) > 1")
def j14_exact_identity(spark, sf_dir):
    """Members of one key, as a class with its representative; pairs are not spelled out."""
    return table(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("identity")).agg(F.min("doc_id").alias("kept"), F.count("*").alias("n")).filter("n > 1")


_SEG = "SELECT doc_id segment_id, text segment, sha256(text) segment_hash FROM documents WHERE doc_id % 10 <> 9"
_CLAIM = "SELECT doc_id segment_id, substr(text, 11, 20) quote, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 10 END quote_start, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE sha256(text) END claim_hash FROM documents WHERE length(text) > 40"


@query(f"""WITH s AS ({_SEG}), c AS ({_CLAIM}) SELECT c.segment_id, CASE WHEN segment IS NULL THEN 'source_removed' WHEN claim_hash <> segment_hash AND contains(segment, quote) THEN 'stale_binding' WHEN substr(segment, quote_start + 1, length(quote)) = quote THEN 'valid' ELSE 'invalid' END binding FROM c LEFT JOIN s USING (segment_id)""")
def j16_j17_citation_binding(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    s = d.filter("doc_id % 10 <> 9").select(F.col("doc_id").alias("segment_id"), F.col("text").alias("segment"), F.sha2("text", 256).alias("segment_hash"))
    c = d.filter("length(text) > 40").select(F.col("doc_id").alias("segment_id"), F.substring("text", 11, 20).alias("quote"), F.when(F.col("doc_id") % 3 == 0, 3).otherwise(10).alias("quote_start"), F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.sha2("text", 256)).alias("claim_hash"))
    return evidence.bound(c, s).select("segment_id", "binding")



#: The next version cuts texts at full stops; some documents aren't in it.
_NEXT = "string_split(replace(text, chr(10), ' '), '. ')"


@query(rf"""WITH o AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 line, unnest(string_split(text, chr(10))) seg FROM documents), q AS (SELECT doc_id * 100000 + line citation_id, doc_id, substr(seg, 6, 40) quote FROM o WHERE length(seg) >= 12),
n AS (SELECT doc_id, generate_subscripts({_NEXT}, 1) - 1 sq, unnest({_NEXT}) seg FROM documents WHERE doc_id % 20 <> 7), f AS (SELECT citation_id, min((sq, position(quote IN seg) - 1, sha256(seg))) p, count(*) places FROM q JOIN n USING (doc_id) WHERE contains(seg, quote) GROUP BY 1)
SELECT q.citation_id, q.doc_id document_id, CASE WHEN q.doc_id % 20 = 7 THEN 'source_removed' WHEN p IS NULL THEN 'stale_binding' ELSE 'valid' END binding_status, p[1]::BIGINT AS sequence, p[2]::BIGINT quote_start, p[3] segment_hash, coalesce(places, 0)::BIGINT places FROM q LEFT JOIN f USING (citation_id)""")
def j17_rebound_quotes(spark, sf_dir):
    """Quotes from the lines of all documents, bound anew to the sentences of the next version."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "seg")).filter(F.length("seg") >= 12)
    quotes = lines.select((F.col("doc_id") * 100000 + F.col("line")).alias("citation_id"), F.col("doc_id").alias("document_id"), F.substring("seg", 6, 40).alias("quote"))
    after = docs.filter("doc_id % 20 <> 7").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\. ")).alias("sequence", "segment"))
    got = rebinding.rebound(quotes, after, Folder(spark, "j17"), "2")
    return got.select("citation_id", "document_id", "binding_status", F.col("sequence").cast("long").alias("sequence"), F.col("quote_start").cast("long").alias("quote_start"), "segment_hash", "places")


_CLAIMS = "SELECT o_orderkey, o_custkey % 50 cluster, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END polarity, o_custkey % 17 independence, o_orderpriority platform, o_totalprice, o_orderdate FROM orders"


def claims(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", (F.col("o_custkey") % 50).alias("cluster"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", -1).otherwise(0).alias("polarity"), (F.col("o_custkey") % 17).alias("independence"), F.col("o_orderpriority").alias("platform"), "o_totalprice", "o_orderdate")


@query(f"""WITH c AS ({_CLAIMS}) SELECT cluster, count(*) claims, count(DISTINCT independence) independent, count(DISTINCT platform) platforms, count_if(polarity > 0)::BIGINT supporting, count_if(polarity < 0)::BIGINT challenging,
 CASE WHEN count_if(polarity > 0) > 0 AND count_if(polarity < 0) > 0 THEN 'mixed' WHEN count_if(polarity > 0) > 0 THEN 'supporting' WHEN count_if(polarity < 0) > 0 THEN 'challenging' ELSE 'insufficient' END state FROM c GROUP BY 1""")
def a15_a16_a17_a18_evidence_profile(spark, sf_dir):
    return evidence.profile(claims(spark, sf_dir), "cluster")


@query(f"""WITH c AS ({_CLAIMS}), p AS (SELECT cluster, count(*) n, count(DISTINCT independence) i, count(DISTINCT platform) pl, count_if(polarity > 0) s, count_if(polarity < 0) c, max(o_totalprice) mx FROM c GROUP BY 1), g AS (SELECT *, n >= 300 coverage, i >= 1 independent, pl >= 5 platforms, s > 0 supported FROM p)
SELECT cluster, coverage, independent, platforms, supported, coverage AND independent AND platforms AND supported sufficient, CASE WHEN NOT (coverage AND independent AND platforms AND supported) THEN 'investigate_more' WHEN s - c < -10 AND mx < 480000 AND cluster % 2 = 0 AND c > 0 THEN 'kill'
 WHEN s - c > 0 AND c < s AND cluster % 2 = 1 AND mx > 450000 AND cluster % 7 <> 0 THEN 'build_to_validate' WHEN s - c > 0 AND (cluster % 7 = 0 OR NOT mx > 450000 OR cluster % 2 = 0) THEN 'modify' ELSE 'investigate_more' END decision FROM g""")
def a22_decision_gates(spark, sf_dir):
    p = claims(spark, sf_dir).groupBy("cluster").agg(F.count("*").alias("n"), F.countDistinct("independence").alias("i"), F.countDistinct("platform").alias("pl"), F.count_if(F.col("polarity") > 0).alias("s"), F.count_if(F.col("polarity") < 0).alias("c"), F.max("o_totalprice").alias("mx"))
    g = evidence.gates(p, {"coverage": F.col("n") >= 300, "independent": F.col("i") >= 1, "platforms": F.col("pl") >= 5, "supported": F.col("s") > 0})
    problem = F.when(F.col("s") - F.col("c") > 0, F.col("s")).when(F.col("s") - F.col("c") < -10, -1).otherwise(0)
    d = evidence.decision(F.col("sufficient"), problem, F.col("c"), F.col("mx") < 480000, F.col("cluster") % 2 == 1, F.col("mx") > 450000, F.col("cluster") % 7 == 0)
    return g.select("cluster", "coverage", "independent", "platforms", "supported", "sufficient", d.alias("decision"))


@query(f"""WITH c AS (SELECT *, polarity::BIGINT w FROM ({_CLAIMS})), t AS (SELECT *, sum(w) OVER (PARTITION BY cluster) total FROM c), f AS (SELECT *, sign(total) <> sign(total - w) flips FROM t) SELECT cluster, total::BIGINT total, count_if(flips)::BIGINT flips, CASE WHEN count_if(flips) = 0 THEN 'stable' WHEN count_if(flips) <= 2 THEN 'sensitive' ELSE 'fragile' END stability FROM f GROUP BY 1, 2""")
def g06_g07_counterfactual(spark, sf_dir):
    one = evidence.without_one(claims(spark, sf_dir).withColumn("w", F.col("polarity").cast("long")), "cluster", "w")
    g = one.groupBy("cluster", "total").agg(F.count_if("flips").alias("flips"))
    return g.withColumn("stability", evidence.stability(F.col("flips")))


#: A claim's independent source is its customer; a cluster's are its part of them.
_OWN = "SELECT o_orderkey, o_custkey % 200 cluster, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END polarity, o_custkey voice, o_orderpriority platform, o_totalprice FROM orders"
_GATES = {"coverage": "{n} >= 60", "independent": "{voices} >= 8", "platforms": "{platforms} >= 5", "supported": "{s} > 0", "weighty": "{mx} >= 300000"}


def _gates(of: str = "") -> dict[str, str]:
    return {name: "coalesce(" + rule.format(**{c: of + c for c in ("n", "voices", "platforms", "s", "mx")}) + ", false)" for name, rule in _GATES.items()}


def _decided(gates: dict[str, str], of: str = "") -> str:
    return f"CASE WHEN NOT ({' AND '.join(gates.values())}) THEN 'investigate_more' WHEN {of}s > {of}c THEN 'build_to_validate' WHEN {of}s < {of}c THEN 'kill' ELSE 'modify' END"


def _turned(name: str) -> str:
    """The decision if one gate said the opposite."""
    return _decided(_gates() | {name: f"(NOT {_gates()[name]})"})


@query(f"""WITH c AS ({_OWN}), k AS (SELECT cluster, count(*) n, count(DISTINCT voice) voices, count(DISTINCT platform) platforms, count_if(polarity > 0) s, count_if(polarity < 0) c, max(o_totalprice) mx FROM c GROUP BY 1),
l AS (SELECT a.cluster, a.o_orderkey, (SELECT count(*) FROM c b WHERE b.cluster = a.cluster AND b.o_orderkey <> a.o_orderkey) without_n, (SELECT count(DISTINCT voice) FROM c b WHERE b.cluster = a.cluster AND b.o_orderkey <> a.o_orderkey) without_voices,
 (SELECT count(DISTINCT platform) FROM c b WHERE b.cluster = a.cluster AND b.o_orderkey <> a.o_orderkey) without_platforms, (SELECT count_if(polarity > 0) FROM c b WHERE b.cluster = a.cluster AND b.o_orderkey <> a.o_orderkey) without_s,
 (SELECT count_if(polarity < 0) FROM c b WHERE b.cluster = a.cluster AND b.o_orderkey <> a.o_orderkey) without_c, (SELECT max(o_totalprice) FROM c b WHERE b.cluster = a.cluster AND b.o_orderkey <> a.o_orderkey) without_mx FROM c a),
d AS (SELECT cluster, {_decided(_gates("without_"), "without_")} other, without_voices, without_mx FROM l), t AS (SELECT cluster, n, voices, platforms, {_decided(_gates())} decision, array_to_string(list_filter([{", ".join(f"CASE WHEN {_turned(g)} <> {_decided(_gates())} THEN '{g}' END" for g in _GATES)}], lambda x: x IS NOT NULL), ',') turning, voices v, mx FROM k)
SELECT cluster, any_value(n)::BIGINT n, any_value(voices)::BIGINT voices, any_value(platforms)::BIGINT platforms, any_value(decision) decision, count_if(without_voices < v)::BIGINT single, count_if(without_mx < mx)::BIGINT greatest, count_if(other <> decision)::BIGINT flips, any_value(turning) turning FROM t JOIN d USING (cluster) GROUP BY 1""")
def g06_a22_counterfactuals(spark, sf_dir):
    """Of each cluster: its decision, claims that are their voice's only one, claims without which it is another, gates that would turn it."""
    own = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey % 200 cluster", "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END polarity", "o_custkey voice", "o_orderpriority platform", "o_totalprice")
    kinds = evidence.without_each(own, "cluster", {"voices": "voice", "platforms": "platform"}, {"s": F.col("polarity") > 0, "c": F.col("polarity") < 0}, {"mx": "o_totalprice"})
    one = kinds.selectExpr("*", f"{_decided(_gates())} decision", f"{_decided(_gates('without_'), 'without_')} other")
    turning = F.array_join(F.array_compact(F.array(*[F.when(F.expr(_turned(g)) != F.col("decision"), g) for g in _GATES])), ",")
    sums = {"single": "without_voices < voices", "greatest": "without_mx < mx", "flips": "other != decision"}
    return one.withColumn("turning", turning).groupBy("cluster", "n", "voices", "platforms", "decision", "turning").agg(*[F.sum(F.when(F.expr(c), F.col("copies")).otherwise(0)).alias(name) for name, c in sums.items()])


@query(f"""WITH c AS ({_CLAIMS}) SELECT cluster, {", ".join(f"count_if(platform = '{p}')::BIGINT AS \"{p}\"" for p in ("1-URGENT", "2-HIGH", "5-LOW"))} FROM c GROUP BY 1""")
def a19_claim_map(spark, sf_dir):
    return claims(spark, sf_dir).groupBy("cluster").pivot("platform", ["1-URGENT", "2-HIGH", "5-LOW"]).agg(F.count(F.lit(1))).na.fill(0)


@query("""WITH l AS (SELECT l_partkey, l_returnflag currency, l_orderkey, l_linenumber, l_extendedprice / l_quantity price FROM lineitem WHERE l_quantity > 0), w AS (SELECT *, lag(price) OVER (PARTITION BY l_partkey, currency ORDER BY l_orderkey, l_linenumber, price) prev, first_value(price) OVER (PARTITION BY l_partkey, currency ORDER BY l_orderkey, l_linenumber, price) f FROM l)
SELECT l_partkey, currency, count(*) n, count_if(prev IS NOT NULL AND price > prev)::BIGINT rises, round(max(price / f), 6) peak FROM w GROUP BY 1, 2""")
def w12_price_history(spark, sf_dir):
    """Prices are followed within one currency only."""
    return _prices(table(spark, sf_dir, "lineitem").filter("l_quantity > 0"))


def _prices(l: DataFrame) -> DataFrame:
    l = l.withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    w = Window.partitionBy("l_partkey", "l_returnflag").orderBy("l_orderkey", "l_linenumber", "price")
    l = l.withColumn("prev", F.lag("price").over(w)).withColumn("f", F.first("price").over(w))
    return l.groupBy("l_partkey", F.col("l_returnflag").alias("currency")).agg(F.count("*").alias("n"), F.count_if(F.col("price") > F.col("prev")).alias("rises"), F.round(F.max(F.col("price") / F.col("f")), 6).alias("peak"))


@query("""SELECT event_id, round(sum(value) OVER w, 4) balance, sum(value) OVER w > 500 warns, sum(value) OVER w <= 1000 admitted FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def w08_ledger_balance(spark, sf_dir):
    got = acquisition.ledger(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 500, 1000, exact=False)  # doubles, as SQL has them
    return got.select("event_id", F.round("balance", 4).alias("balance"), "warns", "admitted")


@query("""WITH r AS (SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) rk FROM orders) SELECT o_orderkey, rk::BIGINT AS "rank", rk <= 2 eligible, CASE WHEN rk > 2 THEN 'beyond_quota' END reason FROM r""")
def t06_w07_diverse_top_k(spark, sf_dir):
    got = evidence.eligible(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], "o_totalprice", "o_orderkey", 2)
    return got.select("o_orderkey", F.col("rank").cast("long").alias("rank"), "eligible", "reason")


@query("""SELECT o_custkey, o_orderkey latest, v::BIGINT versions, prev superseded FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) r, count(*) OVER (PARTITION BY o_custkey) v, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) prev FROM orders) WHERE r = 1""")
def w09_k07_version_chain(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    o = table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).withColumn("versions", F.count("*").over(Window.partitionBy("o_custkey"))).withColumn("superseded", F.lead("o_orderkey").over(w))
    return o.filter("r = 1").select("o_custkey", F.col("o_orderkey").alias("latest"), "versions", "superseded")


@query("SELECT date_trunc('month', o_orderdate)::DATE::VARCHAR AS \"month\", count(*) n, sum(count(*)) OVER (ORDER BY date_trunc('month', o_orderdate))::BIGINT upto, coalesce(count(*) - lag(count(*)) OVER (ORDER BY date_trunc('month', o_orderdate)), 0)::BIGINT delta FROM orders GROUP BY date_trunc('month', o_orderdate)")
def w10_w11_recency_and_coverage(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-01").alias("month")).agg(F.count("*").alias("n"))
    w = Window.orderBy("month")  # months, not rows
    return g.withColumn("upto", F.sum("n").over(w)).withColumn("delta", F.coalesce(F.col("n") - F.lag("n").over(w), F.lit(0)))


@query("""SELECT p_partkey, round(sev * gain * fit * ind * fresh - cost - red, 6) priority, round(sev * gain * fit / (1 + cost + red + 0.5) / (1 + p_partkey % 3), 6) voi FROM (SELECT p_partkey, p_size / 50.0 sev, (p_partkey % 7) / 7.0 gain, (p_partkey % 5) / 5.0 fit, 0.5 ind, 0.8 fresh, p_retailprice / 10000 cost, (p_partkey % 2) * 0.1 red FROM part)""")
def t07_t08_priorities(spark, sf_dir):
    k = F.col("p_partkey")
    sev, gain, fit, cost, red = F.col("p_size") / 50.0, (k % 7) / 7.0, (k % 5) / 5.0, F.col("p_retailprice") / 10000, (k % 2) * 0.1
    return table(spark, sf_dir, "part").select("p_partkey", F.round(evidence.priority(sev, gain, fit, F.lit(0.5), F.lit(0.8), cost, red), 6).alias("priority"), F.round(evidence.value_of_information(sev, gain, fit, cost, red, F.lit(0.5), k % 3), 6).alias("voi"))


@query("SELECT c_custkey, (floor((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) / 25))::BIGINT batch, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3 asked FROM customer")
def t05_t09_batches_and_questions(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    top = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return c.select("c_custkey", F.floor((n - 1) / 25).alias("batch"), (top <= 3).alias("asked"))


@query("SELECT user_id, event_id AS first_event FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) r FROM events WHERE event_type = 'purchase') WHERE r = 1 ORDER BY first_event LIMIT 6")
def a09_t01_t03_t04_destinations(spark, sf_dir):
    """The first of each origin, then as many as the budget of six pays for."""
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    return acquisition.first_in(e, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_id").alias("first_event")).orderBy("first_event").limit(6)


@query("""WITH f AS (SELECT c_custkey, c_nationkey % 4 > 0 product, c_custkey % 3 > 0 usr, c_custkey % 5 > 0 problem, c_custkey % 2 > 0 niche, c_acctbal > 0 confirmed FROM customer)
SELECT c_custkey, CASE WHEN NOT (product OR usr OR problem) THEN 'needs_clarification' WHEN product AND usr AND problem AND niche THEN 'ready' WHEN product AND usr AND problem THEN 'broad_but_continue' ELSE 'needs_clarification' END readiness, CASE WHEN problem AND NOT usr THEN 'primary' ELSE 'secondary' END gap FROM f WHERE confirmed""")
def f20_f21_f23_f24_intake(spark, sf_dir):
    k = F.col("c_custkey")
    product, user, problem, niche = F.col("c_nationkey") % 4 > 0, k % 3 > 0, k % 5 > 0, k % 2 > 0
    return table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", evidence.readiness(product, user, problem, niche).alias("readiness"), F.when(problem & ~user, "primary").otherwise("secondary").alias("gap"))


@query("SELECT source, lang, count(*) n, round(avg((length(text) < 20)::INT), 6) short, round(avg((text IS NULL)::INT), 6) missing FROM documents GROUP BY CUBE (source, lang)")
def a13_a14_normalization_metrics(spark, sf_dir):
    return table(spark, sf_dir, "documents").cube("source", "lang").agg(F.count("*").alias("n"), F.round(F.avg((F.length("text") < 20).cast("int")), 6).alias("short"), F.round(F.avg(F.col("text").isNull().cast("int")), 6).alias("missing"))


@query("SELECT n_name run, count(o_orderkey) claims, count(DISTINCT o_custkey) FILTER (o_orderkey IS NOT NULL) independent, count(o_orderkey) FILTER (o_orderstatus = 'P') unvalidated, 0::BIGINT interviews FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a21_a23_disclosures(spark, sf_dir):
    """Counters of every run, 0 where there is nothing."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    g = o.groupBy("c_nationkey").agg(F.count("*").alias("claims"), F.countDistinct("o_custkey").alias("independent"), F.count_if(F.col("o_orderstatus") == "P").alias("unvalidated"))
    zero = [F.coalesce(x, F.lit(0)).alias(x) for x in ("claims", "independent", "unvalidated")]
    return table(spark, sf_dir, "nation").join(g, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("run"), *zero, F.lit(0).cast("long").alias("interviews"))


@query("SELECT count(DISTINCT user_id)::BIGINT users FROM events")
def a25_distinct_users(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.countDistinct("user_id").alias("users"))


@query()
def a25_approximate_users(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.approx_count_distinct("user_id", 0.01).alias("users"), F.hll_sketch_estimate(F.hll_sketch_agg("user_id", F.lit(14))).alias("sketched"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'keyless' ELSE 'keyed' END access, c_custkey % 2 = 0 AND coalesce(nullif(c_custkey % 3, 2) <> 1, true) usable, regexp_matches('Q' || c_custkey, '^Q[1-9][0-9]*$') qid FROM customer")
def f17_f18_f19_endpoints(spark, sf_dir):
    """A missing `official` counts as official; keyless must be true."""
    k = F.col("c_custkey")
    official = F.when(k % 3 == 2, None).otherwise(k % 3 != 1)
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "keyless").otherwise("keyed").alias("access"), ((k % 2 == 0) & F.coalesce(official, F.lit(True))).alias("usable"), F.concat(F.lit("Q"), k).rlike("^Q[1-9][0-9]*$").alias("qid"))


@query("""WITH h AS (SELECT p_partkey url, p_partkey // 10 target FROM part WHERE p_partkey >= 10 AND p_partkey % 4 <> 3) SELECT p.p_partkey url, coalesce(c.target, b.target, a.target, p.p_partkey) AS "final", ((a.target IS NOT NULL)::INT + (b.target IS NOT NULL)::INT + (c.target IS NOT NULL)::INT) hops
FROM part p LEFT JOIN h a ON a.url = p.p_partkey LEFT JOIN h b ON b.url = a.target LEFT JOIN h c ON c.url = b.target""")
def f16_redirects(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    hops = p.filter("p_partkey >= 10 and p_partkey % 4 <> 3").select(F.col("p_partkey").alias("url"), F.expr("p_partkey div 10").alias("target"))
    return acquisition.redirects(p.select(F.col("p_partkey").alias("url")), hops, 3)


@query("""WITH g AS (SELECT o_custkey, least(2 * o_custkey, min(2 * o_orderkey + 1)) component FROM orders GROUP BY 1) SELECT 2 * o_custkey node, component FROM g UNION ALL SELECT 2 * o_orderkey + 1, component FROM orders JOIN g USING (o_custkey)""")
def g01_g03_independence_groups(spark, sf_dir):
    """Every order and customer is a node of its own: a customer's is twice its key, an order's twice its key and one."""
    return evidence.components(table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("a"), (F.col("o_orderkey") * 2 + 1).alias("b")))


@query("SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) parent, count(*) OVER (PARTITION BY conv_id) thread_size FROM conversations")
def g04_threads(spark, sf_dir):
    w = Window.partitionBy("conv_id")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("turn").over(w.orderBy("turn")).alias("parent"), F.count("*").over(w).alias("thread_size"))


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS \"day\", event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY ALL")
def r07_tumbling_windows(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) k FROM g), c AS (SELECT user_id, k, count(*) n FROM s GROUP BY ALL)
SELECT user_id, count(*) sessions, max(n) longest FROM c GROUP BY 1""")
def r04_r07_sessions(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) k FROM events")
def s02_s10_json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.from_json("props", "k long").getField("k").alias("k"))


_FAILED, _ENDS = "event_type = 'error'", "event_type = 'purchase' AND value > 150"


@query(f"""WITH e AS (SELECT user_id origin, event_id, ts, {_FAILED} failed, {_ENDS} ends, min(ts) OVER (PARTITION BY user_id) + INTERVAL 20 DAY deadline, max(ts) OVER () - INTERVAL 1 HOUR upto FROM events), i AS (SELECT *, row_number() OVER w i, sum(failed::INT) OVER (w ROWS 2 PRECEDING) f FROM e WINDOW w AS (PARTITION BY origin ORDER BY ts, event_id)),
c AS (SELECT origin, coalesce(min(i) FILTER (f = 3 AND i <= 40 AND ts < deadline), 1000000) open_, min(i) FILTER (ends AND i <= 40 AND ts < deadline) end_, any_value(deadline) deadline, any_value(upto) upto FROM i GROUP BY 1), d AS (SELECT origin, open_, CASE WHEN end_ <= open_ THEN end_ END end_, deadline, upto FROM c)
SELECT origin, event_id, CASE WHEN ts >= i.deadline OR coalesce(i > end_, false) THEN 'late' WHEN i > open_ OR i > 40 THEN 'suppressed' ELSE 'done' END status, CASE WHEN ts >= i.deadline OR coalesce(i > end_, false) THEN NULL WHEN i > open_ THEN 'origin_circuit_open' WHEN i > 40 THEN 'budget_exhausted' END reason FROM i JOIN d USING (origin)
UNION ALL SELECT origin, NULL, CASE WHEN end_ IS NOT NULL THEN 'completed' ELSE 'cancelled' END, CASE WHEN end_ IS NULL THEN 'origin_job_timeout' END FROM d WHERE end_ IS NOT NULL OR deadline <= upto""")
def r04_r06_jobs(spark, sf_dir):
    """The batch form; the stream with timers gives the same rows."""
    e = table(spark, sf_dir, "events").withColumn("origin", F.col("user_id"))
    upto = e.agg((F.max("ts") - F.expr("INTERVAL 1 HOUR")).alias("t"))
    return jobs.batch(e, F.expr(_FAILED), F.expr(_ENDS), F.lit(upto.first()["t"]))


@query("""WITH t AS (SELECT concat_ws('-', user_id, event_type) transaction_id, event_id number, event_type IN ('purchase', 'error') final, '' || coalesce(props, '') || '|' || event_id body FROM events)
SELECT transaction_id, number, final, sha256(body) sha256, n FROM (SELECT *, count(*) OVER (PARTITION BY transaction_id) n, row_number() OVER (PARTITION BY transaction_id ORDER BY final DESC, number DESC) k FROM t) WHERE k = 1""")
def k02_k06_snapshots(spark, sf_dir):
    """The last state of each transaction after three batches, of which one is delivered twice, with how many events it had."""
    body = F.concat_ws("|", F.coalesce("props", F.lit("")), F.col("event_id").cast("string"))
    name = F.concat_ws("-", "user_id", "event_type")
    rows = table(spark, sf_dir, "events").select(name.alias("transaction_id"), F.col("event_id").alias("number"), F.col("event_type").isin("purchase", "error").alias("final"), F.sha2(body, 256).alias("sha256"), body.cast("binary").alias("content"))
    store = Snapshots(spark, Folder(spark, "k06").path, "transaction_id string, number long, final boolean, sha256 string, content binary")
    kind = F.element_at(F.split("transaction_id", "-"), -1)
    arrival = F.when(kind == "error", 0).when(kind.isin("view", "click"), 2).otherwise(1)
    for k in (0, 1, 1, 2):
        store.upsert(rows.filter(arrival == k), k)
    n = rows.groupBy("transaction_id").agg(F.count("*").alias("n"))
    return store.rows().drop("content").join(n, "transaction_id")


# queries of a turn are the customers of a year; what they bring are the parts that they ordered
@query("""WITH o AS (SELECT o_orderpriority gap, year(o_orderdate) - 1991 turn, o_custkey query, o_orderkey FROM orders), p AS (SELECT DISTINCT gap, turn, query FROM o WHERE turn BETWEEN 1 AND 6), a AS (SELECT gap, query, min(turn) turn FROM p GROUP BY ALL),
f AS (SELECT gap, evidence, min(turn) turn FROM (SELECT a.gap, a.turn, l_partkey evidence FROM a JOIN o ON o.gap = a.gap AND o.query = a.query JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY ALL), n AS (SELECT count(*) n FROM part), g AS (SELECT DISTINCT o_orderpriority gap, turn FROM orders, range(1, 7) t(turn)),
c AS (SELECT g.gap, g.turn, (SELECT count(*) FROM p WHERE p.gap = g.gap AND p.turn = g.turn) proposed, (SELECT count(*) FROM a WHERE a.gap = g.gap AND a.turn = g.turn) asked, (SELECT count(*) FROM f WHERE f.gap = g.gap AND f.turn = g.turn) gained FROM g),
s AS (SELECT *, (sum(gained) OVER w)::BIGINT covered, (sum(asked) OVER w)::BIGINT spent FROM c WINDOW w AS (PARTITION BY gap ORDER BY turn)),
r AS (SELECT s.*, CASE WHEN covered >= 0.99 * n THEN 'target_reached' WHEN proposed = 0 THEN 'no_source_left' WHEN proposed - asked > 0.9 * proposed THEN 'repeating' WHEN gained < 1 THEN 'no_new_evidence' WHEN spent >= 100000000 THEN 'budget_exhausted' WHEN turn >= 6 THEN 'limit_reached' END stop FROM s, n)
SELECT gap, turn::INTEGER turn, proposed, asked, gained, covered, spent, stop FROM (SELECT *, count(stop) OVER (PARTITION BY gap ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ended FROM r) WHERE ended = 0""")
def g05_gap_loop(spark, sf_dir):
    """For each priority, the turns of a search for parts, until 99 of 100 are found or another rule ends it."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("gap"), (F.year("o_orderdate") - 1991).alias("turn"), F.col("o_custkey").alias("query"), "o_orderkey")
    parts = table(spark, sf_dir, "part").agg((F.count("*") * F.lit(0.99)).alias("target"))  # one row
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("evidence"))
    loop = gaploop.Loop(
        spark, Folder(spark, "g05").path, o.select("gap").distinct().join(F.broadcast(parts)), lambda turn, _: o.filter(F.col("turn") == turn),
        lambda new: new.join(o.select("gap", "query", "o_orderkey"), ["gap", "query"]).join(lines, "o_orderkey"), repeated=0.9, budget=100_000_000,
    )
    return loop.run().select("gap", "turn", "proposed", "asked", "gained", "covered", "spent", "stop")
