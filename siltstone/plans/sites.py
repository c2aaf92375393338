"""Queries over planning, extraction and evidence of sites, with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from siltstone.functions import pages, texts, urls
from siltstone.operators import acquisition, evidence
from siltstone.plans.flows import _OUT, _TX, _outcome, transactions
from siltstone.plans.web import _D, _HASH, _TOK, _VARIED, table, varied
from siltstone.sources import stored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# guards and policies


@query(f"""WITH d AS (SELECT *, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) allowed FROM ({_D} FROM (SELECT page_id, url, {_VARIED} u FROM pages))) SELECT page_id, CASE WHEN s = '' THEN 'invalid_url' WHEN s NOT IN ('http', 'https') THEN 'scheme_denied'
 WHEN regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*@)', 1) <> '' THEN 'credentials_denied' WHEN p NOT IN ('', '80', '443') THEN 'port_denied' WHEN regexp_matches(h, '^(\\[.*\\]|[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}})$') THEN 'ip_literal_denied' WHEN s || '://' || h <> allowed THEN 'origin_denied' END reason FROM d""")
def f02_single_origin(spark, sf_dir):
    allowed = F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1)
    return varied(spark, sf_dir).select("page_id", urls.within_origin(F.col("u"), allowed).alias("reason"))


_RULES = [("listing", "https", "/[a-z]{2}/[0-9]+", ""), ("second_page", "https", "/[a-z]{2}/[0-9]+", "page=2&ref=x"), ("robots", "http", "/robots[.]txt", "")]
_METHOD = "CASE page_id % 4 WHEN 0 THEN 'listing' WHEN 1 THEN 'second_page' WHEN 2 THEN 'robots' ELSE 'unknown' END"


@query(f"""WITH r(method, scheme, path, query) AS (VALUES {", ".join(map(str, _RULES))}), p AS (SELECT page_id, url, {_METHOD} method FROM pages) SELECT page_id, p.method, r.method IS NOT NULL AND regexp_extract(url, '^([a-z]+)://', 1) = scheme AND regexp_full_match(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), path)
 AND regexp_extract(url, '[?]([^#]*)', 1) = query allowed FROM p LEFT JOIN r USING (method)""")
def f03_path_rules(spark, sf_dir):
    """Each method may fetch its own paths only; the rules are a table, small by its nature."""
    rules = spark.createDataFrame(_RULES, "method string, scheme string, path string, query string")
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(_METHOD).alias("method")).join(F.broadcast(rules), "method", "left")
    return p.select("page_id", "method", urls.fits_rule(F.col("url"), F.col("scheme"), F.col("path"), F.col("query")).alias("allowed"))


_ENCODING = "CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'gzip' WHEN 2 THEN ' Deflate' WHEN 3 THEN 'br' WHEN 4 THEN 'gzip, deflate' WHEN 5 THEN 'identity' ELSE '' END"


@query(f"SELECT doc_id, coalesce(lower(trim({_ENCODING})), '') IN ('', 'identity', 'gzip', 'deflate') accepted FROM documents")
def f15_accepted_encodings(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", pages.accepted_encoding(F.expr(_ENCODING)).alias("accepted"))


_SITE = {"view": "robots_preflight", "click": "root_html", "purchase": "sitemap_xml", "signup": "rss_link_discovery"}
_MAP = "CASE method_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SITE.items()) + " END"


@query(f"""{_TX}, m AS (SELECT user_id, {_MAP} m, max_by({_OUT}, event_id) o FROM tx GROUP BY ALL), s AS (SELECT s_suppkey, CASE WHEN s_acctbal > 1000 THEN s_name END official_origin FROM supplier)
SELECT s_suppkey, CASE WHEN official_origin IS NULL THEN '' ELSE 'robots_preflight,root_html,sitemap_xml' END selected, CASE WHEN official_origin IS NULL THEN '' ELSE 'rss_feed' END conditional, coalesce(bool_or(m = 'rss_link_discovery' AND o = 'succeeded'), false) rss_signal,
 coalesce(max(o) FILTER (m = 'root_html'), 'not_reported') root_outcome, CASE WHEN official_origin IS NULL THEN 'unresolved_official_origin' ELSE 'adaptive_core_selected' END stop_reason FROM s LEFT JOIN m ON user_id = s_suppkey GROUP BY s_suppkey, official_origin""")
def f19_selected_methods(spark, sf_dir):
    """What a second pass fetches of each source, from its origin and what the first pass found."""
    tx = transactions(spark, sf_dir).withColumn("method", F.expr(_MAP)).filter("method is not null")
    first = tx.groupBy("user_id", "method").agg(F.max_by(_outcome(), "event_id").alias("outcome"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), F.when(F.col("s_acctbal") > 1000, F.col("s_name")).alias("official_origin"))
    return acquisition.second_pass(s, first, "user_id").select(F.col("user_id").alias("s_suppkey"), F.array_join("selected", ",").alias("selected"), F.array_join("conditional", ",").alias("conditional"), "rss_signal", "root_outcome", "stop_reason")


@query("""WITH scoped AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING') SELECT n_name, count(c_custkey) customers, round(coalesce(sum(c_acctbal), 0), 2) balance FROM nation LEFT JOIN scoped ON c_nationkey = n_nationkey GROUP BY 1""")
def f24_tenant_scope(spark, sf_dir):
    """Reads of a tenant's rows, here a market segment, never see another's."""
    own = evidence.scoped(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "tenant_id"), "BUILDING")
    g = own.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance"))
    n = table(spark, sf_dir, "nation").join(g, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return n.select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.round(F.coalesce("balance", F.lit(0.0)), 2).alias("balance"))


_POLICIES = [("view", 30, True), ("click", 7, True), ("purchase", 3650, False), ("signup", 1, True)]


@query(f"""WITH p(event_type, days, reusable) AS (VALUES {", ".join(map(str, _POLICIES))}), m AS (SELECT max(ts) m FROM events) SELECT event_id, coalesce(reusable AND ts + to_days(days) >= m, false) reusable, CASE WHEN days IS NULL THEN 'no_policy' WHEN NOT reusable THEN 'licence' WHEN ts + to_days(days) < m THEN 'expired' END reason
FROM events LEFT JOIN p USING (event_type), m""")
def f25_reusable_artifacts(spark, sf_dir):
    """What a cache may hand out again: its licence allows it and its retention hasn't ended. The time asked for is the last of the table."""
    e = table(spark, sf_dir, "events")
    rules = spark.createDataFrame(_POLICIES, "event_type string, days int, licensed boolean")
    at = F.lit(e.agg(F.max("ts")).first()[0])
    return evidence.reusable(e, rules, "event_type", "ts", at).select("event_id", "reusable", "reason")


@query(f"""{_TX}, k AS (SELECT *, coalesce(max((coalesce(network_error, false) OR coalesce(status >= 400, false))::INT) OVER (PARTITION BY origin, method_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) failed FROM tx) SELECT event_id, failed = 0 fetched FROM k""")
def s07_until_first_failure(spark, sf_dir):
    """The queries of an arm run in turn up to and with the first that fails."""
    w = Window.partitionBy("origin", "method_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.coalesce(F.col("network_error"), F.lit(False)) | F.coalesce(F.col("status") >= 400, F.lit(False))
    return transactions(spark, sf_dir).select("event_id", (F.coalesce(F.max(failed.cast("int")).over(w), F.lit(0)) == 0).alias("fetched"))


# sources


_LIST = "CASE p_partkey % 5 WHEN 0 THEN '[' || (p_partkey + 1) || ', ' || (p_partkey + 2) || ']' WHEN 1 THEN '[]' WHEN 2 THEN '{\"id\": 1}' WHEN 3 THEN '[0, 5]' ELSE '[' || p_partkey || ', 1000000000]' END"


@query(f"""WITH l AS (SELECT p_partkey, json_extract({_LIST}, '$[*]')::BIGINT[] ids, starts_with({_LIST}, '[') is_list FROM part), v AS (SELECT *, is_list AND len(list_filter(ids, lambda x: x <= 0)) = 0 valid FROM l)
SELECT p_partkey, CASE WHEN NOT valid THEN 'invalid_api_list' WHEN len(ids) = 0 THEN 'empty_api_list' ELSE 'ok' END status, (SELECT count(*) FROM part q WHERE valid AND list_contains(ids[1:20], q.p_partkey)) items FROM v""")
def s11_listed_items(spark, sf_dir):
    """Lists of item numbers, all above 0: their first 20 that are there as items."""
    part = table(spark, sf_dir, "part")
    ids = F.from_json(F.expr(_LIST), "array<long>")
    valid = F.expr(_LIST).startswith("[") & F.forall(ids, lambda x: F.coalesce(x > 0, F.lit(False)))
    l = part.select("p_partkey", ids.alias("ids"), F.coalesce(valid, F.lit(False)).alias("valid"))
    asked = l.filter("valid").select("p_partkey", F.explode(F.slice("ids", 1, 20)).alias("item"))
    found = asked.join(part.select(F.col("p_partkey").alias("item")), "item").groupBy("p_partkey").agg(F.countDistinct("item").alias("items"))
    status = F.when(~F.col("valid"), "invalid_api_list").when(F.size("ids") == 0, "empty_api_list").otherwise("ok")
    return l.join(found, "p_partkey", "left").select("p_partkey", status.alias("status"), F.coalesce("items", F.lit(0)).alias("items"))


@query("""WITH l AS (SELECT s_suppkey, lower(replace(s_name, 'Supplier', 'Customer')) label, s_suppkey // 25 batch FROM supplier), e AS (SELECT lower(c_name) label, 'Q' || (c_custkey + 1) qid, CASE WHEN c_acctbal > 0 THEN 'https://' || c_custkey || '.example' END website FROM customer)
SELECT s_suppkey, batch, count(qid) entities, count(website) websites, min(qid) AS first FROM l LEFT JOIN e USING (label) GROUP BY 1, 2""")
def s12_s13_entity_lookup(spark, sf_dir):
    """Labels, in batches as an outside service would take them, meet stored entities in one equi-join."""
    l = table(spark, sf_dir, "supplier").select("s_suppkey", F.lower(F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))).alias("label"), F.expr("s_suppkey div 25").alias("batch"))
    e = table(spark, sf_dir, "customer").select(F.lower("c_name").alias("label"), F.concat(F.lit("Q"), F.col("c_custkey") + 1).alias("qid"), F.when(F.col("c_acctbal") > 0, F.concat(F.lit("https://"), "c_custkey", F.lit(".example"))).alias("website"))
    return l.join(e, "label", "left").groupBy("s_suppkey", "batch").agg(F.count("qid").alias("entities"), F.count("website").alias("websites"), F.min("qid").alias("first"))


# pages


@query("SELECT page_id, md5(substr(html, 1, 50) || chr(65533) || url) decoded FROM pages")
def x07_decoded(spark, sf_dir):
    """Bytes as text; what is no UTF-8 becomes U+FFFD."""
    raw = F.concat(F.substring("html", 1, 50).cast("binary"), F.unhex(F.lit("FF")), F.col("url").cast("binary"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.make_valid_utf8(raw.cast("string")).cast("binary")).alias("decoded"))


_DATA = """CASE page_id % 6 WHEN 0 THEN '<script type="application/json">{"Price": ' || page_id || '}</script>' WHEN 1 THEN '<SCRIPT> [{"rating": ' || page_id || '}] </SCRIPT><script>var x = {"price": 1}</script>' WHEN 2 THEN '<script>{"a": ' || page_id || '}</script>'
 WHEN 3 THEN '<script type="application/ld+json">{"review": 1}</script>' WHEN 4 THEN '<script>{"review": broken</script>' ELSE '<p>{"price": 1}</p><script>{"description": "' || url || '"}</script><script>{"price": 2}</script>' END"""


@query("""SELECT page_id, CASE page_id % 6 WHEN 5 THEN 2 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END::BIGINT n, CASE page_id % 6 WHEN 0 THEN '{"Price": ' || page_id || '}' WHEN 1 THEN '[{"rating": ' || page_id || '}]' WHEN 5 THEN '{"description": "' || url || '"}' END AS first FROM pages""")
def x11_embedded_json(spark, sf_dir):
    found = pages.embedded_json(F.expr(_DATA))
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("n"), F.get(found, F.lit(0)).alias("first"))


_FOUND = """CASE page_id % 3 WHEN 0 THEN '<a rel="nofollow" class="x result__a" href="//d.example/l/?uddg=https%3A%2F%2Fs' || page_id || '.example%2Fa&amp;rut=1">S <b>' || page_id || '</b> &amp; co</a><a rel="nofollow" href="https://other.example/">Other title</a>'
 WHEN 1 THEN '<a rel="nofollow" href="https://t' || page_id || '.example/?a=1&amp;b=2">Title  ' || page_id || '</a><a rel="nofollow" href="https://short.example/">abc</a><a rel="nofollow" href="/local">Local one</a>' ELSE '<a href="https://plain.example/">plain</a>' END"""


@query("""SELECT page_id, CASE page_id % 3 WHEN 2 THEN 0 ELSE 1 END::BIGINT n, CASE page_id % 3 WHEN 0 THEN 'https://s' || page_id || '.example/a' WHEN 1 THEN 'https://t' || page_id || '.example/?a=1&b=2' END url, CASE page_id % 3 WHEN 0 THEN 'S ' || page_id || ' & co' WHEN 1 THEN 'Title ' || page_id END title FROM pages""")
def x15_results(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", pages.results(F.expr(_FOUND)).alias("r"))
    return p.select("page_id", F.size("r").cast("long").alias("n"), F.get("r", F.lit(0))["url"].alias("url"), F.get("r", F.lit(0))["title"].alias("title"))


_LABEL = "regexp_extract(url, '://([^/?#]*)', 1)"
_SEEN = f"CASE WHEN page_id % 2 = 0 THEN {_LABEL} ELSE substr({_LABEL}, 1, 6) END"


@query(f"""WITH t AS (SELECT page_id, url, list_filter({_TOK.format(_LABEL)}, lambda x: NOT list_contains({texts.GENERIC}, x)) n, {_TOK.format(_SEEN)} e FROM pages), c AS (SELECT page_id, url, CASE WHEN len(n) = 0 THEN 0 ELSE len(list_intersect(n, e)) / len(n) END c FROM t)
SELECT page_id, starts_with(url, 'https://') AND c >= 0.6 accepted, CASE WHEN NOT starts_with(url, 'https://') THEN 'https_required' WHEN c >= 0.6 THEN 'confidence_passed' ELSE 'confidence_below_threshold' END stop_reason FROM c""")
def x21_target_shape(spark, sf_dir):
    """Is a page what a label names? Its address must be https and unguarded, and its evidence have the label's tokens."""
    label, seen = F.regexp_extract("url", "://([^/?#]*)", 1), F.expr(_SEEN)
    shape = texts.target_shape(F.col("url"), label, seen)
    return table(spark, sf_dir, "pages").select("page_id", (shape == "confidence_passed").alias("accepted"), shape.alias("stop_reason"))


@query("""SELECT o_orderkey, '{' || array_to_string(list_filter(['"id":' || o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN '"status":"' || o_orderstatus || '"' END, CASE WHEN o_custkey % 2 = 0 THEN '"customer":' || o_custkey END], lambda x: x IS NOT NULL), ',') || '}' item FROM orders""")
def x24_compact_items(spark, sf_dir):
    item = F.struct(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("customer"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(item).alias("item"))


_COUNTS = ", ".join(f"len(list_filter(t, lambda x: list_contains({words}, x))) {lang}" for lang, words in texts.STOP_WORDS.items())


@query(f"""WITH w AS (SELECT doc_id, length(text) n, regexp_extract_all(lower(text), '([a-z]+)', 1) t FROM documents), c AS (SELECT doc_id, n, {_COUNTS} FROM w)
SELECT doc_id, CASE WHEN n < 20 OR n IS NULL OR greatest(de, en, es, fr) = 0 THEN 'unknown' {" ".join(f"WHEN {lang} = greatest(de, en, es, fr) THEN '{lang}'" for lang in texts.STOP_WORDS)} END lang FROM c""")
def x31_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.language(F.col("text")).alias("lang"))


_SIGNALS = """CASE WHEN s_acctbal > 8000 THEN 'active_website_signal' WHEN s_acctbal > 4000 THEN 'registered_domain_signal' WHEN s_suppkey % 4 = 0 THEN 'historical_certificate_signal' WHEN n >= 5 THEN 'brand_collision_candidate' ELSE 'not_verified' END"""


@query(f"""WITH n AS (SELECT s_nationkey, count(*) n FROM supplier GROUP BY 1) SELECT s_suppkey, lower(replace(s_name, '#', '-')) || suffix AS domain, {_SIGNALS} signal FROM supplier JOIN n USING (s_nationkey), (VALUES ('.com'), ('.io'), ('-app.com')) v(suffix)""")
def x36_domain_signals(spark, sf_dir):
    """Name variations of each source, and the strongest signal that its observations allow; none says more than was seen."""
    s = table(spark, sf_dir, "supplier")
    own = s.join(s.groupBy("s_nationkey").agg(F.count("*").alias("n")), "s_nationkey")
    seen = dict(answers=F.col("s_acctbal") > 8000, registered=F.col("s_acctbal") > 4000, certified=F.col("s_suppkey") % 4 == 0, alike=F.col("n") >= 5)
    return own.select("s_suppkey", F.explode(urls.variations(F.replace("s_name", F.lit("#"), F.lit("-")))).alias("domain"), evidence.domain_signal(**seen).alias("signal"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) n FROM events GROUP BY ALL) SELECT user_id, array_to_string(list_sort(list(event_type || '=' || n * 2)), ',') doubled, count(*) kinds FROM c GROUP BY 1""")
def x40_map_functions(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = c.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))  # an entry for each type
    doubled = F.transform_values("m", lambda k, v: v * 2)
    return m.select("user_id", F.array_join(F.array_sort(F.transform(F.map_entries(doubled), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("doubled"), F.size("m").cast("long").alias("kinds"))


# near duplicates

_BLOCKS = [(10 * k, 10) for k in range(6)]


@query(f"""WITH r AS (SELECT doc_id, {_HASH} h FROM (SELECT doc_id, unnest({_TOK.format("text")}) t FROM documents)), s AS (SELECT doc_id, {", ".join(f"CASE WHEN sum(CASE WHEN (h >> {b}) & 1 = 1 THEN 1 ELSE -1 END) >= 0 THEN {1 << b} ELSE 0 END b{b}" for b in range(60))} FROM r GROUP BY 1), v AS (SELECT doc_id, ({" + ".join(f"b{b}" for b in range(60))})::BIGINT simhash FROM s),
 c AS (SELECT simhash, min(doc_id) class_id, count(*) copies FROM v GROUP BY 1), l AS (SELECT a.simhash, count(*) links FROM c a JOIN c b ON a.simhash <> b.simhash AND bit_count(xor(a.simhash, b.simhash)) <= 3 GROUP BY 1)
SELECT doc_id, class_id, copies, coalesce(links, 0) links FROM v JOIN c USING (simhash) LEFT JOIN l USING (simhash)""")
def j13_near_duplicates(spark, sf_dir):
    """Documents by class of equal SimHash, and how many other classes are within three bits.

    Of six blocks of ten bits, two hashes within three bits agree in three at least: every three blocks are a key of an
    equi-join of classes, and what meets is compared whole.
    """
    v = texts.simhash(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    c = v.groupBy("simhash").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    links = texts.near_hashes(c.select("simhash"), "simhash", 3, _BLOCKS)
    n = links.groupBy("simhash").agg(F.count("*").alias("links"))
    return v.join(c.join(n, "simhash", "left"), "simhash").select("doc_id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))


# evidence


_PILLAR = "count(*) claims, count(DISTINCT l_suppkey) sources, count_if(l_returnflag = 'R')::BIGINT challenging, count_if(l_linestatus = 'F')::BIGINT supporting"


@query(f"""WITH g AS (SELECT r_name pillar, n_name source_nation, {_PILLAR} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT *, CASE WHEN sources < 2 THEN 'insufficient' WHEN supporting > 2 * challenging THEN 'strong' WHEN supporting > challenging THEN 'mixed' ELSE 'weak' END status FROM g""")
def j18_s16_pillar_evidence(spark, sf_dir):
    """Evidence meets the source registry and the pillars in a star of joins; the dimensions have a row for each nation and region."""
    dims = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    registry = table(spark, sf_dir, "supplier").join(dims, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("source_nation"), F.col("r_name").alias("pillar"))
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").join(registry, F.col("l_suppkey") == F.col("s_suppkey"))
    g = l.groupBy("pillar", "source_nation").agg(F.count("*").alias("claims"), F.countDistinct("l_suppkey").alias("sources"), F.count_if(F.col("l_returnflag") == "R").alias("challenging"), F.count_if(F.col("l_linestatus") == "F").alias("supporting"))
    return g.withColumn("status", evidence.pillar_status(F.col("sources"), F.col("supporting"), F.col("challenging")))


@query(f"""{_TX}, g AS (SELECT origin, count(*) used, count_if({_OUT} = 'succeeded')::BIGINT completed FROM tx GROUP BY 1) SELECT origin, used, completed, 60::BIGINT lease, greatest(60 - used, 0) unused, used > 60 overrun FROM g""")
def a10_worker_metrics(spark, sf_dir):
    g = transactions(spark, sf_dir).groupBy("origin").agg(F.count("*").alias("used"), F.count_if(_outcome() == "succeeded").alias("completed"))
    return g.select("*", F.lit(60).cast("long").alias("lease"), F.greatest(60 - F.col("used"), F.lit(0)).alias("unused"), (F.col("used") > 60).alias("overrun"))


@query("""SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderdate, o_orderkey) tasks, count(*) n FROM orders GROUP BY 1""")
def a12_grouped_tasks(spark, sf_dir):
    """Tasks of each origin in their order."""
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("l"), F.count("*").alias("n"))
    return g.select("o_custkey", F.array_join(F.transform("l", lambda x: x["o_orderkey"].cast("string")), ",").alias("tasks"), "n")


@query("""WITH g AS (SELECT p_brand, count(DISTINCT l_suppkey) competitors, count(*) sightings, min(year(o_orderdate)) since, count_if(year(o_orderdate) >= 1997) / count(*) fresh FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT p_brand, competitors, sightings, round(fresh, 6) fresh, CASE WHEN sightings < 5 THEN 'unknown' WHEN competitors <= 2 THEN 'new' WHEN fresh > 0.6 THEN 'emerging' WHEN since <= 1994 AND fresh < 0.2 THEN 'existing' ELSE 'resegmented' END maturity FROM g""")
def a20_market_maturity(spark, sf_dir):
    """Few sightings say nothing of a market; thresholds are ours."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    g = l.groupBy("p_brand").agg(F.countDistinct("l_suppkey").alias("competitors"), F.count("*").alias("sightings"), F.min("y").alias("since"), F.avg((F.col("y") >= 1997).cast("int")).alias("fresh"))
    return g.select("p_brand", "competitors", "sightings", F.round("fresh", 6).alias("fresh"), evidence.maturity(F.col("competitors"), F.col("sightings"), F.col("since"), F.col("fresh")).alias("maturity"))


@query("""SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) missing, (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) extra""")
def u04_set_equality(spark, sf_dir):
    """What either set lacks of the other; they are equal if both are 0."""
    a, b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct()
    sides = a.exceptAll(b).select(F.lit(1).alias("m"), F.lit(0).alias("e")).union(b.exceptAll(a).select(F.lit(0), F.lit(1)))
    return sides.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("missing"), F.coalesce(F.sum("e"), F.lit(0)).alias("extra"))


@query(f"""{_TX} SELECT origin, count_if(coalesce({_OUT}, '') <> 'challenge')::BIGINT transactions, count_if({_OUT} = 'challenge')::BIGINT policy_events FROM tx GROUP BY 1""")
def u05_u06_disjoint_records(spark, sf_dir):
    """Workers' records together; what policy stopped is no transaction and is counted apart."""
    tx = transactions(spark, sf_dir).withColumn("outcome", _outcome())
    spent, stopped = acquisition.apart(tx, F.col("outcome") == "challenge")
    both = spent.select("origin", F.lit(1).alias("t"), F.lit(0).alias("p")).unionByName(stopped.select("origin", F.lit(0).alias("t"), F.lit(1).alias("p")))
    return both.groupBy("origin").agg(F.sum("t").alias("transactions"), F.sum("p").alias("policy_events"))


@query("""SELECT o_orderpriority, count(*) n, quantile_cont(o_totalprice, 0.5) p50, quantile_cont(o_totalprice, 0.9) p90 FROM orders GROUP BY 1""")
def w10_percentiles(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.percentile("o_totalprice", 0.5).alias("p50"), F.percentile("o_totalprice", 0.9).alias("p90"))


@query("""WITH g AS (SELECT o_orderpriority gap, year(o_orderdate) - 1991 AS "round", count(DISTINCT o_custkey) n FROM orders GROUP BY ALL), c AS (SELECT *, sum(n) OVER w / sum(n) OVER (PARTITION BY gap) coverage FROM g WINDOW w AS (PARTITION BY gap ORDER BY "round" ROWS UNBOUNDED PRECEDING)),
 d AS (SELECT *, coverage - coalesce(lag(coverage) OVER (PARTITION BY gap ORDER BY "round"), 0) gain FROM c), s AS (SELECT *, CASE WHEN coverage >= 0.8 THEN 'target_reached' WHEN gain < 0.05 THEN 'no_new_evidence' WHEN "round" >= 6 THEN 'budget_exhausted' END stop FROM d)
SELECT gap, "round", round(coverage, 6) coverage, coalesce(count(stop) OVER (PARTITION BY gap ORDER BY "round" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 runs, stop FROM s""")
def g05_w11_gap_rounds(spark, sf_dir):
    """Rounds of a search for what is missing run until one reaches the target, brings too little or is the last that the budget allows."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("gap"), (F.year("o_orderdate") - 1991).cast("long").alias("round"), "o_custkey")
    n = o.groupBy("gap", "round").agg(F.countDistinct("o_custkey").alias("n"))
    return evidence.gap_rounds(n, "gap", "round", "n", target=0.8, least=0.05, most=6).select("gap", "round", F.round("coverage", 6).alias("coverage"), "runs", "stop")


@query("""WITH g AS (SELECT o_custkey, count(*) + 1 size, least(2 * o_custkey, min(2 * o_orderkey + 1)) c FROM orders GROUP BY 1) SELECT 2 * o_custkey node, CASE WHEN size >= 5 THEN c END AS "group" FROM g UNION ALL SELECT 2 * o_orderkey + 1, CASE WHEN size >= 5 THEN c END FROM orders JOIN g USING (o_custkey)""")
def g02_dense_groups(spark, sf_dir):
    """Components of five nodes or more are groups; what stands nearly alone stays unassigned."""
    return evidence.dense(evidence.components(table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("a"), (F.col("o_orderkey") * 2 + 1).alias("b"))), 5)


# sources, tied together


_FEEDS = """'<link rel="alternate" type="application/rss+xml" href="/feed' || page_id % 7 || '"><link type="application/atom+xml" rel="alternate" href="/feed' || (page_id + 1) % 7 || '">'"""


@query("SELECT page_id, '/feed' || page_id % 7 feed, i::BIGINT place, 'Item ' || i || ' of ' || page_id % 7 title FROM pages, LATERAL (SELECT unnest(range(0, page_id % 7 + 1)) i)")
def s08_first_feed(spark, sf_dir):
    """Items of the first feed that each page tells of."""
    p = table(spark, sf_dir, "pages").select("page_id", F.get(pages.feeds(F.expr(_FEEDS)), F.lit(0)).alias("feed"))
    item = F.array_join(F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: F.concat(F.lit("<item><title>Item "), i, F.lit(" of "), F.col("k"), F.lit("</title></item>"))), "")
    bodies = spark.range(7).select(F.concat(F.lit("/feed"), "id").alias("source_id"), F.col("id").alias("k")).select("source_id", F.concat(F.lit("<rss>"), item, F.lit("</rss>")).alias("body"))
    items = stored.feed_items(bodies).withColumnRenamed("source_id", "feed")
    return p.join(items, "feed").select("page_id", "feed", F.col("place").cast("long").alias("place"), "title")


_ROBOTS = "CASE nation % 4 WHEN 0 THEN 'User-agent: *' || char(10) || 'Disallow: /private' || char(10) || 'Allow: /' WHEN 1 THEN 'User-agent: other' || char(10) || 'Disallow: /' WHEN 2 THEN 'user-agent: *' || char(10) || 'Allow: /private/open' || char(10) || 'Disallow: /private # all else' ELSE '# none' END"
_PATH = "CASE s_suppkey % 3 WHEN 0 THEN '/private/' || s_suppkey WHEN 1 THEN '/private/open/' || s_suppkey ELSE '/public' END"


@query(f"SELECT s_suppkey, NOT (s_suppkey % 3 < 2 AND (s_nationkey % 4 = 0 OR s_nationkey % 4 = 2 AND s_suppkey % 3 = 0)) allowed FROM supplier")
def s06_f06_robots(spark, sf_dir):
    """Which requests the rules of their origin's robots text allow."""
    bodies = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation")).select(F.concat(F.lit("n"), "nation").alias("origin"), F.expr(_ROBOTS).alias("body"))
    asked = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("n"), "s_nationkey").alias("origin"), F.expr(_PATH).alias("path"))
    return stored.may_fetch(asked, stored.robots_rules(bodies)).select("s_suppkey", "allowed")


@query("""SELECT p_partkey, '' || p_partkey id FROM part UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, '-5' FROM part WHERE p_partkey % 3 = 0""")
def s10_listed_ids(spark, sf_dir):
    """Ids of JSON lists: strings and whole numbers count, the first 100 entries are looked at."""
    body = F.expr("""'[' || p_partkey || ', true, null, 2.5, {"a": 1}' || if(p_partkey % 2 = 0, ', "' || p_name || '"', '') || if(p_partkey % 3 = 0, ', -5', '') || repeat(', null', 95) || ', 7]'""")
    return stored.list_ids(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), body.alias("body"))).select(F.col("source_id").alias("p_partkey"), "id")


@query("SELECT page_id, page_id % 6 IN (0, 3) allowed FROM pages")
def f04_global_addresses(spark, sf_dir):
    """Every address that a name stands for must be a public one."""
    lists = {0: ["93.184.216.34", "8.8.8.8"], 1: ["8.8.8.8", "10.0.0.7"], 2: [], 3: ["2606:4700::1111"], 4: ["2001:db8::1"], 5: ["no address"]}
    own = F.element_at(F.array(*[F.array(*map(F.lit, x)).cast("array<string>") for x in lists.values()]), (F.col("page_id") % 6).cast("int") + 1)
    return table(spark, sf_dir, "pages").select("page_id", urls.all_global(own).alias("allowed"))
