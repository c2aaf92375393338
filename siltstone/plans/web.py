"""Queries over pages and documents, with the same in DuckDB's SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltstone.functions import pages, table_functions, texts, urls
from siltstone.sources import stored
from siltstone.sources.tables import Folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_P = r"'^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]/?#]*\]|[^/?#:@]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(#.*)?$'"
_D = f"SELECT *, lower(regexp_extract(u, {_P}, 1)) s, regexp_replace(lower(regexp_extract(u, {_P}, 3)), '\\.$', '') h, regexp_extract(u, {_P}, 4) p, regexp_extract(u, {_P}, 5) path, regexp_extract(u, {_P}, 6) q"
#: pages.url in forms that the verdicts differ for
_VARIED = """CASE page_id % 9 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://user:pass@') WHEN 2 THEN 'file:///etc/passwd' WHEN 3 THEN 'http://127.0.0.1/' || page_id WHEN 4 THEN 'http://localhost/'
 WHEN 5 THEN replace(url, '.com/', '.com:8080/') WHEN 6 THEN upper(substr(url, 1, 14)) || substr(url, 15) WHEN 7 THEN 'no url ' || page_id ELSE 'https://meta.internal/' || page_id END"""


def varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").withColumn("u", F.expr(_VARIED))


@query(f"""WITH d AS ({_D} FROM (SELECT page_id, {_VARIED} u FROM pages)), o AS (SELECT *, CASE WHEN s IN ('http', 'https') AND h <> '' THEN s || '://' || h || CASE WHEN p = '' OR (s = 'http' AND p = '80') OR (s = 'https' AND p = '443') THEN '' ELSE ':' || p END END origin FROM d)
SELECT page_id, origin, origin || CASE WHEN path = '' THEN '/' ELSE path END || coalesce(q, '') canonical FROM o""")
def x01_x02_x03_canonical_url(spark, sf_dir):
    return varied(spark, sf_dir).select("page_id", urls.origin(F.col("u")).alias("origin"), urls.canonical(F.col("u")).alias("canonical"))


@query(f"""WITH d AS ({_D} FROM (SELECT page_id, {_VARIED} u FROM pages)) SELECT page_id, CASE WHEN s = '' THEN 'invalid_url' WHEN s NOT IN ('http', 'https') THEN 'scheme_not_allowed'
 WHEN regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*@)', 1) <> '' THEN 'credentials_not_allowed' WHEN h = '' THEN 'missing_host' WHEN regexp_matches(h, '^(\\[.*\\]|[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}})$') THEN 'ip_literal_not_allowed'
 WHEN position('.' in h) = 0 OR regexp_extract(h, '([^.]*)$', 1) IN ('localhost', 'local', 'internal', 'lan', 'home', 'corp') THEN 'internal_host_not_allowed' WHEN p NOT IN ('', '80', '443') THEN 'port_not_allowed' END reason FROM d""")
def f01_f02_f03_url_guard(spark, sf_dir):
    return varied(spark, sf_dir).select("page_id", urls.guard(F.col("u")).alias("reason"))


@query(r"""SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END clean FROM (SELECT page_id, url,
 list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)')) k FROM pages)""")
def x29_without_tracking(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.without_tracking(F.col("url")).alias("clean"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(replace(url, '#', '?h='), ' ', '') ELSE url END target FROM pages")
def x04_unwrapped(spark, sf_dir):
    inner = F.expr("replace(replace(url, '#', '?h='), ' ', '')")
    link = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://search.example/l/?k=1&uddg="), F.url_encode(inner), F.lit("&z=2"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", urls.unwrapped(link).alias("target"))


def _gone(x: str, tag: str) -> str:
    return rf"array_to_string(list_concat(list_transform(regexp_split_to_array({x}, '(?i)</{tag}\s*>')[:-2], lambda p: regexp_split_to_array(p, '(?i)<{tag}\b')[1]), [regexp_split_to_array({x}, '(?i)</{tag}\s*>')[-1]]), ' ')"


def _plain(x: str) -> str:
    # the entities of the pages table; DuckDB has no table of all
    text = rf"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for entity, c in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{c}')"
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


def _boilerplate(x: str) -> str:
    for tag in ("nav", "footer", "aside", "script", "style"):
        x = _gone(x, tag)
    return x


@query(rf"""WITH t AS (SELECT page_id, {_plain("regexp_split_to_array(regexp_split_to_array(html, '(?i)<title[^>]*>')[2], '(?i)</title')[1]")} t, {_plain(_gone(_gone("html", "script"), "style"))} b FROM pages)
SELECT page_id, CASE WHEN t <> '' THEN substr(t, 1, 500) END title, length(b)::BIGINT n_chars, md5(b) text_md5, substr(b, 1, 240) excerpt FROM t""")
def x06_x08_x16_title_and_text(spark, sf_dir):
    text = pages.visible_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", pages.title(F.col("html")).alias("title"), text.alias("t")).select("page_id", "title", F.length("t").cast("long").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("text_md5"), F.substring("t", 1, 240).alias("excerpt"))


@query(rf"SELECT page_id, length({_plain(_boilerplate('html'))})::BIGINT n_chars FROM pages")
def x28_without_boilerplate(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(pages.without_boilerplate(F.col("html"))).cast("long").alias("n_chars"))


@query(r"""SELECT page_id, place::BIGINT place, href FROM (SELECT page_id, unnest(l) href, generate_subscripts(l, 1) - 1 place FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*href=["'']([^"'']*)["'']', 1) l FROM pages))""")
def x15_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(pages.hrefs(F.col("html"))).alias("place", "href")).select("page_id", F.col("place").cast("long").alias("place"), "href")


_HEAD = """'<html><head><title>T' || page_id || '</title><meta name="description" content="D' || page_id || '"><meta content="O" property="og:title"><link rel="alternate" type="application/rss+xml" href="/feed' || page_id % 7 || '"><link hreflang="de" rel="alternate" href="/de">
<link rel="next" href="?page=' || (page_id % 5 + 2) || '"><script type="application/ld+json">{"@type": "Product", "id": ' || page_id || '}</script><script type="application/ld+json">{broken</script></head><body>item?id=' || page_id || ' item?id=7 item?id=' || page_id || '</body></html>'"""


@query("SELECT page_id, 'D' || page_id description, 'O' og_title, '/feed' || page_id % 7 feed, 1::BIGINT n_feeds, '?page=' || (page_id % 5 + 2) next_link, 1::BIGINT n_json, 'Product' json_type, CASE WHEN page_id = 7 THEN '7' ELSE page_id || ',7' END item_ids FROM pages")
def x09_x10_x12_x13_x14_discovery(spark, sf_dir):
    h = F.col("h")
    blocks = pages.json_blocks(h)
    return table(spark, sf_dir, "pages").withColumn("h", F.expr(_HEAD)).select(
        "page_id", pages.meta(h, "description").alias("description"), pages.meta(h, "og:title").alias("og_title"), pages.feeds(h)[0].alias("feed"), F.size(pages.feeds(h)).cast("long").alias("n_feeds"), pages.next_links(h)[0].alias("next_link"),
        F.size(blocks).cast("long").alias("n_json"), F.variant_get(blocks[0], "$.@type", "string").alias("json_type"), F.array_join(pages.item_ids(h), ",").alias("item_ids"),
    )


@query("SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/feed' || page_id joined, '<b>' || page_id || ' & \"x\"</b>' plain FROM pages")
def x05_x25_absolute_and_unescaped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pages.absolute(F.col("url"), F.concat(F.lit("/feed"), F.col("page_id"))).alias("joined"), pages.unescaped(F.concat(F.lit("&lt;b&gt;"), F.col("page_id"), F.lit(" &amp; &quot;x&quot;&lt;/b&gt;"))).alias("plain"))


_BODY = "CASE page_id % 6 WHEN 0 THEN html WHEN 1 THEN 'User-agent: *' || chr(10) || 'Disallow: /x' WHEN 2 THEN '<html>please solve this CAPTCHA</html>' WHEN 3 THEN '   ' WHEN 4 THEN '{\"not\": \"html\"}' ELSE '<?xml version=\"1.0\"?><urlset><loc> https://a.example/' || page_id || ' </loc><loc>b</loc></urlset>' END"
_CHALLENGED = "(" + " OR ".join(f"contains(lower(substr(b, 1, 100000)), '{t}')" for t in pages.CHALLENGE) + ")"


@query(rf"""SELECT page_id, {_CHALLENGED} challenge, NOT {_CHALLENGED} AND len(list_filter(string_split(b, chr(10)), lambda x: lower(trim(split_part(x, ':', 1))) = 'user-agent' AND trim(split_part(x, ':', 2)) <> '')) > 0 AND len(list_filter(string_split(b, chr(10)), lambda x: contains(x, ':') AND lower(trim(split_part(x, ':', 1))) IN ('allow', 'disallow'))) > 0 robots,
 regexp_matches(b, '(?is)^\s*<(!doctype html|html|head|body|!--)') html_fits, regexp_matches(b, '(?s)^\s*[\[{{]') json_fits, regexp_extract(b, '(?is)<loc>\s*(.*?)\s*</loc>', 1) first_loc FROM (SELECT page_id, {_BODY} b FROM pages)""")
def f07_f08_f09_s09_body_checks(spark, sf_dir):
    b = F.col("b")
    return table(spark, sf_dir, "pages").withColumn("b", F.expr(_BODY.replace("chr(10)", "char(10)"))).select(
        "page_id", pages.is_challenge(b).alias("challenge"), pages.is_robots(b).alias("robots"), pages.fits_kind(F.lit("Text/HTML; charset=utf-8"), b, "html").alias("html_fits"), pages.fits_kind(F.lit("application/json"), b, "json").alias("json_fits"),
        F.coalesce(F.get(pages.locations(b), F.lit(0)), F.lit("")).alias("first_loc"),
    )


@query("SELECT page_id, sha256(html) content_sha256, CASE WHEN octet_length(encode(html)) <= 16384 THEN 'inline:' || sha256(html) ELSE sha256(html) || '.bin' END ref, base64(encode(substr(url, 1, 200))) b64, sha256('fetch|run-1|' || sha256(html) || '|1') idempotency FROM pages")
def x17_x18_x37_k03_content_addresses(spark, sf_dir):
    body = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", texts.content_hash(body).alias("content_sha256"), texts.reference(body).alias("ref"), texts.inline(F.substring("url", 1, 200).cast("binary")).alias("b64"), texts.idempotency_key(F.lit("fetch"), F.lit("run-1"), texts.content_hash(body), F.lit("1")).alias("idempotency"))


@query("SELECT page_id, octet_length(encode(html)) > 4096 truncated, least(octet_length(encode(html)), 4096)::BIGINT kept FROM pages")
def f14_f15_size_limits(spark, sf_dir):
    size = F.octet_length("html")
    return table(spark, sf_dir, "pages").select("page_id", (size > 4096).alias("truncated"), F.least(size, F.lit(4096)).cast("long").alias("kept"))


_TOK = "list_distinct(list_filter(regexp_extract_all(lower({0}), '([a-z0-9]+)', 1), lambda x: length(x) >= 2))"


@query(f"""SELECT page_id, len(t)::BIGINT n_tokens, round(CASE WHEN len(n) = 0 THEN 0 ELSE len(list_intersect(n, e)) / len(n) END, 6) confidence FROM
 (SELECT page_id, {_TOK.format("url")} t, list_filter({_TOK.format("url")}, lambda x: NOT list_contains({texts.GENERIC}, x)) n, {_TOK.format("html")} e FROM pages)""")
def x19_x20_x21_tokens_and_confidence(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(texts.tokens(F.col("url"))).cast("long").alias("n_tokens"), F.round(texts.confidence(F.col("url"), F.col("html")), 6).alias("confidence"))


@query(f"""WITH d AS (SELECT doc_id, {_TOK.format("text")} t FROM documents) SELECT a.doc_id, round(CASE WHEN len(a.t) + len(b.t) = 0 THEN 0 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) END, 6) jaccard FROM d a JOIN d b ON b.doc_id = a.doc_id + 1""")
def u03_u07_jaccard_of_neighbours(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", texts.tokens(F.col("text")).alias("t"))
    other = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("o"))
    return d.join(other, "doc_id").select("doc_id", F.round(texts.jaccard(F.col("t"), F.col("o")), 6).alias("jaccard"))


@query("SELECT doc_id, round_even((contains(lower(text), 'the')::INT + contains(lower(text), 'der')::INT + contains(lower(text), 'que')::INT) / 3, 4) coverage FROM documents")
def a03_keyword_coverage(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.coverage(F.col("text"), ["the", "der", "que"]).alias("coverage"))


_HASH = "('0x' || substr(md5(t), 1, 15))::BIGINT"
_BITS = ", ".join(f"CASE WHEN sum(CASE WHEN (h >> {b}) & 1 = 1 THEN 1 ELSE -1 END) >= 0 THEN {1 << b} ELSE 0 END b{b}" for b in range(60))


@query(f"""WITH r AS (SELECT doc_id, {_HASH} h FROM (SELECT doc_id, unnest({_TOK.format("text")}) t FROM documents)), s AS (SELECT doc_id, {_BITS} FROM r GROUP BY 1), v AS (SELECT doc_id, ({" + ".join(f"b{b}" for b in range(60))})::BIGINT simhash FROM s)
SELECT a.doc_id, a.simhash, bit_count(xor(a.simhash, b.simhash))::BIGINT distance FROM v a JOIN v b ON b.doc_id = a.doc_id + 1""")
def x32_simhash(spark, sf_dir):
    v = texts.simhash(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    other = v.select((F.col("doc_id") - 1).alias("doc_id"), F.col("simhash").alias("o"))
    return v.join(other, "doc_id").select("doc_id", "simhash", texts.hamming(F.col("simhash"), F.col("o")).cast("long").alias("distance"))


@query(f"""SELECT doc_id, {", ".join(f"min((h * {2 * k + 1} + {k * 7919}) % 2147483647)::BIGINT m{k}" for k in range(8))} FROM (SELECT doc_id, {_HASH} % 2147483647 h FROM (SELECT doc_id, unnest({_TOK.format("text")}) t FROM documents)) GROUP BY 1""")
def x33_minhash(spark, sf_dir):
    return texts.minhash(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) term FROM documents), tf AS (SELECT doc_id, term, count(*) tf FROM t GROUP BY ALL), dl AS (SELECT doc_id, sum(tf) dl FROM tf GROUP BY 1), df AS (SELECT term, count(*) df FROM tf GROUP BY 1),
 n AS (SELECT count(*) n, avg(dl) avgdl FROM dl) SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) score FROM tf JOIN dl USING (doc_id) JOIN df USING (term), n WHERE term IN ('hand', 'then', 'mente') GROUP BY 1""")
def x34_bm25(spark, sf_dir):
    query = ["hand", "then", "mente"]
    weights = texts.term_weights(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), Folder(spark, "bm25"), only=query)
    return texts.bm25(weights, "doc_id", query).select("doc_id", F.round("score", 6).alias("score"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) term FROM documents), tf AS (SELECT doc_id, term, count(*) tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) df FROM tf GROUP BY 1), n AS (SELECT count(DISTINCT doc_id) n FROM tf)
SELECT doc_id, count(*) terms, round(max(tf * ln(n / df)), 6) top FROM tf JOIN df USING (term), n GROUP BY 1""")
def x34_tfidf(spark, sf_dir):
    w = texts.term_weights(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), Folder(spark, "tfidf"))
    return w.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.max(F.col("tf") * F.log(F.col("n") / F.col("df"))), 6).alias("top"))


@query("""SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def x38_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("o"))
    return e.join(other, "vec_id").select("vec_id", F.round(texts.cosine(F.col("embedding"), F.col("o")), 6).alias("cosine"))


@query("""WITH s AS (SELECT doc_id, unnest(l) seg, generate_subscripts(l, 1) - 1 sq FROM (SELECT doc_id, string_split(text, chr(10)) l FROM documents)), p AS (SELECT *, coalesce(sum(length(seg) + 1) OVER (PARTITION BY doc_id ORDER BY sq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) st FROM s)
SELECT doc_id, sq::BIGINT seq, st::BIGINT start_offset, (st + length(seg))::BIGINT end_offset, sha256(seg) segment_hash FROM p""")
def x35_segments(spark, sf_dir):
    return texts.segments(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.col("sequence").cast("long").alias("seq"), F.col("start_offset").cast("long").alias("start_offset"), F.col("end_offset").cast("long").alias("end_offset"), "segment_hash")


@query("SELECT doc_id, md5(nfc_normalize(text)) nfc_md5, CASE WHEN length(text) < 20 THEN 'unknown' ELSE lang END lang, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '2024-0' || (1 + doc_id % 9) || '-15' END seen FROM documents")
def x27_x30_x31_normalized(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 3 == 0, F.lit("unknown date")).otherwise(F.concat(F.lit("2024-0"), 1 + F.col("doc_id") % 9, F.lit("-15T00:00:00Z")))
    seen = F.date_format(F.try_to_timestamp(raw, F.lit("yyyy-MM-dd'T'HH:mm:ssX")), "yyyy-MM-dd")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(pages.normalized(F.col("text")).cast("binary")).alias("nfc_md5"), F.when(F.length("text") < 20, "unknown").otherwise(F.col("lang")).alias("lang"), seen.alias("seen"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN text IS NULL OR text = '' THEN 'missing_body' END, CASE WHEN length(text) < 20 THEN 'too_short' END, CASE WHEN contains(text, '!!') THEN 'shouting' END, CASE WHEN length(text) > 10000 THEN 'very_long' END], lambda x: x IS NOT NULL), ',') flags FROM documents""")
def f22_integrity_flags(spark, sf_dir):
    from siltstone.operators.evidence import flags

    t = F.col("text")
    own = flags(missing_body=t.isNull() | (t == ""), too_short=F.length(t) < 20, shouting=F.contains(t, F.lit("!!")), very_long=F.length(t) > 10000)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(own, ",").alias("flags"))


@query("""WITH nm AS (SELECT DISTINCT lower(p_name) nm FROM part WHERE p_name IS NOT NULL), t AS (SELECT DISTINCT nm, substr('  ' || nm || ' ', i::INT, 3) g FROM nm, LATERAL (SELECT unnest(range(1, length(nm) + 2)) i)), c AS (SELECT nm, count(*) n FROM t GROUP BY 1)
SELECT a.nm AS name, b.nm AS other, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 6) similarity, NULL::BIGINT p_partkey FROM t a JOIN t b ON a.g = b.g AND a.nm < b.nm JOIN c x ON x.nm = a.nm JOIN c y ON y.nm = b.nm GROUP BY 1, 2 HAVING count(*) / (any_value(x.n) + any_value(y.n) - count(*)) >= 0.6
UNION ALL SELECT lower(p_name), NULL, NULL, p_partkey FROM part WHERE p_name IS NOT NULL""")
def j15_fuzzy_names(spark, sf_dir):
    """Pairs (name, other, similarity) of distinct names, and one row (name, p_partkey) for each part, so that copies are not expanded.

    Similar names share one of their rarest trigrams: of n, only n - ceil(0.6 * n) can be missing in the other. What shares one is compared whole.
    """
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name")).filter("name is not null")
    sets = p.select("name").distinct().select("name", texts.trigrams(F.col("name")).alias("t"))
    terms = sets.select("name", F.explode("t").alias("g"))
    ordered = terms.join(terms.groupBy("g").agg(F.count("*").alias("df")), "g").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("by"))
    rare = ordered.select("name", F.explode(F.slice("by", F.lit(1), F.expr("size(by) - (6 * size(by) + 9) div 10 + 1").cast("int"))).alias("x")).select("name", "x.g")
    pairs = rare.join(rare.select(F.col("name").alias("other"), "g"), "g").filter("name < other").select("name", "other").distinct()
    both = pairs.join(sets, "name").join(sets.select(F.col("name").alias("other"), F.col("t").alias("o")), "other")
    sim = F.size(F.array_intersect("t", "o")) / F.size(F.array_union("t", "o"))
    found = both.withColumn("s", sim).filter("s >= 0.6").select("name", "other", F.round("s", 6).alias("similarity"), F.lit(None).cast(p.schema["p_partkey"].dataType).alias("p_partkey"))
    members = p.select("name", F.lit(None).cast("string").alias("other"), F.lit(None).cast("double").alias("similarity"), "p_partkey")
    return found.unionByName(members)


_PLAIN = r"regexp_replace(text, '[\x00-\x09\x0B-\x1F]', ' '"


@query(f"""WITH l AS (SELECT doc_id, unnest(x) line, generate_subscripts(x, 1) - 1 place FROM (SELECT doc_id, string_split({_PLAIN}, 'g'), chr(10)) x FROM documents))
SELECT doc_id, form, place::BIGINT place, CASE WHEN form != 'sitemap' THEN md5(nullif(trim(line), '')) END title_md5, 'https://feeds.example/' || doc_id || '/' || place link FROM l, (VALUES ('rss'), ('atom'), ('sitemap')) f(form)""")
def s08_s09_feed_entries(spark, sf_dir):
    """Texts go out as feeds of their lines, in CDATA, in entities and as prefixed names, and come back as entries."""
    lines = F.split(F.regexp_replace("text", r"[\x00-\x09\x0B-\x1F]", " "), "\n")

    def link(k):
        return F.concat(F.lit("https://feeds.example/"), F.col("doc_id"), F.lit("/"), k)

    def escaped(line):
        return F.replace(F.replace(F.replace(line, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def body(begin, item, end):
        return F.concat(F.lit(begin), F.array_join(F.transform(lines, item), ""), F.lit(end))

    forms = {
        "rss": body('<?xml version="1.0"?><rss xmlns:a="http://www.w3.org/2005/Atom"><channel><title>T</title>', lambda x, k: F.concat(F.lit("<item><title><![CDATA["), F.replace(x, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit(']]></title><a:link rel="self" href="/self"/><link>'), link(k), F.lit("</link></item>")), "</channel></rss>"),
        "atom": body('<feed xmlns="http://www.w3.org/2005/Atom">', lambda x, k: F.concat(F.lit('<entry><title type="text">'), escaped(x), F.lit('</title><link rel="edit" href="/edit"/><link rel="alternate" href="'), link(k), F.lit('"/></entry>')), "</feed>"),
        "sitemap": body('<s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9">', lambda x, k: F.concat(F.lit("<s:url><s:loc> "), link(k), F.lit(" </s:loc></s:url>")), "</s:urlset>"),
    }
    rows = table(spark, sf_dir, "documents")
    bodies = reduce(DataFrame.unionByName, [rows.select("doc_id", b.alias("body")) for b in forms.values()])
    got = stored.feed_entries(bodies, "doc_id")
    return got.select("doc_id", "form", F.col("place").cast("long").alias("place"), F.md5(F.col("title").cast("binary")).alias("title_md5"), "link")


@query("""WITH s AS (SELECT conv_id, turn, text, unnest(l) seg, generate_subscripts(l, 1) k FROM (SELECT conv_id, turn, text, string_split(text, chr(10)) l FROM conversations)), w AS (SELECT *, row_number() OVER p - 1 q, coalesce(sum(length(seg) + 1) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) st FROM s WINDOW p AS (PARTITION BY conv_id ORDER BY turn, text, k))
SELECT conv_id, turn, q::BIGINT sequence, st::BIGINT start_offset, (st + length(seg))::BIGINT end_offset, sha256(seg) segment_hash FROM w""")
def d04_x35_conversation_segments(spark, sf_dir):
    """Lines of whole conversations, numbered from turn to turn, by a table function that SQL calls."""
    table_functions.register(spark)
    return spark.sql("SELECT conv_id, turn, sequence, start_offset, end_offset, segment_hash FROM text_segments(TABLE(SELECT * FROM {c}), 'conv_id', 'turn', 'text')", c=table(spark, sf_dir, "conversations"))
