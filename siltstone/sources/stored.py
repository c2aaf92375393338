"""Readers of stored reports, manifests, feeds and raw bodies, each with its schema and checks.

Live fetching is no analytic operator and is left out: connectors deliver rows of these shapes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ENDPOINT = "struct<method_id: string, url: string, keyless: boolean, official: boolean, expected_mime: array<string>>"
MANIFEST = f"schema_version string, manifest_id string, expected_unique_sources int, sources array<struct<source_id: string, display_name: string, resolution_status: string, official_origin: string, confidence: string, verification_basis: string, global_catalog_disposition: string, api_endpoints: array<{ENDPOINT}>>>"
METHOD = "struct<source_id: string, method_id: string, method_category: string, site_outcome: string, stop_reason: string, network_transaction_count: int, candidates: array<struct<result_kind: string, url: string, canonical_url: string, native_id: string, source_transaction_id: string>>, fetched_artifacts: array<struct<result_kind: string, url: string, content_sha256: string, immutable_raw_ref: string, source_transaction_id: string>>>"
REPORT = f"schema_version string, run_id string, sites array<struct<source_id: string, outcome: string, stop_reason: string, methods: array<{METHOD}>>>"


def json_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a file; anything else fails."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a manifest; raises unless their number and the uniqueness of their names are as it says."""
    doc = json_object(spark, path, MANIFEST)
    sources = doc.select("manifest_id", "expected_unique_sources", F.explode("sources").alias("s")).select("manifest_id", "expected_unique_sources", "s.*")
    n, names, expected = sources.agg(F.count("*"), F.countDistinct("display_name"), F.max("expected_unique_sources")).first()
    if n != expected or names != n:
        raise ValueError(f"the manifest says {expected} sources; it has {n} with {names} names")
    return sources.drop("expected_unique_sources")


def report_methods(spark: SparkSession, path: str) -> DataFrame:
    """One row for each method of a run report, sites without any included."""
    return json_object(spark, path, REPORT).select("run_id", F.explode("sites").alias("s")).select("run_id", F.col("s.source_id").alias("site"), "s.outcome", F.explode_outer("s.methods").alias("m")).select("run_id", "site", "outcome", "m.*")


def bullets(spark: SparkSession, path: str) -> DataFrame:
    """Distinct names of a Markdown list, each with the line it first stands in."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    names = lines.filter(F.col("value").startswith("- ")).select("line", F.trim(F.substr("value", F.lit(3))).alias("name"))
    return names.groupBy("name").agg(F.min("line").alias("line"))


def robots_rules(bodies: DataFrame) -> DataFrame:
    """origin, agent, rule, path, line of robots texts (origin, body); rules before any agent are dropped."""
    lines = bodies.select("origin", F.posexplode(F.split("body", "\r?\n")).alias("line", "raw"))
    parts = lines.select("origin", "line", F.lower(F.regexp_extract("raw", r"^\s*([A-Za-z-]+)\s*:", 1)).alias("field"), F.trim(F.regexp_extract("raw", r"^\s*[A-Za-z-]+\s*:\s*([^#]*)", 1)).alias("value"))
    own = F.expr("last(if(field = 'user-agent', value, null), true) over (partition by origin order by line rows unbounded preceding)")
    return parts.withColumn("agent", F.lower(own)).filter(F.col("field").isin("allow", "disallow") & F.col("agent").isNotNull()).select("origin", "agent", F.col("field").alias("rule"), F.col("value").alias("path"), "line")


def may_fetch(requests: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """Adds allowed to requests (origin, path): the first rule of the agent whose path begins the request's; none allows."""
    own = rules.filter((F.col("agent") == agent) & (F.col("path") != "")).select("origin", F.col("path").alias("rule_path"), "rule", "line")
    fits = requests.join(own, "origin", "left").withColumn("fits", F.col("path").startswith(F.col("rule_path")))
    first = F.min(F.when(F.col("fits"), F.struct("line", "rule")))
    return fits.groupBy(*requests.columns).agg(F.coalesce(first["rule"] != "disallow", F.lit(True)).alias("allowed"))


def feed_items(feeds: DataFrame) -> DataFrame:
    """source_id, place, title, link of RSS bodies (source_id, body)."""
    items = feeds.select("source_id", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<item[^>]*>(.*?)</item>"), F.lit(1))).alias("place", "item"))

    def inner(tag):
        return F.nullif(F.trim(F.regexp_extract("item", rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)), F.lit(""))

    return items.select("source_id", "place", inner("title").alias("title"), inner("link").alias("link"))


def list_ids(bodies: DataFrame, most: int = 100) -> DataFrame:
    """source_id, id: the first `most` entries of JSON lists, of which strings and whole numbers count; true and false don't."""
    entries = bodies.select("source_id", F.explode(F.slice(F.from_json("body", "array<variant>"), 1, most)).alias("v"))
    kind = F.schema_of_variant("v")
    return entries.filter(kind.isin("STRING", "BIGINT")).select("source_id", F.variant_get("v", "$", "string").alias("id"))


def raw_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """sha256, length and content of content-addressed files, with whether the name holds."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    return files.select(F.regexp_extract("path", r"([0-9a-f]+)\.bin$", 1).alias("sha256"), "length", "content").withColumn("verified", F.sha2("content", 256) == F.col("sha256"))


_LINK = "array<struct<_VALUE: string, _href: string, _rel: string>>"
_ENTRY = f"struct<title: string, link: {_LINK}, guid: string, id: string>"
#: RSS 2.0, RSS 1.0, Atom, sitemaps and indexes of sitemaps, by names without their prefixes.
FEED = f"channel struct<title: string, item: array<{_ENTRY}>>, item array<{_ENTRY}>, entry array<{_ENTRY}>, url array<struct<loc: string, lastmod: string>>, sitemap array<struct<loc: string, lastmod: string>>, _corrupt_record string"


def feed_entries(feeds: DataFrame, key: str = "source_id", body: str = "body") -> DataFrame:
    """key, form (rss, atom, sitemap, sitemap_index, malformed), place (from 0), id, title, link of feeds (key, body).

    An entry's link is the first one with text or with no other relation than alternate. Namespaces, CDATA and entities are
    read as XML has them; feeds within a feed are the rows of sitemap_index. Bodies that are no well-formed XML have one row
    without a place; nulls and well-formed bodies of another kind have none; empty titles and links are null.
    """
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    rows = feeds.select(F.col(key).alias("key"), F.from_xml(body, FEED, options).alias("x"))

    def entry(e):
        named = F.filter(e["link"], lambda x: (F.trim(x["_VALUE"]) != "") | (x["_href"].isNotNull() & F.coalesce(x["_rel"] == "alternate", F.lit(True))))
        first = F.get(named, F.lit(0))
        return F.struct(F.coalesce(e["id"], e["guid"]).alias("id"), _text(e["title"]).alias("title"), _text(F.coalesce(F.nullif(F.trim(first["_VALUE"]), F.lit("")), first["_href"])).alias("link"))

    def located(e):
        return F.struct(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("title"), _text(e["loc"]).alias("link"))

    items = F.coalesce(F.col("x.channel.item"), F.col("x.item"))
    found = [F.when(F.col("x._corrupt_record").isNull(), F.transform(list_, each)) for list_, each in ((items, entry), (F.col("x.entry"), entry), (F.col("x.url"), located), (F.col("x.sitemap"), located))]
    form = F.when(F.col("x._corrupt_record").isNotNull(), "malformed").when(items.isNotNull(), "rss").when(F.col("x.entry").isNotNull(), "atom").when(F.col("x.url").isNotNull(), "sitemap").otherwise("sitemap_index")
    # filtered after it is exploded: a filter below would be moved under the reader, and read each body again for each name in it
    rows = rows.select("key", form.alias("form"), F.coalesce(*found).alias("e")).select(F.col("key").alias(key), "form", F.posexplode_outer("e").alias("place", "e"))
    return rows.filter("place is not null or form = 'malformed'").select(key, "form", "place", "e.id", "e.title", "e.link")


def _text(c):
    return F.nullif(F.trim(c), F.lit(""))
