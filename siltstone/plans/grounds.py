"""Queries over what evidence rests on: independence by several kinds of ties, profiles, ten gates, with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltstone.operators import evidence, independence
from siltstone.plans.web import table
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


_PUBLISHER = "^[a-z]+://(?:(?:www|m|blog)[.])?([^/:?#]+)"
_COMPANY = "^[a-z]+://(?:(?:www|m|blog)[.])?([^/.:?#]+)[.]"
_PARAGRAPH = "<p>([^<]{80,})"
_CONTACT = "([A-Za-z0-9._-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+)"
_LANGUAGE = '<html lang="([a-z]+)"'
_NOW = "2024-01-03 12:00:00"
#: Days that count as recent, and as not yet old.
_DAYS = (1, 2)
_PLATFORMS = ["documents", "pages", "conversations"]
#: Claims that a market should have by its maturity.
_NEEDED = {"new": 10, "emerging": 30, "resegmented": 60, "existing": 60}

_GROUND = rf"""e(node, number, platform, family, language, polarity, direct) AS (SELECT 'd' || doc_id, doc_id, 'documents', source, lang, CASE quality WHEN 1 THEN 1 WHEN 0 THEN -1 ELSE 0 END, false FROM documents LEFT JOIN labels USING (doc_id)
 UNION ALL SELECT 'p' || page_id, page_id, 'pages', regexp_extract(url, '{_PUBLISHER}', 1), regexp_extract(html, '{_LANGUAGE}', 1), 0, false FROM pages UNION ALL SELECT 'c' || conv_id, conv_id, 'conversations', 'conversations', NULL, 0, true FROM conversations GROUP BY conv_id),
t0(node, kind, hub) AS (SELECT 'p' || page_id, 'publisher', regexp_extract(url, '{_PUBLISHER}', 1) FROM pages UNION ALL SELECT 'p' || page_id, 'company', regexp_extract(url, '{_COMPANY}', 1) FROM pages UNION ALL SELECT 'p' || page_id, 'quote', unnest(regexp_extract_all(html, '{_PARAGRAPH}', 1)) FROM pages
 UNION ALL SELECT 'd' || doc_id, 'syndication', regexp_replace(text, '[ \t\r\n]+', ' ', 'g') FROM documents WHERE length(text) >= 80 UNION ALL SELECT * FROM (SELECT 'd' || doc_id, 'quote', unnest(string_split(text, chr(10))) line FROM documents) WHERE length(line) >= 80
 UNION ALL SELECT 'd' || doc_id, 'chain', unnest(regexp_extract_all(text, '{_CONTACT}', 1)) FROM documents UNION ALL SELECT 'c' || conv_id, 'comment', text FROM conversations WHERE "role" = 'user' AND length(text) >= 40),
t AS (SELECT DISTINCT node, kind, md5(hub) hub FROM t0 WHERE hub <> ''), h AS (SELECT kind, hub, min(node) low FROM t GROUP BY ALL HAVING count(*) > 1), s AS (SELECT node a, low b, kind FROM t JOIN h USING (kind, hub)),
l AS (SELECT a, b FROM s UNION SELECT b, a FROM s), r AS (SELECT node, node low FROM e UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node WHERE r.low < l.b), g AS (SELECT node, min(low) independence FROM r GROUP BY 1),
k AS (SELECT independence, array_to_string(list_sort(list(DISTINCT kind)), ',') kinds FROM s JOIN g ON g.node = s.a GROUP BY 1),
c AS (SELECT e.*, independence, user_id % 20 cluster, event_type intent, ts "at", event_type = 'error' blocked, event_type = 'purchase' priced, round(value * 100)::BIGINT engagement FROM e JOIN g USING (node) LEFT JOIN events ON event_id = number)"""


def _sources(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every document, page and conversation as a source, and what may tie it to others."""
    docs, pages, talks = (table(spark, sf_dir, n) for n in _PLATFORMS)
    d, p, c = (F.concat(F.lit(x), F.col(key).cast("string")) for x, key in (("d", "doc_id"), ("p", "page_id"), ("c", "conv_id")))
    long = F.when(F.length("text") >= 80, F.col("text"))
    tied = independence.ties(docs, d, {"syndication": F.regexp_replace(long, r"[ \t\r\n]+", " "), "quote": F.filter(F.split("text", "\n"), lambda line: F.length(line) >= 80), "chain": F.regexp_extract_all("text", F.lit(_CONTACT), F.lit(1))})
    tied = tied.union(independence.ties(pages, p, {"publisher": F.regexp_extract("url", _PUBLISHER, 1), "company": F.regexp_extract("url", _COMPANY, 1), "quote": F.regexp_extract_all("html", F.lit(_PARAGRAPH), F.lit(1))}))
    tied = tied.union(independence.ties(talks.filter((F.col("role") == "user") & (F.length("text") >= 40)), c, {"comment": F.col("text")}))
    polarity = F.when(F.col("quality") == 1, 1).when(F.col("quality") == 0, -1).otherwise(0)
    own = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(d.alias("node"), F.col("doc_id").alias("number"), F.lit("documents").alias("platform"), F.col("source").alias("family"), F.col("lang").alias("language"), polarity.alias("polarity"), F.lit(False).alias("direct"))
    own = own.union(pages.select(p, "page_id", F.lit("pages"), F.regexp_extract("url", _PUBLISHER, 1), F.regexp_extract("html", _LANGUAGE, 1), F.lit(0), F.lit(False)))
    return own.union(talks.groupBy("conv_id").agg(F.lit(1)).select(c, "conv_id", F.lit("conversations"), F.lit("conversations"), F.lit(None).cast("string"), F.lit(0), F.lit(True))), tied


def _claims(spark, sf_dir, folder: Folder) -> DataFrame:
    """Sources as claims of the event of their number: its user's cluster, its type as intent, its time, its value in hundredths as engagement."""
    own, tied = _sources(spark, sf_dir)
    found, _ = independence.groups(tied, folder)
    said = table(spark, sf_dir, "events").select(F.col("event_id").alias("number"), (F.col("user_id") % 20).alias("cluster"), F.col("event_type").alias("intent"), F.col("ts").alias("at"), F.round(F.col("value") * 100).cast("long").alias("engagement"))
    claims = own.join(found, "node", "left").withColumn("independence", F.coalesce("independence", "node")).join(said, "number", "left")
    return claims.withColumn("blocked", F.col("intent") == "error").withColumn("priced", F.col("intent") == "purchase")


@query(f"WITH RECURSIVE {_GROUND} SELECT independence, count(*) sources, count(DISTINCT family) families, count(DISTINCT platform) platforms, any_value(kinds) kinds FROM e JOIN g USING (node) JOIN k USING (independence) GROUP BY 1")
def g03_a18_independence_by_ties(spark, sf_dir):
    """Groups of sources that aren't independent, by publisher, company, syndication, quotes, comments and cited contacts."""
    own, tied = _sources(spark, sf_dir)
    found, kinds = independence.groups(tied, Folder(spark, "g03"))
    sizes = own.join(found, "node").groupBy("independence").agg(F.count("*").alias("sources"), F.countDistinct("family").alias("families"), F.countDistinct("platform").alias("platforms"))
    return sizes.join(kinds, "independence").select("independence", "sources", "families", "platforms", F.array_join("kinds", ",").alias("kinds"))


@query(f"WITH RECURSIVE {_GROUND} SELECT intent, count(*) claims, count(DISTINCT independence) independent, count(DISTINCT platform) platforms, round(1 - count(DISTINCT independence) / count(*), 6) duplicate_ratio, strftime(max(\"at\"), '%Y-%m-%d') newest FROM c GROUP BY 1")
def a15_gap_signals_by_ties(spark, sf_dir):
    """Per intent: claims, independent sources, platforms, duplicates, the newest."""
    g = _claims(spark, sf_dir, Folder(spark, "a15")).groupBy("intent").agg(F.count("*").alias("claims"), F.countDistinct("independence").alias("independent"), F.countDistinct("platform").alias("platforms"), F.date_format(F.max("at"), "yyyy-MM-dd").alias("newest"))
    return g.withColumn("duplicate_ratio", F.round(1 - F.col("independent") / F.col("claims"), 6))


_AGE = "coalesce(\"at\" >= TIMESTAMP '" + _NOW + "' - INTERVAL {} DAY, false)"
_PROFILE = f"""{_GROUND}, p AS (SELECT cluster, count(*) claims, count(DISTINCT node) sources, count(DISTINCT independence) independent_source_count, count(DISTINCT family) independent_source_families, count_if({_AGE.format(_DAYS[0])})::BIGINT recent,
 count_if(NOT {_AGE.format(_DAYS[0])} AND {_AGE.format(_DAYS[1])})::BIGINT aging, count(DISTINCT platform) platforms, count(DISTINCT "language") languages, count_if(direct)::BIGINT direct, {", ".join(f"avg(engagement) FILTER (platform = '{p}') engagement_{p}" for p in _PLATFORMS)},
 count_if(polarity > 0)::BIGINT supporting, count_if(polarity < 0)::BIGINT challenging, count_if(blocked)::BIGINT blocked, count_if(priced)::BIGINT priced, 1 - count(DISTINCT independence) / count(*) duplicate_ratio, count(DISTINCT intent) intents, count(DISTINCT intent) FILTER (intent IN ('purchase', 'signup')) critical FROM c GROUP BY 1),
q AS (SELECT *, list_filter([CASE WHEN blocked > 0.3::DOUBLE * claims THEN 'source_unavailable' END, CASE WHEN languages < 2 THEN 'language_coverage_limited' END, CASE WHEN recent < 0.2::DOUBLE * claims THEN 'recency_limited' END, CASE WHEN platforms < 2 THEN 'single_platform_bias' END,
 CASE WHEN duplicate_ratio >= 0.5 THEN 'duplicate_heavy_corpus' END, CASE WHEN priced = 0 THEN 'insufficient_pricing_data' END, CASE WHEN direct < 1 THEN 'insufficient_user_voice' END], lambda x: x IS NOT NULL) limits FROM p)"""


@query(f"""WITH RECURSIVE {_PROFILE} SELECT cluster, claims, sources, independent_source_count, independent_source_families, recent, aging, claims - recent - aging old, platforms cross_platform_coverage, direct direct_experience_count, {", ".join(f"engagement_{p}" for p in _PLATFORMS)},
 round(duplicate_ratio, 6) duplicate_ratio, supporting supporting_evidence_count, challenging challenging_evidence_count, array_to_string(limits, ',') data_limitations FROM q""")
def a16_profile_by_ties(spark, sf_dir):
    """The ten figures of each cluster's evidence, over components of all kinds of ties."""
    p = independence.profile(_claims(spark, sf_dir, Folder(spark, "a16")), "cluster", F.lit(_NOW).cast("timestamp"), _PLATFORMS, *_DAYS)
    return p.select(
        "cluster", "claims", "sources", "independent_source_count", "independent_source_families", "recency_distribution.*", F.col("platforms").alias("cross_platform_coverage"), F.col("direct").alias("direct_experience_count"),
        *[F.col("engagement_context")[x].alias(f"engagement_{x}") for x in _PLATFORMS], F.round("duplicate_ratio", 6).alias("duplicate_ratio"),
        F.col("supporting").alias("supporting_evidence_count"), F.col("challenging").alias("challenging_evidence_count"), F.array_join("data_limitations", ",").alias("data_limitations"),
    )


_HARMFUL = ("single_platform_bias", "insufficient_pricing_data")
_RULES = (
    "intents >= 5", "independent_source_count >= 20", "duplicate_ratio < 0.5", "challenging > 0", "recent >= 0.2::DOUBLE * claims", "blocked <= 0.3::DOUBLE * claims", "critical = 2", "languages >= 3",
    "claims >= CASE WHEN claims < 5 THEN NULL WHEN independent_source_families <= 2 THEN 10 WHEN recent / claims > 0.6 THEN 30 ELSE 60 END", f"NOT list_has_any(limits, {list(_HARMFUL)})",
)


@query(f"""WITH RECURSIVE {_PROFILE}, z AS (SELECT cluster, supporting, challenging, {", ".join(f"coalesce({r}, false) {g}" for g, r in zip(independence.GATES, _RULES))} FROM q) SELECT cluster, {", ".join(independence.GATES)}, {" AND ".join(independence.GATES)} sufficient,
 array_to_string(list_filter([{", ".join(f"CASE WHEN NOT {g} THEN '{g}' END" for g in independence.GATES)}], lambda x: x IS NOT NULL), ',') failed, CASE WHEN NOT ({" AND ".join(independence.GATES)}) THEN 'investigate_more' WHEN supporting > challenging THEN 'build_to_validate' WHEN supporting < challenging THEN 'kill' ELSE 'modify' END decision FROM z""")
def a22_ten_gates(spark, sf_dir):
    """Whether each cluster's evidence suffices to decide, by ten gates, and what is decided then."""
    folder = Folder(spark, "a22")
    claims = folder.save(_claims(spark, sf_dir, folder), "claims")
    p = independence.profile(claims, "cluster", F.lit(_NOW).cast("timestamp"), _PLATFORMS, *_DAYS)
    intents = claims.groupBy(F.col("cluster").alias("of")).agg(F.countDistinct("intent").alias("intents"), F.countDistinct(F.when(F.col("intent").isin("purchase", "signup"), F.col("intent"))).alias("critical"))
    p = p.join(intents, F.col("cluster").eqNullSafe(F.col("of")))
    grown = evidence.maturity(F.col("independent_source_families"), F.col("claims"), F.lit(2000), F.col("recent") / F.col("claims"))
    needed = F.element_at(F.create_map(*[F.lit(x) for kv in _NEEDED.items() for x in kv]), grown)
    g = independence.sufficient(p, F.col("intents"), F.col("critical") == 2, needed, _HARMFUL, independent=20, intents_least=5, languages=3)
    decided = F.when(~F.col("sufficient"), "investigate_more").when(F.col("supporting") > F.col("challenging"), "build_to_validate").when(F.col("supporting") < F.col("challenging"), "kill").otherwise("modify")
    return g.select("cluster", *independence.GATES, "sufficient", F.array_join("failed", ",").alias("failed"), decided.alias("decision"))
