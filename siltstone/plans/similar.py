"""Queries over likeness: near duplicates, nearest vectors, dense groups, with the same in DuckDB's SQL where that is exact."""

from __future__ import annotations


from pyspark.sql import functions as F

from siltstone.operators import dense, near, neighbours, retrieval
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


# every two texts with a shingle in common, and what their links reach
@query(r"""WITH RECURSIVE w AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[^ \t\n\v\f\r]+') ws FROM documents),
s AS (SELECT doc_id, lang, len(ws)::BIGINT n_words, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END sh FROM w),
e AS (SELECT *, min(doc_id) OVER (PARTITION BY lang, md5(array_to_string(list_sort(sh), chr(10)))) class_id FROM s WHERE n_words >= 10), u AS (SELECT doc_id, lang, len(sh) n, unnest(sh) g FROM e WHERE doc_id = class_id),
l AS (SELECT a.doc_id a, b.doc_id b FROM u a JOIN u b ON a.g = b.g AND a.lang IS NOT DISTINCT FROM b.lang AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING count(*) >= 0.75 * (any_value(a.n) + any_value(b.n) - count(*))),
both_ AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT doc_id node, doc_id root FROM e WHERE doc_id = class_id UNION SELECT both_.b, r.root FROM r JOIN both_ ON both_.a = r.node), c AS (SELECT node, min(root) component_id FROM r GROUP BY 1)
SELECT s.doc_id, s.n_words, len(s.sh)::BIGINT n_shingles, e.class_id IS NOT NULL eligible, e.class_id, c.component_id FROM s LEFT JOIN e USING (doc_id) LEFT JOIN c ON c.node = e.class_id""")
def j13_x33_minhash_bands(spark, sf_dir):
    return near.duplicates(table(spark, sf_dir, "documents"), Folder(spark, "j13"))


# vectors are found by several tables of codes, so SQL would have to repeat those; the tests measure recall instead
@query()
def x38_nearest_vectors(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), Folder(spark, "x38"), asked=F.col("key") % 50 == 0)


@query()
def g02_dense_clusters(spark, sf_dir):
    return dense.clustered(table(spark, sf_dir, "embeddings"), Folder(spark, "g02"))


# the scores of all documents that share a word with an item
@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) term FROM documents), tf AS (SELECT doc_id, term, count(*) tf FROM t GROUP BY ALL), dl AS (SELECT doc_id, sum(tf) dl FROM tf GROUP BY 1), df AS (SELECT term, count(*) df FROM tf GROUP BY 1),
n AS (SELECT count(*) n, sum(dl) / count(*) avgdl FROM dl), q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) term FROM benchmark),
p AS (SELECT item_id, doc_id, sum(floor(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) * 1e6 + 0.5)::BIGINT) points FROM q JOIN tf USING (term) JOIN dl USING (doc_id) JOIN df USING (term), n GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY points DESC, doc_id) place FROM p) SELECT item_id, place::INTEGER place, doc_id, points / 1e6 score FROM r WHERE place <= 10""")
def x34_t06_ranked_items(spark, sf_dir):
    """The ten documents that score most for each benchmark item."""
    index = retrieval.Index(table(spark, sf_dir, "documents"), Folder(spark, "x34"))
    return index.search(table(spark, sf_dir, "benchmark")).select(F.col("query").alias("item_id"), "place", F.col("key").alias("doc_id"), (F.col("points") / 1e6).alias("score"))
