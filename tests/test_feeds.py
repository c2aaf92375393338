import pytest

from siltstone.functions import table_functions
from siltstone.sources import stored

RSS = '<?xml version="1.0"?><rss xmlns:a="http://www.w3.org/2005/Atom"><channel><title>C</title><link>site</link><item><title><![CDATA[A <b>]]]]><![CDATA[> & c]]></title><a:link rel="self" href="no"/><link>l1</link><guid isPermaLink="false">g1</guid></item><item><title>B &amp; D</title><link> l2 </link></item><item/></channel></rss>'
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title type="html">T</title><link rel="edit" href="no"/><link href="h1"/><id>i1</id></entry><entry><title></title></entry></feed>'
RDF = '<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><item><title>R</title><link>l</link></item></r:RDF>'
MAP = '<s:urlset xmlns:s="s"><s:url><s:loc> http://a </s:loc><s:lastmod>2024-01-01</s:lastmod></s:url></s:urlset>'
INDEX = "<sitemapindex><sitemap><loc>x.xml</loc></sitemap><sitemap><loc>y.xml</loc></sitemap></sitemapindex>"


def entries(spark, bodies):
    rows = spark.createDataFrame(list(enumerate(bodies)), "source_id int, body string")
    return [tuple(r) for r in stored.feed_entries(rows).orderBy("source_id", "place").collect()]


@pytest.mark.parametrize(("body", "want"), [
    (RSS, [("rss", 0, "g1", "A <b>]]> & c", "l1"), ("rss", 1, None, "B & D", "l2"), ("rss", 2, None, None, None)]),
    (ATOM, [("atom", 0, "i1", "T", "h1"), ("atom", 1, None, None, None)]),
    (RDF, [("rss", 0, None, "R", "l")]),
    (MAP, [("sitemap", 0, None, None, "http://a")]),
    (INDEX, [("sitemap_index", 0, None, None, "x.xml"), ("sitemap_index", 1, None, None, "y.xml")]),
    ("<rss><channel><item><title>open", [("malformed", None, None, None, None)]),
    ("<html/>", []), (None, []),
])
def test_feed_entries(spark, body, want):
    assert entries(spark, [body]) == [(0, *w) for w in want]


def test_no_feeds(spark):
    assert stored.feed_entries(spark.createDataFrame([], "source_id int, body string")).count() == 0


def test_long_feed(spark):
    body = "<rss><channel>" + "".join(f"<item><title>{k}</title><link>l{k}</link></item>" for k in range(5000)) + "</channel></rss>"
    assert [e[4] for e in entries(spark, [body])] == [str(k) for k in range(5000)]


def segments(rows):
    """Segments of each key's texts in order, None left out."""
    out = []
    for key in dict.fromkeys(r[0] for r in rows):
        n = at = 0
        for _, order, text, *_ in sorted((r for r in rows if r[0] == key and r[2] is not None), key=lambda r: (r[1] is not None, r[1], r[2])):
            for s in text.split("\n"):
                out.append((key, order, n, at, at + len(s), s))
                n, at = n + 1, at + len(s) + 1
    return sorted(out, key=repr)


def test_table_function(spark):
    rows = [(1, 2, "b\n\nc", "x"), (1, 1, "ä\U0001f600", "x"), (1, 1, "a", "x"), (1, 1, "a", "x"), (2, 1, None, "x"), (2, 2, "", "x"), (None, 1, "n", "x"), (None, 0, "z\r\ny", "x"), (3, 0, "long\n" * 30000, "x")]
    spark.createDataFrame(rows, "`the key` long, turn int, text string, segment string").createOrReplaceTempView("told")
    table_functions.register(spark)
    got = spark.sql("SELECT * FROM text_segments(TABLE(told), 'the key', 'turn', 'text')")
    assert got.columns == ["the key", "turn", "sequence", "start_offset", "end_offset", "segment", "segment_hash"]
    assert sorted((tuple(r)[:6] for r in got.collect()), key=repr) == segments(rows)
    assert got.filter("segment_hash != sha2(segment, 256)").count() == 0
    assert spark.sql("SELECT * FROM text_segments(TABLE(SELECT * FROM told WHERE turn > 9), 'the key', 'turn', 'text')").count() == 0
    for call, why in (("TABLE(told), 'none', 'turn', 'text'", "no column none"), ("TABLE(told), 'turn', 'turn', 'turn'", "is no text"), ("1, 'a', 'a', 'a'", "must be a table")):
        with pytest.raises(Exception, match=why):
            spark.sql(f"SELECT * FROM text_segments({call})").collect()


def test_each_body_is_read_once(spark):
    plan = stored.feed_entries(spark.createDataFrame([("a", RSS)], "source_id string, body string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xmltostructs(") + plan.count("from_xml(") == 1
