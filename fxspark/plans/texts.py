"""Identifiers, texts, chunks, hosts, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import sets as st
from .inputs import table
from .registry import query


HEX = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url))"


@query("P11_article_id", f"""WITH h AS (SELECT page_id, url, {HEX} AS h FROM pages)
SELECT page_id, url, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
 substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h""")
def article_id(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", tx.uuid5_url("url").alias("id"))


@query("P12_text_limits", """SELECT doc_id, length(CASE WHEN length(text) > 8000 THEN substr(text, 1, 8000) || '...' ELSE text END) AS prompt_chars,
 length(substr(text, 1, 50000)) AS stored_chars, md5(CASE WHEN length(text) > 8000 THEN substr(text, 1, 8000) || '...' ELSE text END) AS digest FROM documents""")
def text_limits(spark, sf):
    d = table(spark, sf, "documents").withColumn("p", tx.prompt_text("text"))
    return d.select("doc_id", F.length("p").alias("prompt_chars"), F.length(tx.stored_text("text")).alias("stored_chars"), F.md5(F.encode("p", "UTF-8")).alias("digest"))


_STRIP = r"regexp_replace({0}, '^[\s\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\s\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')"


@query("P18_text_chunks", f"""WITH p AS (SELECT doc_id, i, {_STRIP.format('substr(text, CAST(i AS INTEGER) + 1, 2000)')} AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 1800)) AS i FROM documents))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, length(chunk) AS n_chars, md5(chunk) AS digest FROM p WHERE length(chunk) > 100""")
def text_chunks(spark, sf):
    # the outer form keeps the optimizer from computing all chunks twice to test for empty lists
    c = table(spark, sf, "documents").select("doc_id", F.posexplode_outer(tx.chunks("text")).alias("chunk_index", "chunk"))
    return c.filter("chunk_index IS NOT NULL").select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), F.md5(F.encode("chunk", "UTF-8")).alias("digest"))


HOSTS = r"h AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages)"


@query("P20_domain_list", f"""WITH {HOSTS}, i AS (SELECT host, min(page_id) AS pos FROM h GROUP BY 1), x AS (SELECT DISTINCT host FROM h WHERE host LIKE 'm.%'),
l AS (SELECT host FROM i WHERE host NOT IN (SELECT host FROM x) ORDER BY pos LIMIT 300) SELECT page_id, host FROM h WHERE host IN (SELECT host FROM l)""")
def domain_list(spark, sf):
    h = table(spark, sf, "pages").select("page_id", tx.host("url").alias("host"))
    allowed = st.domain_list(h, h.filter(F.col("host").startswith("m.")), "host", ["page_id"])
    return h.join(F.broadcast(allowed.select("host")), "host", "left_semi").select("page_id", "host")  # at most 300 rows


@query("U2_ordered_distinct", f"""WITH {HOSTS}, i AS (SELECT host, min(page_id) AS page_id FROM h GROUP BY 1) SELECT host, page_id FROM i WHERE host NOT IN (SELECT host FROM h WHERE host LIKE 'm.%')""")
def ordered_distinct(spark, sf):
    h = table(spark, sf, "pages").select("page_id", tx.host("url").alias("host"))
    return st.ordered_distinct(h, "host", ["page_id"]).join(h.filter(F.col("host").startswith("m.")).select("host").distinct(), "host", "left_anti").select("host", "page_id")


@query("P31_content_hash", "SELECT count(*) AS n_pages, count(DISTINCT url) AS n_urls, count(DISTINCT url) AS n_hashes FROM pages")
def content_hash(spark, sf):
    return table(spark, sf, "pages").agg(F.count("*").alias("n_pages"), F.count_distinct("url").alias("n_urls"), F.count_distinct(tx.content_hash("url")).alias("n_hashes"))


@query("J5_new_sources", """SELECT count(*) AS fresh, count(DISTINCT text) AS texts FROM (SELECT DISTINCT text FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = d.text))""")
def new_sources(spark, sf):
    d = table(spark, sf, "documents").select("text").withColumn("hash", tx.content_hash("text"))
    log = table(spark, sf, "benchmark").select(tx.content_hash("text").alias("hash"))  # accepted or rejected alike
    return st.unseen(d, log, "hash").agg(F.count("*").alias("fresh"), F.count_distinct("text").alias("texts"))


PAIR_TEXT = """CASE event_id % 5 WHEN 0 THEN 'EUR/USD' WHEN 1 THEN 'eur_usd' WHEN 2 THEN 'EURUSD' WHEN 3 THEN 'Usd_Jpy' ELSE 'usdjpy' END"""


@query("P4_pair_key", f"""WITH p AS (SELECT event_id, {PAIR_TEXT} AS pair FROM events), k AS (SELECT *, upper(regexp_replace(pair, '[/_]', '', 'g')) AS key FROM p),
f AS (SELECT key, arg_min(pair, event_id) AS stored FROM k GROUP BY 1) SELECT key, pair, stored, count(*) AS n FROM k JOIN f USING (key) GROUP BY 1, 2, 3""")
def pair_key(spark, sf):
    k = table(spark, sf, "events").select("event_id", F.expr(PAIR_TEXT).alias("pair")).withColumn("key", tx.pair_key("pair"))
    first = k.groupBy("key").agg(F.min_by("pair", "event_id").alias("stored"))
    return k.groupBy("key", "pair").agg(F.count("*").alias("n")).join(first, "key").select("key", "pair", "stored", "n")


SET_ID = """CASE event_id % 4 WHEN 0 THEN 'pair_clusters_EURUSD_h1' WHEN 1 THEN 'GBPUSD_H4' WHEN 2 THEN 'daily_if_usdjpy_D' ELSE 'if_AUDUSD_H1' END"""


@query("P5_dataset_parts", f"""WITH d AS (SELECT {SET_ID} AS id FROM events), x AS (SELECT id, string_split(id, '_') AS b FROM d)
SELECT id, CASE WHEN len(b) >= 3 THEN array_to_string(b[1:len(b) - 2], '_') END AS model_type, upper(substr(b[len(b) - 1], 1, 3)) || '_' || upper(substr(b[len(b) - 1], 4, 3)) AS pair,
 upper(b[len(b)]) AS timeframe, count(*) AS n FROM x GROUP BY ALL""")
def dataset_parts(spark, sf):
    d = table(spark, sf, "events").select(F.expr(SET_ID).alias("id"))
    return d.groupBy("id").agg(F.count("*").alias("n")).withColumns(tx.dataset_parts("id"))
