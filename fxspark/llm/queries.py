"""The registered queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from fxspark.llm import (
    divergence, fill_middle, mixing, ngram_join, piece_counts, piecewise_hash, private_data, quality_rules, residual_packing, slack_packing, tool_calls, toxicity, warc,
)
from fxspark.llm.common import table
from fxspark.llm.registry import query


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS n_capitals,
             len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines FROM w),
s AS (SELECT doc_id, w, unnest(range(0, len(w) - 7)) AS i FROM w WHERE len(w) >= 8),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i + 1:i + 8], ' ')) AS n FROM s),
c AS (SELECT doc_id, least(8, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -8)) AS k FROM h WHERE n > 1),
r AS (SELECT doc_id, sum(k) AS n_repeat_words FROM c GROUP BY doc_id),
a AS (SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > 3 * n_words OR 2 * n_capitals > word_chars
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept,
       CAST((CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
            + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_capitals > word_chars THEN 8 ELSE 0 END)
            + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END)
            + (CASE WHEN 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END) AS INTEGER) AS failed
FROM a"""


@query("op6_quality_rules", OP6_SQL)
def op6_quality_rules(spark, sf_dir):
    judged = quality_rules.verdicts(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


@query("op7_sainte_lague_mix")
def op7_sainte_lague_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chosen = mixing.mix(docs, F.col("doc_id"), mixing.words(F.col("text")), keep=True)
    return chosen.select(F.col("row").alias("doc_id"), "size", "source_size", "target", "taken", "passes", F.size("cuts").cast("long").alias("n_cuts"))


@query("op8_piecewise_hash")
def op8_piecewise_hash(spark, sf_dir):
    return piecewise_hash.compared(table(spark, sf_dir, "documents"))


@query("op10_minimum_slack_packing")
def op10_minimum_slack_packing(spark, sf_dir):
    return slack_packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id WHERE r.root < e.y)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id"""


@query("op5_ngram_join", OP5_SQL)
def op5_ngram_join(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM f"""


@query("op2_warc_salvage", OP2_SQL)
def op2_warc_salvage(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_piece_counts")
def op4_piece_counts(spark, sf_dir):
    return piece_counts.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op3_private_data")
def op3_private_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return private_data.found(docs, private_data.train(private_data.sample(docs)))


@query("op1_factorization_toxicity")
def op1_factorization_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, *toxicity.train(docs, table(spark, sf_dir, "labels")))


OP9_SQL = """
WITH RECURSIVE u AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant'),
v AS (SELECT u.conv_id, u.turn, 0 AS level FROM u LEFT JOIN u p ON p.conv_id = u.conv_id AND p.turn = u.turn - 2 WHERE p.turn IS NULL
      UNION ALL SELECT u.conv_id, u.turn, v.level + 1 FROM v JOIN u ON u.conv_id = v.conv_id AND u.turn = v.turn + 2),
c AS (SELECT u.conv_id, u.turn, u.text, v.level, a.turn AS result_turn, a.text AS result
      FROM u JOIN v USING (conv_id, turn) LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1),
r AS (SELECT *, '{"arguments":{"prompt":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || turn || '},"call_id":"call-' || turn || '","level":' || level
             || ',"name":"answer"' || CASE WHEN turn >= 2 THEN ',"parent_id":"call-' || (turn - 2) || '"' ELSE '' END || coalesce(',"result":' || CAST(to_json(result) AS VARCHAR), '') || '}' AS record FROM c)
SELECT conv_id, 'call-' || turn AS call_id, turn, result_turn, CASE WHEN result_turn IS NULL THEN 'no result' ELSE 'linked' END AS state, CAST(level AS BIGINT) AS level,
       length(text) BETWEEN 20 AND 400 AS valid, sha256(record) AS record_sha256 FROM r
UNION ALL SELECT a.conv_id, 'call-' || (a.turn - 1), NULL, a.turn, 'no call', NULL, NULL,
       sha256('{"call_id":"call-' || (a.turn - 1) || '","result":' || CAST(to_json(a.text) AS VARCHAR) || '}')
FROM a LEFT JOIN u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE u.turn IS NULL"""


@query("op9_tool_call_links", OP9_SQL)
def op9_tool_call_links(spark, sf_dir):
    calls, results = tool_calls.from_turns(table(spark, sf_dir, "conversations"))
    found = tool_calls.records(calls, results, tool_calls.SCHEMAS)
    return found.select("conv_id", "call_id", "turn", "result_turn", "state", "level", (F.size("errors") == 0).alias("valid"), F.sha2("record", 256).alias("record_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang)
      LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + g.v) AS BIGINT) AS p
      FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (sum(c.n) + 1)) // (any_value(l.n) + any_value(l.v)) AS BIGINT) AS q
      FROM c JOIN (SELECT lang, sum(n) AS n, any_value(v) AS v FROM g GROUP BY lang) l USING (lang) GROUP BY lang, term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - q.q) * (p.p - q.q) // q.q FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
FROM u QUALIFY part = 'pair' OR rank <= 200"""


@query("op11_source_divergence", OP11_SQL)
def op11_source_divergence(spark, sf_dir):
    return divergence.audited(table(spark, sf_dir, "documents"))


@query("op12_residual_packing")
def op12_residual_packing(spark, sf_dir):
    return residual_packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS y,
             CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
                  WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b FROM u),
p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p"""


@query("op13_fill_middle", OP13_SQL)
def op13_fill_middle(spark, sf_dir):
    made = fill_middle.transformed(table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", F.col("a").alias("prefix_chars"), (F.col("b") - F.col("a")).alias("middle_chars"),
                       F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


# What SQL can say of operators that it cannot express whole.

PRIVATE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS n_email, regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') AS ips,
             list_transform(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[\x20-]', '', 'g')) AS cards,
             list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) AS phones FROM d),
c AS (SELECT *, list_transform(list_filter(cards, lambda x: length(x) BETWEEN 14 AND 19), lambda x: list_transform(string_split(reverse(x), ''), lambda y, i: CAST(y AS INTEGER) * (1 + (i - 1) % 2))) AS doubled FROM m)
SELECT doc_id, n_email, len(list_filter(ips, lambda x: len(list_filter(string_split(x, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0)) AS n_ip,
       len(list_filter(doubled, lambda x: list_sum(list_transform(x, lambda y: CASE WHEN y > 9 THEN y - 9 ELSE y END)) % 10 = 0)) AS n_card, len(list_filter(phones, lambda n: n BETWEEN 10 AND 15)) AS n_phone FROM c"""


@query("private_data_counts", PRIVATE_SQL)
def private_data_counts(spark, sf_dir):
    """Base spans by kind, without a tagger."""
    return private_data.found(table(spark, sf_dir, "documents"), None).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


TARGETS_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS size, 1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS w FROM d GROUP BY source),
o AS (SELECT *, 3.0 * size / w AS stop, row_number() OVER (ORDER BY 3.0 * size / w, source) AS k FROM s),
u AS (SELECT k, stop, (sum(size) OVER () - 3 * coalesce(sum(size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM o),
f AS (SELECT arg_min(unit, k) AS unit FROM u WHERE unit <= stop)
SELECT doc_id, d.size, CAST(o.size AS BIGINT) AS source_size, CAST(floor(least(3.0 * o.size, unit * w) + 0.5) AS BIGINT) AS target FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source, f"""


@query("mixing_targets", TARGETS_SQL)
def mixing_targets(spark, sf_dir):
    chosen = op7_sainte_lague_mix(spark, sf_dir)
    return chosen.select("doc_id", "size", "source_size", F.floor(F.col("target") + 0.5).alias("target"))


EDITS_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC) AS following, first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC) AS first FROM documents)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(substr(text, 1, length(text) - length(text) // 2) || substr(coalesce(following, first), 1, length(text) // 2)) AS edited_sha256 FROM d"""


@query("piecewise_hash_edits", EDITS_SQL)
def piecewise_hash_edits(spark, sf_dir):
    return op8_piecewise_hash(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")
