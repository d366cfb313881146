"""The registered query of each operator: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, dialogue, htmlmain, media, neardup, ngramjoin, packing, phrases, quality, ranked, suffixdedup, tokenfiles, tokens, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_matroska_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_table(spark, sf_dir, "documents"))


def op2_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_boosted_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.main_text(_table(spark, sf_dir, "pages"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokens.default_path())


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_files(_table(spark, sf_dir, "documents"), tokens.default_path())


def op7_bottom_k_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), size=4)


def op8_suffix_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.suffix_dedup(_table(spark, sf_dir, "documents"))


def op9_toxicity_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_phrase_automata_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrase_dedup(_table(spark, sf_dir, "documents"))


def op11_glr_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair(_table(spark, sf_dir, "conversations"))


def op12_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.ngram_components(_table(spark, sf_dir, "documents"))


def op13_best_position_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_matroska_media, op2_quality_attention, op3_winnowing_decontamination, op4_boosted_html_extraction, op5_best_fit_packing, op6_token_files, op7_bottom_k_near_dedup, op8_suffix_radix_dedup, op9_toxicity_subwords, op10_phrase_automata_dedup, op11_glr_conversation_repair, op12_adaptive_prefix_join, op13_best_position_search)}
#: The same rows by brute force: every window of every document against every window of the items.
OP3_SQL = r"""
WITH up AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS wlen, array_to_string(w[s + 1 : s + 10], ' ') AS t FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT wlen FROM iw),
dw AS (SELECT doc_id, s, wlen, array_to_string(w[s + 1 : s + wlen], ' ') AS t FROM (SELECT doc_id, w, wlen, unnest(range(0, len(w) - wlen + 1)) AS s FROM up, lens WHERE len(w) >= wlen)),
hit AS (SELECT d.doc_id, d.s, d.wlen, i.item_id FROM dw d JOIN iw i ON d.t = i.t AND d.wlen = i.wlen),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + wlen)) AS p FROM (SELECT DISTINCT doc_id, s, wlen FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT u.doc_id, CAST(len(u.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM up u LEFT JOIN cov c USING (doc_id) LEFT JOIN its i USING (doc_id)
"""

#: Similar pairs by counting common shingles, components by a recursive walk.
OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1 : k + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 0) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
walk AS (SELECT a AS k, a AS l FROM both_ UNION SELECT walk.k, both_.b FROM walk JOIN both_ ON both_.a = walk.l),
c AS (SELECT k, min(l) AS component_id FROM walk GROUP BY k)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(component_id, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON k = w.doc_id
"""

#: Every 50-byte window (100 hexadecimal digits) against its smallest document.
OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, h[2 * s + 1 : 2 * s + 100] AS x FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS s FROM d)),
f AS (SELECT x, min(doc_id) AS m FROM w GROUP BY x HAVING count(*) > 1),
g AS (SELECT doc_id, s, s + 50 AS e FROM w JOIN f USING (x) WHERE m < doc_id),
o AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM g),
r AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM o),
sp AS (SELECT doc_id, run, min(s) AS a, max(e) AS b FROM r GROUP BY doc_id, run),
pieces AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x0, a AS x1 FROM sp UNION ALL SELECT doc_id, max(b), NULL FROM sp GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN x1 = x0 THEN '' ELSE h[2 * x0 + 1 : coalesce(2 * x1, len(h))] END, '' ORDER BY x0) AS k FROM pieces JOIN d USING (doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM sp GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN t USING (doc_id)
"""

#: Every 20-word window against its first place.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS nth FROM (SELECT doc_id, s, array_to_string(w[s + 1 : s + 20], ' ') AS t FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 19, 0))) AS s FROM d))),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM x WHERE nth > 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, p, w[p + 1] AS v FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS p FROM d)),
kept AS (SELECT word.doc_id, string_agg(v, ' ' ORDER BY word.p) AS k FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p WHERE gone.p IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: As OP7_SQL, with shingles of three words and a similarity of 0.9.
OP12_SQL = OP7_SQL.replace("k + 4", "k + 3").replace("len(w) - 4", "len(w) - 3").replace(">= 80 *", ">= 90 *").replace(", coalesce(component_id, w.doc_id) = w.doc_id AS kept", "")

#: Damage by a bitwise CRC-32, faults by windows, the cheapest edits row by row for the four places of the grammar.
OP11_SQL = r"""
WITH RECURSIVE z AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)) AS b FROM conversations),
y AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, v: list_reduce(list_prepend(xor(c, v), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, u: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 20 AS d FROM z),
x AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS again FROM y WHERE d <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), again) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) AS nth, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e, substr(role, 1, 1) AS ini FROM x),
f AS (SELECT conv_id, turn, role, text, i, ini, CASE WHEN e = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM o),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (p IS NOT NULL AND p || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
ins(s1, s2, ic, il) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 3, 3, 'I'), (3, 2, 3, 'I')),
g(t, q1, q2) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
edit AS (SELECT s1, s2 AS q, ic + 4 AS cost, il || 'D' AS l, 'D' AS act, '' AS t FROM ins UNION ALL SELECT s1, q2, ic, il || 'K', 'K', t FROM ins JOIN g ON q1 = s2 UNION ALL SELECT s1, q2, ic + 3, il || 'R', 'R', '' FROM ins JOIN g ON q1 = s2 WHERE t <> 's'),
dp AS (SELECT conv_id, 0 AS at, 0 AS q, '0000000000' AS best FROM n UNION ALL
  SELECT f.conv_id, dp.at + 1, edit.q, min(printf('%010d', CAST(left(best, 10) AS BIGINT) + edit.cost + CASE WHEN fault = 't' AND act <> 'D' THEN 3 ELSE 0 END) || substr(best, 11) || l)
  FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.at + 1 JOIN edit ON edit.s1 = dp.q AND (act = 'D' OR (fault NOT IN ('b', 'd') AND (act = 'R' OR edit.t = ini))) GROUP BY f.conv_id, dp.at, edit.q),
fin AS (SELECT dp.conv_id, min(printf('%010d', CAST(left(best, 10) AS BIGINT) + ic) || substr(best, 11) || il) AS best FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.n = dp.at JOIN ins ON s1 = q AND s2 IN (0, 3) GROUP BY dp.conv_id),
aud AS (SELECT conv_id, CAST(left(best, 10) AS BIGINT) AS cost, substr(best, 11) AS audit FROM fin),
le AS (SELECT conv_id, len(replace(audit, 'D', '')) % 2 AS sys, j, substr(audit, j, 1) AS l FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS j FROM aud)),
lo AS (SELECT *, count(*) FILTER (l <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i, count(*) FILTER (l <> 'D') OVER (PARTITION BY conv_id ORDER BY j) - 1 - sys AS k FROM le),
line AS (SELECT lo.conv_id, j, CASE WHEN l = 'K' THEN f.role WHEN k % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l = 'I' THEN '' ELSE f.text END AS v FROM lo LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM lo.conv_id AND f.i = lo.i WHERE l <> 'D'),
said AS (SELECT conv_id, string_agg(v, chr(10) ORDER BY j) AS v FROM line GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(v, '')) AS repaired_sha256
FROM ids LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN aud ON aud.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM ids.conv_id
"""

#: Every document's score for every item.
OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT count(*) AS nn, sum(len(w)) AS ll FROM d WHERE len(w) > 0),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM b) GROUP BY ALL),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
i AS (SELECT doc_id, p.t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + CAST((50 * n * nn) // ll AS BIGINT)))) AS s FROM p JOIN f USING (t) CROSS JOIN c),
x AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM b JOIN i USING (t) GROUP BY item_id, doc_id HAVING sum(s) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x) WHERE rank <= 50
"""

ORACLE_SQL: dict[str, str] = {"op3_winnowing_decontamination": OP3_SQL, "op7_bottom_k_near_dedup": OP7_SQL, "op8_suffix_radix_dedup": OP8_SQL, "op10_phrase_automata_dedup": OP10_SQL, "op11_glr_conversation_repair": OP11_SQL, "op12_adaptive_prefix_join": OP12_SQL, "op13_best_position_search": OP13_SQL}
