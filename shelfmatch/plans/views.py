"""Stand-in tables of a catalogue, as views over the given tables; the same text runs in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import SparkSession

TABLES = ("documents", "labels", "pages", "benchmark", "lineitem", "part", "supplier")
VIEWS = {
    "listing_rows": r"""
WITH h AS (
  SELECT doc_id, n_chars, regexp_extract(text, '^[^.\n]{1,120}', 0) AS head,
         cast(100000000 + ((n_chars - n_chars % 8) * 31) % 90001 AS string) AS b
  FROM documents),
c AS (
  SELECT *, cast((10 - (38 + 3*cast(substr(b,1,1) AS int) + cast(substr(b,2,1) AS int) + 3*cast(substr(b,3,1) AS int)
      + cast(substr(b,4,1) AS int) + 3*cast(substr(b,5,1) AS int) + cast(substr(b,6,1) AS int) + 3*cast(substr(b,7,1) AS int)
      + cast(substr(b,8,1) AS int) + 3*cast(substr(b,9,1) AS int)) % 10) % 10 AS string) AS k
  FROM h)
SELECT cast(doc_id % 7 AS int) AS source_seq,
       'list-' || cast(doc_id % 7 AS string) AS source_label,
       doc_id AS row_seq,
       CASE WHEN doc_id % 7 = 4 THEN 'all-campuses' WHEN doc_id % 7 = 5 THEN 'sora'
            WHEN doc_id % 7 = 6 THEN 'ebook-order' ELSE 'master' END AS kind,
       CASE WHEN doc_id % 53 = 0 THEN 'Grand Total'
            WHEN doc_id % 11 = 0 THEN 'The ' || head || '!'
            WHEN doc_id % 11 = 1 THEN translate(head, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')
            WHEN doc_id % 11 = 2 THEN head || ' (unabridged)'
            WHEN doc_id % 11 = 3 THEN ''
            WHEN doc_id % 11 = 4 THEN head || ' : a story of ' || substr(head, 1, 12)
            ELSE head END AS title,
       CASE WHEN doc_id % 2 = 0 THEN 'Writer' || cast(n_chars % 13 AS string) || ', Ann'
            ELSE 'Ann Writer' || cast(n_chars % 13 AS string) END AS author,
       CASE WHEN doc_id % 7 >= 4 THEN '' WHEN n_chars % 4 = 0 THEN 'Sep 2025' WHEN n_chars % 4 = 1 THEN 'Oct 2025'
            WHEN n_chars % 4 = 2 THEN 'Jan 2026' ELSE '2026-2027' END AS source_batch,
       CASE WHEN doc_id % 6 = 0 THEN 'elementary' WHEN doc_id % 6 = 1 THEN 'Middle School' WHEN doc_id % 6 = 2 THEN 'HIGH'
            WHEN doc_id % 6 = 3 THEN 'High School, Staff Only' WHEN doc_id % 6 = 4 THEN 'Adult' ELSE '' END AS level,
       CASE WHEN doc_id % 7 = 5 THEN CASE WHEN doc_id % 5 = 0 THEN 'Magazine' WHEN doc_id % 5 = 1 THEN 'Audiobook' ELSE 'Ebook' END
            ELSE '' END AS format,
       CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE '' END AS book,
       CASE WHEN doc_id % 8 = 0 THEN '2024-01-0' || cast(1 + doc_id % 9 AS string) WHEN doc_id % 8 = 1 THEN 'Juvenile Fiction' ELSE '' END AS audience,
       CASE WHEN doc_id % 8 = 0 THEN '978-' || substr(b,1,1) || '-' || substr(b,2,4) || '-' || substr(b,6,4) || '-' || k
            WHEN doc_id % 8 = 1 THEN '978' || b || k || ' (pbk.)'
            WHEN doc_id % 8 = 2 THEN '9.78' || b || k || 'E12'
            WHEN doc_id % 8 = 3 THEN b || 'X'
            WHEN doc_id % 8 = 4 THEN '978' || b || k || ' 979' || b || '1'
            WHEN doc_id % 8 = 5 THEN '978' || b || k || '; 979' || b || '1'
            WHEN doc_id % 8 = 6 THEN '' ELSE '978' || b || k END AS isbn
FROM c""",
    "holdings_rows": r"""
SELECT doc_id AS row_seq, 'report-a' AS source_label,
       CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 = 1 THEN translate(title, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE title END AS title,
       CASE WHEN doc_id % 14 <= 7 THEN title ELSE '' END AS series_title, author, isbn,
       CASE WHEN doc_id % 5 = 0 THEN 'Book' WHEN doc_id % 5 = 1 THEN 'eBook' WHEN doc_id % 5 = 2 THEN 'Sound'
            WHEN doc_id % 5 = 3 THEN 'Recording' ELSE 'Video' END AS material_type
FROM (SELECT row_seq AS doc_id, title, author, isbn FROM listing_rows ) d
UNION ALL
SELECT 1000000000 + page_id, 'report-a', regexp_extract(html, '<title>([^<]*)</title>', 1), '', 'Page' || cast(page_id % 17 AS string) || ', Pat',
       '978' || cast(200000000 + page_id % 97 AS string) || '0',
       CASE WHEN page_id % 5 = 0 THEN 'Kit' WHEN page_id % 5 = 1 THEN 'Sound' ELSE 'Book' END
FROM pages""",
    "exclusion_rules": r"""
SELECT regexp_extract(text, '^[^.\n]{1,120}', 0) AS title, 'Ann Writer' || cast(n_chars % 13 AS string) AS author,
       n_chars % 4 <> 0 AS hide, doc_id % 3 = 0 AS match_author
FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "lookup_queries": r"""
SELECT doc_id AS query_id,
       CASE WHEN doc_id % 80 = 0 THEN lower(head) WHEN doc_id % 80 = 20 THEN substr(head, 1, 9) || substr(head, 11, 200)
            WHEN doc_id % 80 = 40 THEN substr(head, 1, 14) ELSE 'writer' || cast(n_chars % 13 AS string) END AS query
FROM (SELECT doc_id, n_chars, regexp_extract(text, '^[^.\n]{1,120}', 0) AS head FROM documents WHERE doc_id % 20 = 0) q
UNION ALL SELECT 1000000 + row_seq, isbn FROM listing_rows WHERE row_seq % 20 = 0 AND isbn <> ''
UNION ALL SELECT 3000000 + page_id, '978' || cast(200000000 + page_id % 97 AS string) || '0' FROM pages WHERE page_id % 20 = 0
UNION ALL SELECT 2000000 + item_id, regexp_extract(text, '^[^.\n]{1,120}', 0) FROM benchmark""",
    "listing_rows_big": r"""
SELECT cast(l_linenumber AS int) AS source_seq, 'bulk-' || cast(l_linenumber AS string) AS source_label,
       l_orderkey * 10 + l_linenumber AS row_seq, 'master' AS kind,
       CASE WHEN l_orderkey % 5 = 0 THEN 'The ' ELSE '' END || p_name || ' ' || lower(p_type) || ' ' || cast(p_size AS string) AS title,
       s_name AS author, CASE WHEN l_returnflag = 'R' THEN 'Sep 2025' WHEN l_returnflag = 'A' THEN 'Jan 2026' ELSE '2026-2027' END AS source_batch,
       CASE WHEN l_linestatus = 'O' THEN 'elementary' ELSE 'High School' END AS level, '' AS format, '' AS book, '' AS audience,
       '978' || cast(300000000 + l_partkey AS string) || '0' AS isbn
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
}
NEEDS = {"holdings_rows": ("listing_rows",), "lookup_queries": ("listing_rows",)}


def register(spark: SparkSession, sf_dir: str) -> None:
    """The tables at sf_dir and the views over them, as temporary views of the session."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for name, sql in VIEWS.items():
        spark.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS {sql}")


def ctes(*names: str) -> str:
    """The views as common table expressions, each after what it needs."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*NEEDS.get(n, ()), n) if x not in order]
    return ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
