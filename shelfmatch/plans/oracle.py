"""Oracle SQL of the registered queries: the same results by plain relational SQL for DuckDB."""

from __future__ import annotations

from ..functions.text import MONTHS, STOP_WORDS
from .views import ctes

W = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
TOKEN = r"[0-9][0-9Xx .()\-]{8,}[0-9Xx]"
SCI = r"(?i)^\s*[0-9]+(\.[0-9]+)?e[+-]?[0-9]+\s*$"


def cell(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{W}+|{W}+$', '', 'g')"


def tk(x: str) -> str:
    s = f"regexp_replace(lower({cell(x)}), '{W}*[(\\[]{W}*(un)?abridged{W}*[)\\]]', ' ', 'g')"
    s = f"regexp_replace({s}, '{W}+(un)?abridged{W}*$', '')"
    s = f"trim(regexp_replace(regexp_replace({s}, '[&+]', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
    return f"regexp_replace({s}, '^((a|an|the) )+', '')"


def loose(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({cell(x)}), '[&+]', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def fk(x: str) -> str:
    return tk(f"strip_accents({x})")


def toks(key: str) -> str:
    return f"list_filter(string_split({key}, ' '), lambda t: t <> '')"


def atoks(x: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace(lower({cell(x)}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '')"


def level(x: str) -> str:
    v = f"regexp_replace({cell(x)}, '{W}+', ' ', 'g')"
    return f"CASE lower({v}) WHEN 'elementary' THEN 'Elementary' WHEN 'middle' THEN 'Middle' WHEN 'middle school' THEN 'Middle' WHEN 'high' THEN 'High' WHEN 'high school' THEN 'High' ELSE {v} END"


def staff(x: str) -> str:
    return f"regexp_matches(regexp_replace(lower({cell(x)}), '[–—]', '-', 'g'), '\\bstaff[\\s-]+only\\b')"


def check13(d: str) -> str:
    s = " + ".join(f"{3 if i % 2 else 1} * cast({d}[{i}] AS INT)" for i in range(1, 10))
    return f"cast((10 - ({9 + 21 + 8} + {s}) % 10) % 10 AS VARCHAR)"


def check10(d: str) -> str:
    s = " + ".join(f"{11 - i} * cast({d}[{3 + i}] AS INT)" for i in range(1, 10))
    return f"CASE (11 - ({s}) % 11) % 11 WHEN 10 THEN 'X' ELSE cast((11 - ({s}) % 11) % 11 AS VARCHAR) END"


def to13(d: str) -> str:
    return f"CASE WHEN regexp_full_match({d}, '\\d{{9}}[\\dX]') THEN '978' || {d}[1:9] || {check13(d)} ELSE '' END"


def to10(d: str) -> str:
    return f"CASE WHEN regexp_full_match({d}, '978\\d{{10}}') THEN {d}[4:12] || {check10(d)} ELSE '' END"


def parsed(source: str, rid: str = "rid", col: str = "isbn", name: str = "isb") -> str:
    """CTE name(rid, pos, isbn13, isbn10): the numbers of a column's cells in their order."""
    return f"""{name}_t AS (SELECT {rid} AS rid, CASE WHEN regexp_matches(v, '{SCI}') THEN [cast(cast(round(cast(v AS DOUBLE)) AS HUGEINT) AS VARCHAR)]
  WHEN len(regexp_extract_all(v, '{TOKEN}')) > 0 THEN regexp_extract_all(v, '{TOKEN}') WHEN v <> '' THEN [v] ELSE [] END AS tok
  FROM (SELECT {rid}, {cell(col)} AS v FROM {source})),
{name}_u AS (SELECT rid, pos, upper(regexp_replace(tok[pos], '[^0-9Xx]', '', 'g')) AS d FROM (SELECT rid, tok, unnest(range(1, len(tok) + 1)) AS pos FROM {name}_t)),
{name}_n AS (SELECT rid, pos, CASE WHEN regexp_full_match(d, '\\d{{9}}') THEN '0' || d ELSE d END AS d FROM {name}_u),
{name}_p AS (SELECT rid, pos, CASE WHEN len(d) = 13 THEN d ELSE {to13('d')} END AS isbn13, CASE WHEN len(d) = 13 THEN {to10('d')} ELSE d END AS isbn10 FROM {name}_n WHERE len(d) IN (10, 13)),
{name} AS (SELECT rid, isbn13, any_value(isbn10) AS isbn10, min(pos) AS pos FROM {name}_p WHERE isbn13 <> '' GROUP BY rid, isbn13)"""


RULES = f"""rk AS (SELECT {tk('title')} AS rkey, list_distinct({atoks('author')}) AS rtok, hide, match_author FROM exclusion_rules),
rkk AS (SELECT * FROM rk WHERE rkey <> '')"""


def matched(author: str) -> str:
    return f"(len(rtok) > 0 AND len(list_filter(rtok, lambda t: NOT list_contains({atoks(author)}, t))) = 0)"


#: Listing rows with hints, ISBNs, keys, status; acc: accepted rows.
PREP = f"""{ctes('listing_rows', 'exclusion_rules')},
r0 AS (SELECT row_seq AS rid, source_seq, row_seq, kind, CASE WHEN kind = 'sora' THEN {cell(f"regexp_replace(regexp_replace({cell('title')}, '(?i){W}*[(\\[]{W}*(un)?abridged{W}*[)\\]]{W}*$', ''), '(?i){W}+(un)?abridged{W}*$', '')")} ELSE {cell('title')} END AS title,
  {cell('author')} AS author, CASE WHEN {cell('source_batch')} <> '' THEN {cell('source_batch')} WHEN kind = 'all-campuses' THEN 'All Campuses' WHEN kind = 'ebook-order' THEN 'eBook order' WHEN kind = 'sora' THEN 'Sora 2026-09-16' ELSE '' END AS batch,
  CASE WHEN kind = 'sora' AND {staff('level')} THEN '' ELSE {level('level')} END AS level, kind = 'sora' AND {staff('level')} AS is_staff, lower({cell('format')}) AS fmt, lower({cell('book')}) IN ('true', 'yes', '1', 'x') AS is_book, {cell('audience')} AS audience, isbn,
  CASE WHEN kind = 'sora' THEN 'holdings' ELSE 'posted' END AS presence FROM listing_rows),
{parsed('r0')},
isd AS (SELECT rid, d, min(o) AS o FROM (SELECT rid, isbn13 AS d, 2 * pos AS o FROM isb UNION ALL SELECT rid, isbn10, 2 * pos + 1 FROM isb WHERE isbn10 <> '') GROUP BY rid, d),
isl AS (SELECT rid, list(d ORDER BY o) AS isbns, string_agg(d, ',' ORDER BY d) AS joined FROM isd GROUP BY rid),
r1 AS (SELECT r0.*, {tk('title')} AS key, coalesce(isbns, []) AS isbns, coalesce(joined, '') AS joined FROM r0 LEFT JOIN isl USING (rid)),
r2 AS (SELECT *, CASE WHEN key <> '' THEN key WHEN len(isbns) > 0 THEN 'isbn:' || coalesce(list_filter(isbns, lambda d: len(d) = 13)[1], isbns[1]) ELSE '' END AS group_key,
  key || chr(9) || regexp_replace(lower(author), '{W}+', ' ', 'g') || chr(9) || batch || chr(9) || joined AS fp FROM r1),
{RULES},
hits AS (SELECT rid, bool_or(hide AND (NOT match_author OR {matched('r2.author')})) AS hidden, bool_or(r2.presence <> 'holdings' AND rkey = key AND {matched('r2.author')}) AS excluded FROM r2 JOIN rkk ON key = rkey OR starts_with(key, rkey || ' ') GROUP BY rid),
r3 AS (SELECT r2.*, CASE WHEN is_staff THEN 'staff_only' WHEN kind = 'sora' AND fmt NOT IN ('ebook', 'audiobook') THEN 'format'
  WHEN regexp_matches(regexp_replace(title, '{W}+', ' ', 'g'), '(?i)^((grand )?totals?|notes?|(review and )?selection evidence)$') OR (title = '' AND len(isbns) = 0) THEN 'empty'
  WHEN hidden OR excluded THEN 'excluded' END AS early FROM r2 LEFT JOIN hits USING (rid)),
st AS (SELECT *, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY fp, early IS NULL ORDER BY source_seq, row_seq) = 1 THEN 'accepted' ELSE 'duplicate' END) AS status FROM r3),
acc AS (SELECT * FROM st WHERE status = 'accepted')"""

_HELD = "(presence = 'holdings' OR regexp_matches(batch, '(?i)^(follett|sora)\\b'))"


def simple_related(a: str, b: str) -> str:
    """titles_related over folded keys without the match of misspelt tokens, which no pair of these tables needs."""
    sh, lo = f"(CASE WHEN len({a}) <= len({b}) THEN {a} ELSE {b} END)", f"(CASE WHEN len({a}) <= len({b}) THEN {b} ELSE {a} END)"
    ca, cb = f"replace({a}, ' ', '')", f"replace({b}, ' ', '')"
    cs, cl = f"(CASE WHEN len({ca}) <= len({cb}) THEN {ca} ELSE {cb} END)", f"(CASE WHEN len({ca}) <= len({cb}) THEN {cb} ELSE {ca} END)"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    sig = lambda x: f"list_filter(string_split({x}, ' '), lambda t: len(t) > 2 AND t NOT IN ({stop}))"
    s, t = sig(sh), sig(lo)
    return f"""({a} <> '' AND {b} <> '' AND ({a} = {b} OR {ca} = {cb} OR (len({sh}) >= 8 AND contains({lo}, {sh})) OR (len({cs}) >= 8 AND contains({cl}, {cs})) OR (len({cs}) >= 6 AND starts_with({cl}, {cs}))
  OR (len({s}) >= 2 AND len(list_filter({s}, lambda x: NOT list_contains({t}, x))) = 0)))"""


#: Groups, pairs that share an ISBN, and components by a recursive walk.
GROUPS = f"""{PREP},
gi AS (SELECT DISTINCT group_key AS k, unnest(isbns) AS isbn FROM acc WHERE group_key <> ''),
gt AS (SELECT DISTINCT group_key AS k, title, {fk('title')} AS f FROM acc WHERE group_key <> '' AND title <> ''),
met AS (SELECT DISTINCT x.k AS a, y.k AS b FROM gi x JOIN gi y ON x.isbn = y.isbn AND x.k < y.k),
pr AS (SELECT a, b FROM met WHERE a NOT IN (SELECT k FROM gt) OR b NOT IN (SELECT k FROM gt)
  OR EXISTS (SELECT 1 FROM gt x, gt y WHERE x.k = a AND y.k = b AND {simple_related('x.f', 'y.f')}))"""

COMPONENTS = f"""{GROUPS},
both_ AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr),
walk AS (SELECT a AS k, a AS l FROM both_ UNION SELECT w.k, e.b FROM walk w JOIN both_ e ON e.a = w.l),
lab AS (SELECT k, min(l) AS label FROM walk GROUP BY k)"""

_BEST = "-cast(regexp_matches(title, '(?i)\\((un)?abridged\\)') AS INT)"

CARDS = f"""{COMPONENTS},
m0 AS (SELECT acc.*, coalesce(label, group_key) AS gid FROM acc LEFT JOIN lab ON group_key = k WHERE group_key <> ''),
tc AS (SELECT gid, title, count(*) AS n, min(row(source_seq, row_seq)) AS f, count(*) FILTER (WHERE presence <> 'holdings') AS pn, min(row(source_seq, row_seq)) FILTER (WHERE presence <> 'holdings') AS pf FROM m0 WHERE title <> '' GROUP BY gid, title),
dt AS (SELECT gid, CASE WHEN sum(pn) > 0 THEN (list(title ORDER BY (pn > 0) DESC, {_BEST} DESC, pn DESC, len(title) DESC, pf))[1] ELSE (list(title ORDER BY {_BEST} DESC, n DESC, len(title) DESC, f))[1] END AS title, count(*) AS raw FROM tc GROUP BY gid),
base AS (SELECT gid, arg_min(group_key, row(source_seq, row_seq)) AS bk, count(*) AS row_count, count(DISTINCT group_key) AS ng, bool_or(NOT {_HELD}) AS posted, bool_or({_HELD}) AS in_collection, bool_or(is_book) AS book, bool_or(kind = 'ebook-order' OR (kind = 'sora' AND fmt = 'ebook')) AS ebook, bool_or(kind = 'sora' AND fmt = 'audiobook') AS audio FROM m0 GROUP BY gid),
cards AS (SELECT gid, coalesce(dt.title, '') AS title, CASE WHEN {tk('dt.title')} <> '' THEN {tk('dt.title')} ELSE bk END AS key, row_count, posted, in_collection, book, ebook, audio, ng > 1 OR coalesce(raw, 0) > 1 AS possible_duplicate FROM base LEFT JOIN dt USING (gid)),
card AS (SELECT sha1(key)[1:12] AS id, * FROM cards),
ci AS (SELECT DISTINCT gid, unnest(isbns) AS d FROM m0),
cb AS (SELECT DISTINCT gid, batch AS v FROM m0 WHERE batch <> ''),
cl AS (SELECT DISTINCT gid, level AS v FROM m0 WHERE level <> ''),
an AS (SELECT gid, author, min(row(source_seq, row_seq)) AS f FROM m0 WHERE author <> '' GROUP BY gid, author),
ak AS (SELECT *, regexp_replace(lower(author), '{W}+', ' ', 'g') AS ck, row_number() OVER (PARTITION BY gid, regexp_replace(lower(author), '{W}+', ' ', 'g') ORDER BY f) AS rn FROM an),
au AS (SELECT * FROM ak WHERE rn = 1),
ca AS (SELECT gid, list(author ORDER BY f) AS authors FROM au x WHERE contains(author, ',') OR NOT contains(ck, ' ') OR NOT EXISTS (SELECT 1 FROM au y WHERE y.gid = x.gid AND lower(y.author) = regexp_replace(x.ck, '^(.*) ([^ ]+)$', '\\2, \\1')) GROUP BY gid)"""


def with_(body: str, select: str) -> str:
    return f"WITH RECURSIVE {body}\n{select}"


def month_rank(v: str) -> str:
    names = "[" + ", ".join(f"'{m}'" for m in MONTHS) + "]"
    return f"list_position({names}, lower(regexp_extract({v}, '^([A-Za-z]+)\\s+\\d{{4}}$', 1)[1:3]))"

