"""SQL for DuckDB that says what the catalogue's queries return, written from their definitions."""

from __future__ import annotations

WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\p{Z}]"
BULLET = rf"^[•‣◦⁃∙·\-–]{WS}+"
NUMBERED = rf"^(\p{{Nd}}{{1,3}}|[a-zA-Z])[.\)]{WS}+"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


LINES = """lines AS (
  SELECT doc_id, i - 1 AS line_no, a[i] AS text, CAST((i - 1) // 20 AS INTEGER) AS page_no,
         CAST(CASE WHEN i = 1 THEN 24 WHEN length(a[i]) <= 40 THEN 16 ELSE 11 END AS DOUBLE) AS size,
         CAST(CASE WHEN doc_id % 3 = 0 AND (i - 1) % 2 = 1 THEN 320 ELSE 72 END AS DOUBLE) AS x0,
         CAST(72 + 30 * ((i - 1) % 20) AS DOUBLE) AS y0
  FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), unnest(range(1, len(a) + 1)) AS u(i)),
box AS (SELECT *, x0 + 5 * length(text) AS x1, y0 + size AS y1 FROM lines),
pc AS (SELECT doc_id, max(page_no) + 1 AS page_count FROM lines GROUP BY 1),
pages_l AS (SELECT doc_id, CAST(p AS INTEGER) AS page_no, page_count FROM pc, unnest(range(0, page_count)) AS u(p))"""

SAMPLE = """sample AS (
  SELECT DISTINCT doc_id, CAST(CASE WHEN page_count <= 25 THEN i ELSE round_even(i * ((page_count - 1) / 24.0), 0) END AS INTEGER) AS page_no
  FROM pc, unnest(range(0, least(page_count, 25))) AS u(i))"""

HIST = f"""{LINES}, {SAMPLE},
marked AS (SELECT l.*, length({strip('text')}) AS n FROM lines l SEMI JOIN sample USING (doc_id, page_no)),
hist AS (SELECT doc_id, size, CAST(sum(n) AS BIGINT) AS chars, min(line_no) AS first_at FROM marked WHERE n > 0 GROUP BY 1, 2),
body AS (SELECT d.doc_id, coalesce(arg_min(size, [-chars, first_at]), 12.0) AS body_size FROM documents d LEFT JOIN hist USING (doc_id) GROUP BY 1),
tiers AS (SELECT * FROM (SELECT h.doc_id, h.size, h.chars, body_size, CAST(row_number() OVER (PARTITION BY h.doc_id ORDER BY h.size DESC) AS INTEGER) AS level
          FROM hist h JOIN body USING (doc_id) WHERE h.size > body_size * 1.08) WHERE level <= 4),
own AS (SELECT doc_id, page_no, line_no AS block_no, text, CASE WHEN length({strip('text')}) > 0 THEN size ELSE body_size END AS rep_size, body_size FROM lines JOIN body USING (doc_id)),
heads AS (SELECT o.doc_id, o.page_no, o.block_no, t.level,
           (CASE WHEN o.body_size > 0 THEN greatest(0.0, least(1.0, (rep_size / o.body_size - 1.08) / 0.5)) ELSE 1.0 END
            + greatest(0.0, least(1.0, coalesce(h.chars, 0) / 20.0))
            + CASE WHEN length(o.text) <= 120 THEN 1.0 ELSE greatest(0.0, 1.0 - (length(o.text) - 120) / 120.0) END) / 3 AS c
          FROM own o JOIN tiers t ON t.doc_id = o.doc_id AND t.size = o.rep_size LEFT JOIN hist h ON h.doc_id = o.doc_id AND h.size = o.rep_size)"""

ITEMS = f"""{LINES},
gaps AS (SELECT *, CASE WHEN x0 - lag(x0) OVER w > 612 * 0.04 THEN 1 ELSE 0 END AS new FROM box WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY x0, line_no)),
clu AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id, page_no ORDER BY x0, line_no ROWS UNBOUNDED PRECEDING) AS INTEGER) AS cluster FROM gaps),
sides AS (SELECT doc_id, page_no, cluster, count(*) AS n, min(y0) AS top, max(y1) AS bottom FROM clu GROUP BY 1, 2, 3),
pg AS (SELECT doc_id, page_no, CAST(count(*) AS INTEGER) AS clusters, CAST(sum(n) AS BIGINT) AS items, min(n) AS least_n, max(bottom) - min(top) AS h FROM sides GROUP BY 1, 2),
test AS (SELECT doc_id, page_no, clusters, items, items >= 4 AND clusters = 2 AND least_n >= 2 AS split,
          items >= 4 AND clusters = 2 AND least_n >= 2 AND h > 0 AND ok AS columns
         FROM pg JOIN (SELECT s.doc_id, s.page_no, bool_and(s.n / pg.items >= 0.3 AND pg.h > 0 AND (s.bottom - s.top) / pg.h >= 0.6) AS ok FROM sides s JOIN pg USING (doc_id, page_no) GROUP BY 1, 2) USING (doc_id, page_no)),
tested AS (SELECT *, items >= 4 AND (clusters >= 3 OR (split AND NOT columns)) AS uncertain FROM test)"""

SEQ = "seq AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS ord, CAST(1 + length(text) % 6 AS INTEGER) AS level, text FROM conversations)"
FOLDED = """numbered AS (SELECT *, row_number() OVER w AS i,
   CASE WHEN level = 1 AND count(*) FILTER (WHERE level = 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) > 1 THEN 2 ELSE level END AS demoted FROM {src} WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
walk AS (SELECT doc_id, ord, level, text, synthetic, i, demoted, 0 AS before, least(demoted, 1) AS final FROM numbered WHERE i = 1
   UNION ALL SELECT n.doc_id, n.ord, n.level, n.text, n.synthetic, n.i, n.demoted, w.final, least(n.demoted, w.final + 1) FROM walk w JOIN numbered n ON n.doc_id = w.doc_id AND n.i = w.i + 1)"""
WITH_TITLE = """titled AS (SELECT doc_id, ord, level, text, false AS synthetic FROM seq
   UNION ALL SELECT doc_id, -1, 1, 'conversation ' || doc_id, true FROM seq GROUP BY doc_id HAVING count(*) FILTER (WHERE level = 1) = 0)"""

CODES = """codes AS (SELECT * FROM (VALUES
 ('LANG_ASSUMED','R15','needs-human-review'),('LANG_DETECTED','R15','needs-human-review'),('TITLE_FROM_FILENAME','R12','needs-human-review'),
 ('TITLE_CLEANED','R12','needs-human-review'),('MISSING_ALT','R1b','needs-human-review'),('IMAGE_UNKNOWN_MIME_TYPE','R1','needs-human-review'),
 ('DECORATIVE_ASSUMED','R1b','needs-human-review'),('NO_HEADER_ROW_DETECTED','R18','needs-human-review'),('COMPLEX_TABLE_STRUCTURE','R18','needs-human-review'),
 ('TABLE_EXTRACTION_UNCERTAIN','R18','needs-human-review'),('HEADER_ROW_AUTO_ADDED','R18','auto-fixed'),('UNMAPPED_BLOCK','R2','needs-human-review'),
 ('GENERIC_LINK_TEXT','R13','needs-human-review'),('LINK_UNASSOCIATED','R21','needs-human-review'),('HEADING_SKIP_REPAIRED','R14','auto-fixed'),
 ('MULTIPLE_H1_DEMOTED','R2','auto-fixed'),('TITLE_PROMOTED_TO_H1','R2','auto-fixed'),('HEADINGS_INFERRED','R19','info'),
 ('HEADING_LOW_CONFIDENCE','R19','needs-human-review'),('READING_ORDER_UNCERTAIN','R20','needs-human-review'),('OCR_APPLIED','R22','needs-human-review'),
 ('OCR_NO_TEXT_RECOVERED','R22','needs-human-review'),('SCAN_IMAGES_EXCLUDED','R22','info')) AS t(code, r_number, severity)),
names AS (SELECT list(code ORDER BY code) || ['SOMETHING_NEW'] AS a FROM codes),
fl AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS flag_ord, a[length(text) % 24 + 1] AS code, role FROM conversations, names),
flags AS (SELECT *, CASE WHEN flag_ord = 0 THEN 'document' ELSE 'block' END AS scope,
   row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN flag_ord = 0 THEN -1 ELSE flag_ord % 3 END, flag_ord, code) - 1 AS flag_no FROM fl)"""

FIXES = """fixes AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank, ord) - 1 AS fix_ord FROM (
   SELECT doc_id, ord, 0 AS rank, 'TITLE_PROMOTED_TO_H1' AS code, '1.3.1' AS wcag_sc, text FROM walk WHERE synthetic
   UNION ALL SELECT doc_id, ord, 1, 'MULTIPLE_H1_DEMOTED', '1.3.1', text FROM walk WHERE demoted <> level
   UNION ALL SELECT doc_id, ord, 2, 'HEADING_SKIP_REPAIRED', '2.4.6', text FROM walk WHERE final <> demoted))"""


def quoted(x: str) -> str:
    inner = f"replace(replace(replace(replace({x}, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
    return f"""CASE WHEN contains({x}, '''') AND NOT contains({x}, '"') THEN '"' || {inner} || '"' ELSE '''' || replace({inner}, '''', '\\''') || '''' END"""


def escaped(x: str) -> str:
    return f"""replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""


LINKS = """pl AS (SELECT page_id AS doc_id, i - 1 AS link_ord, t[i] AS text, h[i] AS href
  FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>([^<]*)</a>', 2) AS t, regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>([^<]*)</a>', 1) AS h FROM pages),
  unnest(range(1, len(t) + 1)) AS u(i))"""
TITLE = """nullif(replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '')"""
ADS = """regexp_matches(html, '(?is)<div[^>]*>[^<]+</div>')"""
WORD = r"(?i)^Microsoft Word - (.+?)(\.docx?|\.rtf)?$"
WRAP = f"""{LINES}, wl AS (SELECT doc_id, line_no // 4 AS block_no, line_no, CASE WHEN line_no % 3 = 0 THEN lower(text) || '-' ELSE lower(text) END AS text, line_no % 5 = 0 AS linked FROM lines)"""
IMG = f"""{LINES}, img AS (SELECT doc_id, page_no, xref, side, page_count FROM pages_l, (VALUES (1, 200), (2, 10), (3, 700), (4, 0)) AS v(xref, side)
  WHERE xref = 1 OR (xref = 2 AND page_no % 3 = 0) OR (xref = 3 AND page_no % 5 = 0) OR xref = 4)"""
TAB = f"""{LINES}, tabs AS (SELECT DISTINCT doc_id, page_no FROM lines WHERE page_no % 2 = 1 AND line_no % 20 BETWEEN 4 AND 7),
ov AS (SELECT b.*, CASE WHEN (x1 - x0) * (y1 - y0) > 0 THEN greatest(0, least(x1, 400) - greatest(x0, 60)) * greatest(0, least(y1, 275) - greatest(y0, 190)) / ((x1 - x0) * (y1 - y0)) ELSE 0 END AS ratio FROM box b)"""


def script(family: str, ranges: list[str]) -> str:
    cls = "".join(f"\\x{{{a}}}-\\x{{{b}}}" for a, b in (r.split("-") for r in ranges))
    letters = f"list_filter(regexp_extract_all(text, '[{cls}]'), lambda x: regexp_matches(x, '\\p{{L}}'))"
    return f"SELECT doc_id, text, '{family}' AS family, len({letters}) AS n, position({letters}[1] IN text) AS first_at FROM t"


SCRIPTS = {"cjk": ["4E00-9FFF", "3040-30FF", "3400-4DBF", "AC00-D7A3", "F900-FAFF"], "cyrillic": ["0400-04FF"], "arabic": ["0600-06FF", "0750-077F"], "greek": ["0370-03FF"], "hebrew": ["0590-05FF"], "devanagari": ["0900-097F"], "thai": ["0E00-0E7F"]}
FAMILY = " UNION ALL ".join(script(f, r) for f, r in SCRIPTS.items())

LIST_CASES = "VALUES " + ", ".join(f"(-1, {i}, '{t}')" for i, t in enumerate(("• a", "– b", "1. c", "12) d", "1234. e", "a) f", "ab) g", "-h", "•", "  * i", "3.j")))
STRIP_CASES = "VALUES " + ", ".join(f"(-1, {i}, '{t}')" for i, t in enumerate(("• a", "– b", "1. c", "12) d", " • e", "• 1. f", "1. • g", "plain")))
GENERIC = "'click here','here','read more','more','link','learn more','this link','more info','more information'"
LINK_CASES = "VALUES " + ", ".join(f"(-1, {i}, '{t}', 'h')" for i, t in enumerate(("Click here", " more ", "https://a.b/c", "WWW.x.y", "see the plan", "www.", "", " here")))
ALTS = "VALUES ('Picture1.jpg'), ('IMG_001.png'), ('image 3.jpeg'), ('DSC1234'), ('pic-7'), ('A chart of sales'), (''), ('  '), ('figure.png'), ('photo'), ('img12'), ('graphic__2.gif'), ('img.png.'), (NULL)"
TITLES = "VALUES ('Microsoft Word - Plan.docx'), ('microsoft word - a b.DOC'), ('Microsoft Word - x.rtf'), ('Microsoft Word - y'), ('Plan'), ('  Microsoft Word - z.doc  '), ('Microsoft Word - .docx')"
TEXTS = """VALUES (-1, 'Hello 京都 and more English text around it, long enough to be Latin'), (-2, 'これは日本語の文章です'), (-3, 'Привет, мир'), (-4, 'שלום עולם'), (-5, '123 456'), (-6, 'abcdefg Ω Ж'), (-7, 'ΑΒ ЖЗ'), (-8, 'नमस्ते दुनिया')"""

GRAMS = r"""WITH low AS (SELECT doc_id, lang, lower(text) AS t FROM documents),
       g AS (SELECT doc_id, lang, substr(t, i, 3) AS gram, count(*) AS n FROM low, unnest(range(1, length(t) - 1)) AS u(i) WHERE regexp_matches(substr(t, i, 3), '^\p{L}{3}$') GROUP BY 1, 2, 3)"""

ORACLE_SQL: dict[str, str] = {
    "severity_by_page": f"SELECT page_id AS doc_id, CAST({ADS} AS BIGINT) AS total_items, 0::BIGINT AS auto_fixed, CAST({ADS} AS BIGINT) AS needs_human_review, 0::BIGINT AS info FROM pages",
    "report_totals": f"SELECT 'needs-human-review' AS severity, 'UNMAPPED_BLOCK' AS code, 'R2' AS r_number, count(*) AS items FROM pages WHERE {ADS}",
    "page_blocks": f"SELECT page_id AS doc_id, CAST(len(regexp_extract_all(html, '(?is)<h[1-6][^>]*>[^<]+')) AS BIGINT) AS headings, CAST({ADS} AS BIGINT) AS unmapped FROM pages",
    "page_links": f"""WITH {LINKS} SELECT * FROM pl UNION ALL VALUES (-1, 0, 'one', 'a?x=1&y=2'), (-1, 1, 'two and more', 'b'), (-1, 2, 'three é', 'c'), (-1, 3, 'four', ''), (-1, 4, '', 'd')""",
    "generic_links": f"""WITH {LINKS}, al AS (SELECT * FROM pl UNION ALL {LINK_CASES}), r AS (SELECT doc_id, link_ord, text,
       CASE WHEN lower({strip('text')}) IN ({GENERIC}) THEN 'generic link text' WHEN regexp_matches({strip('text')}, '(?i)^(https?://|www\\.)[^\\s]+$') THEN 'a bare URL as link text' END AS reason FROM al)
       SELECT *, reason IS NOT NULL AS flagged FROM r""",
    "page_language": "SELECT page_id AS doc_id, nullif(regexp_extract(html, '(?is)<html[^>]*\\slang=[\"'']?([^\"''\\s>]+)', 1), '') AS lang FROM pages",
    "page_title": f"SELECT page_id AS doc_id, {TITLE} AS meta_title FROM pages",
    "title_cleanup": f"""WITH t(title) AS ({TITLES}), a AS (SELECT title FROM t UNION ALL SELECT 'Microsoft Word - ' || text || '.docx' FROM benchmark)
       SELECT title, CASE WHEN regexp_matches({strip('title')}, '{WORD}') THEN nullif({strip(f"regexp_extract({strip('title')}, '{WORD}', 1)")}, '') END AS cleaned FROM a""",
    "title_fallback": f"""WITH {LINES}, h AS (SELECT doc_id, {strip('text')} AS heading FROM lines WHERE line_no = 1 AND doc_id % 2 = 0)
       SELECT d.doc_id, CASE WHEN d.doc_id % 5 = 0 THEN source WHEN coalesce(heading, '') <> '' THEN heading ELSE 'file ' || d.doc_id || '.v1' END AS title,
              CASE WHEN d.doc_id % 5 = 0 THEN 'TITLE_CLEANED' WHEN coalesce(heading, '') = '' THEN 'TITLE_FROM_FILENAME' END AS flag FROM documents d LEFT JOIN h USING (doc_id)""",
    "alt_filename": f"""WITH t(alt) AS ({ALTS}), f AS (SELECT alt, {strip("coalesce(alt, '')")} AS a FROM t), g AS (SELECT alt, a = '' OR regexp_matches(a, '(?i)^(img|image|pic|picture|photo|graphic|figure)[\\s_-]*\\d*\\.\\w+$') OR regexp_matches(a, '(?i)^(img|image|pic|dsc)[_\\s-]?\\d+$') AS filename_like FROM f)
       SELECT alt, filename_like, nullif(alt, '') AS alt_kept, filename_like OR coalesce(alt, '') = '' AS needs_review, CASE WHEN filename_like THEN 'MISSING_ALT' END AS flag FROM g""",
    "list_lines": f"""WITH {LINES}, a AS (SELECT doc_id, line_no, text FROM lines UNION ALL {LIST_CASES})
       SELECT doc_id, line_no, regexp_matches({strip('text')}, '{BULLET}') AS bullet, regexp_matches({strip('text')}, '{NUMBERED}') AS numbered, regexp_matches({strip('text')}, '{BULLET}') OR regexp_matches({strip('text')}, '{NUMBERED}') AS item FROM a""",
    "list_strip": f"""WITH {LINES}, a AS (SELECT doc_id, line_no, text FROM lines UNION ALL {STRIP_CASES})
       SELECT doc_id, line_no, CASE WHEN regexp_matches(text, '{BULLET}') THEN regexp_replace(text, '{BULLET}', '') ELSE regexp_replace(text, '{NUMBERED}', '') END AS stripped FROM a""",
    "sanitize_filename": "SELECT page_id, coalesce(nullif(trim(regexp_replace(replace(url, '/', '|'), '[^A-Za-z0-9._ -]+', '_', 'g'), ' .'), ''), 'document') AS stem FROM pages",
    "valid_uuid": "SELECT event_id, event_id % 3 <> 0 AS valid FROM events",
    "html_escape": f"SELECT page_id, md5({escaped('html')}) AS escaped_md5 FROM pages",
    "python_quote": f"""WITH c(doc_id, text) AS (VALUES (-1, 'it''s'), (-2, 'say "x"'), (-3, 'it''s "x"'), (-4, 'a' || chr(10) || 'b\\c')), a AS (SELECT doc_id, substring(text, 1, 60) AS s FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM c))
       SELECT doc_id, {quoted('s')} AS quoted FROM a""",
    "artifact_lookup": """WITH e AS (SELECT event_id AS job_id, event_type, ['pdf','html','report.json','meta.json'][event_id % 4 + 1] AS artifact FROM events),
       x AS (SELECT *, CASE WHEN artifact = 'meta.json' THEN 'unknown artifact' WHEN event_type = 'error' THEN 'not ready' END AS error FROM e)
       SELECT job_id, artifact, CASE WHEN error IS NULL THEN 'my file_' || job_id || '.' || artifact END AS filename,
              CASE WHEN error IS NULL THEN CASE artifact WHEN 'pdf' THEN 'application/pdf' WHEN 'html' THEN 'text/html' ELSE 'application/json' END END AS media_type, error FROM x""",
    "h1_demotion": f"WITH RECURSIVE {SEQ}, s2 AS (SELECT *, false AS synthetic FROM seq), {FOLDED.format(src='s2')} SELECT doc_id, ord, level, demoted FROM walk",
    "title_promotion": f"WITH {SEQ}, {WITH_TITLE} SELECT doc_id, ord, level, text FROM titled WHERE synthetic",
    "heading_skip_repair": f"WITH RECURSIVE {SEQ}, s2 AS (SELECT *, false AS synthetic FROM seq), {FOLDED.format(src='s2')} SELECT doc_id, ord, demoted, before AS level_before, final AS level_final FROM walk",
    "heading_repair_full": f"WITH RECURSIVE {SEQ}, {WITH_TITLE}, {FOLDED.format(src='titled')}, {FIXES} SELECT doc_id, CAST(fix_ord AS INTEGER) AS fix_ord, code, wcag_sc, CASE WHEN rank > 0 THEN 'heading: ' || {quoted('substring(text, 1, 60)')} END AS location FROM fixes",
    "flags_union": f"WITH {CODES} SELECT doc_id, scope, code, flag_no FROM flags",
    "report_items_ordered": f"""WITH RECURSIVE {SEQ}, {WITH_TITLE}, {FOLDED.format(src='titled')}, {FIXES}, {CODES},
       rows AS (SELECT doc_id, 0 AS k, flag_no AS n, code, 'needs-human-review' AS fallback FROM flags UNION ALL SELECT doc_id, 1, fix_ord, code, 'auto-fixed' FROM fixes),
       full_rows AS (SELECT r.*, coalesce(c.r_number, 'R2') AS r_number, coalesce(c.severity, fallback) AS severity FROM rows r LEFT JOIN codes c USING (code))
       SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'auto-fixed' THEN 0 WHEN 'needs-human-review' THEN 1 ELSE 2 END, r_number, code, k, n) - 1 AS item_ord, r_number, severity, code FROM full_rows""",
    "page_sample": "WITH pc AS (SELECT doc_id, CAST(n_chars % 300 AS INTEGER) AS page_count FROM documents), " + SAMPLE + " SELECT * FROM sample",
    "size_histogram": f"WITH {HIST} SELECT doc_id, size, chars FROM hist",
    "half_point_sizes": "SELECT DISTINCT CAST(l_extendedprice AS DOUBLE) / 8 AS raw, round_even(CAST(l_extendedprice AS DOUBLE) / 8 * 2, 0) / 2 AS size FROM lineitem",
    "body_size": f"WITH {HIST} SELECT doc_id, body_size FROM body",
    "heading_tiers": f"WITH {HIST} SELECT doc_id, size, level FROM tiers",
    "block_size": f"""WITH {HIST}, b3 AS (SELECT doc_id, page_no, line_no // 3 AS block_no, line_no, size, length({strip('text')}) AS n FROM lines),
       g AS (SELECT doc_id, page_no, block_no, size, sum(n) AS c, min(line_no) AS f FROM b3 WHERE n > 0 GROUP BY 1, 2, 3, 4), best AS (SELECT doc_id, page_no, block_no, arg_min(size, [-c, f]) AS size FROM g GROUP BY 1, 2, 3)
       SELECT DISTINCT b3.doc_id, b3.page_no, b3.block_no, coalesce(best.size, body_size) AS rep_size FROM b3 JOIN body USING (doc_id) LEFT JOIN best USING (doc_id, page_no, block_no)""",
    "heading_confidence": f"WITH {HIST} SELECT doc_id, page_no, block_no, level, round(c, 6) AS confidence, c < 0.5 AS low FROM heads",
    "confidence_range": f"WITH {HIST} SELECT doc_id, count(*) FILTER (WHERE c >= 0.5) AS sure, round(min(c) FILTER (WHERE c >= 0.5), 6) AS lo, round(max(c) FILTER (WHERE c >= 0.5), 6) AS hi FROM heads GROUP BY 1",
    "scanned_pages": f"""WITH {LINES}, ch AS (SELECT doc_id, page_no, length({strip("string_agg(text, '' ORDER BY line_no)")}) AS c FROM lines WHERE length(text) < 20 GROUP BY 1, 2),
       s10 AS (SELECT DISTINCT doc_id, CAST(round_even(i * ((page_count - 1) / 9.0), 0) AS INTEGER) AS page_no FROM pc, unnest(range(0, 10)) AS u(i) WHERE page_count > 50)
       SELECT p.doc_id, p.page_no FROM pages_l p LEFT JOIN ch USING (doc_id, page_no) LEFT JOIN s10 s USING (doc_id, page_no) WHERE coalesce(c, 0) < 25 AND p.page_no % 5 = 0 AND (page_count <= 50 OR s.page_no IS NOT NULL)""",
    "low_yield_pages": f"WITH {LINES}, ch AS (SELECT doc_id, page_no, CAST(sum(length({strip('text')})) AS BIGINT) AS chars FROM lines GROUP BY 1, 2) SELECT doc_id, p.page_no, coalesce(chars, 0) AS chars FROM pages_l p LEFT JOIN ch USING (doc_id, page_no) WHERE coalesce(chars, 0) < 10",
    "scan_image_exclusion": f"WITH {IMG} SELECT doc_id, page_no, xref, side = 700 AND page_no % 2 = 0 AS excluded FROM img WHERE side > 0",
    "x_clusters": f"WITH {ITEMS} SELECT doc_id, page_no, line_no AS item_no, cluster FROM clu",
    "two_column_test": f"WITH {ITEMS} SELECT doc_id, page_no, clusters, items, split, columns, uncertain FROM tested",
    "reading_order": f"""WITH {ITEMS} SELECT doc_id, page_no, line_no AS item_no, uncertain, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY CASE WHEN columns THEN cluster ELSE 0 END, y0, CASE WHEN columns THEN 0 ELSE x0 END, line_no) - 1 AS place
       FROM clu JOIN tested USING (doc_id, page_no)""",
    "list_groups": f"""WITH {LINES}, g AS (SELECT doc_id, page_no, line_no // 4 AS block_no, line_no, CASE WHEN line_no % 4 = doc_id % 3 THEN '1. ' || text ELSE text END AS text FROM lines),
       m AS (SELECT *, regexp_matches({strip('text')}, '{BULLET}') OR regexp_matches({strip('text')}, '{NUMBERED}') AS starts, regexp_matches({strip('text')}, '{NUMBERED}') AS num FROM g),
       w AS (SELECT *, bool_or(starts) OVER (PARTITION BY doc_id, page_no, block_no) AS some_item, CAST(sum(starts::INT) OVER (PARTITION BY doc_id, page_no, block_no ORDER BY line_no) AS BIGINT) AS item, first_value(num) OVER (PARTITION BY doc_id, page_no, block_no ORDER BY line_no) AS ordered FROM m)
       SELECT doc_id, page_no, block_no, line_no, starts, item, ordered FROM w WHERE some_item""",
    "list_merge": f"""WITH {LINES}, g AS (SELECT doc_id, page_no, line_no AS place, CASE WHEN line_no % 5 = 0 THEN 'list' WHEN line_no % 11 = 7 THEN 'table' ELSE 'paragraph' END AS kind, line_no % 2 = 0 AS ordered,
         CASE WHEN (line_no + doc_id) % 4 < 2 THEN '• ' || text ELSE text END AS text FROM lines),
       m AS (SELECT *, CASE WHEN kind = 'list' THEN 'L' WHEN kind = 'paragraph' AND (regexp_matches({strip('text')}, '{BULLET}') OR regexp_matches({strip('text')}, '{NUMBERED}')) THEN 'P' ELSE 'O' END AS c FROM g),
       n AS (SELECT *, CASE WHEN c = 'O' OR coalesce(lag(c) OVER w, '') <> c THEN 1 ELSE 0 END AS new FROM m WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY place)),
       i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id, page_no ORDER BY place ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM n),
       k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_no, island) AS cnt, first_value(CASE WHEN c = 'L' THEN ordered ELSE regexp_matches({strip('text')}, '{NUMBERED}') END) OVER (PARTITION BY doc_id, page_no, island ORDER BY place) AS f FROM i)
       SELECT doc_id, page_no, place, island, CASE WHEN c = 'L' OR (c = 'P' AND cnt > 1) THEN 'list' ELSE kind END AS merged_kind, CASE WHEN c = 'L' OR (c = 'P' AND cnt > 1) THEN f END AS merged_ordered FROM k""",
    "hyphen_join": f"WITH {WRAP} SELECT doc_id, line_no, coalesce(regexp_matches(lag(text) OVER w, '\\p{{L}}-$') AND regexp_matches(text, '^\\p{{Ll}}'), false) AS joins FROM wl WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)",
    "line_merge": f"""WITH {WRAP}, j AS (SELECT *, coalesce(regexp_matches(lag(text) OVER w, '\\p{{L}}-$') AND regexp_matches(text, '^\\p{{Ll}}') AND NOT linked AND NOT lag(linked) OVER w, false) AS joined FROM wl WINDOW w AS (PARTITION BY doc_id, block_no ORDER BY line_no)),
       p AS (SELECT *, coalesce(lead(joined) OVER w, false) AS goes_on, lead(line_no) OVER w IS NOT NULL AS follows FROM j WINDOW w AS (PARTITION BY doc_id, block_no ORDER BY line_no))
       SELECT doc_id, block_no, md5(string_agg(CASE WHEN goes_on THEN left(text, -1) WHEN follows THEN text || ' ' ELSE text END, '' ORDER BY line_no)) AS text_md5, CAST(sum(joined::INT) AS BIGINT) AS joins FROM p GROUP BY 1, 2""",
    "link_match": f"WITH {LINES} SELECT doc_id, page_no, line_no AS probe_no, line_no AS link_no, 'u' || doc_id || '/' || line_no AS uri FROM lines WHERE line_no % 7 = 3 AND length(text) > 0",
    "links_unassociated": f"""WITH {LINES} SELECT doc_id, page_no, line_no AS link_no, 'u' || doc_id || '/' || line_no AS uri FROM lines WHERE line_no % 7 = 3 AND length(text) = 0
       UNION ALL SELECT doc_id, page_no, 1000000, 'orphan' FROM pages_l WHERE page_no % 3 = 0""",
    "table_partition": f"WITH {TAB} SELECT o.doc_id, o.page_no, line_no AS block_no, CASE WHEN t.doc_id IS NOT NULL AND ratio >= 0.95 THEN 0 END AS table_no FROM ov o LEFT JOIN tabs t USING (doc_id, page_no)",
    "cells_reconcile": f"""WITH {TAB}, inn AS (SELECT o.doc_id, o.page_no, text FROM ov o JOIN tabs USING (doc_id, page_no) WHERE ratio >= 0.95),
       ce AS (SELECT doc_id, page_no, array_to_string(string_split(text, ' ')[1:3], '') AS text FROM lines JOIN tabs USING (doc_id, page_no) WHERE line_no % 20 BETWEEN 4 AND 7),
       cc AS (SELECT doc_id, page_no, ch, count(*) AS n FROM ce, unnest(string_split(regexp_replace(text, '{WS}+', '', 'g'), '')) AS u(ch) WHERE ch <> '' GROUP BY 1, 2, 3),
       ic AS (SELECT doc_id, page_no, ch, count(*) AS n FROM inn, unnest(string_split(regexp_replace(text, '{WS}+', '', 'g'), '')) AS u(ch) WHERE ch <> '' GROUP BY 1, 2, 3)
       SELECT cc.doc_id, cc.page_no, 0 AS table_no, cc.ch, cc.n - coalesce(ic.n, 0) AS surplus FROM cc LEFT JOIN ic USING (doc_id, page_no, ch) WHERE cc.n > coalesce(ic.n, 0)""",
    "table_flags": f"""WITH {TAB}, s AS (SELECT doc_id, page_no, min(least(len(string_split(text, ' ')), 3)) AS lo, max(least(len(string_split(text, ' ')), 3)) AS hi FROM lines JOIN tabs USING (doc_id, page_no) WHERE line_no % 20 BETWEEN 4 AND 7 GROUP BY 1, 2)
       SELECT doc_id, page_no, 0 AS table_no, code, 'page ' || (page_no + 1) AS location FROM s, (VALUES ('NO_HEADER_ROW_DETECTED'), ('COMPLEX_TABLE_STRUCTURE')) AS v(code) WHERE code = 'NO_HEADER_ROW_DETECTED' OR lo <> hi""",
    "image_page_counts": f"WITH {IMG} SELECT doc_id, xref, count(DISTINCT page_no) AS pages_with FROM img GROUP BY 1, 2",
    "image_decorative": f"""WITH {IMG}, n AS (SELECT doc_id, xref, count(DISTINCT page_no) AS c FROM img GROUP BY 1, 2), r AS (SELECT doc_id, page_no, xref, CASE WHEN side < 24 THEN 'tiny' WHEN page_count >= 4 AND c / page_count > 0.5 THEN 'repeated' END AS reason FROM img JOIN n USING (doc_id, xref) WHERE side > 0)
       SELECT doc_id, page_no, xref, CASE WHEN reason IS NOT NULL THEN true END AS decorative, reason, CASE WHEN reason IS NULL THEN 'MISSING_ALT' ELSE 'DECORATIVE_ASSUMED' END AS flag FROM r""",
    "image_src": f"""WITH {IMG} SELECT DISTINCT doc_id, xref, m AS mime_type, 'data:' || m || ';base64,' || to_base64(encode('i' || xref)) AS src FROM (SELECT *, CASE xref WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' ELSE 'image/svg' END AS m FROM img)""",
    "alt_choice": "SELECT alt, decorative, needs_review, CASE WHEN coalesce(decorative, false) THEN '' WHEN needs_review THEN '[ALT TEXT NEEDED: description of image]' ELSE coalesce(alt, '') END AS shown FROM (VALUES ('A dog'), (''), (NULL)) a(alt), (VALUES (true), (false), (NULL)) d(decorative), (VALUES (true), (false)) n(needs_review)",
    "overlap_ratios": f"WITH {TAB}, k AS (SELECT *, greatest(0, least(x1, 400) - greatest(x0, 60)) * greatest(0, least(y1, 275) - greatest(y0, 190)) AS sh, least((x1 - x0) * (y1 - y0), 28900.0) AS sm FROM ov) SELECT doc_id, line_no, CAST(floor(CAST(ratio AS DOUBLE) * 10000) AS BIGINT) AS ratio, sh > 0 AND sm > 0 AND sh >= 0.5 * sm AS half FROM k",
    "layout_intake": """WITH d AS (SELECT doc_id, 'f' || doc_id AS f, doc_id % 10 = 0 AS pass, n_chars % 7 AS n, doc_id % 4 = 1 AS scan FROM documents)
       SELECT doc_id, CASE WHEN pass OR n = 0 OR scan THEN 'rejected' ELSE 'ok' END AS status,
              CASE WHEN pass THEN 'Cannot open ''' || f || ''': it is password-protected.' WHEN n = 0 THEN '''' || f || ''' has no pages.' WHEN scan THEN 'Cannot process ''' || f || ''': it looks scanned, and the text recognition tools aren''t installed.' END AS error, scan AS needs_ocr FROM d""",
    "recognised_pages": "SELECT doc_id, CAST(p AS INTEGER) AS page_no FROM documents, unnest(range(0, CASE WHEN doc_id % 6 = 0 THEN n_chars % 7 + 2 ELSE 1 END)) AS u(p) WHERE doc_id % 2 = 0",
    "script_family": f"""WITH t AS (SELECT doc_id, text FROM documents UNION ALL {TEXTS}), f AS ({FAMILY}),
       b AS (SELECT doc_id, arg_max(family, [n, -first_at]) AS family, max(n) AS n FROM f WHERE n > 0 GROUP BY 1)
       SELECT t.doc_id, CASE WHEN b.n / len(regexp_extract_all(t.text, '\\p{{L}}')) >= 0.15 THEN b.family END AS family FROM t LEFT JOIN b USING (doc_id)""",
    "language_decision": f"""WITH d AS (SELECT doc_id, length({strip('text')}) AS n, lang, CASE WHEN doc_id % 7 = 0 THEN 'la' WHEN doc_id % 7 = 1 THEN 'ru' ELSE lang END AS code, (doc_id % 10) / 10 AS c FROM documents)
       SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN lang || '-XX' WHEN n >= 40 AND c >= 0.7 AND code <> 'la' THEN code ELSE 'en' END AS lang,
              CASE WHEN doc_id % 4 = 0 THEN NULL WHEN n >= 40 AND c >= 0.7 AND code <> 'la' THEN 'LANG_DETECTED' ELSE 'LANG_ASSUMED' END AS flag FROM d""",
    "language_grams": f"{GRAMS} SELECT lang, gram, sum(n) AS n FROM g GROUP BY 1, 2",
    "language_id_accuracy": f"""{GRAMS},
       c AS (SELECT lang AS code, gram, sum(n) AS n FROM g GROUP BY 1, 2), v AS (SELECT count(DISTINCT gram) AS v FROM c), t AS (SELECT code, sum(n) AS total FROM c GROUP BY 1),
       s AS (SELECT g.doc_id, any_value(g.lang) AS lang, t.code, sum(g.n * ln((coalesce(c.n, 0) + 1) / (t.total + v.v))) AS score FROM g, v, t LEFT JOIN c ON c.code = t.code AND c.gram = g.gram GROUP BY g.doc_id, t.code)
       SELECT doc_id, d.lang, code FROM documents d LEFT JOIN (SELECT doc_id, arg_max(code, score) AS code FROM s GROUP BY 1) USING (doc_id)""",
    "render_runs": f"""SELECT item_id, '<em><strong>' || replace({escaped('text')}, chr(10), '<br>') || '</strong></em><strong>a&lt;b&gt;&amp;<br>' || replace({escaped("string_split(text, ' ')[1]")}, chr(10), '<br>') || '</strong><a href="x?a=1&amp;b=&quot;2&quot;">' || {escaped("string_split(text, ' ')[1]")} || '</a>' AS html FROM benchmark""",
    "render_table_rows": """WITH w AS (SELECT item_id, list_transform(string_split(text, ' '), lambda x: replace(x, chr(10), '<br>')) AS w FROM benchmark)
       SELECT item_id, '<table><caption>A &amp; B</caption><thead><tr><th scope="col">' || w[1] || '</th><th scope="col" colspan="2">' || w[2] || '</th></tr></thead><tbody><tr>' ||
         CASE WHEN item_id % 2 = 0 THEN '<th scope="row">' || w[3] || '</th>' ELSE '<td>' || w[3] || '</td>' END || '<td colspan="2">' || w[4] || '</td></tr></tbody></table>' AS html FROM w""",
    "render_report_rows": f"""WITH {CODES}, r AS (SELECT f.*, coalesce(r_number, 'R2') AS rn, coalesce(severity, 'needs-human-review') AS sev FROM flags f LEFT JOIN codes USING (code)),
       o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE sev WHEN 'auto-fixed' THEN 0 WHEN 'needs-human-review' THEN 1 ELSE 2 END, rn, code, flag_no) - 1 AS item_ord FROM r)
       SELECT doc_id, item_ord, '<tr class="severity-' || sev || '"><td>' || rn || '</td><td>1.1.1</td><td class="severity">' || CASE sev WHEN 'auto-fixed' THEN 'Auto-fixed' WHEN 'info' THEN 'Informational' ELSE 'Needs human review' END || '</td><td><code>' || code || '</code></td><td>' || role || '</td><td></td></tr>' AS html FROM o""",
    "html_shell": f"""SELECT conv_id AS doc_id, md5('<!DOCTYPE html>' || chr(10) || '<html lang="fr">' || chr(10) || '<head>' || chr(10) || '<meta charset="utf-8">' || chr(10) || '<meta name="viewport" content="width=device-width, initial-scale=1">' || chr(10) || '<title>conversation ' || conv_id || '</title>' || chr(10) || '<style></style>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || string_agg('<p>' || {escaped('text')} || '</p>', chr(10) ORDER BY turn) || chr(10) || '</body>' || chr(10) || '</html>' || chr(10)) AS html_md5 FROM conversations GROUP BY 1""",
    "docx_blocks": f"""WITH {LINES}, k AS (SELECT doc_id, line_no, text, line_no > 0 AND line_no % 7 = 6 AS item FROM lines)
       SELECT d.doc_id, 'ok' AS status, CAST(NULL AS VARCHAR) AS meta_title, any_value(lang) AS meta_lang, count(*) FILTER (WHERE line_no = 0 AND k.text <> '') AS headings,
              count(*) FILTER (WHERE line_no > 0 AND NOT item AND k.text <> '') AS paragraphs, count(*) FILTER (WHERE item) AS lists, count(*) FILTER (WHERE item) AS items FROM documents d JOIN k USING (doc_id) GROUP BY 1""",
    "job_latest_state": "SELECT user_id AS job_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS stage FROM events GROUP BY 1",
    "stage_changes": "SELECT * FROM (SELECT user_id AS job_id, event_id, event_type AS stage, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS NULL OR was <> stage",
    "progress_rescale": "SELECT event_id, round(0.35 * CAST(json_extract(props, '$.k') AS BIGINT) / 100, 6) AS share FROM events",
}
