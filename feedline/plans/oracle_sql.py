"""DuckDB twins of the registered queries (the correctness gate).

Each text runs on the driver tables registered as views.  The derived views
of ``sources/fixtures.py`` are restated as CTEs.  Oracle rules:
``||`` instead of ``concat`` (DuckDB's concat skips nulls), explicit
boundary classes instead of ``\\b`` (RE2's is ASCII), literals cast to DOUBLE
where Spark computes in double, BIGINT casts on sums.
"""

from __future__ import annotations

POSTINGS_CTE = r"""
postings AS (
  SELECT d.doc_id AS seq,
         (d.doc_id // 15) % 2 AS run_no,
         CASE WHEN d.doc_id % 10 = 9 THEN upper(t.title0) ELSE t.title0 END AS title,
         coalesce(c.c_name, 'Company ' || CAST(d.k AS VARCHAR)) AS company,
         CASE WHEN d.doc_id % 5 <> 0 THEN 'Remote' ELSE 'On-site' END AS location,
         CASE WHEN d.doc_id % 17 = 16 THEN 'ftp' ELSE 'https' END || '://x.example/' || CAST(d.k AS VARCHAR) AS url,
         CASE d.doc_id % 4 WHEN 0 THEN 'remoteok' WHEN 1 THEN 'himalayas' WHEN 2 THEN 'hackernews'
              ELSE 'retired_board' END AS source,
         d.doc_id % 5 <> 0 AS is_remote,
         d.lang,
         d.text || CASE d.doc_id % 11 WHEN 0 THEN ' 3-5 years' WHEN 1 THEN ' 7+ years' WHEN 2 THEN ' 2 años'
              WHEN 3 THEN ' entry level' WHEN 4 THEN ' 2—4 yrs' WHEN 5 THEN ' security clearance'
              ELSE '' END AS description,
         CASE WHEN d.doc_id % 6 = 0 THEN NULL ELSE e.ts END AS posted_at,
         CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE o.o_totalprice / 12 END AS min_salary_usd_monthly
  FROM (SELECT doc_id, text, lang,
               CASE WHEN doc_id % 10 = 9 THEN doc_id - 9 ELSE doc_id END AS k FROM documents) d
  LEFT JOIN (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'Senior ' WHEN 1 THEN 'Junior '
                    WHEN 2 THEN 'Sr. ' WHEN 3 THEN 'Líder ' ELSE '' END || p_name AS title0
             FROM part) t ON t.p_partkey = d.k
  LEFT JOIN customer c ON c.c_custkey = d.k
  LEFT JOIN events e ON e.event_id = d.doc_id * 5
  LEFT JOIN orders o ON o.o_orderkey = d.doc_id
),
fp_postings AS (
  SELECT *, sha256(lower(title || company || url)) AS fingerprint FROM postings
)"""

# Fixed-parameter predicate texts used by several oracles (fixture parameters).
SEARCHABLE = "lower(title || ' ' || description)"
F1_SQL = f"(is_remote AND (contains({SEARCHABLE}, 'widget') OR contains({SEARCHABLE}, 'schkeit')))"
F3_SQL = "(posted_at IS NULL OR posted_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAY)"
VALID_SQL = ("(title IS NOT NULL AND company IS NOT NULL AND (starts_with(url, 'https://') "
             "OR starts_with(url, 'http://')) AND source IN ('linkedin','indeed','glassdoor','remoteok',"
             "'remotive','weworkremotely','cybersecjobs','computrabajo','bumeran','himalayas','hackernews',"
             "'occ','getonboard'))")

POSTING_COLS = ("seq, title, company, location, url, source, is_remote, description, posted_at, "
                "min_salary_usd_monthly, fingerprint")


def with_postings(body: str) -> str:
    return "WITH " + POSTINGS_CTE + ",\n" + body


def dedup_sql(src: str) -> str:
    """A1 in SQL: last values (arg_max by seq) at the first position (min seq)."""
    return f"""SELECT fingerprint, min(seq) AS seq,
  arg_max(title, seq) AS title, arg_max(company, seq) AS company, arg_max(location, seq) AS location,
  arg_max(url, seq) AS url, arg_max(source, seq) AS source, arg_max(is_remote, seq) AS is_remote,
  arg_max(description, seq) AS description, arg_max(posted_at, seq) AS posted_at,
  arg_max(min_salary_usd_monthly, seq) AS min_salary_usd_monthly
FROM {src} GROUP BY fingerprint"""


ORACLE: dict[str, str] = {}

ORACLE["new_postings"] = with_postings(f"""
batch AS (SELECT * FROM fp_postings WHERE run_no = 1 AND {VALID_SQL} AND {F1_SQL} AND {F3_SQL}),
hist AS (SELECT fingerprint FROM fp_postings WHERE run_no = 0 AND {VALID_SQL} AND {F1_SQL} AND {F3_SQL}),
dedup AS ({dedup_sql('batch')})
SELECT {POSTING_COLS} FROM dedup WHERE fingerprint NOT IN (SELECT fingerprint FROM hist)
""")

GEO_CTE = r"""
geo AS (
  SELECT s_suppkey AS element_id,
         CASE WHEN s_suppkey % 2 = 0 THEN 'node' ELSE 'way' END AS type,
         'Lead ' || CAST(site AS VARCHAR) AS name,
         CASE WHEN s_suppkey % 13 = 12 THEN NULL
              ELSE 'https://lead' || CAST(site AS VARCHAR) || '.example' || CASE WHEN site % 8 = 5 THEN '/es' ELSE '' END END AS website,
         CAST(19.1 AS DOUBLE) + CAST(s_suppkey % 40 AS DOUBLE) * CAST(0.05 AS DOUBLE) AS latitude,
         CAST(-101.8 AS DOUBLE) + CAST(s_suppkey % 25 AS DOUBLE) * CAST(0.08 AS DOUBLE) AS longitude
  FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 9 THEN s_suppkey - 9 ELSE s_suppkey END AS site FROM supplier)
)"""

FEED_SEQ = "(seq // 50) * 1048576 + seq % 50"
FP = "sha256(lower(title || company || url)) AS fingerprint"

ORACLE["src_json_array"] = with_postings(f"""
s1 AS (
  SELECT (seq // 50) * 1048576 + seq % 50 + 2 AS seq, title,
         CASE WHEN seq % 13 = 5 THEN '' ELSE company END AS company, 'Remote' AS location,
         'https://remoteok.com/remote-jobs/job-' || CAST(seq AS VARCHAR) AS url, 'remoteok' AS source,
         true AS is_remote, CASE WHEN seq % 13 = 9 THEN '' ELSE description END AS description,
         CASE WHEN seq % 13 = 8 THEN NULL ELSE date_trunc('second', posted_at) END AS posted_at,
         CASE WHEN seq % 13 = 7 THEN NULL WHEN min_salary_usd_monthly * 12 > 0
              THEN (min_salary_usd_monthly * 12) / 12 END AS min_salary_usd_monthly
  FROM postings WHERE seq % 13 <> 6
)
SELECT *, {FP} FROM s1""")

ORACLE["src_json_envelope"] = with_postings(f"""
s2 AS (
  SELECT {FEED_SEQ} AS seq, title, company,
         CASE WHEN seq % 13 = 5 THEN 'Remote' ELSE location END AS location, url,
         'remotive' AS source, true AS is_remote, description,
         CAST(NULL AS TIMESTAMP) AS posted_at, CAST(NULL AS DOUBLE) AS min_salary_usd_monthly
  FROM postings
  WHERE (seq // 50) % 5 <> 4 AND seq % 13 NOT IN (6, 7)
    AND (starts_with(url, 'https://') OR starts_with(url, 'http://'))
)
SELECT *, {FP} FROM s2""")

ORACLE["src_json_salaried"] = with_postings(f"""
s3 AS (
  SELECT {FEED_SEQ} AS seq, title, company,
         CASE WHEN seq % 3 = 1 THEN location ELSE 'Remote' END AS location,
         CASE WHEN seq % 13 = 5 THEN 'https://himalayas.app/jobs/g' || CAST(seq AS VARCHAR) ELSE url END AS url,
         'himalayas' AS source, true AS is_remote, description,
         CASE WHEN seq % 4 = 3 THEN NULL ELSE date_trunc('second', posted_at) END AS posted_at,
         CASE WHEN seq % 5 = 0 OR min_salary_usd_monthly IS NULL THEN NULL
              WHEN seq % 13 = 7 AND seq % 4 IN (0, 1) THEN 0.0
              WHEN seq % 13 = 7 THEN NULL
              WHEN seq % 4 = 0 THEN (min_salary_usd_monthly * 12) / 12
              WHEN seq % 4 = 1 THEN min_salary_usd_monthly END AS min_salary_usd_monthly
  FROM postings WHERE seq % 13 <> 6
)
SELECT *, {FP} FROM s3 WHERE starts_with(url, 'https://') OR starts_with(url, 'http://')""")

ORACLE["src_thread_comments"] = with_postings(f"""
s4 AS (
  SELECT seq, pos, title, company,
         company || ' | ' || title || ' | ' || CASE WHEN is_remote THEN 'REMOTE' ELSE 'Onsite' END
           || description AS plain, posted_at
  FROM (SELECT *, row_number() OVER (PARTITION BY seq // 50 ORDER BY seq) - 1 AS pos FROM postings WHERE run_no = 1)
  WHERE seq % 13 NOT IN (6, 7)
)
SELECT (seq // 50) * 1048576 + pos AS seq, title, company,
       CASE WHEN contains(upper(plain), 'REMOTE') THEN 'Remote' ELSE 'On-site' END AS location,
       'https://news.ycombinator.com/item?id=' || CAST(seq AS VARCHAR) AS url, 'hackernews' AS source,
       contains(upper(plain), 'REMOTE') AS is_remote, plain AS description,
       date_trunc('second', posted_at) AS posted_at, CAST(NULL AS DOUBLE) AS min_salary_usd_monthly
FROM s4""")

ORACLE["src_geo_elements"] = f"""WITH {GEO_CTE}
SELECT (element_id // 50) * 1048576 + element_id % 50 AS seq, type, name, website, latitude, longitude
FROM geo WHERE website IS NOT NULL"""

# ---------------------------------------------------------------- P* / F* oracles

WB = r"[^\p{L}\p{N}_]"
ENTRY_SQL = (r"(^|" + WB + r")(entry[\s-]?level|junior|no experience required|recent graduate"
             r"|recién egresado|sin experiencia)(" + WB + r"|$)")
RANGE_SQL = r"(\d+)\s*[-‒–—−]\s*(\d+)\s*(years?|yrs?|años?)"
YEARS_SQL = r"(\d+)\+?\s*(years?|yrs?|años?)"
SENIOR_SQL = (r"(^|" + WB + r")(senior|sr\.?|staff|principal|lead|l[ií]der|arquitect[oa]|architect"
              r"|director|head\s+of|chief|vp)(" + WB + r"|$)")


def _num(t, pat):
    x = f"regexp_extract({t}, '{pat}', 1)"
    return f"CASE WHEN {x} <> '' THEN coalesce(TRY_CAST({x} AS BIGINT), 9223372036854775807) END"


def min_years_sql(t):
    lt = f"lower({t})"
    return (f"(CASE WHEN regexp_matches({lt}, '{ENTRY_SQL}') THEN CAST(0 AS BIGINT) "
            f"ELSE coalesce({_num(lt, RANGE_SQL)}, {_num(lt, YEARS_SQL)}) END)")


SENIOR_TITLE = f"regexp_matches(lower(title), '{SENIOR_SQL}')"
REQ_YEARS = (f"coalesce({min_years_sql(chr(40) + 'title || ' + chr(39) + ' ' + chr(39) + ' || description' + chr(41))}, "
             f"CASE WHEN {SENIOR_TITLE} THEN CAST(5 AS BIGINT) END)")
F2_SQL = f"({REQ_YEARS} IS NULL OR {REQ_YEARS} <= 3)"
BLACKLIST_TERMS = ("security clearance,active clearance,top secret,ts/sci,dod clearance,"
                   "secret clearance,public trust,us citizens only,"
                   "must be authorized to work in the us,us work authorization,"
                   "must be a us citizen,green card required,"
                   "sales executive,account executive,must relocate,relocation required,"
                   "staffing agency,recruiting firm").split(",")
F4_SQL = "(NOT (" + " OR ".join(f"contains({SEARCHABLE}, '{t}')" for t in BLACKLIST_TERMS) + "))"
F6_SQL = "(min_salary_usd_monthly IS NULL OR min_salary_usd_monthly >= 20000.0)"
SLUG_SQL = ("regexp_replace(regexp_replace(trim(lower({x})), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), "
            "'\\s+', '-', 'g')")


def slug_sql(x):
    return SLUG_SQL.format(x=x)


def title_case_sql(x):
    s = f"lower({x})"
    return (f"array_to_string(list_transform(range(1, length({s}) + 1), lambda i: CASE WHEN i = 1 OR NOT "
            f"regexp_matches(substring({s}, i - 1, 1), '^\\p{{L}}$') THEN upper(substring({s}, i, 1)) "
            f"ELSE substring({s}, i, 1) END), '')")


ORACLE["fingerprint"] = with_postings("x AS (SELECT 1)\nSELECT seq, sha256(lower(title || company || url)) AS fingerprint FROM postings")
ORACLE["lead_fingerprint"] = f"""WITH {GEO_CTE}
SELECT element_id, sha256(lower(name || website)) AS fingerprint FROM geo WHERE website IS NOT NULL"""
ORACLE["searchable_text"] = with_postings(f"""x AS (SELECT 1)
SELECT seq, {SEARCHABLE} AS searchable,
       substring(regexp_replace(title || ' ' || description, '^\\s+|\\s+$', '', 'g'), 1, 500) AS lang_window
FROM postings""")
ORACLE["title_company_lines"] = with_postings("""x AS (SELECT 1)
SELECT seq, title, CASE WHEN seq % 3 = 2 THEN '' ELSE company END AS company FROM postings""")
ORACLE["title_company_pipes"] = with_postings("""x AS (SELECT 1)
SELECT seq, title, CASE WHEN seq % 3 = 2 THEN '' ELSE company END AS company FROM postings""")
ORACLE["title_company_at"] = with_postings("""x AS (SELECT 1)
SELECT seq, CASE WHEN seq % 4 = 3 THEN title || ' at ' || company ELSE title END AS title,
       CASE seq % 4 WHEN 2 THEN '' WHEN 3 THEN 'HQ' ELSE company END AS company FROM postings""")
ORACLE["epoch_to_ts"] = """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL
  ELSE date_trunc('second', ts) END AS ts FROM events"""
ORACLE["rfc2822_to_ts"] = """SELECT event_id, CASE event_id % 5
  WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts)
  WHEN 2 THEN date_trunc('second', ts) + INTERVAL 5 HOUR
  WHEN 3 THEN date_trunc('minute', ts) - INTERVAL 1 HOUR END AS ts FROM events"""
ORACLE["date_to_ts"] = """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL
  ELSE date_trunc('day', ts) END AS ts FROM events"""
ORACLE["salary_by_period"] = """SELECT o_orderkey,
  CASE WHEN o_orderkey % 3 = 2 THEN NULL
       WHEN o_orderkey % 4 = 0 THEN (CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE o_totalprice END) / 12
       WHEN o_orderkey % 4 = 1 THEN (CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE o_totalprice END) END AS monthly,
  CASE WHEN o_orderkey % 7 <> 0 AND o_totalprice - 100000.0 > 0 THEN (o_totalprice - 100000.0) / 12 END
    AS annual_monthly
FROM orders"""
ORACLE["slugify"] = with_postings(f"""x AS (SELECT 1)
SELECT seq, {slug_sql("'  ' || title || ' & Co. '")} AS slug FROM postings""")
ORACLE["absolutise_url"] = with_postings("""h AS (SELECT seq, CASE seq % 3 WHEN 0 THEN '/empleos/' || CAST(seq AS VARCHAR)
    WHEN 1 THEN url ELSE 'oferta-' || CAST(seq AS VARCHAR) END AS href FROM postings)
SELECT seq, CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://board-a.example' || href END AS url_a,
       CASE WHEN starts_with(href, '/') THEN 'https://board-b.example' || href ELSE href END AS url_b FROM h""")
ORACLE["search_url"] = f"""WITH s AS (SELECT term, {slug_sql('term')} AS slug
  FROM (SELECT DISTINCT p_name AS term FROM part))
SELECT term, true AS is_remote,
  'https://www.bumeran.com.mx/empleos-busqueda-' || slug || '.html' AS bumeran,
  'https://mx.computrabajo.com/trabajo-de-' || slug AS computrabajo,
  'https://www.occ.com.mx/empleos/de-' || slug || '/tipo-home-office-remoto/' AS occ FROM s
UNION ALL
SELECT term, false AS is_remote,
  'https://www.bumeran.com.mx/empleos-busqueda-' || slug || '-en-celaya.html' AS bumeran,
  'https://mx.computrabajo.com/trabajo-de-' || slug || '/en-celaya' AS computrabajo,
  'https://www.occ.com.mx/empleos/de-' || slug || '/en-guanajuato/en-celaya/' AS occ FROM s"""
ORACLE["title_case_place"] = f"""WITH x AS (
  SELECT n_nationkey, lower(n_name || ' d''or-' || CAST(n_nationkey AS VARCHAR) || 'x') AS city,
         CASE WHEN n_nationkey % 4 = 0 THEN '  ' ELSE lower(r_name) END AS state
  FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_nationkey, CASE WHEN trim(state) = '' THEN {title_case_sql('trim(city)')}
  ELSE {title_case_sql('trim(city)')} || ', ' || {title_case_sql('trim(state)')} END AS place FROM x"""
ORACLE["remote_flag_text"] = with_postings("""x AS (SELECT 1)
SELECT seq, CASE WHEN seq % 4 IN (0, 1) THEN true ELSE contains(upper(description), 'REMOTE') END AS is_remote
FROM postings""")
ORACLE["mailto_address"] = """SELECT c_custkey, CASE c_custkey % 5 WHEN 2 THEN NULL WHEN 3 THEN NULL
  ELSE lower(replace(c_name, '#', '')) || '@x.example' END AS email FROM customer"""
ORACLE["required_years"] = with_postings(f"""x AS (SELECT 1)
SELECT seq, {min_years_sql("(title || ' ' || description)")} AS min_years, {SENIOR_TITLE} AS title_is_senior,
       {REQ_YEARS} AS required_years FROM postings""")
ORACLE["keyword_filter"] = with_postings(f"x AS (SELECT 1)\nSELECT seq FROM postings WHERE {F1_SQL}")
ORACLE["experience_filter"] = with_postings(f"x AS (SELECT 1)\nSELECT seq FROM postings WHERE {F2_SQL}")
ORACLE["recency_filter"] = with_postings(f"x AS (SELECT 1)\nSELECT seq FROM postings WHERE {F3_SQL}")
ORACLE["blacklist_filter"] = with_postings(f"x AS (SELECT 1)\nSELECT seq FROM postings WHERE {F4_SQL}")
ORACLE["salary_filter"] = with_postings(f"x AS (SELECT 1)\nSELECT seq FROM postings WHERE {F6_SQL}")
ORACLE["valid_url"] = with_postings("""x AS (SELECT 1)
SELECT seq, (starts_with(url, 'https://') OR starts_with(url, 'http://')) AS valid_url,
  source IN ('linkedin','indeed','glassdoor','remoteok','remotive','weworkremotely','cybersecjobs',
             'computrabajo','bumeran','himalayas','hackernews','occ','getonboard') AS known_source,
  (length(title) > 0 AND length(url) > 0) AS required_fields FROM postings""")
ORACLE["filter_funnel"] = with_postings(f"""x AS (SELECT 1)
SELECT count(*) AS n_total, count_if({F1_SQL}) AS n_relevant,
  count_if({F1_SQL} AND {F2_SQL}) AS n_experience,
  count_if({F1_SQL} AND {F2_SQL} AND {F3_SQL}) AS n_recent,
  count_if({F1_SQL} AND {F2_SQL} AND {F3_SQL} AND {F4_SQL}) AS n_not_blacklisted,
  count_if({F1_SQL} AND {F2_SQL} AND {F3_SQL} AND {F4_SQL} AND {F6_SQL}) AS n_salary
FROM postings WHERE {VALID_SQL}""")
ORACLE["quarantine"] = with_postings("""x AS (SELECT 1)
SELECT seq, CASE WHEN NOT (starts_with(url, 'https://') OR starts_with(url, 'http://')) THEN 'bad_url'
  ELSE 'unknown_source' END AS reason FROM postings
WHERE NOT (starts_with(url, 'https://') OR starts_with(url, 'http://'))
   OR source NOT IN ('linkedin','indeed','glassdoor','remoteok','remotive','weworkremotely','cybersecjobs',
             'computrabajo','bumeran','himalayas','hackernews','occ','getonboard')""")

# ---------------------------------------------------------------- dedup / state / digest oracles

SCENARIO = f"""
f AS (SELECT * REPLACE ((seq // 30) * 15 + seq % 15 AS seq) FROM fp_postings WHERE {VALID_SQL} AND {F1_SQL} AND {F3_SQL}),
b0 AS ({dedup_sql("(SELECT * FROM f WHERE run_no = 0)")}),
b1 AS ({dedup_sql("(SELECT * FROM f WHERE run_no = 1)")}),
saved0 AS (SELECT *, CAST(0 AS BIGINT) AS run_id FROM b0),
marks0 AS (SELECT fingerprint, CAST(0 AS BIGINT) AS run_id, 'new' AS kind FROM saved0 ORDER BY seq LIMIT 10),
pend1 AS (SELECT * FROM saved0 WHERE fingerprint NOT IN (SELECT fingerprint FROM marks0)),
marks1r AS (SELECT fingerprint, CAST(1 AS BIGINT) AS run_id, 'retry' AS kind FROM pend1 ORDER BY seq LIMIT 10),
new1 AS (SELECT * FROM b1 WHERE fingerprint NOT IN (SELECT fingerprint FROM saved0)),
saved1 AS (SELECT *, CAST(1 AS BIGINT) AS run_id FROM new1),
marks1n AS (SELECT fingerprint, CAST(1 AS BIGINT) AS run_id, 'new' AS kind FROM new1 ORDER BY seq LIMIT 10),
tbl AS (SELECT * FROM saved0 UNION ALL SELECT * FROM saved1),
notes1 AS (SELECT * FROM marks0 UNION ALL SELECT * FROM marks1r UNION ALL SELECT * FROM marks1n),
pend2 AS (SELECT * FROM tbl WHERE fingerprint NOT IN (SELECT fingerprint FROM notes1)),
marks2r AS (SELECT fingerprint, CAST(2 AS BIGINT) AS run_id, 'retry' AS kind FROM pend2 ORDER BY pend2.run_id, seq, fingerprint LIMIT 10),
notes AS (SELECT * FROM notes1 UNION ALL SELECT * FROM marks2r),
pend AS (SELECT * FROM tbl WHERE fingerprint NOT IN (SELECT fingerprint FROM notes) AND {VALID_SQL})"""

POSTING_LINE_SQL = ("'• *' || title || '* @ ' || company || chr(10) || '  [' || source || '] ' || url || chr(10)")

ORACLE["dedup_batch_last"] = with_postings(f"""d AS ({dedup_sql(f"(SELECT * FROM fp_postings WHERE {VALID_SQL})")})
SELECT {POSTING_COLS} FROM d""")
ORACLE["seen_semi"] = with_postings(f"""v AS (SELECT * FROM fp_postings WHERE {VALID_SQL})
SELECT DISTINCT fingerprint FROM v WHERE run_no = 0
  AND fingerprint IN (SELECT fingerprint FROM v WHERE run_no = 1)""")
ORACLE["insert_ignore"] = with_postings(SCENARIO + "\nSELECT fingerprint, seq, run_id, title, source FROM tbl")
ORACLE["inserted_count"] = with_postings(SCENARIO + "\nSELECT run_id, count(*) AS inserted FROM tbl GROUP BY run_id")
ORACLE["mark_notified"] = with_postings(SCENARIO + "\nSELECT * FROM notes")
ORACLE["retry_pending"] = with_postings(SCENARIO + """
SELECT n.run_id, t.run_id AS saved_run, t.seq, t.fingerprint FROM notes n JOIN tbl t USING (fingerprint) WHERE n.kind = 'retry'""")
ORACLE["scan_unnotified"] = with_postings(SCENARIO + """
SELECT fingerprint, title, company, location, url, source, is_remote, description FROM pend""")
ORACLE["pending_count"] = with_postings(SCENARIO + "\nSELECT count(*) AS pending FROM pend")
# the first run's delivery broke it off: its rows are saved, none is announced
AFTER_BREAK = SCENARIO.replace("FROM saved0 ORDER BY seq LIMIT 10", "FROM saved0 ORDER BY seq LIMIT 0")
ORACLE["retry_after_break"] = with_postings(AFTER_BREAK + """
SELECT n.run_id, n.kind, t.run_id AS saved_run, t.seq, t.fingerprint FROM notes n JOIN tbl t USING (fingerprint)""")
ORACLE["pending_after_break"] = with_postings(AFTER_BREAK + "\nSELECT fingerprint, run_id, title, url, source FROM pend")
ORACLE["digest_slice"] = with_postings(SCENARIO + "\nSELECT seq, fingerprint, title FROM new1 ORDER BY seq LIMIT 10")
ORACLE["digest_line"] = with_postings(SCENARIO + f"\nSELECT seq, {POSTING_LINE_SQL} AS line FROM new1")
ORACLE["digest_text"] = with_postings(SCENARIO + f""",
top AS (SELECT * FROM new1 ORDER BY seq LIMIT 10),
agg AS (SELECT count(*) AS n_items, (SELECT count(*) FROM new1) AS n_total,
               string_agg({POSTING_LINE_SQL}, chr(10) ORDER BY seq) AS body FROM top)
SELECT n_items, n_total, greatest(n_total - 10, 0) AS overflow,
       '*Nuevas ofertas:*' || chr(10) || chr(10) || body ||
       CASE WHEN n_total > 10 THEN chr(10) || '_...y ' || CAST(n_total - 10 AS VARCHAR) || ' más guardadas en DB_'
            ELSE '' END AS text
FROM agg WHERE n_items > 0""")
ORACLE["overflow_count"] = with_postings(SCENARIO + """
SELECT count(*) AS n_total, greatest(count(*) - 10, 0) AS overflow FROM new1""")
ORACLE["counts_by_source"] = with_postings("x AS (SELECT 1)\nSELECT source, count(*) AS n FROM postings GROUP BY source")
ORACLE["unknown_sources"] = with_postings("""x AS (SELECT 1)
SELECT DISTINCT source FROM postings WHERE source NOT IN ('linkedin','indeed','glassdoor','remoteok','remotive',
  'weworkremotely','cybersecjobs','computrabajo','bumeran','himalayas','hackernews','occ','getonboard')""")

# ---------------------------------------------------------------- leads oracles

CRAWL_CTE = r"""
crawl AS (
  SELECT page_id, host || base AS website, host, base, site, (page_id // 90) % 6 AS path_ord,
         ['', '/contacto', '/trabaja-con-nosotros', '/bolsa-de-trabajo', '/careers', '/rh'][(page_id // 90) % 6 + 1] AS path,
         CASE WHEN page_id % 19 = 18 THEN 404 ELSE 200 END AS status,
         html || CASE page_id % 4
           WHEN 0 THEN '<p>Contacto: <a href="mailto:info' || CAST(page_id AS VARCHAR) || '@lead.example">Escríbenos</a></p>'
           WHEN 1 THEN '<p>Ventas: <a href="mailto:ventas' || CAST(page_id AS VARCHAR)
                       || '@lead.example?subject=Hola">ventas</a></p><p>Recursos Humanos: <a href="mailto:rh'
                       || CAST(page_id AS VARCHAR) || '@lead.example">escribir</a></p>'
           ELSE '' END AS html
  FROM (SELECT *, 'https://lead' || CAST(site AS VARCHAR) || '.example' AS host, CASE WHEN site % 8 = 5 THEN '/es' ELSE '' END AS base
        FROM (SELECT page_id, html, (page_id // 540) * 90 + page_id % 90 AS site FROM pages))
),
rsites AS (SELECT DISTINCT host AS website, base || '/contacto' AS prefix FROM crawl WHERE site % 7 = 3),
allowed AS (
  SELECT * FROM crawl WHERE status < 400 AND NOT (site % 7 = 3 AND starts_with(base || path, base || '/contacto'))
)"""

HAVERSINE = ("(CAST(12742.0 AS DOUBLE) * asin(sqrt(pow(sin((radians(latitude) - radians(CAST(20.1 AS DOUBLE))) / 2), 2)"
             " + cos(radians(CAST(20.1 AS DOUBLE))) * cos(radians(latitude))"
             " * pow(sin((radians(longitude) - radians(CAST(-100.8 AS DOUBLE))) / 2), 2))))")

FOUND_CTE = f"""
found AS (
  SELECT (element_id // 50) * 1048576 + element_id % 50 AS seq, type, name, website, latitude, longitude,
         {HAVERSINE} AS distance_km, sha256(lower(name || website)) AS fingerprint
  FROM geo WHERE website IS NOT NULL AND {HAVERSINE} <= 80.0
)"""

HR_SQL = " OR ".join(f"contains(context, '{p}')" for p in (
    "recursos humanos", "trabaja con nosotros", "bolsa de trabajo", "vacantes", "careers", "hr", "reclutamiento"))

CAND_CTE = f"""
frags AS (
  SELECT page_id, regexp_extract_all(html, '<p>[^<]*<a href="mailto:[^"]*">[^<]*</a>[^<]*</p>') AS fs
  FROM SRC
),
cand0 AS (SELECT page_id, unnest(range(len(fs))) AS pos, unnest(fs) AS frag FROM frags),
cand AS (
  SELECT page_id, pos, trim(split_part(regexp_extract(frag, 'mailto:([^"]*)"', 1), '?', 1)) AS email,
         lower(trim(regexp_extract(frag, '">([^<]*)</a>', 1)) || ' ' || trim(regexp_extract(frag, '<p>([^<]*)<a', 1)))
           AS context
  FROM cand0
),
hcand AS (SELECT *, ({HR_SQL}) AS is_hr FROM cand)"""

LEADS_BASE = "WITH " + GEO_CTE + "," + CRAWL_CTE + "," + FOUND_CTE
BEST_CTE = """
targets AS (SELECT a.* FROM allowed a WHERE a.website IN (SELECT website FROM found)),
""" + CAND_CTE.replace("FROM SRC", "FROM targets") + """,
tc AS (SELECT h.*, t.website, t.path_ord FROM hcand h JOIN targets t USING (page_id)),
ranked AS (SELECT website, email, is_hr, row_number() OVER (PARTITION BY website
           ORDER BY NOT is_hr, path_ord, page_id, pos) AS rn FROM tc),
best AS (SELECT website, email, is_hr AS email_is_hr_context FROM ranked WHERE rn = 1),
dl AS (SELECT fingerprint, min(seq) AS seq, arg_max(name, seq) AS name, arg_max(website, seq) AS website,
              arg_max(latitude, seq) AS latitude, arg_max(longitude, seq) AS longitude
       FROM found GROUP BY fingerprint),
nl AS (SELECT dl.seq, dl.name, dl.website, dl.latitude, dl.longitude, b.email,
              coalesce(b.email_is_hr_context, false) AS email_is_hr_context,
              CASE WHEN b.email IS NULL THEN 'no_email_found' ELSE 'pending' END AS status, dl.fingerprint
       FROM dl LEFT JOIN best b ON b.website = regexp_replace(dl.website, '/+$', ''))"""

LEAD_LINE_SQL = ("'• *' || name || '* (' || CASE WHEN email_is_hr_context THEN '✅ RH confirmado' "
                 "ELSE '⚠️ contacto general' END || ')' || chr(10) || '  ' || email || ' — ' || website || chr(10)")

ORACLE["geo_radius"] = LEADS_BASE + "\nSELECT seq, name, website, round(distance_km, 6) AS distance_km FROM found"
ORACLE["discovery_cap"] = LEADS_BASE + "\nSELECT seq, name, website FROM found ORDER BY seq, fingerprint LIMIT 5"
ORACLE["union_geo_types"] = "WITH " + GEO_CTE + """
SELECT element_id, type, latitude, longitude FROM geo WHERE website IS NOT NULL"""
ORACLE["site_pages"] = LEADS_BASE + """
SELECT c.website, c.path_ord, c.path, c.page_id, c.status FROM crawl c
WHERE c.website IN (SELECT website FROM found)"""
ORACLE["src_pages"] = "WITH " + CRAWL_CTE + "\nSELECT page_id, website, path_ord, status FROM crawl WHERE status < 400"
ORACLE["robots_anti"] = "WITH " + CRAWL_CTE + "\nSELECT page_id, website, path FROM allowed"
ORACLE["src_robots"] = "WITH " + CRAWL_CTE + """
SELECT website, CAST(0 AS BIGINT) AS ord, false AS allow, prefix FROM rsites"""
ORACLE["mailto_candidates"] = "WITH " + CRAWL_CTE + "," + CAND_CTE.replace(
    "FROM SRC", "FROM crawl WHERE status < 400") + "\nSELECT page_id, pos, email, context, is_hr FROM hcand"
ORACLE["hr_context"] = "WITH " + CRAWL_CTE + "," + CAND_CTE.replace(
    "FROM SRC", "FROM crawl WHERE status < 400") + "\nSELECT is_hr, count(*) AS n FROM hcand GROUP BY is_hr"
ORACLE["best_email"] = LEADS_BASE + "," + BEST_CTE + "\nSELECT website, email, email_is_hr_context FROM best"
ORACLE["new_leads"] = LEADS_BASE + "," + BEST_CTE + "\nSELECT * FROM nl"
ORACLE["scan_unnotified_leads"] = LEADS_BASE + "," + BEST_CTE + """,
notif AS (SELECT * FROM nl WHERE email IS NOT NULL),
m AS (SELECT fingerprint FROM notif ORDER BY seq LIMIT 3)
SELECT fingerprint, name, email FROM notif WHERE fingerprint NOT IN (SELECT fingerprint FROM m)"""
ORACLE["lead_digest_text"] = LEADS_BASE + "," + BEST_CTE + f""",
notif AS (SELECT * FROM nl WHERE email IS NOT NULL),
top AS (SELECT * FROM notif ORDER BY seq LIMIT 30),
agg AS (SELECT count(*) AS n_items, (SELECT count(*) FROM notif) AS n_total,
               string_agg({LEAD_LINE_SQL}, chr(10) ORDER BY seq) AS body FROM top)
SELECT n_items, n_total, greatest(n_total - 30, 0) AS overflow,
       '*Empresas para contacto (extracción semanal):*' || chr(10) || chr(10) || body ||
       CASE WHEN n_total > 30 THEN chr(10) || '_...y ' || CAST(n_total - 30 AS VARCHAR) || ' más guardadas en DB_'
            ELSE '' END AS text
FROM agg WHERE n_items > 0"""

# ---------------------------------------------------------------- markup / tabular / card feed oracles

VALID_URL = "(starts_with(url, 'https://') OR starts_with(url, 'http://'))"

ORACLE["src_rss"] = with_postings(f"""
r AS (
  SELECT (seq // 50) * 1048576 + seq % 50 AS seq, title,
         CASE WHEN seq % 4 = 3 THEN '' ELSE company END AS company, 'Remote' AS location,
         CASE WHEN seq % 13 = 5 THEN 'https://weworkremotely.com/g/' || CAST(seq AS VARCHAR) ELSE url END AS url,
         'weworkremotely' AS source, true AS is_remote, description,
         CASE WHEN posted_at IS NULL OR seq % 3 = 2 THEN NULL ELSE date_trunc('second', posted_at) END AS posted_at,
         CAST(NULL AS DOUBLE) AS min_salary_usd_monthly
  FROM postings WHERE (seq // 50) % 7 <> 6 AND seq % 13 NOT IN (6, 7)
)
SELECT * FROM r WHERE {VALID_URL}""")

ORACLE["src_html_cards"] = with_postings(f"""
occ AS (
  SELECT seq AS ord, seq // 50 AS chunk, title, company, url, is_remote, description FROM postings
  UNION ALL
  SELECT seq + 1000000000 AS ord, seq // 50 + 1 AS chunk, title, company, url, is_remote, description
  FROM postings WHERE seq % 7 = 0
),
p AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY ord) - 1 AS pos FROM occ),
ok AS (SELECT * FROM p WHERE is_remote AND {VALID_URL}),
d AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY chunk, pos) AS rn FROM ok)
SELECT chunk * 1048576 + pos AS seq, title, company, 'Remote' AS location, url, 'getonboard' AS source,
       true AS is_remote, description, CAST(NULL AS TIMESTAMP) AS posted_at,
       CAST(NULL AS DOUBLE) AS min_salary_usd_monthly
FROM d WHERE rn = 1""")

ORACLE["src_html_list"] = with_postings("""x AS (SELECT 1)
SELECT (seq // 50) * 1048576 + seq % 50 AS seq, title, '' AS company, 'Remote' AS location,
       'https://foorilla.com/hiring/jobs/' || CAST(seq AS VARCHAR) || '-x' AS url, 'cybersecjobs' AS source,
       true AS is_remote, '' AS description, CAST(NULL AS TIMESTAMP) AS posted_at,
       CAST(NULL AS DOUBLE) AS min_salary_usd_monthly
FROM postings WHERE seq % 5 <> 0""")

TAB_CTE = f"""
tab AS (
  SELECT seq, title, company,
         coalesce(CASE WHEN seq % 13 = 5 THEN NULL ELSE location END, 'Remote') AS location, url,
         CASE seq % 4 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'indeed' ELSE 'glassdoor' END AS source,
         run_no = 0 AS is_remote, CASE WHEN seq % 13 = 7 THEN '' ELSE description END AS description,
         date_trunc('day', posted_at) AS posted_at, CAST(NULL AS DOUBLE) AS min_salary_usd_monthly
  FROM postings WHERE seq % 4 <> 3 AND seq % 13 <> 6 AND {VALID_URL}
)"""
ORACLE["src_tabular"] = with_postings(TAB_CTE + "\nSELECT * FROM tab")
ORACLE["union_passes"] = with_postings(TAB_CTE + "\nSELECT is_remote, count(*) AS n FROM tab GROUP BY is_remote")
ORACLE["source_map"] = with_postings(TAB_CTE + "\nSELECT source, count(*) AS n FROM tab GROUP BY source")
ORACLE["per_site_cap"] = with_postings(TAB_CTE + """,
f AS (SELECT * FROM tab WHERE posted_at IS NULL OR posted_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 720 HOUR),
r AS (SELECT source, url, posted_at, row_number() OVER (PARTITION BY source ORDER BY posted_at DESC NULLS LAST, url ASC) AS rank
      FROM f)
SELECT source, url, posted_at, rank FROM r WHERE rank <= 50""")


def _cards_cte(base):
    return f"""
c AS (
  SELECT seq, seq // 50 AS step, seq % 50 AS pos,
         CASE WHEN seq % 23 = 22 THEN '' WHEN seq % 6 = 0 THEN '{base}/empleos/oferta-' || CAST(k AS VARCHAR)
              ELSE '/empleos/oferta-' || CAST(k AS VARCHAR) END AS href,
         CASE WHEN seq % 13 = 6 THEN '' ELSE title END AS title_f, title, company,
         seq % 3 <> 0 AS has_marker, (seq // 50) % 2 = 0 AS is_remote
  FROM (SELECT *, CASE WHEN seq % 10 = 9 THEN seq - 9 ELSE seq END AS k FROM postings)
),
c2 AS (SELECT * FROM c WHERE step < coalesce((SELECT min(step) FROM c WHERE step % 16 = 13), 9223372036854775807))"""


def _card_text_sql(base, source, markers: bool):
    cond = "AND (NOT is_remote OR has_marker)" if markers else ""
    return with_postings(_cards_cte(base) + f""",
d AS (SELECT *, row_number() OVER (PARTITION BY href ORDER BY seq) AS rn FROM c2 WHERE href <> '')
SELECT step * 1048576 + pos AS seq, title, company,
       CASE WHEN is_remote THEN 'Remote' ELSE 'Celaya' END AS location,
       CASE WHEN starts_with(href, 'http') THEN href ELSE '{base}' || href END AS url, '{source}' AS source,
       is_remote, '' AS description, CAST(NULL AS TIMESTAMP) AS posted_at,
       CAST(NULL AS DOUBLE) AS min_salary_usd_monthly
FROM d WHERE rn = 1 {cond}""")


ORACLE["src_card_text"] = _card_text_sql("https://www.bumeran.com.mx", "bumeran", True)
ORACLE["src_card_links"] = _card_text_sql("https://www.occ.com.mx", "occ", False)
ORACLE["src_card_fields"] = with_postings(_cards_cte("https://mx.computrabajo.com") + """,
u AS (SELECT *, CASE WHEN starts_with(href, '/') THEN 'https://mx.computrabajo.com' || href ELSE href END AS url
      FROM c2 WHERE title_f <> '' AND href <> ''),
d AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS rn FROM u)
SELECT step * 1048576 + pos AS seq, title_f AS title, company,
       CASE WHEN is_remote THEN 'Remote' ELSE 'Celaya' END AS location, url, 'computrabajo' AS source,
       is_remote, '' AS description, CAST(NULL AS TIMESTAMP) AS posted_at,
       CAST(NULL AS DOUBLE) AS min_salary_usd_monthly
FROM d WHERE rn = 1 AND (NOT is_remote OR has_marker)""")
ORACLE["first_blocked"] = with_postings("""
c AS (SELECT 'bumeran' AS feed, seq // 50 AS step, seq % 50 AS pos FROM postings
      UNION ALL SELECT 'occ' AS feed, seq // 50 AS step, seq % 50 AS pos FROM postings WHERE seq % 2 = 0),
fb AS (SELECT feed, min(step) AS fs FROM c WHERE step % 16 = 13 GROUP BY feed)
SELECT c.feed, c.step, c.pos FROM c LEFT JOIN fb USING (feed) WHERE fb.fs IS NULL OR c.step < fb.fs""")
ORACLE["latest_thread"] = """SELECT o_orderkey AS object_id,
  'Ask HN: Who is hiring? (' || o_orderpriority || ')' AS title, o_orderdate AS created_at
FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1"""
ORACLE["dedup_url_first"] = with_postings(f"""
d AS (SELECT url, seq, title, row_number() OVER (PARTITION BY url ORDER BY seq) AS rn
      FROM postings WHERE {VALID_SQL})
SELECT url, seq, title FROM d WHERE rn = 1""")


def _feed(i: int, key: str) -> str:
    """One feed of the union: its number, the file and the place in the file, from the packed order of its own key."""
    place = "CASE WHEN is_remote THEN 0 ELSE 1 END AS payload, seq AS pos" if key == "src_tabular" else "seq // 1048576 AS payload, seq % 1048576 AS pos"
    return (f"SELECT {i} AS feed, {place}, source, sha256(lower(title || company || url)) AS fingerprint FROM ({ORACLE[key]})")


UNION_KEYS = ("src_tabular", "src_json_array", "src_json_envelope", "src_rss", "src_html_list", "src_card_fields", "src_card_text",
              "src_json_salaried", "src_thread_comments", "src_card_links", "src_html_cards")
ORACLE["union_feeds"] = ("SELECT feed, dense_rank() OVER (PARTITION BY feed ORDER BY payload) AS file, pos, source, fingerprint FROM (\n"
                         + "\nUNION ALL\n".join(_feed(i, k) for i, k in enumerate(UNION_KEYS)) + ")")
ORACLE["response_rejects"] = with_postings("""c AS (SELECT DISTINCT seq // 50 AS k FROM postings),
r AS (SELECT feed, CASE WHEN k % 7 = 1 OR (k % 7 = 6 AND feed = 'wwr') THEN 'not_parsable'
                        WHEN k % 7 = 2 THEN 'empty_response' WHEN k % 7 = 3 THEN 'wrong_shape' END AS reason
      FROM c, (VALUES ('remoteok'), ('remotive'), ('himalayas'), ('wwr')) v(feed))
SELECT feed, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY feed, reason""")
_THETA = ("widget", "schkeit", *[f"zz-term-{i:03d}" for i in range(60)])
ORACLE["keyword_theta"] = with_postings("x AS (SELECT 1)\nSELECT seq FROM postings WHERE "
                                        + " OR ".join(f"contains({SEARCHABLE}, '{t}')" for t in _THETA))

# ---------------------------------------------------------------- language oracles

NB_MODEL = r"""
train AS (SELECT lang, regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g') AS t
          FROM documents WHERE doc_id % 2 = 0 AND lang IS NOT NULL),
ti AS (SELECT lang, t, unnest(range(1, length(t) + 1)) AS i FROM train),
tg AS (SELECT lang, substring(t, i, v.n) AS gram FROM ti, (VALUES (1), (2), (3)) v(n)
       WHERE i + v.n - 1 <= length(t)),
counts AS (SELECT lang, gram, count(*) AS c FROM tg GROUP BY lang, gram),
vocab AS (SELECT count(DISTINCT gram) AS v FROM counts),
pl AS (SELECT lang, sum(c) AS n_grams FROM counts GROUP BY lang),
pdocs AS (SELECT lang, count(*) AS n_docs FROM train GROUP BY lang),
langs AS (SELECT pdocs.lang, ln(n_docs / (SELECT sum(n_docs) FROM pdocs)) AS prior, n_grams
          FROM pdocs JOIN pl USING (lang)),
prof AS (SELECT g.gram, l.lang,
                ln((CAST(coalesce(c.c, 0) AS DOUBLE) + 1.0) / CAST(l.n_grams + (SELECT v FROM vocab) AS DOUBLE)) AS lp
         FROM (SELECT DISTINCT gram FROM counts) g CROSS JOIN langs l
         LEFT JOIN counts c ON c.gram = g.gram AND c.lang = l.lang)"""


def nb_scores(src: str, key: str) -> str:
    """CTEs scoring ``src`` (columns key, t = raw text window) -> tot(key, lang, score)."""
    return f"""
sn AS (SELECT {key}, regexp_replace(lower(t), '[^\\p{{L}}]+', ' ', 'g') AS t FROM {src}),
si AS (SELECT {key}, t, unnest(range(1, length(t) + 1)) AS i FROM sn),
sg AS (SELECT {key}, substring(t, i, v.n) AS gram, count(*) AS n FROM si, (VALUES (1), (2), (3)) v(n)
       WHERE i + v.n - 1 <= length(t) GROUP BY {key}, substring(t, i, v.n)),
sc AS (SELECT sg.{key}, prof.lang, sum(sg.n * prof.lp) AS s FROM sg JOIN prof USING (gram)
       GROUP BY sg.{key}, prof.lang),
tot AS (SELECT sc.{key}, sc.lang, sc.s + l.prior AS score FROM sc JOIN langs l USING (lang)),
best AS (SELECT {key}, max(score) AS m FROM tot GROUP BY {key}),
det AS (SELECT t.{key}, min(CASE WHEN t.score = b.m THEN t.lang END) AS detected_lang,
               1.0 / sum(exp(t.score - b.m)) AS detected_prob
        FROM tot t JOIN best b USING ({key}) GROUP BY t.{key})"""


PTEXT = "pt AS (SELECT seq, title || ' ' || description AS t FROM postings)"

ORACLE["detect_language"] = with_postings(NB_MODEL + ",\n" + PTEXT + "," + nb_scores("pt", "seq") + """
SELECT p.seq, d.detected_lang, round(d.detected_prob, 4) AS detected_prob
FROM postings p LEFT JOIN det d USING (seq)""")
ORACLE["language_scores"] = with_postings(NB_MODEL + ",\n" + PTEXT + "," + nb_scores("pt", "seq") + """
SELECT seq, lang, round(score, 4) AS score FROM tot""")
ORACLE["language_filter"] = with_postings(NB_MODEL + ",\n" + PTEXT + "," + nb_scores("pt", "seq") + """
SELECT p.seq FROM postings p LEFT JOIN det d USING (seq)
WHERE d.detected_lang IS NULL OR d.detected_prob IS NULL OR d.detected_prob < 0.8
   OR d.detected_lang IN ('en', 'es')""")
ORACLE["posting_filter"] = with_postings(NB_MODEL + ",\n" + PTEXT + "," + nb_scores("pt", "seq") + f"""
SELECT p.seq FROM postings p LEFT JOIN det d USING (seq)
WHERE {VALID_SQL} AND {F1_SQL} AND {F2_SQL} AND {F3_SQL} AND {F4_SQL} AND {F6_SQL}
  AND (d.detected_lang IS NULL OR d.detected_prob < 0.8 OR d.detected_lang IN ('en', 'es'))""")
ORACLE["language_accuracy"] = ("WITH " + NB_MODEL + """,
held AS (SELECT doc_id, lang AS true_lang, text AS t FROM documents WHERE doc_id % 2 = 1),"""
                               + nb_scores("held", "doc_id") + """
SELECT h.true_lang AS lang, count(*) AS n, count_if(d.detected_lang = h.true_lang) AS n_correct
FROM held h LEFT JOIN det d USING (doc_id) GROUP BY h.true_lang""")

# ---------------------------------------------------------------- streaming twins (batch SQL)

# Two landings of nine feeds: payloads of the postings of either run, read back, filtered, deduplicated, saved once.
STREAM_KEYS = ("src_json_array", "src_json_envelope", "src_rss", "src_html_list", "src_card_fields", "src_card_text", "src_json_salaried",
               "src_card_links", "src_html_cards")


def _landing(run: int) -> str:
    feeds = [(k, i) for i, k in enumerate(STREAM_KEYS)]
    rows = " UNION ALL ".join(
        f"SELECT {i} AS feed, seq // 1048576 AS payload, seq % 1048576 AS pos, title, company, url, source, is_remote, description, posted_at"
        f" FROM ({ORACLE[k].replace('postings AS (', 'all_postings AS (', 1).replace('fp_postings AS (', f'postings AS (SELECT * FROM all_postings WHERE run_no = {run}), fp_postings AS (', 1)})"
        for k, i in feeds)
    return f"""u{run} AS (SELECT *, sha256(lower(title || company || url)) AS fingerprint FROM ({rows}) WHERE {F1_SQL} AND {F3_SQL}),
l{run} AS (SELECT fingerprint, arg_max(title, (feed, payload, pos)) AS title, arg_max(source, (feed, payload, pos)) AS source FROM u{run} GROUP BY fingerprint)"""


ORACLE["stream_postings"] = f"""WITH {_landing(0)},
{_landing(1)}
SELECT fingerprint, title, source, CAST(0 AS BIGINT) AS run_id FROM l0
UNION ALL SELECT fingerprint, title, source, CAST(1 AS BIGINT) AS run_id FROM l1 WHERE fingerprint NOT IN (SELECT fingerprint FROM l0)"""
ORACLE["late_postings"] = ORACLE["recency_filter"]
ORACLE["stream_leads"] = ORACLE["new_leads"]
# Over two landings with late rows: a key once, unless it comes back later than the delay after the watermark.
ORACLE["stream_dedup_bounded"] = with_postings("""k AS (
  SELECT sha256(lower(title || company || url)) AS fingerprint, posted_at FROM postings)
SELECT fingerprint, CAST(1 AS BIGINT) AS n FROM (SELECT DISTINCT fingerprint FROM k)""")


def _digest(run: int, kind: str, rows: str) -> str:
    return f"""SELECT CAST({run} AS BIGINT) AS run_id, '{kind}' AS kind, count(*) AS n_items, (SELECT count(*) FROM {rows}) AS n_total,
  '*Nuevas ofertas:*' || chr(10) || chr(10) || string_agg({POSTING_LINE_SQL}, chr(10) ORDER BY run_id, seq, fingerprint) ||
  CASE WHEN (SELECT count(*) FROM {rows}) > 10 THEN chr(10) || '_...y ' || CAST((SELECT count(*) FROM {rows}) - 10 AS VARCHAR) || ' más guardadas en DB_' ELSE '' END AS text
FROM (SELECT * FROM {rows} ORDER BY run_id, seq, fingerprint LIMIT 10) HAVING count(*) > 0"""


ORACLE["digest_log"] = with_postings(SCENARIO + "\n" + "\nUNION ALL ".join((
    _digest(0, "new", "saved0"), _digest(1, "retry", "pend1"), _digest(1, "new", "saved1"), _digest(2, "retry", "pend2"))))

# ---------------------------------------------------------------- single-operator keys

ORACLE["salary_annual"] = """SELECT o_orderkey,
  CASE WHEN o_orderkey % 7 <> 0 AND o_totalprice - 100000.0 > 0 THEN (o_totalprice - 100000.0) / 12 END
    AS annual_monthly FROM orders"""
ORACLE["html_to_text"] = r"""WITH s AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?s)<script[^>]*>.*?</script>', '', 'g'), '(?s)<style[^>]*>.*?</style>', '', 'g'),
    '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g') AS t FROM pages)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  replace(t, '&#x27;', ''''), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'),
  '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g') AS text FROM s"""
ORACLE["language_window"] = with_postings("""x AS (SELECT 1)
SELECT seq, substring(regexp_replace(title || ' ' || description, '^\\s+|\\s+$', '', 'g'), 1, 500) AS lang_window
FROM postings""")
ORACLE["csv_params"] = """WITH r AS (SELECT p_partkey, ' ' || p_type || ' , ,' || p_name || ' ' AS raw FROM part)
SELECT p_partkey, list_transform(string_split(raw, ','), lambda x: lower(trim(x))) AS keywords,
  list_filter(list_transform(string_split(raw, ','), lambda x: lower(trim(x))), lambda x: x <> '') AS items,
  list_filter(list_transform(string_split(raw, ','), lambda x: trim(x)), lambda x: x <> '') AS paths FROM r"""
ORACLE["min_years"] = with_postings(f"""x AS (SELECT 1)
SELECT seq, {min_years_sql("(title || ' ' || description)")} AS min_years FROM postings""")
ORACLE["title_is_senior"] = with_postings(f"x AS (SELECT 1)\nSELECT seq, {SENIOR_TITLE} AS title_is_senior FROM postings")
ORACLE["mail_context"] = "WITH " + CRAWL_CTE + "," + CAND_CTE.replace(
    "FROM SRC", "FROM crawl WHERE status < 400") + "\nSELECT page_id, pos, context FROM hcand"
ORACLE["lead_status"] = LEADS_BASE + "," + BEST_CTE + "\nSELECT fingerprint, status FROM nl"
ORACLE["remote_marker_filter"] = with_postings("""x AS (SELECT 1)
SELECT seq // 50 AS step, seq % 50 AS pos FROM postings WHERE NOT ((seq // 50) % 2 = 0) OR seq % 3 <> 0""")
ORACLE["known_source"] = with_postings("""x AS (SELECT 1)
SELECT seq, source FROM postings WHERE source IN ('linkedin','indeed','glassdoor','remoteok','remotive',
  'weworkremotely','cybersecjobs','computrabajo','bumeran','himalayas','hackernews','occ','getonboard')""")
ORACLE["required_fields"] = with_postings("""x AS (SELECT 1)
SELECT seq // 50 AS step, seq % 50 AS pos FROM postings WHERE seq % 13 <> 6 AND seq % 23 <> 22""")
ORACLE["unknown_feeds"] = """SELECT DISTINCT source AS feed FROM documents
WHERE source NOT IN ('jobspy','remoteok','remotive','wwr','cybersecjobs','computrabajo','bumeran','himalayas','hackernews','occ','getonboard')"""
ORACLE["stream_dedup_exact"] = f"SELECT fingerprint FROM ({ORACLE['stream_postings']})"
CENTRES = ((0, 20.1, -100.8), (1, 70.0, 10.0), (2, 10.0, 179.9), (3, -10.0, -179.5), (4, 89.0, 0.0))
ORACLE["radius_join"] = f"""WITH c AS (SELECT * FROM (VALUES {", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, a, b in CENTRES)}) v(centre_id, centre_lat, centre_lon)),
p AS (SELECT c_custkey AS point_id, ((c_custkey * 7919) % 180001) / 1000.0::DOUBLE - 90.0::DOUBLE AS latitude,
             ((c_custkey * 104729) % 360001) / 1000.0::DOUBLE - 180.0::DOUBLE AS longitude FROM customer),
d AS (SELECT centre_id, point_id, CAST(12742.0 AS DOUBLE) * asin(sqrt(pow(sin((radians(latitude) - radians(centre_lat)) / 2), 2)
        + cos(radians(centre_lat)) * cos(radians(latitude)) * pow(sin((radians(longitude) - radians(centre_lon)) / 2), 2))) AS km FROM c, p)
SELECT CAST(centre_id AS BIGINT) AS centre_id, point_id, round(km, 6) AS distance_km FROM d WHERE km <= 800.0"""
