"""SQL that states the results of the registered queries on the same tables, from page_id formulas alone.

Nothing here parses HTML or JSON-LD: what a page holds follows from its number.
"""

from __future__ import annotations

from ..operators.rules import RECOMMENDED as ADVICE
from .fixtures import WILD
from .queries import _IPS, RULE_IDS, rule_key

ORIGIN = "lower(regexp_extract({u}, '^[A-Za-z]+://[^/?#]+'))"
RAWPATH = "CASE WHEN regexp_extract({u}, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({u}, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) END"
PATH = "CASE WHEN length(" + RAWPATH + ") > 1 THEN regexp_replace(" + RAWPATH + ", '/$', '') ELSE '/' END"
QUERY = r"regexp_extract({u}, '(\?[^#]*)', 1)"
NORM = f"({ORIGIN} || {PATH} || {QUERY})"


def _tag(name: str) -> str:
    """Text of a page's first element of that name."""
    return f"replace(replace(replace(trim(regexp_extract(html, '(?s)<{name}>(.*?)</{name}>', 1)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


def _u(expr: str, u: str = "url") -> str:
    return expr.replace("{u}", u)


PG = f"""pg AS (SELECT page_id, url, html, {_u(ORIGIN)} AS site, {_u(PATH)} AS path, {_u(NORM)} AS norm, {_tag("title")} AS title, {_tag("h1")} AS h1, (SELECT count(*) FROM pages) AS n_pages FROM pages),
st AS (SELECT site, row_number() OVER (ORDER BY site) - 1 AS rank FROM (SELECT DISTINCT site FROM pg))"""


def _snap(shift: int = 0, name: str = "sn") -> str:
    return f"""{name} AS (SELECT *, CASE WHEN k % 23 = 5 THEN 404 WHEN k % 29 = 7 THEN 503 WHEN k % 31 = 3 THEN 301 ELSE 200 END AS status_code, CAST(k % 4 AS INTEGER) AS depth
    FROM (SELECT *, page_id + {shift} AS k FROM pg))"""


LAB = """lab AS (SELECT p.site, p.url, median(CASE WHEN event_type <> 'error' THEN value * 20 END) AS lcp_ms, median(CASE WHEN event_type <> 'error' THEN value / 1000 END) AS cls_unitless,
    median(CASE WHEN event_type <> 'error' THEN value END) AS tbt_ms, CAST(count(*) AS INTEGER) AS runs_completed FROM events e JOIN pg p ON e.event_id % p.n_pages = p.page_id GROUP BY p.site, p.url)"""

#: rule id: category, severity, when, current value
_RULES = {
    "R-CANONICAL-MISSING": ("canonical", "high", "ok AND k % 3 = 0", "NULL"),
    "R-CANONICAL-JS-ONLY": ("canonical", "critical", "ok AND k % 3 = 2", "url"),
    "R-NOINDEX-DETECTED": ("indexing", "medium", "ok AND k % 7 = 0", "'NoIndex'"),
    "R-JSONLD-MISSING": ("schema", "low", "ok AND k % 8 = 0", "NULL"),
    "R-JSONLD-INVALID": ("schema", "high", "ok AND k % 8 IN (3, 4)", "CASE WHEN k % 8 = 3 THEN 'block 1: malformed_json' ELSE 'block 1: missing_context_or_type' END"),
    "R-QA-STRUCTURE-MISSING": ("geo", "low", "ok AND k % 8 <> 2", "NULL"),
    "R-JSONLD-PRODUCT-INCOMPLETE": ("schema", "medium", "ok AND k % 8 = 6", "'review/aggregateRating/offers'"),
    "R-JSONLD-PRODUCT-NAME-MISMATCH": ("schema", "high", "ok AND k % 8 = 7", "'no such thing here'"),
    "R-OG-BASIC-MISSING": ("meta", "low", "ok AND (k % 2 = 1 OR (k % 5 = 0 AND k % 3 <> 0))", "concat_ws(', ', CASE WHEN k % 2 = 1 THEN 'og:title' END, CASE WHEN k % 5 = 0 AND k % 3 <> 0 THEN 'og:url' END)"),
    "R-OG-DESCRIPTION-MISSING": ("meta", "low", "ok AND k % 3 <> 0", "NULL"),
    "R-META-DESCRIPTION-MISSING": ("meta", "low", "ok AND k % 4 = 0", "NULL"),
    "R-STATUS-4XX": ("indexing", "critical", "status_code = 404", "'404'"),
    "R-STATUS-5XX": ("indexing", "critical", "status_code = 503", "'503'"),
    "R-REDIRECT-CHAIN-LONG": ("indexing", "medium", "k % 4 >= 2", "(k % 4) || ' hops: ' || url || '/hop1 -> ' || url || '/hop2 -> ' || CASE WHEN k % 4 = 3 THEN url || '/hop3 -> ' ELSE '' END || url"),
    "R-RAW-RENDERED-GAP-TITLE": ("indexing", "high", "ok AND k % 11 = 0 AND k % 22 <> 0", "title"),
    "R-RAW-RENDERED-GAP-METAROBOTS": ("indexing", "high", "ok AND k % 7 = 0 AND k % 14 <> 0", "'NoIndex'"),
    "R-CWV-LCP-POOR": ("cwv", "high", "depth = 0 AND lcp_ms > 2500", "CAST(round(lcp_ms) AS BIGINT) || 'ms'"),
    "R-CWV-CLS-POOR": ("cwv", "high", "depth = 0 AND cls_unitless > 0.1", "printf('%.3f', round(cls_unitless, 3))"),
    "R-CWV-TBT-POOR": ("cwv", "high", "depth = 0 AND tbt_ms > 150", "CAST(round(tbt_ms) AS BIGINT) || 'ms'"),
    "R-TITLE-MISSING": ("meta", "high", "ok AND k % 22 = 0", "NULL"),
    "R-H1-MISSING": ("meta", "medium", "ok AND k % 13 = 0 AND k % 9 <> 0", "NULL"),
    "R-H1-MULTIPLE": ("meta", "low", "ok AND k % 13 <> 0 AND k % 9 = 0", "'2'"),
    "R-IMG-ALT-MISSING": ("meta", "low", "ok AND k % 6 > 0", "CAST(k % 6 AS VARCHAR)"),
}
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"


def _viol(name: str = "v", snap: str = "sn", lab: bool = False) -> str:
    """Violations of a snapshot; without vitals unless lab."""
    source = f"(SELECT s.*, s.status_code = 200 AS ok{', l.lcp_ms, l.cls_unitless, l.tbt_ms' if lab else ''} FROM {snap} s{' LEFT JOIN lab l ON s.site = l.site AND s.url = l.url' if lab else ''})"
    parts = [
        f"SELECT site, url, norm, page_id, k, path, title, h1, '{r}' AS rule_id, '{c}' AS category, '{sv}' AS severity, CAST({cur} AS VARCHAR) AS current_value, {RULE_IDS.index(r)} AS rule_ord FROM {source} WHERE {when}"
        for r, (c, sv, when, cur) in _RULES.items()
        if lab or not r.startswith("R-CWV")
    ]
    return f"{name} AS (SELECT *, left(sha256(norm || '|' || rule_id || '|1'), 16) AS finding_key, page_id * 1000 + rule_ord AS id FROM ({' UNION ALL '.join(parts)}))"


def _with(*ctes: str, q: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + q


SN, V = _snap(), _viol()
SNB, VB = _snap(1, "snb"), _viol("vb", "snb")
# The runs' findings: B's are acknowledged on every fifth page.
BASE = "ba AS (SELECT site, finding_key, arg_max(category, id) AS category, arg_max(severity, id) AS severity, count(*) AS occurrences FROM v GROUP BY site, finding_key)"
CUR = "cu AS (SELECT site, finding_key, arg_max(CASE WHEN page_id % 5 = 0 THEN 'acknowledged' ELSE 'open' END, id) AS status, arg_max(severity, id) AS severity, arg_max(rule_id, id) AS rule_id, arg_max(url, id) AS url, arg_max(rule_ord, id) AS rule_ord FROM vb GROUP BY site, finding_key)"
REG = "re AS (SELECT cu.*, CASE WHEN status = 'acknowledged' THEN 'intended' ELSE 'regression' END AS kind FROM cu WHERE NOT EXISTS (SELECT 1 FROM ba WHERE ba.site = cu.site AND ba.finding_key = cu.finding_key))"
RUNS = "runs AS (SELECT rank * 10 + i AS id, rank AS project_id, CASE WHEN i < 2 OR rank % 2 = 0 THEN 1706745600 + i * 60 END AS finished_at FROM st, (SELECT unnest([0, 1, 2]) AS i))"
STATE = "CASE rank % 5 WHEN 0 THEN 'absent' WHEN 1 THEN 'unavailable' ELSE 'found' END"
MAY = f"""may AS (SELECT p.site, p.url, {STATE} AS state, CASE rank % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN NOT regexp_matches(p.url, '^[a-z]+://[^/]+/en/') WHEN 3 THEN true
    ELSE regexp_matches(p.url, '^[a-z]+://[^/]+/fr/') END AS allowed FROM (SELECT DISTINCT site, url FROM pg) p JOIN st USING (site))"""
BOTS = """bots AS (SELECT * FROM (VALUES ('GPTBot', 'training'), ('OAI-SearchBot', 'ai_search'), ('ChatGPT-User', 'user_fetch'), ('ClaudeBot', 'training'), ('Claude-SearchBot', 'ai_search'), ('Claude-User', 'user_fetch'),
    ('PerplexityBot', 'ai_search'), ('Perplexity-User', 'user_fetch'), ('Google-Extended', 'training'), ('CCBot', 'training'), ('Bytespider', 'training')) t(token, purpose))"""
ACC = "acc AS (SELECT site, token, purpose, CASE rank % 5 WHEN 3 THEN token <> 'GPTBot' WHEN 4 THEN false ELSE true END AS allowed, rank % 5 <> 0 AS robots_found FROM st, bots WHERE rank % 5 <> 1)"
# URLs of a site's sitemap in document order: halves of even ranks one after the other.
LIST = "li AS (SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY CASE WHEN rank % 2 = 0 THEN page_id % 2 ELSE 0 END, page_id) AS INTEGER) AS ord, url, path FROM pg JOIN st USING (site) WHERE page_id % 4 <> 0 AND rank % 7 <> 0)"
GAP = "gap AS (SELECT DISTINCT site, path FROM sn WHERE status_code = 200 AND NOT EXISTS (SELECT 1 FROM li WHERE li.site = sn.site AND li.path = sn.path))"
NUM = "nu AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS n FROM sn)"
ED = "ed AS (SELECT a.site, a.n AS a_n, a.norm AS src, b.norm AS dst, b.n AS b_n, t.pos FROM nu a, (VALUES (0), (1), (2)) t(pos) JOIN nu b ON a.site = b.site AND b.n = CASE t.pos WHEN 0 THEN a.n * 2 WHEN 1 THEN a.n * 2 + 1 ELSE a.n - 3 END)"


def _reach(polite: bool, mapped: bool = False) -> str:
    """Levels unrolled: depth, and order by (parent's order, position); no budget is met at the sizes that are compared."""
    ok = "bool_and(m.allowed)" if polite else "true"
    ctes = [f"nd AS (SELECT nu.site, nu.norm, any_value(nu.status_code) AS status_code, {ok} AS allowed FROM nu JOIN may m ON nu.site = m.site AND nu.url = m.url GROUP BY nu.site, nu.norm)"]
    ctes.append("l0 AS (SELECT site, norm, 0 AS depth, 1 AS ord FROM nu WHERE n = 1)")
    for i in (1, 2, 3):
        seen = " UNION ALL ".join(f"SELECT site, norm, ord FROM l{j}" for j in range(i))
        ctes.append(f"c{i} AS (SELECT ed.site, ed.dst AS norm, min(row(l.ord, ed.pos)) AS o FROM l{i - 1} l JOIN nd USING (site, norm) JOIN ed ON ed.site = l.site AND ed.src = l.norm WHERE nd.allowed AND nd.status_code = 200 AND NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.site = ed.site AND s.norm = ed.dst) GROUP BY ed.site, ed.dst)")
        if mapped and i == 1:  # what sitemaps list comes before all links
            ctes[-1] = ctes[-1].replace("c1 AS", "k1 AS")
            ctes.append("c1 AS (SELECT site, norm, min(o) AS o FROM (SELECT site, norm, o FROM k1 UNION ALL SELECT li.site, pg.norm, row(CAST(-1 AS BIGINT), CAST(li.ord AS INTEGER)) FROM li JOIN pg ON pg.url = li.url WHERE NOT EXISTS (SELECT 1 FROM l0 WHERE l0.site = li.site AND l0.norm = pg.norm)) GROUP BY site, norm)")
        ctes.append(f"l{i} AS (SELECT c.site, c.norm, {i} AS depth, row_number() OVER (PARTITION BY c.site ORDER BY c.o, c.norm) + (SELECT count(*) FROM ({seen}) s WHERE s.site = c.site) AS ord FROM c{i} c)")
    ctes.append("rc AS (SELECT l.*, CASE WHEN allowed THEN 'visited' ELSE 'skipped_by_robots' END AS visit_status FROM (" + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(4)) + ") l JOIN nd USING (site, norm))")
    return ",\n".join(ctes)


SQL: dict[str, str] = {}
P = lambda q: _with(PG, q=q)
S = lambda q: _with(PG, SN, q=q)
VQ = lambda q: _with(PG, SN, V, q=q)

SQL["src1_pages"] = S("SELECT site, url, depth, CAST(status_code AS INTEGER) AS status_code FROM sn WHERE status_code = 200")
SQL["src2_robots"] = P(f"SELECT site, CAST(CASE rank % 5 WHEN 0 THEN 404 WHEN 1 THEN 503 ELSE 200 END AS INTEGER) AS status_code, {STATE} AS state FROM st")
SQL["src3_sitemaps"] = P("""SELECT site, site || CASE WHEN rank % 2 = 0 THEN '/part' || (page_id % 2) || '.xml' ELSE '/sitemap.xml' END AS sitemap_url, CAST(17 + sum(length(url) + 22) AS BIGINT) AS body_length
    FROM pg JOIN st USING (site) WHERE page_id % 4 <> 0 AND rank % 7 <> 0 GROUP BY ALL
    UNION ALL SELECT site, site || '/sitemap.xml', CAST(length('<sitemapindex></sitemapindex>') + 2 * (length(site) + length('<sitemap><loc>/part0.xml</loc></sitemap>')) AS BIGINT) FROM st WHERE rank % 2 = 0 AND rank % 7 <> 0""")
SQL["src4_lab_runs"] = P("SELECT p.site, p.url, CAST(event_id % 3 AS INTEGER) AS run, count(CASE WHEN event_type <> 'error' THEN value END) AS measured FROM events e JOIN pg p ON e.event_id % p.n_pages = p.page_id GROUP BY ALL")
SQL["src5_field_payloads"] = P("SELECT url, event_id, true AS parses FROM events JOIN pg ON event_id % n_pages = page_id")
SQL["src6_metric_scans"] = """SELECT CAST(ts AS DATE) AS date, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS impressions,
    CASE WHEN day(CAST(ts AS DATE)) % 10 = 0 THEN 'n/a' ELSE CAST(count(*) AS VARCHAR) END AS sessions, CAST(count(DISTINCT user_id) AS VARCHAR) AS active_users FROM events GROUP BY CAST(ts AS DATE)"""
SQL["src7_findings_by_run"] = VQ("SELECT rule_id, count(*) AS n FROM v GROUP BY rule_id")
SQL["snk1_page_records"] = S("SELECT url, CAST(status_code AS INTEGER) AS status_code, CAST(500 AS BIGINT) AS excerpt_length, NOT (k % 11 = 0 AND k % 13 = 0 AND k % 9 <> 0) AS raw_has_content FROM sn")
SQL["snk2_findings"] = VQ("SELECT finding_key, rule_id, 'open' AS status, id FROM v")
SQL["snk5_baseline_rows"] = _with(PG, SN, V, BASE, q="SELECT site, finding_key, category, severity, 'open' AS status FROM ba")
SQL["snk6_projects"] = P("SELECT site AS target, CASE WHEN rank % 2 = 0 THEN CASE WHEN rank % 4 = 0 THEN rank + 1000 ELSE rank END END AS id, rank % 2 <> 0 AS created FROM st")
SQL["snk7_runs"] = P("SELECT rank AS project_id, CAST(3 AS BIGINT) AS finished, CAST(CASE WHEN rank % 2 = 0 THEN 1706745720 ELSE greatest(1706745660, epoch(TIMESTAMP '2024-02-01 00:00:00')) END AS BIGINT) AS last_at, rank % 2 = 0 AS stored_end, 'both' AS render_source FROM st")
_VL = _viol("v", lab=True)
LABEL = "CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN 'danger' WHEN count(*) FILTER (severity = 'high') > 0 THEN 'caution' ELSE 'good' END"
POLICY = """po AS (SELECT site, rank, site || '/robots.txt' AS url, CASE WHEN rank % 5 = 0 THEN 404 ELSE 200 END AS status_code, CASE WHEN rank % 5 = 0 THEN 'no robots.txt, all allowed; ' ELSE '' END || CASE rank % 5
    WHEN 3 THEN 'training - blocked: GPTBot / allowed: ClaudeBot, Google-Extended, CCBot, Bytespider; ai_search - allowed: OAI-SearchBot, Claude-SearchBot, PerplexityBot; user_fetch - allowed: ChatGPT-User, Claude-User, Perplexity-User'
    WHEN 4 THEN 'training - blocked: GPTBot, ClaudeBot, Google-Extended, CCBot, Bytespider; ai_search - blocked: OAI-SearchBot, Claude-SearchBot, PerplexityBot; user_fetch - blocked: ChatGPT-User, Claude-User, Perplexity-User'
    ELSE 'training - allowed: GPTBot, ClaudeBot, Google-Extended, CCBot, Bytespider; ai_search - allowed: OAI-SearchBot, Claude-SearchBot, PerplexityBot; user_fetch - allowed: ChatGPT-User, Claude-User, Perplexity-User' END AS told FROM st WHERE rank % 5 <> 1)"""
FIELD = """fd AS (SELECT p.site, p.url, max(CASE WHEN event_id % 10 <> 0 THEN floor(value) END) AS f_lcp, max(floor(value) / 100) AS f_cls, max(floor(value)) AS f_inp
    FROM events e JOIN pg p ON e.event_id % p.n_pages = p.page_id WHERE event_id % 17 <> 0 GROUP BY p.site, p.url)"""
_LAST = "CAST(ts AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-30'"
SEARCH = f"""se AS (SELECT CAST(sum(c) AS BIGINT) AS clicks, CAST(sum(i) AS BIGINT) AS impressions, sum(p * i) / sum(i) AS position
    FROM (SELECT CAST(ts AS DATE) AS date, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'view') AS i, avg(event_id) AS p FROM events WHERE {_LAST} GROUP BY 1)),
tr AS (SELECT CAST(sum(CASE WHEN day(date) % 10 = 0 THEN 0 ELSE n END) AS BIGINT) AS sessions, CAST(sum(u) AS BIGINT) AS active_users
    FROM (SELECT CAST(ts AS DATE) AS date, count(*) AS n, count(DISTINCT user_id) AS u FROM events WHERE {_LAST} GROUP BY 1))"""
#: All findings of a report, its pages, and its head.
REPORT = """fs AS (SELECT site, url, rule_id, severity, category, current_value, rule_ord FROM v UNION ALL SELECT site, url, 'R-AI-CRAWLER-POLICY', 'low', 'geo', told, 100 FROM po),
pp AS (SELECT sn.site, sn.url, page_id AS ord, status_code, CASE WHEN depth = 0 THEN lcp_ms END AS lcp, CASE WHEN depth = 0 THEN cls_unitless END AS cls, CASE WHEN depth = 0 THEN tbt_ms END AS tbt,
    CASE WHEN depth = 0 THEN f_lcp END AS f_lcp, CASE WHEN depth = 0 THEN f_cls END AS f_cls, CASE WHEN depth = 0 THEN f_inp END AS f_inp
    FROM sn LEFT JOIN lab ON lab.site = sn.site AND lab.url = sn.url LEFT JOIN fd ON fd.site = sn.site AND fd.url = sn.url
    UNION ALL SELECT site, url, -1, status_code, NULL, NULL, NULL, NULL, NULL, NULL FROM po),
hd AS (SELECT st.site, rank, pages, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low,
    CASE WHEN critical > 0 THEN 'danger' WHEN high > 0 THEN 'caution' ELSE 'good' END AS label
    FROM st JOIN (SELECT site, count(*) AS pages FROM pp GROUP BY site) USING (site) LEFT JOIN (SELECT site, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
    count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM fs GROUP BY site) USING (site))"""
X = lambda q: _with(PG, SN, LAB, _VL, POLICY, FIELD, SEARCH, REPORT, q=q)
_N = ", ".join(f"CAST(NULL AS DOUBLE) AS n{i}" for i in range(2, 7))
SQL["snk3_json_report"] = X(f"""SELECT site, 0 AS kind, CAST(0 AS BIGINT) AS ord, concat_ws('|', label, pages, critical + high + medium + low, critical, high, medium, low, CASE WHEN rank % 3 = 0 THEN clicks END, CASE WHEN rank % 3 = 0 THEN impressions END,
    CASE WHEN rank % 3 = 1 THEN 'quota used up' END, CASE WHEN rank % 3 = 1 THEN sessions END, CASE WHEN rank % 3 = 1 THEN active_users END, CASE WHEN rank % 3 = 0 THEN 'quota used up' END) AS told, CASE WHEN rank % 3 = 0 THEN round(position, 6) END AS n1, {_N} FROM hd, se, tr
UNION ALL SELECT pp.site, 1, ord, concat_ws('|', pp.url, status_code, coalesce(found, '')), round(lcp, 6), round(cls, 6), round(tbt, 6), round(f_lcp, 6), round(f_cls, 6), round(f_inp, 6)
    FROM pp LEFT JOIN (SELECT site, url, string_agg(rule_id || '=' || coalesce(current_value, '-'), ';' ORDER BY {RANK}, rule_ord) AS found FROM fs GROUP BY site, url) f ON f.site = pp.site AND f.url = pp.url""")
_MS = lambda c: f"coalesce(CAST(CAST(round({c}) AS BIGINT) AS VARCHAR) || ' ms', 'unknown')"
_F3 = lambda c: f"coalesce(printf('%.3f', round({c}, 3)), 'unknown')"
_CELL = lambda c: f"coalesce(replace(replace({c}, '|', '\\|'), chr(10), ' '), '-')"
RECOMMENDED = "re AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{t.replace(chr(39), chr(39) * 2)}')" for r, t in ADVICE.items()) + ") t(rule_id, recommended))"
SQL["snk4_markdown"] = _with(PG, SN, LAB, _VL, POLICY, FIELD, SEARCH, REPORT, RECOMMENDED, q=f"""SELECT site, 0 AS kind, CAST(0 AS BIGINT) AS ord, concat_ws(chr(10) || chr(10), '# ' || site,
    '| state | pages | critical | high | medium | low | of |' || chr(10) || '|---|---|---|---|---|---|---|' || chr(10) || '| ' || concat_ws(' | ', label, pages, critical, high, medium, low, '2024-02-01T00:00:00Z') || ' |',
    CASE rank % 3 WHEN 1 THEN 'Searches could not be read: quota used up' WHEN 0 THEN 'Searches (29 days): clicks ' || clicks || ', impressions ' || impressions || ', mean position ' || printf('%.1f', round(position, 1)) END,
    CASE rank % 3 WHEN 0 THEN 'Visits could not be read: quota used up' WHEN 1 THEN 'Visits (29 days): sessions ' || sessions || ', active users ' || active_users END) AS text FROM hd, se, tr
UNION ALL SELECT pp.site, 1, ord, chr(10) || concat_ws(chr(10) || chr(10), '## ' || pp.url || ' (' || status_code || ')',
    CASE WHEN coalesce(lcp, cls, tbt) IS NOT NULL THEN 'Lab (medians of lab runs; visitors may see other values): LCP ' || {_MS('lcp')} || ', CLS ' || {_F3('cls')} || ', TBT ' || {_MS('tbt')} END,
    CASE WHEN coalesce(f_lcp, f_cls, f_inp) IS NOT NULL THEN 'Field (values of real visits over 28 days): LCP ' || {_MS('f_lcp')} || ', CLS ' || {_F3('f_cls')} || ', INP ' || {_MS('f_inp')} END, coalesce(found, 'Nothing found.'))
    FROM pp LEFT JOIN (SELECT site, url, string_agg('* ' || severity || ' `' || rule_id || '`, ' || category || ': ' || {_CELL('current_value')} || ' -> ' || {_CELL('recommended')}, chr(10) ORDER BY {RANK}, rule_ord) AS found
    FROM fs JOIN re USING (rule_id) GROUP BY site, url) f ON f.site = pp.site AND f.url = pp.url
UNION ALL SELECT site, 2, 0, chr(10) || 'This run only read pages.' FROM hd""")
SQL["agg8_report"] = X("SELECT site, pages, critical + high + medium + low AS violations, CASE WHEN rank % 5 <> 1 THEN site || '/robots.txt' ELSE (SELECT arg_min(url, page_id) FROM pg WHERE pg.site = hd.site) END AS first_url FROM hd")

SQL["url1_normalize"] = P("SELECT page_id, norm AS normalized FROM pg")
SQL["url2_origin"] = P("SELECT page_id, site AS origin FROM pg")
SQL["url3_path"] = P("SELECT page_id, path FROM pg")
_UP = "regexp_replace(regexp_replace(" + _u(RAWPATH) + ", '[^/]*$', ''), '[^/]+/$', '')"
SQL["url4_resolve"] = P(f"SELECT page_id, site || {_UP} || 'x/y?a=1' AS relative, site || '/z' AS rooted, CAST(NULL AS VARCHAR) AS other, CASE WHEN regexp_extract(html, '<a href=\"(/[A-Za-z0-9]*)\"', 1) <> '' THEN site || regexp_extract(html, '<a href=\"(/[A-Za-z0-9]*)\"', 1) ELSE site || {_u(RAWPATH)} || {_u(QUERY)} END AS href FROM pg")
_PUBLIC = [ip in ("172.32.0.1", "8.8.8.8", "93.184.216.34", "::ffff:8.8.8.8", "2606:4700:4700::1111") for ip in _IPS]
_PUB = f"list_value({', '.join(str(x).lower() for x in _PUBLIC)})[page_id % {len(_IPS)} + 1]"
SQL["url5_safe"] = P(f"SELECT page_id, page_id % 3 <> 0 AND {_PUB} AS ok, true AS own_ok FROM pg")
SQL["url6_private_ip"] = P(f"SELECT page_id, NOT {_PUB} AS private, true AS host_private FROM pg")
SQL["url7_logical"] = P(f"SELECT page_id, 'http://pages.invalid' || {_u(RAWPATH)} || {_u(QUERY)} AS logical FROM pg")
SQL["url8_finding_key"] = P("SELECT page_id, left(sha256(norm || '|R-TITLE-MISSING|1'), 16) AS finding_key FROM pg")
SQL["snk1b_page_digests"] = P("SELECT url, sha256(html) AS html_sha256, left(html, 500) AS html_excerpt FROM pg")
# The addresses are 1.x.y.z here, all public.
SQL["url9_host_spellings"] = """WITH n AS (SELECT page_id, (page_id * 7919 + 16777216) % 4294967296 AS n FROM pages),
h AS (SELECT page_id, CASE page_id % 6 WHEN 4 THEN '[::ffff:' || lower(to_hex(n >> 16)) || ':' || lower(to_hex(n % 65536)) || ']' WHEN 5 THEN 'xn--bcher-kva.p' || page_id || '.example'
    ELSE (n >> 24) || '.' || ((n >> 16) & 255) || '.' || ((n >> 8) & 255) || '.' || (n & 255) END AS host FROM n),
u AS (SELECT page_id, 'http://' || host || '/b' AS url FROM h)
SELECT page_id, url, url AS by_sql, true AS safe, true AS safe_by_sql, left(sha256(url || '|R|1'), 16) AS key FROM u"""
SQL["udf4_sql_functions"] = P("SELECT page_id, norm AS normalized, left(sha256(norm || '|R-X|1'), 16) AS finding_key, true AS safe FROM pg")

SQL["sig_signals"] = S("""SELECT page_id, CASE WHEN k % 11 <> 0 THEN title END AS raw_title, CASE WHEN k % 22 <> 0 THEN title END AS title, CASE WHEN k % 13 <> 0 THEN h1 WHEN k % 9 = 0 THEN 'Second' END AS h1_text, CASE WHEN k % 3 <> 0 THEN url END AS canonical, CAST((k % 13 <> 0)::INT + (k % 9 = 0)::INT AS BIGINT) AS h1_count, CASE WHEN k % 7 = 0 THEN 'noindex' END AS meta_robots,
    CAST((k % 8 <> 0)::INT AS BIGINT) AS blocks, CASE WHEN k % 2 = 0 THEN 'Article ' || k END AS og_title, CASE WHEN k % 5 <> 0 THEN url END AS og_url, CASE WHEN k % 3 = 0 THEN 'Article ' || k END AS og_description,
    CASE WHEN k % 4 <> 0 THEN 'Article ' || k END AS meta_description, CAST(k % 6 AS BIGINT) AS images_without_alt, true AS body_has_name FROM sn""")
SQL["sig13_signal_diff"] = S("SELECT page_id, 'title' AS field FROM sn WHERE k % 11 = 0 AND k % 22 <> 0 UNION ALL SELECT page_id, 'canonical' FROM sn WHERE k % 3 = 2 UNION ALL SELECT page_id, 'meta_robots' FROM sn WHERE k % 7 = 0 AND k % 14 <> 0")
SQL["sig14_indexing_gap"] = S("SELECT page_id, k % 3 = 2 OR (k % 11 = 0 AND k % 22 <> 0) OR (k % 7 = 0 AND k % 14 <> 0) AS gap FROM sn")
for _i, _r in enumerate(RULE_IDS):
    SQL[rule_key(_i)] = _with(PG, SN, LAB, _viol("v", lab=_r.startswith("R-CWV")), q=f"SELECT url, rule_id, category, severity, current_value FROM v WHERE rule_id = '{_r}'")
SQL["r24_ai_crawler_policy"] = P("SELECT site, site || '/robots.txt' AS url, 'R-AI-CRAWLER-POLICY' AS rule_id, 'low' AS severity, 'geo' AS category FROM st WHERE rank % 5 <> 1")
G = lambda q: _with(PG, SN, LIST, GAP, q=q)
SQL["r25_sitemap_missing_url"] = G("SELECT site, 'R-SITEMAP-MISSING-URL' AS rule_id, 'medium' AS severity, CAST(count(*) AS VARCHAR) AS current_value FROM gap GROUP BY site")
SQL["r26_jsonld_website_missing"] = S("SELECT site, 'R-JSONLD-WEBSITE-MISSING' AS rule_id, 'low' AS severity, CAST(count(*) AS VARCHAR) AS current_value FROM sn WHERE status_code = 200 GROUP BY site HAVING bool_and(k % 8 = 0)")
SQL["jld1_nodes"] = S("""SELECT page_id, CAST(CASE WHEN k % 8 IN (0, 3) THEN 0 ELSE 1 END AS BIGINT) AS nodes, CASE k % 8 WHEN 1 THEN 'WebPage:-:false' WHEN 2 THEN 'FAQPage+WebPage:-:false' WHEN 4 THEN 'WebPage:-:false'
    WHEN 5 THEN 'Product:Article ' || k || ':true' WHEN 6 THEN 'Product:Article ' || k || ':false' WHEN 7 THEN 'Product:no such thing here:true' ELSE '' END AS told FROM sn""")
SQL["jld2_types"] = S("SELECT page_id, CASE k % 8 WHEN 0 THEN '' WHEN 1 THEN 'WebPage' WHEN 2 THEN 'FAQPage,WebPage' WHEN 3 THEN '' WHEN 4 THEN 'WebPage' ELSE 'Product' END AS types FROM sn")
SQL["jld3_status"] = S("SELECT page_id, CASE k % 8 WHEN 0 THEN '' WHEN 3 THEN 'malformed_json' WHEN 4 THEN 'missing_context_or_type' ELSE 'valid' END AS status FROM sn")

SQL["agg1_lab_vitals"] = _with(PG, LAB, q="SELECT url, lcp_ms, tbt_ms, runs_completed FROM lab")
_SEV = ", ".join(f"count(*) FILTER (severity = '{x}') AS {x}" for x in ("critical", "high", "medium", "low"))
SQL["agg2_severity_counts"] = VQ(f"SELECT site, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(total, 0) AS total, pages FROM (SELECT site, count(*) AS pages FROM pg GROUP BY site) LEFT JOIN (SELECT site, {_SEV}, count(*) AS total FROM v GROUP BY site) USING (site)")
SQL["agg3_labels"] = VQ(f"SELECT site, coalesce(label, 'good') AS label, false AS no_pages FROM (SELECT DISTINCT site FROM pg) LEFT JOIN (SELECT site, {LABEL} AS label FROM v GROUP BY site) USING (site)")
SQL["agg4_baseline"] = _with(PG, SNB, VB, CUR, q="SELECT finding_key, status, severity FROM cu")
_DAYS = "CAST(ts AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-30'"
SQL["agg5_search_summary"] = f"""WITH d AS (SELECT CAST(ts AS DATE) AS date, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'view') AS i, avg(event_id) AS p FROM events WHERE {_DAYS} GROUP BY 1)
SELECT CAST(sum(c) AS BIGINT) AS clicks, CAST(sum(i) AS BIGINT) AS impressions, round(sum(p * i) / sum(i), 6) AS position FROM d"""
SQL["agg5b_traffic_summary"] = f"""WITH d AS (SELECT CAST(ts AS DATE) AS date, count(*) AS n, count(DISTINCT user_id) AS u FROM events WHERE {_DAYS} GROUP BY 1)
SELECT CAST(sum(CASE WHEN day(date) % 10 = 0 THEN 0 ELSE n END) AS DOUBLE) AS sessions, CAST(sum(u) AS DOUBLE) AS active_users FROM d"""
SQL["agg6_all_pages_lack_jsonld"] = S("SELECT site, bool_and(k % 8 = 0) AS every, count(*) AS n FROM sn WHERE status_code = 200 GROUP BY site")
SQL["agg7_token_lists"] = P("""SELECT site, rank % 5 <> 0 AS robots_found, CASE rank % 5
    WHEN 3 THEN 'training - blocked: GPTBot / allowed: ClaudeBot, Google-Extended, CCBot, Bytespider; ai_search - allowed: OAI-SearchBot, Claude-SearchBot, PerplexityBot; user_fetch - allowed: ChatGPT-User, Claude-User, Perplexity-User'
    WHEN 4 THEN 'training - blocked: GPTBot, ClaudeBot, Google-Extended, CCBot, Bytespider; ai_search - blocked: OAI-SearchBot, Claude-SearchBot, PerplexityBot; user_fetch - blocked: ChatGPT-User, Claude-User, Perplexity-User'
    ELSE 'training - allowed: GPTBot, ClaudeBot, Google-Extended, CCBot, Bytespider; ai_search - allowed: OAI-SearchBot, Claude-SearchBot, PerplexityBot; user_fetch - allowed: ChatGPT-User, Claude-User, Perplexity-User' END AS summary FROM st WHERE rank % 5 <> 1""")
SQL["agg_rollup_severity"] = VQ("SELECT site, category, severity, count(*) AS n FROM v GROUP BY ROLLUP (site, category, severity)")
R = lambda polite, q: _with(PG, SN, NUM, ED, MAY, _reach(polite), q=q)
SQL["agg10_skipped"] = R(True, "SELECT site, count(*) FILTER (visit_status = 'skipped_by_robots') AS skipped, count(*) FILTER (visit_status = 'visited') AS visited FROM rc GROUP BY site")
SQL["grf1_crawl_reach"] = R(True, "SELECT site, norm AS url, depth, CAST(ord AS BIGINT) AS ord, visit_status FROM rc")
SQL["grf1b_single_page"] = _with(PG, SN, NUM, MAY, q="SELECT nu.site, nu.url, CAST(status_code AS INTEGER) AS status_code FROM nu JOIN may m ON nu.site = m.site AND nu.url = m.url WHERE n = 1 AND allowed")
SQL["grf1c_own_site_scan"] = R(False, "SELECT site, norm AS url, depth FROM rc")
SQL["join13_frontier"] = R(False, "SELECT site, depth, count(*) AS pages, arg_min(norm, ord) AS first_url, arg_max(norm, ord) AS last_url FROM rc GROUP BY site, depth")
L = lambda q: _with(PG, LIST, q=q)
SQL["grf2_sitemap_urls"] = L("SELECT site, ord, url, (max(ord) OVER (PARTITION BY site)) > 200 AS truncated FROM li WHERE ord <= 201 QUALIFY ord <= 200")
SQL["grf3_sitemap_candidates"] = P("SELECT site, CASE WHEN rank % 5 = 3 THEN 'https://maps.example/sitemap.xml' ELSE site || '/sitemap.xml' END AS sitemap_url FROM st")
SQL["grf4_seed_filter"] = L("SELECT site, ord, url, 1 AS depth FROM li WHERE ord < 20 AND ord % 3 <> 0")
SQL["rob1_rules"] = P("""SELECT site, '*' AS ua_token, 'disallow' AS kind, '/en/' AS pattern FROM st WHERE rank % 5 = 2
    UNION ALL SELECT site, ua, kind, pattern FROM st, (VALUES ('gptbot', 'disallow', '/'), ('*', 'allow', '/'), ('*', 'crawl_delay', '2'), (NULL, 'sitemap', 'https://maps.example/sitemap.xml')) t(ua, kind, pattern) WHERE rank % 5 = 3
    UNION ALL SELECT site, '*', kind, pattern FROM st, (VALUES ('disallow', '/'), ('allow', '/fr/')) t(kind, pattern) WHERE rank % 5 = 4""")
SQL["rob2_url_allowed"] = _with(PG, MAY, q="SELECT site, url, allowed FROM may")


def _wild() -> str:
    """The longest rule that matches, an allow among equals: the largest of 2 * length + 1 for an allow."""
    rx = lambda p: "^" + "".join(".*" if c == "*" else c if c.isalnum() or c in "/-=#" else "\\" + c for c in p.removesuffix("$")) + "$" * p.endswith("$")
    one = lambda k, p: f"CASE WHEN regexp_matches(path, '{rx(p)}') THEN {2 * len(p) + (k == 'allow')} ELSE -1 END"
    best = [f"greatest({', '.join(one(*r) for r in w)})" for w in WILD]
    path = "regexp_replace(regexp_replace(url, '^[A-Za-z]+://[^/?#]*', ''), '#.*$', '')"
    return f"""SELECT site, url, best = -1 OR best % 2 = 1 AS allowed FROM (SELECT site, url, CASE WHEN rank % 2 = 0 THEN {best[0]} ELSE {best[1]} END AS best
    FROM (SELECT DISTINCT site, url, rank, CASE WHEN {path} LIKE '/%' THEN {path} ELSE '/' || {path} END AS path FROM pg JOIN st USING (site)))"""


SQL["rob4_wildcard_rules"] = P(_wild())
SQL["rob3_ai_bot_access"] = _with(PG, BOTS, ACC, q="SELECT * FROM acc")
SQL["smp1_entries"] = P("""SELECT site, site || CASE WHEN rank % 2 = 0 THEN '/part' || (page_id % 2) || '.xml' ELSE '/sitemap.xml' END AS sitemap_url, 'urlset' AS kind,
    CAST(row_number() OVER (PARTITION BY site, CASE WHEN rank % 2 = 0 THEN page_id % 2 ELSE 0 END ORDER BY page_id) - 1 AS INTEGER) AS ord, url AS loc FROM pg JOIN st USING (site) WHERE page_id % 4 <> 0 AND rank % 7 <> 0
    UNION ALL SELECT site, site || '/sitemap.xml', 'index', n, site || '/part' || n || '.xml' FROM st, (VALUES (0), (1)) t(n) WHERE rank % 2 = 0 AND rank % 7 <> 0""")
SQL["smp2_odd_documents"] = P("SELECT site, '/' || page_id || '.xml' AS sitemap_url, CASE WHEN page_id % 8 = 7 THEN 'index' ELSE 'urlset' END AS kind, CAST(0 AS INTEGER) AS ord, CASE WHEN page_id % 8 = 5 THEN url || '&amp;x' ELSE url END AS loc FROM pg WHERE page_id % 8 NOT IN (2, 4, 6)")
SQL["fld1_field_vitals"] = P("SELECT url, event_id, CASE WHEN event_id % 10 <> 0 THEN floor(value) END AS field_lcp_ms, floor(value) / 100 AS field_cls, floor(value) AS field_inp_ms FROM events JOIN pg ON event_id % n_pages = page_id WHERE event_id % 17 <> 0")
SQL["fld2_search_metrics"] = "SELECT CAST(event_id AS VARCHAR) AS property_scope, CASE WHEN event_id % 7 <> 0 THEN CAST(event_id AS DOUBLE) ELSE 0 END AS clicks, CAST(0 AS DOUBLE) AS impressions, CASE WHEN event_id % 7 <> 0 THEN value ELSE 0 END AS position FROM events"
SQL["fld3_traffic_metrics"] = "SELECT CAST(event_id AS VARCHAR) AS property_id, CASE WHEN event_id % 7 <> 0 THEN CAST(event_id AS DOUBLE) ELSE 0 END AS sessions, CASE WHEN event_id % 7 <> 0 THEN CAST(user_id AS DOUBLE) ELSE 0 END AS active_users FROM events"
SQL["join1_lab"] = _with(PG, SN, LAB, q="SELECT page_id, CASE WHEN depth = 0 THEN lcp_ms END AS lcp_ms FROM sn LEFT JOIN lab USING (site, url)")
SQL["join2_field"] = _with(PG, SN, FIELD, q="SELECT page_id, CASE WHEN depth = 0 THEN f_lcp END AS field_lcp_ms, CASE WHEN depth = 0 THEN f_cls END AS field_cls, CASE WHEN depth = 0 THEN f_inp END AS field_inp_ms FROM sn LEFT JOIN fd ON fd.site = sn.site AND fd.url = sn.url")
SQL["join3_url_rules"] = _with(PG, MAY, q="SELECT site, state, count(*) FILTER (allowed) AS allowed, count(*) AS urls FROM may GROUP BY ALL")
SQL["join4_bots"] = _with(PG, BOTS, ACC, q="SELECT token, count(*) FILTER (allowed) AS allowed, count(*) AS sites FROM acc GROUP BY token")
D = lambda q: _with(PG, SN, V, SNB, VB, BASE, CUR, REG, q=q)
SQL["join5_regressions"] = D("SELECT finding_key, kind FROM re")
SQL["join5b_resolved"] = D("SELECT finding_key FROM ba WHERE NOT EXISTS (SELECT 1 FROM cu WHERE cu.site = ba.site AND cu.finding_key = ba.finding_key)")
SQL["join6_sitemap_gap"] = G("SELECT site, path FROM gap")
SQL["join6b_proposed_urls"] = G("SELECT site, path, CASE WHEN EXISTS (SELECT 1 FROM li WHERE li.site = gap.site) THEN site || path END AS url FROM gap")
_RISK = "CASE WHEN rule_id IN ('R-CANONICAL-MISSING', 'R-CANONICAL-JS-ONLY', 'R-OG-BASIC-MISSING', 'R-NOINDEX-DETECTED', 'R-TITLE-MISSING') THEN 'gated' END"
SQL["join8_catalog"] = VQ(f"SELECT finding_key, rule_id, {_RISK} AS risk_level FROM v")
SQL["join9_page_values"] = VQ("SELECT site, url, url AS canonical FROM v WHERE rule_id = 'R-CANONICAL-JS-ONLY'")
SQL["join11_decorated"] = D("SELECT finding_key, kind, rule_id, severity FROM re")
SQL["join12_index_children"] = L("SELECT site, count(*) AS urls, sha256(string_agg(url, ' ' ORDER BY ord)) AS urls_sha256 FROM li WHERE ord <= 200 GROUP BY site")
SQL["win1_latest_runs"] = _with(PG, RUNS, q="SELECT project_id, max(id) AS id FROM runs WHERE finished_at IS NOT NULL GROUP BY project_id")
SQL["win2_latest_baselines"] = _with(PG, RUNS, q="SELECT project_id, max(id) AS id FROM runs GROUP BY project_id")
SQL["win3_latest_projects"] = _with(PG, RUNS, q="SELECT project_id % 5 AS target, max(id) AS id FROM runs GROUP BY 1")
SQL["win4_impact_order"] = VQ(f"SELECT url, rule_id, CAST(row_number() OVER (PARTITION BY site, url ORDER BY {RANK}, rule_ord) AS INTEGER) AS place FROM v")
SQL["win5_first_violation"] = VQ("SELECT url, current_value FROM v WHERE rule_id = 'R-JSONLD-INVALID'")
SQL["win6_site_titles"] = S("SELECT site, CASE WHEN arg_min(k % 22, row(path <> '/', page_id)) <> 0 THEN arg_min(title, row(path <> '/', page_id)) END AS site_title FROM sn GROUP BY site")
SQL["win7_first_discovery"] = _with(PG, SN, NUM, q="SELECT a.site, b.url, CAST(min(t.pos) AS BIGINT) AS pos FROM nu a, (VALUES (0), (1), (2)) t(pos) JOIN nu b ON a.site = b.site AND b.n = CASE t.pos WHEN 0 THEN a.n * 2 WHEN 1 THEN a.n * 2 + 1 ELSE a.n - 3 END GROUP BY a.site, b.url")
SQL["win8_page_budget"] = P("SELECT site, url, CAST(n AS INTEGER) AS n FROM (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY page_id) AS n FROM pg) WHERE n <= 3")
SQL["win9_sitemap_caps"] = P("""SELECT site, CAST(o AS INTEGER) AS ord, url, most > 2 OR rank % 2 = 0 AS truncated FROM (SELECT *, max(o) OVER (PARTITION BY site) AS most FROM (
    SELECT site, rank, url, row_number() OVER (PARTITION BY site ORDER BY page_id) AS o FROM pg JOIN st USING (site) WHERE page_id % 4 <> 0 AND rank % 7 <> 0 AND (rank % 2 = 1 OR page_id % 2 = 0))) WHERE o <= 2""")
SQL["win10_schedule"] = P("SELECT url, page_id AS ord, CAST(1706745600000 + 500 * (row_number() OVER (PARTITION BY site ORDER BY page_id) - 1) AS BIGINT) AS starts_ms FROM pg")
SQL["win11_history"] = D("SELECT vb.id, re.kind FROM re JOIN vb ON re.finding_key = vb.finding_key")
SQL["win12_listing"] = D(f"SELECT site, rule_id, url, CAST(row_number() OVER (PARTITION BY site ORDER BY {RANK}, rule_ord, url) AS INTEGER) AS place FROM re")
SQL["set1_all_violations"] = _with(PG, SN, V, LIST, GAP, q="""SELECT rule_id, count(*) AS n, min(url) AS first_url, max(url) AS last_url FROM (SELECT rule_id, url FROM v UNION ALL SELECT 'R-AI-CRAWLER-POLICY', site || '/robots.txt' FROM st WHERE rank % 5 <> 1
    UNION ALL SELECT DISTINCT 'R-SITEMAP-MISSING-URL', site || '/sitemap.xml' FROM gap UNION ALL SELECT 'R-JSONLD-WEBSITE-MISSING', site || '/' FROM sn WHERE status_code = 200 GROUP BY site HAVING bool_and(k % 8 = 0)) GROUP BY rule_id""")
SQL["set2_distinct_paths"] = P("SELECT DISTINCT site, path FROM pg")
SQL["set3_except"] = G("SELECT site, count(*) AS missing FROM gap GROUP BY site")
_CAN = "SELECT site, url, finding_key, path FROM (SELECT v.*, pg.path FROM v JOIN pg USING (page_id)) WHERE rule_id = 'R-CANONICAL-MISSING'"
SQL["rem1_catalog"] = _with(PG, SN, V, LIST, GAP, q=f"""SELECT DISTINCT rule_id, {_RISK} AS risk_level FROM v WHERE {_RISK} IS NOT NULL UNION ALL SELECT 'R-AI-CRAWLER-POLICY', 'gated' FROM st WHERE rank = 0 UNION ALL SELECT DISTINCT 'R-SITEMAP-MISSING-URL', 'add_safe' FROM gap
    UNION ALL SELECT DISTINCT 'R-JSONLD-WEBSITE-MISSING', 'gated' FROM (SELECT site FROM sn WHERE status_code = 200 GROUP BY site HAVING bool_and(k % 8 = 0))""")
SQL["rem2_sitemap"] = G("""SELECT site, 'auto' AS approval_status, '["' || string_agg(path, '","' ORDER BY path) || '"]' AS marker FROM gap GROUP BY site""")
SQL["rem3_canonical"] = VQ(f"SELECT site, url, 'file_edit' AS fix_type, 'pending' AS approval_status, path AS marker FROM ({_CAN})")
SQL["rem4_js_canonical"] = VQ("SELECT site, url, 'file_edit' AS fix_type, 'pending' AS approval_status, url AS marker FROM v WHERE rule_id = 'R-CANONICAL-JS-ONLY'")
SQL["rem5_og"] = VQ("SELECT url, CASE WHEN k % 22 <> 0 OR k % 3 <> 0 THEN 'file_edit' ELSE 'report_only' END AS fix_type, CASE WHEN k % 3 <> 0 THEN url END AS og_url, CASE WHEN k % 22 <> 0 THEN title END AS og_title FROM v WHERE rule_id = 'R-OG-BASIC-MISSING'")
SQL["rem6_noindex"] = VQ("SELECT site, url, 'file_edit' AS fix_type, 'pending' AS approval_status, 'index: true' AS marker FROM v WHERE rule_id = 'R-NOINDEX-DETECTED'")
SQL["rem7_ai_policy"] = P("SELECT site, CASE WHEN rank % 5 = 0 THEN 'file_edit' ELSE 'report_only' END AS fix_type, CASE WHEN rank % 5 = 0 THEN 'disallow: GPTBot, ClaudeBot, Google-Extended, CCBot, Bytespider' END AS marker FROM st WHERE rank % 5 <> 1")
SQL["rem9_title"] = VQ("SELECT url, CASE WHEN k % 13 = 0 AND k % 9 <> 0 THEN 'report_only' ELSE 'file_edit' END AS fix_type, CASE WHEN k % 13 <> 0 THEN h1 WHEN k % 9 = 0 THEN 'Second' END AS marker FROM v WHERE rule_id = 'R-TITLE-MISSING'")
_THIRD = "CAST('0x' || left(finding_key, 8) AS BIGINT) % 3"
_DEC = f"CASE {_THIRD} WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END"
SQL["rem11_decide"] = VQ(f"SELECT {_DEC} AS approval_status, {_THIRD} < 2 AS changed, count(*) AS n FROM ({_CAN}) GROUP BY ALL")
SQL["rem12_apply"] = VQ(f"SELECT {_DEC} AS approval_status, CASE {_THIRD} WHEN 0 THEN 'fixed' ELSE 'open' END AS finding_status, count(*) AS n, count(*) FILTER ({_THIRD} = 0) AS applied FROM ({_CAN}) GROUP BY ALL")
SQL["rem13_rollback"] = VQ(f"SELECT {_DEC} AS approval_status, CASE {_THIRD} WHEN 0 THEN 'reverted' ELSE 'open' END AS finding_status, count(*) AS n, CAST(0 AS BIGINT) AS applied FROM ({_CAN}) GROUP BY ALL")
SQL["rem14_outcomes"] = P("SELECT site, list_value('applied', 'already_applied', 'build_failed', 'structure_changed')[page_id % 4 + 1] AS outcome, count(*) AS n, count(*) FILTER (page_id % 4 < 2) AS successes FROM pg GROUP BY ALL")
SQL["rem16_acknowledge"] = VQ("SELECT CASE WHEN (site, finding_key) IN (SELECT (site, finding_key) FROM v WHERE page_id % 3 = 0) THEN 'acknowledged' ELSE 'open' END AS status, count(*) AS n FROM v GROUP BY ALL")
SQL["rem16_acknowledge"] = VQ("SELECT CASE WHEN a THEN 'acknowledged' ELSE 'open' END AS status, count(*) AS n FROM (SELECT bool_or(page_id % 3 = 0) OVER (PARTITION BY site, finding_key) AS a FROM v) GROUP BY ALL")
SQL["rem17_policy"] = "SELECT page_id, page_id % 5 <> 0 AND page_id % 7 <> 0 AS allowed, CASE WHEN page_id % 5 = 0 THEN 'archived' WHEN page_id % 7 = 0 THEN 'disabled' END AS reason, concat_ws(',', CASE WHEN page_id % 2 <> 0 THEN 'no license' END, CASE WHEN page_id % 3 <> 0 THEN 'no contributing notes' END) AS warnings FROM pages"
SQL["rem18_request_states"] = "SELECT CASE WHEN page_id % 4 = 0 THEN 'merged' WHEN page_id % 3 = 0 THEN CASE WHEN page_id % 2 = 0 THEN 'closed' ELSE 'merged' END ELSE 'open' END AS state, count(*) AS n FROM pages GROUP BY 1"
SQL["fn_text"] = r"SELECT doc_id, sha256(left(coalesce(text, ''), 500)) AS excerpt_sha256, 'x/' || regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, 'a b?k=***&***' AS masked, sha256(replace(replace(text, 'and the', '***'), 'and%20the', '***')) AS masked_sha256, sha256('\u003c/script>' || replace(text, '<', '\u003c')) AS safe_sha256 FROM documents"
SQL["fn_table_cell"] = r"SELECT doc_id, sha256(coalesce(replace(replace(text, '|', '\|'), chr(10), ' '), '-')) AS cell_sha256 FROM documents"
SQL["fn_numbers"] = "SELECT event_id, CAST(round(value) AS BIGINT) AS rounded, value / 100 AS hundredth, printf('%.1f', round(value, 1)) AS decimals FROM events"
SQL["udf1_extra_rule"] = S("SELECT url, 'X-TEAPOT' AS rule_id, 'moved' AS current_value FROM sn WHERE status_code = 301")
SQL["udf2_one_parse"] = "SELECT page_id, CAST(len(regexp_extract_all(html, '<h1>')) AS BIGINT) AS h1_count, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS hrefs FROM pages"
SQL["str1_stream_findings"] = VQ("SELECT rule_id, count(*) AS n FROM v GROUP BY rule_id")
SQL["str2_alerts_once"] = _with(PG, SNB, VB, q="SELECT DISTINCT finding_key FROM vb")
SQL["str3_stream_alerts"] = D("SELECT DISTINCT finding_key FROM re")

# What the survey's remaining rows return.
_S = r"[\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
SQL["fn_space"] = f"""SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '^{_S}', ''), '{_S}$', '')) AS trimmed_sha256, sha256(regexp_replace(regexp_replace(regexp_replace('a b' || text, '{_S}', ' ', 'g'), '^ ', ''), ' $', '')) AS collapsed_sha256 FROM documents"""
SQL["fn_enum"] = "SELECT event_id, event_type FROM events"
SQL["sig15_links"] = """SELECT page_id, count(DISTINCT h) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS h FROM pages) GROUP BY page_id"""
SQL["grf5_page_links"] = _with(PG, SN, MAY, NUM, ED, LIST, _reach(True, True), q="SELECT site, norm AS url, depth, ord, visit_status FROM rc")
SQL["agg9b_sitemap_cut"] = R(True, "SELECT site, count(*) >= 200 OR (SELECT count(*) FROM pg WHERE pg.site = rc.site AND page_id % 4 <> 0) > 5 AND any_value(rank) % 7 <> 0 AS truncated FROM rc JOIN st USING (site) GROUP BY site")
SQL["agg9_truncation"] = R(True, "SELECT site, count(*) >= 5 AS truncated, least(count(*), 5) AS met FROM rc GROUP BY site")
#: Every finding with what its rule proposes.
PLAN = f"""pl AS (SELECT *, CASE WHEN marker IS NULL THEN 'report_only' ELSE 'file_edit' END AS fix_type, CASE WHEN marker IS NULL THEN NULL WHEN rule_id = 'R-SITEMAP-MISSING-URL' THEN 'add_safe' ELSE 'gated' END AS risk_level,
    CASE WHEN marker IS NULL THEN NULL WHEN rule_id = 'R-SITEMAP-MISSING-URL' THEN 'auto' ELSE 'pending' END AS approval_status FROM (
    SELECT site, url, rule_id, finding_key, CASE rule_id WHEN 'R-CANONICAL-MISSING' THEN path WHEN 'R-CANONICAL-JS-ONLY' THEN url WHEN 'R-OG-BASIC-MISSING' THEN CASE WHEN k % 22 <> 0 OR k % 3 <> 0 THEN 'og' END WHEN 'R-NOINDEX-DETECTED' THEN 'index: true'
        WHEN 'R-TITLE-MISSING' THEN CASE WHEN k % 13 <> 0 OR k % 9 = 0 THEN 'h1' END END AS marker FROM v
    UNION ALL SELECT site, site || '/robots.txt', 'R-AI-CRAWLER-POLICY', left(sha256(site || '/robots.txt|R-AI-CRAWLER-POLICY|1'), 16), CASE WHEN rank % 5 = 0 THEN 'policy' END FROM st WHERE rank % 5 <> 1
    UNION ALL SELECT DISTINCT site, site || '/sitemap.xml', 'R-SITEMAP-MISSING-URL', left(sha256(site || '/sitemap.xml|R-SITEMAP-MISSING-URL|1'), 16), 'paths' FROM gap
    UNION ALL SELECT site, site || '/', 'R-JSONLD-WEBSITE-MISSING', left(sha256(site || '/|R-JSONLD-WEBSITE-MISSING|1'), 16), site_title FROM wt)),
pn AS (SELECT pl.*, CASE WHEN approval_status = 'auto' THEN 'safe' ELSE 'review' END AS bucket, 'site/fix-' || lower(rule_id) AS branch_name FROM pl JOIN st USING (site) WHERE approval_status IS NOT NULL AND NOT (rank % 2 = 0 AND rule_id = 'R-CANONICAL-MISSING'))"""
WEBSITE = """wt AS (SELECT site, site_title FROM (SELECT site, bool_and(k % 8 = 0) FILTER (status_code = 200) AS bare, CASE WHEN arg_min(k % 22, row(path <> '/', page_id)) <> 0 THEN arg_min(title, row(path <> '/', page_id)) END AS site_title FROM sn GROUP BY site) WHERE bare)"""
PL = lambda q: _with(PG, SN, V, LIST, GAP, WEBSITE, PLAN, q=q)
SQL["rem8_website"] = PL("SELECT site, fix_type, approval_status, marker AS name FROM pl WHERE rule_id = 'R-JSONLD-WEBSITE-MISSING'")
SQL["rem10_add_only"] = PL("SELECT rule_id, count(*) AS n FROM pl WHERE marker IS NOT NULL AND rule_id <> 'R-NOINDEX-DETECTED' GROUP BY rule_id")
SQL["set4_split"] = PL("SELECT fix_type, count(*) AS n FROM pl GROUP BY fix_type")
SQL["udf3_fixer_rows"] = PL("SELECT rule_id, risk_level, count(*) AS n FROM pl GROUP BY ALL")
SQL["join7_applicable"] = PL(f"SELECT pl.finding_key, pl.rule_id, v.severity FROM pl JOIN v ON v.site = pl.site AND v.finding_key = pl.finding_key WHERE pl.rule_id = 'R-CANONICAL-MISSING' AND CAST('0x' || left(pl.finding_key, 8) AS BIGINT) % 3 = 0")
SQL["join10_open_requests"] = PL("SELECT bucket, branch_name, count(*) AS n FROM pn GROUP BY ALL")
SQL["rem15_buckets"] = PL("SELECT bucket, count(*) AS n FROM pn GROUP BY bucket")
SQL["agg11_request_content"] = PL("SELECT site, bucket, count(*) AS n, CASE WHEN count(*) = 1 THEN 'Proposed fix: ' || min(rule_id) ELSE 'Proposed fixes: ' || count(*) END AS title FROM pn GROUP BY site, bucket")
SQL["snk5b_regression_rows"] = D("SELECT site, 'B' AS run_id, finding_key, kind FROM re")
SQL["snk5c_remediation_rows"] = PL("SELECT site, rule_id, finding_key, risk_level, approval_status FROM pl WHERE marker IS NOT NULL")
SQL["snk5d_request_rows"] = PL("SELECT DISTINCT site, bucket, branch_name, 'open' AS state FROM pn")
# Windows end before the watermark, which is a day behind the latest event.
SQL["str4_stream_vitals"] = "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start, 'u' || (event_id % 10) AS url, count(*) AS runs FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY ALL"

_HALF = "CAST('0x' || substr(finding_key, 9, 6) AS BIGINT) % 2"
SQL["rem19_stored_states"] = VQ(f"SELECT finding_key, {_DEC} AS approval_status, {_THIRD} = 0 AND {_HALF} = 1 AS applied, CASE WHEN {_THIRD} <> 0 THEN 'open' WHEN {_HALF} = 0 THEN 'reverted' ELSE 'fixed' END AS finding_status FROM (SELECT DISTINCT finding_key FROM ({_CAN}))")
SQL["rem20_stored_requests"] = P("SELECT page_id AS id, site, 'b' || (page_id % 9) AS branch_name, CASE WHEN page_id % 4 = 0 THEN 'merged' WHEN page_id % 3 = 0 THEN CASE WHEN page_id % 2 = 0 THEN 'closed' ELSE 'merged' END ELSE 'open' END AS state FROM pg")
SQL["rem21_stored_acknowledgements"] = VQ("SELECT site, finding_key, CASE WHEN bool_or(page_id % 3 = 0) THEN 'acknowledged' ELSE 'open' END AS status, arg_max(severity, id) AS severity FROM v GROUP BY site, finding_key")
SQL["join10b_live_requests"] = PL("SELECT pn.site, bucket, branch_name, finding_key FROM pn JOIN st USING (site) WHERE NOT (st.rank % 3 = 1 AND rule_id = 'R-NOINDEX-DETECTED')")
SQL["agg11b_request_lines"] = PL("SELECT site, bucket, '- ' || rule_id || ' (' || risk_level || ') ' || url AS line FROM pn")
SQL["str4b_sliding_medians"] = """WITH w AS (SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) - k * 86400 AS window_start, 'u' || (event_id % 10) AS url, value FROM events, (SELECT unnest([0, 1]) AS k))
SELECT window_start, url, quantile_disc(value, 0.5) AS lcp_ms, count(*) AS runs FROM w WHERE window_start + 2 * 86400 <= (SELECT epoch(max(ts)) - 86400 FROM events) GROUP BY window_start, url"""
SQL["rem2b_sitemap_parts"] = _with(PG, SN, LIST, GAP, q="""SELECT site, CAST(place // 5 AS INTEGER) AS part, count(*) AS n, '[' || string_agg('"' || path || '"', ',' ORDER BY path) || ']' AS marker
FROM (SELECT site, path, row_number() OVER (PARTITION BY site ORDER BY path) - 1 AS place FROM gap) GROUP BY site, place // 5""")
SQL["src1b_snapshot_scan"] = S("SELECT url, CAST(status_code AS INTEGER) AS status_code FROM sn")
SQL["str1b_batches_stored_once"] = VQ("SELECT url, rule_id, finding_key, severity FROM v")
SQL["str2b_late_rows"] = _with(PG, SNB, VB, q="SELECT DISTINCT finding_key FROM vb WHERE page_id % 3 < 2")
SQL["join1b_bucketed"] = _with(PG, SN, LAB, q="SELECT url, depth, CASE WHEN depth = 0 THEN lcp_ms END AS lcp_ms, CASE WHEN depth = 0 THEN tbt_ms END AS tbt_ms FROM sn LEFT JOIN lab USING (site, url)")
SQL["set4b_split_rows"] = PL("SELECT site, finding_key, rule_id, risk_level, fix_type, approval_status FROM pl")
SQL["rem15b_bucket_rows"] = PL("SELECT site, bucket, branch_name, finding_key FROM pn")
SQL["rem10b_add_only_rows"] = PL("SELECT site, rule_id, finding_key FROM pl WHERE marker IS NOT NULL AND rule_id NOT IN ('R-NOINDEX-DETECTED', 'R-TITLE-MISSING')")


def _percent(x: str) -> str:
    """Latin-1 letters beyond ASCII, percent-encoded."""
    for k in range(0xC0, 0x100):
        x = f"replace({x}, '{chr(k)}', '{''.join(f'%{b:02X}' for b in chr(k).encode())}')"
    return x


# All references of the pages are rooted paths.
SQL["sig15b_link_rows"] = P(f"""SELECT DISTINCT page_id, {_u(NORM, "u")} AS link FROM (SELECT page_id, site || {_percent("replace(h, '&amp;', '&')")} AS u
    FROM (SELECT page_id, site, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS h FROM pg))""")
