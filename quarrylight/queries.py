"""Named queries over the driver's tables, each with the same question in DuckDB's SQL.

Code fixtures are strings built from table keys by expressions that mean the
same in both dialects, so what a query must find is a function of the key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import SPACES, html_escape, is_base64, relative_age, remote_name, with_spaces
from .functions.versions import version_number
from .operators import chunks, dedupe, enrich, fingerprint, hosts, libraries, routes, summary
from .operators.libraries import ADVISORIES
from .operators.rules import CATEGORIES, EXPLOITS, RULES, SEVERITIES, URL_NOISE, Rule
from .operators.scan import is_noise, scan_entropy, scan_rules, sources_of
from .operators.syntax import scan_syntax
from .plans.analyze import analyze, findings, findings_raw
from .sinks import reports, store
from .sources import files
from .sources import maps as source_maps
from .sources import traces as source_traces

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# One line of code for each rule; k is the key as text, h its MD5.
SNIPPETS = (
    """concat('var u = "https://h', k, '.example.org/p', k, '"; v = "/v1/a', k, '";')""", """concat('load("api/v', k, '/items", "./x', k, '.js", "//cdn', k, '.example.net/a")')""",
    """concat('ip = 10.0.', cast(p_partkey % 256 as string), '.', cast(p_partkey % 250 as string))""", """concat('mail = user', k, '@mail.example.com')""",
    """concat('x="AKIA', upper(substr(h, 1, 16)), '"; k=AKIA', upper(substr(h, 3, 16)), ';')""", """concat('g = "AIza', substr(concat(h, h), 1, 35), '"')""",
    """concat('t = "ghp_', substr(concat(h, h), 1, 36), '"')""", """concat('s = "xoxb-', h, '"')""", """concat('p = "sk_live_', h, '"')""", """concat('j = "eyJ', h, '.eyJ', h, '.', h, '"')""",
    """'-----BEGIN RSA PRIVATE KEY-----'""", """concat('db = "postgres://u:p@db', k, '/x"')""", """concat('const apiToken = "', h, '";')""", """concat('a("Bearer ', h, '"); b("Bearer ".concat("', h, '"))')""",
    """concat('Authorization: "Bearer ', h, '"')""", """concat('h = "', h, h, '"')""", """concat('document.write (x', k, '); var f = function (a) {}; eval(y)')""", """concat('e', k, '.innerHTML += q')""",
    """concat('w', k, '.postMessage(m); addEventListener("message", f)')""", """concat('o.__proto__.a', k, ' = 1')""", """concat('<b dangerouslySetInnerHTML={x', k, '}>')""", """concat('s.bypassSecurityTrustHtml', k, '(x)')""",
    """concat('localStorage.getItem("k', k, '"); sessionStorage["a"]')""", """concat('document.cookie = "a', k, '"')""", """concat('f("backup', k, '.sql")')""", """concat('r("/etc/passwd', k, '")')""",
    """concat('//# sourceMappingURL=a', k, '.js.map')""", """concat('s("https://x', k, '.sentry.io/1")')""", """concat('b("bucket', k, '.s3.amazonaws.com")')""", """concat('redirect_uri = "https://a', k, '.example.org/cb"')""",
    """concat('debug', k, ' debugMode = true; NODE_ENV="test"')""", """concat('gql(query Get', k, ' { id })')""", """concat('cors = true; "Access-Control-Allow-Origin": "*" ', k)""", """concat('password = "hunt', k, '"')""",
    """concat('__webpack_require__(', k, '); "x', k, '.chunk.js"')""", """concat('plain text ', k)""",
)
_EXPR = [s.replace(", k,", ", cast(p_partkey as string),").replace(", k)", ", cast(p_partkey as string))").replace("(h,", "(md5(cast(p_partkey as string)),").replace(", h)", ", md5(cast(p_partkey as string)))").replace(", h, h,", ", md5(cast(p_partkey as string)), md5(cast(p_partkey as string)),").replace(", h,", ", md5(cast(p_partkey as string)),") for s in SNIPPETS]
CODE = "CASE p_partkey % 36 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(_EXPR)) + " END"
CODE_SQL = f"""src AS (SELECT concat('documents/', CAST(doc_id AS string)) AS path, text AS content FROM documents
  UNION ALL SELECT concat('pages/', CAST(page_id AS string)), html FROM pages UNION ALL SELECT concat('code/', CAST(p_partkey AS string)), {CODE} FROM part)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, pages and code fixtures; each row is an analysis."""
    d = table(spark, sf_dir, "documents").select(F.expr("concat('documents/', cast(doc_id as string))").alias("path"), F.col("text").alias("content"))
    p = table(spark, sf_dir, "pages").select(F.expr("concat('pages/', cast(page_id as string))").alias("path"), F.col("html").alias("content"))
    c = table(spark, sf_dir, "part").select(F.expr("concat('code/', cast(p_partkey as string))").alias("path"), F.expr(CODE).alias("content"))
    return sources_of(d.unionByName(p).unionByName(c), F.col("path"), F.col("content"))


def fixture(spark: SparkSession, sf_dir: str, name: str, path: str, content: str, **more: str) -> DataFrame:
    """sources from expressions over a table."""
    more = {k: F.expr(v) for k, v in more.items()}
    return sources_of(table(spark, sf_dir, name), F.expr(path), F.expr(content), **more)


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# ---- SQL for rules


def re2(p: str, ignore_case: bool = True) -> str:
    return ("(?i)" if ignore_case else "") + with_spaces(p.replace("<b>", r"\b").replace("<z>", "$")).replace("'", "''")


def sql_clean(v: str) -> str:
    return f"""regexp_replace(regexp_replace({v}, '^["'']|["'']$', '', 'g'), '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"""


SQL_BASE64 = "coalesce(length(value) % 4 = 0 AND regexp_full_match(value, '[A-Za-z0-9+/]*={0,2}') AND try(to_base64(from_base64(CASE WHEN length(value) % 4 = 0 AND regexp_full_match(value, '[A-Za-z0-9+/]*={0,2}') THEN value ELSE '' END))) = value, false)"
SQL_NOISE = " OR ".join(f"regexp_matches(value, '{re2(p, i)}')" for p, i in URL_NOISE)


def sql_rule(r: Rule, order: int) -> str:
    """Distinct cleaned matches of a rule with its attributes, from src."""
    p = re2(r.pattern, r.ignore_case)
    cols = ", ".join(f"unnest(regexp_extract_all(content, '{p}', {g})) AS g{g}" for g in (0, *sorted(r.groups)))
    value = "coalesce(" + ", ".join([*(f"nullif(g{g}, '')" for g in r.groups), "g0"]) + ")"
    url = r.category == "urls"
    category = "CASE WHEN regexp_matches(value, '(?i)^https?://') THEN 'full-urls' ELSE 'endpoints' END" if url else f"'{r.category}'"
    label = "CASE WHEN regexp_matches(value, '(?i)^https?://') THEN 'Full URL' ELSE 'Endpoint' END" if url else f"'{r.label}'"
    secret = "secret" in r.id or r.category == "secrets"
    return f"""SELECT DISTINCT path, {category} AS category, value, {label} AS type, '{r.severity}' AS severity, '{r.confidence}' AS confidence, '{r.id}' AS rule_id,
  {SQL_BASE64 if secret else 'false'} AS is_base64, {order} AS rule_ord
FROM (SELECT path, {sql_clean(value)} AS value FROM (SELECT path, {cols} FROM src)) WHERE length(value) >= 4{' AND NOT (' + SQL_NOISE + ')' if url else ''}"""


SCAN_COLUMNS = ["path", "category", "value", "type", "severity", "confidence", "rule_id", "is_base64"]


def _shown(found: DataFrame) -> DataFrame:
    return found.select(F.col("source_file").alias("path"), *SCAN_COLUMNS[1:])


def _rule_query(r: Rule) -> Query:
    return lambda spark, sf_dir: _shown(dedupe.dedupe(scan_rules(all_sources(spark, sf_dir), (r,))))


for _k, _r in enumerate(RULES):
    QUERIES[f"scan_{_r.id.replace('-', '_')}"] = _rule_query(_r)
    ORACLE[f"scan_{_r.id.replace('-', '_')}"] = f"WITH {CODE_SQL}, m AS ({sql_rule(_r, _k)}) SELECT {', '.join(SCAN_COLUMNS)} FROM m"

ALL_SQL = f"WITH {CODE_SQL}, m AS ({' UNION ALL '.join(sql_rule(r, k) for k, r in enumerate(RULES))}), f AS (SELECT path, category, value, arg_min(type, rule_ord) AS type, arg_min(severity, rule_ord) AS severity, arg_min(confidence, rule_ord) AS confidence, arg_min(rule_id, rule_ord) AS rule_id, arg_min(is_base64, rule_ord) AS is_base64 FROM m GROUP BY path, category, value)"


def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.dedupe(scan_rules(all_sources(spark, sf_dir)))


@query("scan_all_dedup", f"{ALL_SQL} SELECT {', '.join(SCAN_COLUMNS)} FROM f")
def _(spark, sf_dir):
    return _shown(all_findings(spark, sf_dir))


_LABELS = " UNION ALL ".join(f"SELECT {k} AS ord, '{c}' AS category, '{t}' AS label" for k, (c, t) in enumerate(CATEGORIES))


@query("cat_counts", f"{ALL_SQL}, c AS ({_LABELS}) SELECT ord, c.category, label, count(f.value) AS n FROM c LEFT JOIN f ON f.category = c.category GROUP BY ALL")
def _(spark, sf_dir):
    return summary.category_counts(all_findings(spark, sf_dir))


_RANKS = " UNION ALL ".join(f"SELECT {k} AS rank, '{s}' AS severity" for k, s in enumerate(SEVERITIES))


@query("severity_counts", f"{ALL_SQL}, s AS ({_RANKS}) SELECT rank, s.severity, count(f.value) AS n FROM s LEFT JOIN f ON f.severity = s.severity GROUP BY ALL")
def _(spark, sf_dir):
    return summary.severity_counts(all_findings(spark, sf_dir))


@query("severity_cube", f"{ALL_SQL} SELECT category, severity, count(*) AS n FROM f GROUP BY CUBE (category, severity)")
def _(spark, sf_dir):
    return summary.severity_by_category(all_findings(spark, sf_dir))


@query("analysis_summary_map", f"{ALL_SQL}, c AS (SELECT path, category, count(*) AS n FROM f GROUP BY ALL) SELECT path AS analysis_id, string_agg(concat(category, '=', n), ',' ORDER BY category) AS summary, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY path")
def _(spark, sf_dir):
    s = summary.analysis_summary(all_findings(spark, sf_dir))
    listed = F.transform(F.array_sort(F.map_entries("summary")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return s.select("analysis_id", F.array_join(listed, ",").alias("summary"), "total")


@query("severity_filter", f"{ALL_SQL} SELECT {', '.join(SCAN_COLUMNS)} FROM f WHERE severity = 'critical'")
def _(spark, sf_dir):
    return _shown(summary.with_severity(all_findings(spark, sf_dir), "critical"))


@query("search_filter", f"{ALL_SQL} SELECT {', '.join(SCAN_COLUMNS)} FROM f WHERE contains(lower(value), 'api') OR contains(lower(path), 'api')")
def _(spark, sf_dir):
    return _shown(summary.search(all_findings(spark, sf_dir), "API"))


@query("csv_projection", f"""{ALL_SQL} SELECT category AS "Category", type AS "Type", severity AS "Severity", value AS "Value", path AS "Source File", CASE WHEN is_base64 THEN 'Yes' ELSE 'No' END AS "Base64" FROM f""")
def _(spark, sf_dir):
    return reports.csv_rows(all_findings(spark, sf_dir))


@query("html_escape", f"{ALL_SQL} SELECT path, value, replace(replace(replace(replace(replace(value, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;') AS safe FROM f")
def _(spark, sf_dir):
    return all_findings(spark, sf_dir).select(F.col("source_file").alias("path"), "value", html_escape(F.col("value")).alias("safe"))


@query("base64_flag", f"{ALL_SQL} SELECT DISTINCT value, {SQL_BASE64} AS flag FROM f")
def _(spark, sf_dir):
    return all_findings(spark, sf_dir).select("value", is_base64(F.col("value")).alias("flag")).distinct()


_KEYS = ", ".join(f"'{k.replace('.', '')}'" for k in EXPLOITS)
OWN_KEY = r"lower(regexp_replace(value, '\s*\($', ''))"
_OWN = " ".join(f"WHEN '{r.id}' THEN {repr(r.exploit_key) if r.exploit_key else OWN_KEY}" for r in RULES if r.exploit)


@query("exploit_join", f"{ALL_SQL} SELECT path, value, rule_id, replace(CASE rule_id {_OWN} END, '.', '') IN ({_KEYS}) AS known FROM f WHERE rule_id IN ({', '.join(repr(r.id) for r in RULES if r.exploit)})")
def _(spark, sf_dir):
    f = all_findings(spark, sf_dir).filter("exploit_key IS NOT NULL")
    return f.select(F.col("source_file").alias("path"), "value", "rule_id", F.col("exploit").isNotNull().alias("known"))


# ---- URL noise

NOISE_EXPR = """CASE s_suppkey % 4 WHEN 0 THEN concat('"/src/a', cast(s_suppkey as string), '/b"') WHEN 1 THEN concat('"./a', cast(s_suppkey as string), '/b.js"') WHEN 2 THEN concat('"/img/', cast(s_suppkey as string), '.png"') ELSE concat('"/v1/a', cast(s_suppkey as string), '"') END"""


@query("noise_filtered_urls", "SELECT cast(s_suppkey as string) AS path, concat('/v1/a', cast(s_suppkey as string)) AS value FROM supplier WHERE s_suppkey % 4 = 3")
def _(spark, sf_dir):
    f = dedupe.dedupe(scan_rules(fixture(spark, sf_dir, "supplier", "cast(s_suppkey as string)", NOISE_EXPR), RULES[:2]))
    return f.select(F.col("source_file").alias("path"), "value")


@query("noise_predicate", f"SELECT page_id, value, {SQL_NOISE} AS noise FROM (SELECT page_id, unnest(regexp_extract_all(html, '\"([^\"]+)\"', 1)) AS value FROM pages)")
def _(spark, sf_dir):
    v = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('"([^"]+)"'), F.lit(1))).alias("value"))
    return v.withColumn("noise", is_noise(F.col("value")))


# ---- entropy

ENTROPY_EXPR = "concat('x(\"', substr('abcdefghijklmnopqrstuvwxyz0123456789', 1, cast(16 + c_custkey % 17 as int)), '\")')"


@query("entropy_strings", """WITH v AS (SELECT concat('documents/', CAST(doc_id AS string)) AS path, unnest(regexp_extract_all(text, '["'']([a-zA-Z0-9\\-_=]{16,64})["'']', 1)) AS value FROM documents
  UNION ALL SELECT cast(c_custkey as string), unnest(regexp_extract_all(""" + ENTROPY_EXPR + """, '["'']([a-zA-Z0-9\\-_=]{16,64})["'']', 1)) FROM customer),
d AS (SELECT DISTINCT path, value FROM v),
c AS (SELECT path, value, ch, count(*) AS n, max(length(value)) AS len FROM (SELECT path, value, unnest(string_split(value, '')) AS ch FROM d) GROUP BY ALL)
SELECT path, value, round(-sum(n / len * log2(n / len)), 6) AS bits FROM c GROUP BY path, value HAVING -sum(n / len * log2(n / len)) > 4.5""")
def _(spark, sf_dir):
    from .functions.text import entropy

    d = table(spark, sf_dir, "documents").select(F.expr("concat('documents/', cast(doc_id as string))").alias("path"), F.col("text").alias("content"))
    c = table(spark, sf_dir, "customer").select(F.expr("cast(c_custkey as string)").alias("path"), F.expr(ENTROPY_EXPR).alias("content"))
    f = dedupe.dedupe(scan_entropy(sources_of(d.unionByName(c), F.col("path"), F.col("content"))))
    return f.select(F.col("source_file").alias("path"), "value", F.round(entropy(F.col("value")), 6).alias("bits"))


# ---- routes

ROUTE_EXPR = """CASE o_orderkey % 4 WHEN 0 THEN concat(repeat(chr(10), cast(o_orderkey % 7 as int)), '{ path: "r', cast(o_orderkey as string), '", component: C }') WHEN 1 THEN concat('app.get("/api/r', cast(o_orderkey as string), '", h)')
  WHEN 2 THEN concat('a', chr(10), '<Route exact path="/u', cast(o_orderkey as string), '/x">', chr(10), '<Route path="p', cast(o_orderkey as string), '">') ELSE concat('router.post("', cast(o_orderkey as string), '")') END"""
_ROUTE_SQL = f"""s AS (SELECT cast(o_orderkey as string) AS path, o_orderkey AS k FROM orders),
r AS (SELECT path, concat('r', path) AS value, 'Angular Route' AS type, CAST(1 + k % 7 AS INT) AS line FROM s WHERE k % 4 = 0
 UNION ALL SELECT path, concat('/api/r', path), 'Express Route', 1 FROM s WHERE k % 4 = 1
 UNION ALL SELECT path, concat('/u', path, '/x'), 'React/Vue Route', 2 FROM s WHERE k % 4 = 2
 UNION ALL SELECT path, concat('p', path), 'React/Vue Route', 3 FROM s WHERE k % 4 = 2)"""


@query("route_extract", f"WITH {_ROUTE_SQL} SELECT path, value, type, line FROM r")
def _(spark, sf_dir):
    f = routes.scan_routes(fixture(spark, sf_dir, "orders", "cast(o_orderkey as string)", ROUTE_EXPR))
    return f.select(F.col("source_file").alias("path"), "value", "type", "line")


@query("route_minus_endpoint", f"WITH {_ROUTE_SQL} SELECT path, value, type FROM r WHERE value NOT LIKE '/%'")
def _(spark, sf_dir):
    s = fixture(spark, sf_dir, "orders", "cast(o_orderkey as string)", ROUTE_EXPR)
    raw = scan_rules(s, RULES[:2]).unionByName(routes.scan_routes(s))
    return dedupe.dedupe(dedupe.drop_known_routes(raw)).filter("category = 'routes'").select(F.col("source_file").alias("path"), "value", "type")


@query("line_numbers", "WITH m AS (SELECT page_id, html, unnest(range(1, len(string_split(html, 'href=')))) AS i FROM pages) SELECT page_id, i AS nth, CAST(1 + len(array_to_string(list_slice(string_split(html, 'href='), 1, i), '')) - len(replace(array_to_string(list_slice(string_split(html, 'href='), 1, i), ''), chr(10), '')) AS INT) AS line FROM m")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(routes.line_numbers(F.col("html"), "href=")).alias("i", "line"))
    return p.select("page_id", (F.col("i") + 1).cast("long").alias("nth"), "line")


# ---- libraries

LIB_PATH = "concat('vendor/jquery-', cast(1 + p_partkey % 3 as string), '.', cast(p_partkey % 7 as string), '.', cast(p_partkey % 5 as string), '.min.js')"
LIB_ID = "cast(p_partkey as string)"
LIB_CONTENT = "concat('/*! Lodash v4.17.', cast(p_partkey % 25 as string), ' */')"
_ADV = ", ".join(f"('{lib}', '{i}', '{s}', {libraries.packed(lo)}, {libraries.packed(hi)}, {repr(f) if f else 'NULL'})" for lib, i, s, lo, hi, f in ADVISORIES)
_LIB_SQL = f"""a(lib, id, severity, lo, hi, fixed) AS (VALUES {_ADV}),
d AS (SELECT cast(p_partkey as string) AS analysis_id, 'jQuery' AS lib, concat(1 + p_partkey % 3, '.', p_partkey % 7, '.', p_partkey % 5) AS version, (1 + p_partkey % 3) * 1000000000000 + (p_partkey % 7) * 1000000 + p_partkey % 5 AS v FROM part
 UNION ALL SELECT cast(p_partkey as string), 'Lodash', concat('4.17.', p_partkey % 25), 4000017000000 + p_partkey % 25 FROM part)"""


def lib_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "part", LIB_PATH, LIB_CONTENT, analysis=LIB_ID)


@query("lib_by_content", f"WITH {_LIB_SQL} SELECT analysis_id, lib, version FROM d WHERE lib = 'Lodash'")
def _(spark, sf_dir):
    return libraries.by_content(lib_sources(spark, sf_dir)).select("analysis_id", "lib", "version")


@query("lib_by_filename", f"WITH {_LIB_SQL} SELECT analysis_id, lib, version FROM d WHERE lib = 'jQuery'")
def _(spark, sf_dir):
    return libraries.by_filename(lib_sources(spark, sf_dir)).select("analysis_id", "lib", "version")


@query("lib_by_hash", "SELECT cast(p_partkey as string) AS analysis_id, 'fixture' AS lib, '1.2.3' AS version FROM part WHERE p_partkey % 25 = 7")
def _(spark, sf_dir):
    import hashlib

    known = {hashlib.sha256(b"/*! Lodash v4.17.7 */").hexdigest(): ("fixture", "1.2.3")}
    return libraries.by_hash(lib_sources(spark, sf_dir), known).select("analysis_id", "lib", "version")


@query("advisory_range_join", f"WITH {_LIB_SQL} SELECT analysis_id, d.lib, version, id, severity, fixed FROM d JOIN a ON a.lib = d.lib AND v >= lo AND v <= hi")
def _(spark, sf_dir):
    return libraries.match_advisories(libraries.detect(lib_sources(spark, sf_dir))).select("analysis_id", "lib", "version", "id", "severity", "fixed")


@query("lib_safe_anti", f"WITH {_LIB_SQL} SELECT analysis_id, d.lib, version FROM d ANTI JOIN a ON a.lib = d.lib AND v >= lo AND v <= hi")
def _(spark, sf_dir):
    return libraries.without_advisory(libraries.detect(lib_sources(spark, sf_dir))).select("analysis_id", "lib", "version")


@query("library_findings", f"""WITH {_LIB_SQL}, hit AS (SELECT analysis_id, concat(d.lib, ' v', version, ' — ', id, CASE WHEN d.lib = 'jQuery' THEN ' (detected via filename)' ELSE '' END) AS value, severity FROM d JOIN a ON a.lib = d.lib AND v >= lo AND v <= hi)
SELECT analysis_id, c AS category, value, severity FROM hit, (VALUES ('libraries'), ('vulnerabilities')) t(c)
UNION ALL SELECT analysis_id, 'libraries', concat(d.lib, ' v', version, ' — No known vulnerabilities', CASE WHEN d.lib = 'jQuery' THEN ' (detected via filename)' ELSE '' END), 'info' FROM d ANTI JOIN a ON a.lib = d.lib AND v >= lo AND v <= hi""")
def _(spark, sf_dir):
    return libraries.scan_libraries(lib_sources(spark, sf_dir)).select("analysis_id", "category", "value", "severity")


@query("semver_compare", "SELECT p_partkey, (1 + p_partkey % 3) * 1000000000000 + (p_partkey % 7) * 1000000 + p_partkey % 5 AS v, (1 + p_partkey % 3) * 1000000000000 + (p_partkey % 7) * 1000000 + p_partkey % 5 BETWEEN 1002000000000 AND 3004000009000 AS inside FROM part")
def _(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", version_number(F.expr("concat(cast(1 + p_partkey % 3 as string), '.', cast(p_partkey % 7 as string), '.', cast(p_partkey % 5 as string))")).alias("v"))
    return t.withColumn("inside", F.col("v").between(1002000000000, 3004000009000))


# ---- fingerprint, hosts, chunks, maps, traces

FW_EXPR = """concat(CASE p_partkey % 4 WHEN 0 THEN 'React.createElement(' WHEN 1 THEN 'createApp(' WHEN 2 THEN 'React.createElement( createApp(' ELSE '' END, CASE WHEN p_partkey % 2 = 0 THEN ' __webpack_require__(' ELSE '' END)"""


@query("fingerprint_framework", "SELECT cast(p_partkey as string) AS path, CASE p_partkey % 4 WHEN 0 THEN 'React' WHEN 1 THEN 'Vue' WHEN 2 THEN 'React' END AS framework, CAST(CASE WHEN p_partkey % 4 = 3 THEN 0 ELSE 1 END AS INT) AS marks FROM part")
def _(spark, sf_dir):
    return fingerprint.fingerprint(fixture(spark, sf_dir, "part", LIB_ID, FW_EXPR)).select("path", "framework", "marks")


@query("fingerprint_bundler", "SELECT cast(p_partkey as string) AS path, CASE WHEN p_partkey % 2 = 0 THEN 'Webpack' END AS bundler, CASE p_partkey % 4 WHEN 0 THEN 'React / Webpack' WHEN 1 THEN 'Vue' WHEN 2 THEN 'React / Webpack' ELSE '' END AS badge FROM part")
def _(spark, sf_dir):
    return fingerprint.fingerprint(fixture(spark, sf_dir, "part", LIB_ID, FW_EXPR)).select("path", "bundler", "badge")


URL_EXPR = "concat('get(\"https://h', cast(s_suppkey % 50 as string), CASE WHEN s_suppkey % 3 = 0 THEN '.api.example.org' WHEN s_suppkey % 3 = 1 THEN '.test.example.net' ELSE '' END, CASE WHEN s_suppkey % 3 = 2 THEN '.w3.org/x' ELSE '/v1' END, '\"); h(\"https://www.w3.org/a\")')"
_HOST_SQL = """s AS (SELECT cast(s_suppkey as string) AS path, concat('h', s_suppkey % 50, CASE s_suppkey % 3 WHEN 0 THEN '.api.example.org' WHEN 1 THEN '.test.example.net' ELSE '.w3.org' END) AS host FROM supplier)"""


def url_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixture(spark, sf_dir, "supplier", "cast(s_suppkey as string)", URL_EXPR, analysis="'all'", order="s_suppkey")
    return scan_rules(s, RULES[:1])


@query("host_noise_anti", f"WITH {_HOST_SQL} SELECT DISTINCT path AS source_file, host FROM s")
def _(spark, sf_dir):
    return hosts.hosts_of_findings(url_findings(spark, sf_dir)).select("source_file", "host").distinct()


@query("host_harvest", f"WITH {_HOST_SQL} SELECT host AS value, string_agg(path, ', ' ORDER BY path) AS source_file FROM s GROUP BY host")
def _(spark, sf_dir):
    return hosts.harvest_hosts(url_findings(spark, sf_dir)).select("value", "source_file")


@query("host_classify_tags", f"WITH {_HOST_SQL} SELECT DISTINCT host AS value, CASE WHEN host LIKE '%.example.org' THEN 'Subdomain' ELSE 'Third-Party Host' END AS type, CASE WHEN host LIKE '%.example.org' THEN 'medium' ELSE 'info' END AS severity, concat_ws(',', CASE WHEN host LIKE '%.example.org' THEN 'subdomain' ELSE 'third-party' END, CASE WHEN host LIKE '%api%' THEN 'interesting' END, CASE WHEN host LIKE '%test%' THEN 'non-prod' END) AS tags FROM s")
def _(spark, sf_dir):
    h = hosts.harvest_hosts(url_findings(spark, sf_dir), "https://www.Example.org/x")
    return h.select("value", "type", "severity", F.array_join("tags", ",").alias("tags"))


@query("dns_resolution", f"WITH {_HOST_SQL}, h AS (SELECT DISTINCT host FROM s) SELECT host AS value, CASE WHEN host LIKE '%.w3.org' THEN '' ELSE concat('10.0.0.', length(host)) END AS ips, host NOT LIKE '%.w3.org' AS resolved FROM h")
def _(spark, sf_dir):
    h = hosts.harvest_hosts(url_findings(spark, sf_dir))
    dns = h.select(F.col("value").alias("host"), F.when(F.col("value").endswith(".w3.org"), 5).otherwise(1).alias("type"), F.concat(F.lit("10.0.0."), F.length("value").cast("string")).alias("data"))
    return hosts.resolve_hosts(h, dns).select("value", F.array_join("ips", ",").alias("ips"), "resolved")


CHUNK_EXPR = """concat('{', cast(p_partkey as string), ':"chunk-', cast(p_partkey as string), '",', cast(p_partkey + 1 as string), ':"c', cast(p_partkey as string), '"}[e]; import("./p', cast(p_partkey as string), '.js"); import("../q.js")')"""
_CHUNK_SQL = "c AS (SELECT cast(p_partkey as string) AS analysis_id, unnest([concat('https://x.org/a/chunk-', p_partkey, '.js'), concat('https://x.org/a/c', p_partkey, '.js'), concat('https://x.org/a/p', p_partkey, '.js'), 'https://x.org/q.js']) AS url FROM part)"


def chunk_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "part", LIB_ID, CHUNK_EXPR, base_url="'https://x.org/a/main.js?v=1'")


@query("chunk_candidates", f"WITH {_CHUNK_SQL} SELECT analysis_id, url FROM c")
def _(spark, sf_dir):
    return chunks.chunk_candidates(chunk_sources(spark, sf_dir)).select("analysis_id", "url")


@query("chunk_fetched", f"WITH {_CHUNK_SQL} SELECT analysis_id, url AS value, 'JS Chunk' AS type FROM c WHERE url LIKE '%chunk-%'")
def _(spark, sf_dir):
    c = chunks.chunk_candidates(chunk_sources(spark, sf_dir))
    fetched = table(spark, sf_dir, "part").select(F.expr("concat('https://x.org/a/chunk-', cast(p_partkey as string), '.js')").alias("url"), F.lit("x").alias("content"))
    return chunks.fetched_chunks(c, fetched).select("analysis_id", "value", "type")


MAP_EXPR = """concat('{"version":3,"sources":["src/a', cast(p_partkey as string), '.js","node_modules/x.js","",null],"sourcesContent":["var a = ', cast(p_partkey as string), '","x","y = ', cast(p_partkey % 3 as string), '"," "]}')"""


def map_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.expr(LIB_ID).alias("analysis_id"), F.lit(0).alias("file_ord"), F.expr(LIB_ID).alias("path"), F.expr(MAP_EXPR).alias("json"))


_MAP_FILES = "SELECT cast(p_partkey as string) AS path, concat('src/a', p_partkey, '.js') AS file, concat('var a = ', p_partkey) AS content FROM part UNION ALL SELECT cast(p_partkey as string), 'source_2.js', concat('y = ', p_partkey % 3) FROM part"


@query("sourcemap_files", _MAP_FILES)
def _(spark, sf_dir):
    return source_maps.map_files(map_table(spark, sf_dir)).select("path", "file", "content")


@query("sourcemap_paths", "SELECT cast(p_partkey as string) AS path, unnest([concat('src/a', p_partkey, '.js'), 'node_modules/x.js']) AS value FROM part")
def _(spark, sf_dir):
    return source_maps.map_paths(map_table(spark, sf_dir)).select(F.col("source_file").alias("path"), "value")


@query("inline_sourcemap", f"SELECT path, file, content FROM ({_MAP_FILES}) WHERE CAST(path AS BIGINT) % 2 = 0")
def _(spark, sf_dir):
    m = map_table(spark, sf_dir)
    data = F.regexp_replace(F.base64(F.col("json").cast("binary")), r"[\r\n]", "")
    bad = F.when(F.col("path").cast("long") % 2 == 0, data).otherwise(F.concat(data, F.lit("=A")))
    s = sources_of(m, F.col("path"), F.concat(F.lit("x\n//# sourceMappingURL=data:application/json;charset=utf-8;base64,"), bad))
    return source_maps.map_files(source_maps.inline_maps(s)).select("path", "file", "content")


@query("trace_findings", """SELECT cast(o_orderkey as string) AS path, concat('https://t/', o_orderkey) AS value, 'Runtime fetch (POST)' AS type, 'medium' AS severity FROM orders WHERE o_orderkey % 3 > 0
 UNION ALL SELECT cast(o_orderkey as string), concat('eval: ', repeat('x', 150)), 'Runtime Dangerous Call', 'high' FROM orders UNION ALL SELECT cast(o_orderkey as string), 'boom', 'Runtime Error', 'info' FROM orders WHERE o_orderkey % 3 = 2""")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    url = F.array(F.struct(F.lit("fetch").alias("type"), F.concat(F.lit("https://t/"), k.cast("string")).alias("url"), F.lit("POST").alias("method")))
    t = table(spark, sf_dir, "orders").select(
        k.cast("string").alias("path"), F.when(k % 3 > 0, url).alias("urls"), F.array(F.struct(F.lit("eval").alias("type"), F.repeat(F.lit("x"), F.lit(200)).alias("value"))).alias("calls"),
        F.when(k % 3 == 2, F.array(F.lit("boom"))).alias("errors"),
    )
    return source_traces.trace_findings(t).select(F.col("source_file").alias("path"), "value", "type", "severity")


# ---- several files of one analysis

MULTI_PATH = "cast(c_custkey as string)"
MULTI_EXPR = "concat('const apiToken = \"', md5(cast(c_custkey % 100 as string)), '\";')"


def multi_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "customer", MULTI_PATH, MULTI_EXPR, analysis="cast(c_nationkey as string)", order="c_custkey")


@query("cross_file_sources", "SELECT cast(c_nationkey as string) AS analysis_id, md5(cast(c_custkey % 100 as string)) AS value, string_agg(cast(c_custkey as string), ',' ORDER BY c_custkey) AS sources, CAST(count(*) AS INT) AS n_sources FROM customer GROUP BY c_nationkey, c_custkey % 100")
def _(spark, sf_dir):
    raw = scan_rules(multi_sources(spark, sf_dir), RULES[12:13])
    return dedupe.across_files(raw).select("analysis_id", "value", F.array_join("sources", ",").alias("sources"), "n_sources")


@query("first_file_wins", "SELECT cast(c_nationkey as string) AS analysis_id, md5(cast(c_custkey % 100 as string)) AS value, cast(min(c_custkey) as string) AS source_file, true AS is_base64 FROM customer GROUP BY c_nationkey, c_custkey % 100")
def _(spark, sf_dir):
    return dedupe.dedupe(scan_rules(multi_sources(spark, sf_dir), RULES[12:13])).select("analysis_id", "value", "source_file", "is_base64")


# ---- syntax trees and data flows

AST_EXPR = """CASE o_orderkey % 6 WHEN 0 THEN concat('axios.get("/v1/u', cast(o_orderkey as string), '");') WHEN 1 THEN concat('fetch(`/v1/u', cast(o_orderkey as string), '/$', '{id}`);') WHEN 2 THEN concat(chr(10), 'el.innerHTML = x', cast(o_orderkey as string), '; eval(y)')
  WHEN 3 THEN concat('const my_token = "tok', md5(cast(o_orderkey as string)), '";') WHEN 4 THEN concat('load("a" + b + "', cast(o_orderkey as string), '.chunk.js"); __webpack_require__("mod', cast(o_orderkey as string), '")') ELSE concat('var f = function ( {', cast(o_orderkey as string)) END"""


def ast_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "orders", "cast(o_orderkey as string)", AST_EXPR)


def _ast(spark, sf_dir, *types: str) -> DataFrame:
    f = scan_syntax(ast_sources(spark, sf_dir), taint=False)
    return f.filter(F.col("type").isin(*types)).select(F.col("source_file").alias("path"), "category", "value", "type", "line")


@query("ast_http_calls", "SELECT cast(o_orderkey as string) AS path, 'endpoints' AS category, CASE o_orderkey % 6 WHEN 0 THEN concat('/v1/u', o_orderkey) ELSE concat('/v1/u', o_orderkey, '/*') END AS value, CASE o_orderkey % 6 WHEN 0 THEN 'AST: axios.get() call' ELSE 'AST: fetch() call' END AS type, 1::INT AS line FROM orders WHERE o_orderkey % 6 IN (0, 1)")
def _(spark, sf_dir):
    return _ast(spark, sf_dir, "AST: axios.get() call", "AST: fetch() call")


@query("ast_dangerous_calls", "SELECT cast(o_orderkey as string) AS path, 'vulnerabilities' AS category, 'eval()' AS value, 'AST: Dangerous Call' AS type, 2::INT AS line FROM orders WHERE o_orderkey % 6 = 2")
def _(spark, sf_dir):
    return _ast(spark, sf_dir, "AST: Dangerous Call")


@query("ast_dangerous_assign", "SELECT cast(o_orderkey as string) AS path, 'vulnerabilities' AS category, '.innerHTML = ...' AS value, 'AST: Dangerous Assignment' AS type, 2::INT AS line FROM orders WHERE o_orderkey % 6 = 2")
def _(spark, sf_dir):
    return _ast(spark, sf_dir, "AST: Dangerous Assignment")


@query("ast_secrets", """SELECT cast(o_orderkey as string) AS path, 'secrets' AS category, concat('my_token = "tok', md5(cast(o_orderkey as string)), '"') AS value, 'AST: Secret Variable' AS type, 1::INT AS line FROM orders WHERE o_orderkey % 6 = 3""")
def _(spark, sf_dir):
    return _ast(spark, sf_dir, "AST: Secret Variable", "AST: Secret Assignment")


@query("ast_chunks", "SELECT cast(o_orderkey as string) AS path, 'libraries' AS category, concat('a', o_orderkey, '.chunk.js') AS value, 'AST: Chunk URL Pattern' AS type, 1::INT AS line FROM orders WHERE o_orderkey % 6 = 4 UNION ALL SELECT cast(o_orderkey as string), 'libraries', concat('mod', o_orderkey), 'AST: Webpack Chunk', 1 FROM orders WHERE o_orderkey % 6 = 4")
def _(spark, sf_dir):
    return _ast(spark, sf_dir, "AST: Chunk URL Pattern", "AST: Webpack Chunk")


# The nodes of each code form in walking order: type, parent, and the name where it has one (x* ends in the key). The sixth form is no program.
AST_NODES = (
    "Program -1, ExpressionStatement 0, CallExpression 1, MemberExpression 2 axios.get, Identifier 3 axios, Identifier 3 get, Literal 2",
    "Program -1, ExpressionStatement 0, CallExpression 1, Identifier 2 fetch, TemplateLiteral 2, Identifier 4 id",
    "Program -1, ExpressionStatement 0, AssignmentExpression 1, MemberExpression 2 el.innerHTML, Identifier 3 el, Identifier 3 innerHTML, Identifier 2 x*, ExpressionStatement 0, CallExpression 7, Identifier 8 eval, Identifier 8 y",
    "Program -1, VariableDeclaration 0, VariableDeclarator 1, Identifier 2 my_token, Literal 2",
    "Program -1, ExpressionStatement 0, CallExpression 1, Identifier 2 load, BinaryExpression 2, BinaryExpression 4, Literal 5, Identifier 5 b, Literal 4, ExpressionStatement 0, CallExpression 9, Identifier 10 __webpack_require__, Literal 10",
)
_FORMS = ", ".join(f"({form}, {i}, '{n[0]}', {n[1]}, {repr(n[2]) if len(n) > 2 else 'NULL'})" for form, nodes in enumerate(AST_NODES) for i, n in enumerate(x.split(" ") for x in nodes.split(", ")))


@query("ast_nodes", f"""SELECT cast(o_orderkey as string) AS path, type, CAST(node_id AS INT) AS node_id, CAST(parent_id AS INT) AS parent_id, replace(dotted, '*', cast(o_orderkey as string)) AS dotted
FROM orders JOIN (VALUES {_FORMS}) f(form, node_id, type, parent_id, dotted) ON o_orderkey % 6 = form""")
def _(spark, sf_dir):
    from .operators.syntax import syntax_nodes

    return syntax_nodes(ast_sources(spark, sf_dir)).select("path", "type", "node_id", "parent_id", "dotted")


TAINT_EXPR = "concat('var q = location.hash;', CASE o_orderkey % 3 WHEN 0 THEN 'el.innerHTML = q;' WHEN 1 THEN 'eval(q);' ELSE 'log(q);' END)"


@query("taint_flows", "SELECT cast(o_orderkey as string) AS path, CASE o_orderkey % 3 WHEN 0 THEN 'location.hash → innerHTML' ELSE 'location.hash → eval()' END AS value, CASE o_orderkey % 3 WHEN 0 THEN 'high' ELSE 'critical' END AS severity FROM orders WHERE o_orderkey % 3 < 2")
def _(spark, sf_dir):
    f = scan_syntax(fixture(spark, sf_dir, "orders", "cast(o_orderkey as string)", TAINT_EXPR), syntax=False)
    return f.select(F.col("source_file").alias("path"), "value", "severity")


@query("secret_near_duplicates", "SELECT cast(o_orderkey as string) AS analysis_id, concat('tok', md5(cast(o_orderkey as string))) AS value, 'generic-secret' AS rule_id FROM orders WHERE o_orderkey % 6 = 3")
def _(spark, sf_dir):
    s = ast_sources(spark, sf_dir)
    f = findings(findings_raw(s)).filter("category = 'secrets'")
    return f.select("analysis_id", "value", "rule_id")


# ---- exports, store, enrichment

API_EXPR = "concat('app.get(\"/u/:id', cast(o_orderkey % 9 as string), '/x\"); f(\"https://h.example.org/', cast(o_orderkey % 5 as string), '\"); route(\"plain/seg', cast(o_orderkey % 3 as string), '\")')"


def api_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything is one analysis."""
    s = fixture(spark, sf_dir, "orders", "cast(o_orderkey as string)", API_EXPR, analysis="'all'", order="o_orderkey")
    return dedupe.dedupe(scan_rules(s, RULES[:2]).unionByName(routes.scan_routes(s)))


@query("postman_items", "WITH u AS (SELECT DISTINCT concat('/u/:id', o_orderkey % 9, '/x') AS url FROM orders UNION SELECT DISTINCT concat('https://h.example.org/', o_orderkey % 5) FROM orders UNION SELECT DISTINCT concat('plain/seg', o_orderkey % 3) FROM orders) SELECT concat('GET ', url) AS name, CASE WHEN url LIKE 'http%' THEN url ELSE concat('{{baseUrl}}', url) END AS raw, CASE WHEN url NOT LIKE 'http%' THEN array_to_string(list_filter(string_split(url, '/'), lambda p: p <> ''), '|') END AS path FROM u")
def _(spark, sf_dir):
    return reports.postman_items(api_findings(spark, sf_dir)).select("name", "raw", F.array_join("path", "|").alias("path"))


@query("openapi_paths", "SELECT DISTINCT concat('/u/{id', o_orderkey % 9, '}/x') AS path, 'get' AS method, concat('id', o_orderkey % 9) AS parameters FROM orders")
def _(spark, sf_dir):
    return reports.openapi_paths(api_findings(spark, sf_dir)).select("path", "method", F.array_join("parameters", ",").alias("parameters"))


def _workspaces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    at = F.timestamp_seconds(F.col("n_nationkey").cast("long") * 86_400)
    w = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), at.alias("created_at"), at.alias("updated_at"))
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").cast("string").alias("workspace_id"), F.col("c_name").alias("file_name"))
    return w, a


@query("workspace_listing", "SELECT cast(n_nationkey as string) AS id, n_name AS name, count(c_custkey) AS n_analyses FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def _(spark, sf_dir):
    return store.listing(*_workspaces(spark, sf_dir)).select("id", "name", "n_analyses")


@query("workspace_cascade_delete", "SELECT cast(c_custkey as string) AS id, cast(c_nationkey as string) AS workspace_id FROM customer WHERE c_nationkey % 5 <> 2")
def _(spark, sf_dir):
    w, a = _workspaces(spark, sf_dir)
    gone = w.filter(F.col("id").cast("int") % 5 == 2).select("id")
    return store.without_workspace(w, a, gone)[1].select("id", "workspace_id")


_RANK = "CASE severity " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(SEVERITIES)) + " END"
_TOP = f"{ALL_SQL}, g AS (SELECT *, (SELECT min(rule_ord) FROM m WHERE m.path = f.path AND m.category = f.category AND m.value = f.value) AS rule_ord FROM f), t AS (SELECT *, row_number() OVER (ORDER BY {_RANK}, path, rule_ord, category, value) AS n FROM g)"


def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.foremost(all_findings(spark, sf_dir).withColumn("match_ord", F.lit(0)))


@query("topk_enrich_batch", f"{_TOP} SELECT concat('finding-', n) AS id, type, severity, confidence, substr(value, 1, 120) AS value, path AS source_file, CAST((n - 1) // 2 AS INT) AS batch FROM t WHERE n <= 15")
def _(spark, sf_dir):
    return top_findings(spark, sf_dir)


@query("enrich_join_back", f"{_TOP} SELECT concat('finding-', n) AS id, severity, CASE WHEN n % 2 = 1 THEN 'low' END AS ai_severity, CASE WHEN n % 2 = 1 THEN concat('about finding-', n) END AS ai_reasoning FROM t WHERE n <= 15")
def _(spark, sf_dir):
    def callback(prompt: str) -> str:
        import json
        import re

        ids = re.findall(r"^- \[(finding-\d+)\]", prompt, re.M)
        return "```json\n" + json.dumps([{"id": i, "severity": "low", "reasoning": f"about {i}", "suggestedTest": "none"} for i in ids[:1]]) + "\n```"

    items = top_findings(spark, sf_dir)
    answers = enrich.parse_answers(enrich.ask(enrich.prompts(items), callback))
    return enrich.join_answers(items, answers).select("id", "severity", "ai_severity", "ai_reasoning")


@query("enrichment_counts", "SELECT 15::BIGINT AS total, 8::BIGINT AS applied")
def _(spark, sf_dir):
    return enrich.enrichment_counts(QUERIES["enrich_join_back"](spark, sf_dir))


@query("input_size", "SELECT concat('documents/', CAST(doc_id AS string)) AS path, CAST(len(string_split(text, chr(10))) AS INT) AS n_lines, CAST(length(text) AS INT) AS n_chars FROM documents")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return files.input_size(sources_of(d, F.expr("concat('documents/', cast(doc_id as string))"), F.col("text"))).select("path", "n_lines", "n_chars")


@query("joined_text", "SELECT cast(c_nationkey as string) AS analysis_id, md5(string_agg(concat('// === ', c_custkey, ' ===', chr(10), c_name), chr(10) || chr(10) ORDER BY c_custkey)) AS content FROM customer GROUP BY c_nationkey")
def _(spark, sf_dir):
    s = fixture(spark, sf_dir, "customer", "cast(c_custkey as string)", "c_name", analysis="cast(c_nationkey as string)", order="c_custkey")
    return files.joined_text(s).select("analysis_id", F.md5("content").alias("content"))


@query("code_files", "SELECT p_partkey FROM part WHERE p_partkey % 5 IN (0, 1, 2) OR p_partkey % 7 = 0")
def _(spark, sf_dir):
    name = F.expr("concat('a', cast(p_partkey as string), CASE p_partkey % 5 WHEN 0 THEN '.js' WHEN 1 THEN '.ts' WHEN 2 THEN '.map' WHEN 3 THEN '.jsx' ELSE '.txt' END)")
    mime = F.expr("CASE WHEN p_partkey % 7 = 0 THEN 'text/javascript' END")
    return table(spark, sf_dir, "part").filter(files.is_code(name, mime)).select("p_partkey")


@query("remote_names", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN concat('f', s_suppkey, '.js') WHEN 1 THEN concat('g', s_suppkey) ELSE 'remote_file.js' END AS name FROM supplier")
def _(spark, sf_dir):
    url = F.expr("concat('https://x.org/a/', CASE s_suppkey % 3 WHEN 0 THEN concat('f', cast(s_suppkey as string), '.js?v=1/2') WHEN 1 THEN concat('g', cast(s_suppkey as string)) ELSE '' END)")
    return table(spark, sf_dir, "supplier").select("s_suppkey", remote_name(url).alias("name"))


@query("value_position", "SELECT page_id, CAST(instr(html, 'href') AS INT) AS first, CAST(CASE WHEN instr(substr(html, instr(html, 'href') + 1), 'href') > 0 THEN instr(html, 'href') + instr(substr(html, instr(html, 'href') + 1), 'href') ELSE instr(html, 'href') END AS INT) AS next FROM pages")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("first", summary.next_occurrence(F.col("html"), F.lit("href"), F.lit(1)))
    return p.select("page_id", "first", summary.next_occurrence(F.col("html"), F.lit("href"), F.col("first") + 1).alias("next"))


@query("distinct_urls", "SELECT DISTINCT concat('/u/:id', o_orderkey % 9, '/x') AS url, 'endpoints' AS category FROM orders UNION SELECT DISTINCT concat('https://h.example.org/', o_orderkey % 5), 'full-urls' FROM orders UNION SELECT DISTINCT concat('plain/seg', o_orderkey % 3), 'endpoints' FROM orders")
def _(spark, sf_dir):
    u = reports.distinct_urls(api_findings(spark, sf_dir))
    return u.select("url", F.element_at(F.array(*[F.lit(c) for c in reports.URL_CATEGORIES]), F.col("place.rank").cast("int")).alias("category"))


@query("report_age", "SELECT o_orderkey, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN concat(m, 'm ago') WHEN m < 1440 THEN concat(m // 60, 'h ago') ELSE concat(m // 1440, 'd ago') END AS age FROM (SELECT o_orderkey, o_orderkey % 40000 AS m FROM orders)")
def _(spark, sf_dir):
    then = F.timestamp_seconds(F.lit(4_000_000_000) - (F.col("o_orderkey") % 40_000) * 60)
    return table(spark, sf_dir, "orders").select("o_orderkey", relative_age(then, F.timestamp_seconds(F.lit(4_000_000_000))).alias("age"))


@query("full_analysis")
def _(spark, sf_dir):
    """All stages over all sources, with originals of source maps and the hosts behind what was found."""
    f = analyze(all_sources(spark, sf_dir))
    return f.select("analysis_id", "category", "value", "type", "severity", "confidence", "rule_id", "line")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: findings of the pages by category and severity."""
    p = table(spark, sf_dir, "pages")
    f = dedupe.dedupe(scan_rules(sources_of(p, F.col("url"), F.col("html"))))
    return f.groupBy("category", "severity").agg(F.count("*").alias("n"))
