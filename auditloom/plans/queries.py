"""Registered queries over the driver's tables, each with its SQL.

The tables are no source trees, so a fixed reading stands in: a project is a document's source, a file its doc_id, content
its text; for findings, a project is an event's user, its severity the event's type.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..operators import findings as A
from ..operators import graph as G
from ..operators import ignores as IG
from ..operators import rules_project as RP
from ..operators import triage as TR
from ..schema import REFUND_TENTHS, SEVERITIES, lookup
from . import trees

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(trees.QUERIES)
ORACLE_SQL: dict[str, str] = dict(trees.ORACLE_SQL)


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _files(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "documents")
    return d.select(F.col("source").alias("project_id"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.octet_length("text").cast("long").alias("size"), F.col("text").alias("content"))


#: Fixed reading of event types as severities, of which a rule and its penalty follow.
SEVERITY_OF = {"error": "critical", "purchase": "high", "click": "medium", "view": "low", "signup": "info"}


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "events")
    severity = lookup(SEVERITY_OF, F.col("event_type"))
    return e.select(
        F.col("user_id").cast("string").alias("project_id"), F.when(F.col("event_id") % 3 == 0, "agentic").otherwise("workflow").alias("category"), F.concat(F.lit("EV-"), F.upper("event_type")).alias("id"), severity.alias("severity"),
        F.concat(F.lit("src/"), (F.col("event_id") % 7).cast("string"), F.lit(".ts")).alias("file"), (F.col("event_id") % 5).cast("int").alias("line"), lookup(REFUND_TENTHS, severity).alias("penalty"), F.col("event_id").alias("ord"), "value",
    )


_SEV = "CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium' WHEN 'view' THEN 'low' ELSE 'info' END"
_PEN = "CASE event_type WHEN 'error' THEN 15 WHEN 'purchase' THEN 10 WHEN 'click' THEN 5 WHEN 'view' THEN 2 ELSE 0 END"
_FIND = f"""findings AS (
  SELECT user_id::VARCHAR AS project_id, CASE WHEN event_id % 3 = 0 THEN 'agentic' ELSE 'workflow' END AS category, 'EV-' || upper(event_type) AS id,
         {_SEV} AS severity, 'src/' || (event_id % 7)::VARCHAR || '.ts' AS file, (event_id % 5)::INTEGER AS line, {_PEN} AS penalty, event_id AS ord, value
  FROM events
)"""
_LOC = "len(string_split(text, chr(10)))"


def _locs(spark: SparkSession, sf: str) -> DataFrame:
    f = _files(spark, sf)
    return f.select("project_id", "path", F.size(X.lines(F.col("content"))).alias("loc"))


@query(f"""
WITH m AS (SELECT source AS project_id, lpad(doc_id::VARCHAR, 12, '0') AS path, {_LOC} AS loc FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY loc DESC, path) AS rn FROM m)
SELECT project_id, sum(loc)::BIGINT AS total_loc, count(*) AS n_measured, floor(median(loc) + 0.5)::BIGINT AS median_loc, arg_min(path, rn) AS largest, max(loc)::INTEGER AS largest_loc,
       floor(100 * sum(CASE WHEN rn <= 5 THEN loc ELSE 0 END) / sum(loc) + 0.5)::BIGINT AS top5_pct
FROM r GROUP BY project_id""")
def size_metrics(spark, sf):
    return RP.size_metrics(_locs(spark, sf))


@query(f"""
WITH m AS (SELECT source AS project_id, lpad(doc_id::VARCHAR, 12, '0') AS path, {_LOC} AS loc FROM documents)
SELECT project_id, path, loc::INTEGER AS loc, CASE WHEN loc > 75 THEN 'high' WHEN loc > 45 THEN 'medium' ELSE 'low' END AS tier
FROM m WHERE loc > 10 QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY loc DESC, path) <= 25""")
def god_files_topn(spark, sf):
    rows = _locs(spark, sf).withColumn("tier", RP.god_tier(F.col("loc"), ((75, "high", 0), (45, "medium", 0), (10, "low", 0)))).where("tier is not null")
    return RP.top_per_project(rows, [F.desc("loc"), F.col("path")], 25).drop("rn")


@query("""
WITH c AS (SELECT source AS project_id, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY ALL)
SELECT project_id, arg_max(lang, (n, -f)) AS primary_lang, count(*) AS n_langs FROM c GROUP BY project_id""")
def language_histogram(spark, sf):
    exts = {"en": ".ts", "fr": ".py", "de": ".rs", "es": ".go"}
    back = {P.LANGUAGES[e]: k for k, e in exts.items()}
    f = _files(spark, sf).join(_table(spark, sf, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), "lang"), "path")
    named = f.select("project_id", F.concat("path", lookup(exts, F.col("lang"))).alias("path"))
    return RP.languages(named).select("project_id", lookup(back, F.col("primary")).alias("primary_lang"), (F.size("secondary") + 1).cast("long").alias("n_langs"))


@query("""
WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_/+=-]{20,}')) AS token FROM documents),
c AS (SELECT doc_id, token, unnest(string_split(token, '')) AS ch FROM t)
SELECT doc_id, token, floor(1e6 * entropy(ch) + 0.5)::BIGINT AS micro_bits FROM c GROUP BY doc_id, token""")
def token_entropy(spark, sf):
    t = _table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_/+=-]{20,}"), F.lit(0)))).alias("token"))
    return t.select("doc_id", "token", F.floor(1e6 * X.entropy(F.col("token")) + 0.5).alias("micro_bits"))


_PRINTS = """prints AS (
  SELECT source AS project_id, substr(sha256('LINE|' || doc_id::VARCHAR || '|' || trim(regexp_replace(line, '\\s+', ' ', 'g'))), 1, 12) AS fingerprint, doc_id, n
  FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents)
)"""


def _prints(spark, sf):
    d = _table(spark, sf, "documents").select(F.col("source").alias("project_id"), "doc_id", F.posexplode(X.lines(F.col("text"))).alias("n", "line"))
    return d.select("project_id", X.fingerprint(F.lit("LINE"), F.col("doc_id"), X.normal_line(F.col("line"))).alias("fingerprint"), "doc_id", F.col("n").cast("long").alias("n"))


@query(f"WITH {_PRINTS} SELECT project_id, fingerprint, doc_id, n FROM prints")
def line_fingerprints(spark, sf):
    return _prints(spark, sf)


def _runs(spark, sf):
    """Words of a project's documents as findings of two runs: odd documents before, even ones now."""
    d = _table(spark, sf, "documents")
    rows = d.select(F.col("source").alias("project_id"), "doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("fingerprint"))
    return rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1")


_OTHER = """k AS (SELECT project_id, fingerprint, list(doc_id) AS docs, count(*) FILTER (doc_id % 2 = 0) AS now, count(*) FILTER (doc_id % 2 = 1) AS was FROM r GROUP BY ALL)
SELECT project_id, unnest(docs) AS doc_id, fingerprint FROM k"""
_RUNS = """r AS (SELECT DISTINCT source AS project_id, doc_id, unnest(string_split(lower(text), ' ')) AS fingerprint FROM documents)"""


@query(f"WITH {_RUNS}, {_OTHER} WHERE was = 0")
def new_findings(spark, sf):
    cur, base = _runs(spark, sf)
    return A.new_findings(cur, base, F.col("fingerprint"))


@query(f"WITH {_RUNS}, {_OTHER} WHERE now = 0")
def fixed_findings(spark, sf):
    cur, base = _runs(spark, sf)
    return A.new_findings(base, cur, F.col("fingerprint"))


@query(f"""WITH {_RUNS}, k AS (
  SELECT project_id, fingerprint, count(*) FILTER (doc_id % 2 = 0) AS now, count(*) FILTER (doc_id % 2 = 1) AS was FROM r GROUP BY ALL)
SELECT project_id, sum(CASE WHEN was = 0 THEN now ELSE 0 END)::BIGINT AS n_new, sum(CASE WHEN now = 0 THEN was ELSE 0 END)::BIGINT AS n_fixed, sum(CASE WHEN was > 0 THEN now ELSE 0 END)::BIGINT AS n_existing FROM k GROUP BY project_id""")
def report_diff(spark, sf):
    return A.diff(*_runs(spark, sf), F.col("fingerprint"))


@query("""SELECT event_id, event_type, user_id, nullif(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1, 0)::INTEGER AS instance FROM events""")
def instance_numbers(spark, sf):
    return A.with_instances(_table(spark, sf, "events"), ("user_id", "event_type"), "event_id").select("event_id", "event_type", "user_id", F.col("instance").cast("int").alias("instance"))


#: Suppressions of the two queries below.
HIDDEN = [
    {"rule": "ev-error", "file": "src/1.ts", "reason": "known"},
    {"rule": "EV-ERROR", "file": "2.ts", "reason": "by name"},
    {"rule": "EV-CLICK", "reason": "noise"},
    {"rule": "EV-VIEW", "reason": "old", "expires": "2020-01-01"},
    {"rule": "EV-PURCHASE", "file": "lib/", "reason": "stale"},
]
_MATCH = f"""WITH {_FIND}, m AS (
  SELECT *, CASE WHEN id = 'EV-ERROR' AND file = 'src/1.ts' THEN 0 WHEN id = 'EV-ERROR' AND file = 'src/2.ts' THEN 1 WHEN id = 'EV-CLICK' THEN 2 END AS seq_hit FROM findings)"""


def _matched(spark, sf):
    rules = A.active(A.suppression_table(spark, HIDDEN))
    return A.match_suppressions(_findings(spark, sf), rules, {s["file"]: P.glob_regex(s["file"]) for s in HIDDEN if s.get("file")}), rules


@query(f"{_MATCH} SELECT project_id, category, sum({_PEN.replace('event_type', 'lower(substr(id, 4))')})::BIGINT AS refund FROM m WHERE seq_hit IS NOT NULL GROUP BY ALL")
def suppress_refund(spark, sf):
    return A.refunds(_matched(spark, sf)[0])


@query(f"""WITH {_FIND}, rules AS (SELECT * FROM (VALUES (0, 'EV-ERROR', 'src/1.ts'), (1, 'EV-ERROR', '2.ts'), (2, 'EV-CLICK', NULL), (4, 'EV-PURCHASE', 'lib/')) r(seq, rule, place))
SELECT seq, rule FROM rules WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.id = rule AND (place IS NULL OR f.file = place OR ends_with(f.file, '/' || place) OR (ends_with(place, '/') AND contains('/' || f.file, '/' || place))))""")
def stale_suppressions(spark, sf):
    return A.stale(*_matched(spark, sf)).select("seq", "rule")


_LOST = f"""WITH {_FIND}, lost AS (
  SELECT project_id, category, id, least(sum(penalty), CASE WHEN id = 'AGT-003' THEN 20 ELSE 2147483647 END) AS lost FROM findings GROUP BY project_id, category, id
), scores AS (
  SELECT p.project_id, c.category, greatest(0, 100 - coalesce(sum(lost), 0))::BIGINT AS tenths
  FROM (SELECT DISTINCT project_id FROM findings) p CROSS JOIN (VALUES ('structure', 10), ('security', 20), ('dependencies', 15), ('docker', 10), ('tests', 15), ('consistency', 8), ('agentic', 15), ('workflow', 10)) c(category, weight)
  LEFT JOIN lost l ON l.project_id = p.project_id AND l.category = c.category GROUP BY p.project_id, c.category
), weights AS (SELECT * FROM (VALUES ('structure', 10), ('security', 20), ('dependencies', 15), ('docker', 10), ('tests', 15), ('consistency', 8), ('agentic', 15), ('workflow', 10)) w(category, weight))"""


@query(f"{_LOST} SELECT project_id, category, tenths FROM scores")
def category_score(spark, sf):
    f = _findings(spark, sf)
    return A.category_scores(f, f)


@query(f"{_LOST} SELECT project_id, floor(sum(tenths * weight) / sum(weight * 10) * 10 + 0.5) / 10 AS overall FROM scores JOIN weights USING (category) GROUP BY project_id")
def overall_score(spark, sf):
    return A.overall_score(category_score(spark, sf))


_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITIES)


@query(f"WITH {_FIND} SELECT project_id, {_COUNTS} FROM findings GROUP BY project_id")
def severity_pivot(spark, sf):
    return A.severity_counts(_findings(spark, sf))


@query(f"""{_LOST}, o AS (SELECT project_id, floor(sum(tenths * weight) / sum(weight * 10) * 10 + 0.5) / 10 AS overall FROM scores JOIN weights USING (category) GROUP BY project_id),
n AS (SELECT project_id, {_COUNTS} FROM findings GROUP BY project_id),
j AS (SELECT project_id, (overall < 7.5)::INTEGER + (critical + high > 0)::INTEGER + (critical > 3)::INTEGER + (high > 2)::INTEGER AS n_reasons FROM o JOIN n USING (project_id))
SELECT project_id, n_reasons = 0 AS passed, n_reasons FROM j""")
def quality_gate(spark, sf):
    f = _findings(spark, sf)
    return A.quality_gate(A.overall_score(A.category_scores(f, f)), f, 7.5, "high", 3, 2).select("project_id", "passed", F.size("reasons").alias("n_reasons"))


_VOTE = """v AS (
  SELECT event_id, voter, CASE (event_id * (voter + 3) + voter) % 4 WHEN 0 THEN 'real' WHEN 1 THEN 'real' WHEN 2 THEN 'false-positive' ELSE 'uncertain' END AS c, ((event_id * 7 + voter * 13) % 16) / 16.0 AS confidence
  FROM events, (VALUES (0), (1), (2)) t(voter))"""


@query(f"""WITH {_VOTE}, t AS (
  SELECT event_id, count(*) FILTER (c = 'false-positive') AS fp, count(*) FILTER (c = 'real') AS re FROM v GROUP BY event_id
), w AS (SELECT *, CASE WHEN fp = 3 THEN 'false-positive' WHEN re >= 2 THEN 'real' ELSE 'uncertain' END AS classification FROM t)
SELECT w.event_id, w.classification, coalesce(avg(v.confidence), 0)::DOUBLE AS confidence, coalesce(arg_max('voter ' || v.voter::VARCHAR, (v.confidence, -v.voter)), 'the panel did not agree')
       || ' [panel: ' || re || ' real, ' || fp || ' fp, ' || (3 - re - fp) || ' uncertain]' AS reasoning
FROM w LEFT JOIN v ON v.event_id = w.event_id AND v.c = w.classification GROUP BY w.event_id, w.classification, re, fp""")
def panel_vote(spark, sf):
    e = _table(spark, sf, "events").select("event_id", F.explode(F.array(*map(F.lit, range(3)))).alias("voter"))
    k = (F.col("event_id") * (F.col("voter") + 3) + F.col("voter")) % 4
    votes = e.select("event_id", "voter", F.when(k < 2, "real").when(k == 2, "false-positive").otherwise("uncertain").alias("classification"), (((F.col("event_id") * 7 + F.col("voter") * 13) % 16) / 16.0).alias("confidence"), F.concat(F.lit("voter "), F.col("voter").cast("string")).alias("reasoning"))
    return TR.panel_vote(votes, ("event_id",))


@query("""SELECT d.doc_id, CASE quality WHEN 1 THEN 'real' WHEN 0 THEN 'false-positive' ELSE 'uncertain' END AS classification, CASE WHEN quality IS NULL THEN 0.0 ELSE 0.5 END::DOUBLE AS confidence FROM documents d LEFT JOIN labels l USING (doc_id)""")
def verdict_alignment(spark, sf):
    key = F.concat(F.lit("K|"), F.col("doc_id").cast("string"), F.lit("|"))
    keyed = _table(spark, sf, "documents").select("doc_id", F.lit("p").alias("project_id"), key.alias("finding_key"))
    given = _table(spark, sf, "labels").select(F.lit("p").alias("project_id"), A.bare_key(key).alias("finding_key"), F.when(F.col("quality") == 1, "real").otherwise("false-positive").alias("classification"), F.lit(0.5).alias("confidence"), F.lit("").alias("reasoning"), F.lit(0).alias("seq"))
    return TR.align(keyed, given).select("doc_id", "classification", "confidence")


@query("""SELECT conv_id, role, count(*) AS n, string_agg('TURN|' || role || '|' || turn::VARCHAR, ',' ORDER BY turn) AS keys, max(length(coalesce(text, '')))::BIGINT AS longest FROM conversations GROUP BY conv_id, role""")
def triage_units(spark, sf):
    """Turns as findings, a role's as those of one file: units hold a file's findings in order, with keys and content."""
    c = _table(spark, sf, "conversations").withColumn("project_id", F.col("conv_id").cast("string"))
    found = c.select("project_id", F.lit("TURN").alias("id"), F.lit("low").alias("severity"), F.lit("t").alias("title"), F.col("role").alias("file"), F.col("turn").cast("int").alias("line"), F.col("turn").cast("int").alias("ord"))
    files = c.groupBy("project_id", F.col("role").alias("path")).agg(F.max(F.length(F.coalesce("text", F.lit("")))).cast("string").alias("content"))
    units = TR.units(found, files)
    return units.select(F.col("project_id").cast("long").alias("conv_id"), F.col("file").alias("role"), F.size("findings").cast("long").alias("n"), F.array_join(F.transform("findings", lambda f: f["key"]), ",").alias("keys"), F.col("content").cast("long").alias("longest"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l, (doc_id % 9 + 1) AS n FROM documents)
SELECT doc_id, greatest(1, n - 3)::INTEGER AS start_line, least(len(l), n + 3)::INTEGER AS end_line, array_to_string(l[greatest(1, n - 3):least(len(l), n + 3)], chr(10)) AS code FROM l""")
def snippets(spark, sf):
    d = _table(spark, sf, "documents").select("doc_id", X.snippet(F.col("text"), (F.col("doc_id") % 9 + 1).cast("int")).alias("s"))
    return d.select("doc_id", F.col("s.start_line").cast("int").alias("start_line"), F.col("s.end_line").cast("int").alias("end_line"), "s.code")


def _flows(spark, sf):
    """Nations with an edge to those that sell them much more than their suppliers' average."""
    li, s, o, c = (_table(spark, sf, t) for t in ("lineitem", "supplier", "orders", "customer"))
    flow = li.join(s, li.l_suppkey == s.s_suppkey).join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    flow = flow.groupBy(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b")).agg(F.count("*").alias("n"))
    mean = F.avg("n").over(W.partitionBy("b"))
    return flow.withColumn("m", mean).where(F.col("n") > 1.25 * F.col("m")).select("a", "b")


_FLOW = """RECURSIVE flow AS (
  SELECT s_nationkey AS a, c_nationkey AS b, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL
), edge AS (SELECT a, b FROM flow QUALIFY n > 1.25 * avg(n) OVER (PARTITION BY b)),
reach AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a)"""


@query(f"""WITH {_FLOW}, scc AS (SELECT x.a AS node, least(x.a, min(x.b)) AS root FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT root AS first_nation, count(*)::INTEGER AS n_members, string_agg(node::VARCHAR, ',' ORDER BY node) AS members FROM scc GROUP BY root""")
def scc_nation_graph(spark, sf):
    e = _flows(spark, sf).select(F.lit("nations").alias("project_id"), F.lpad(F.col("a").cast("string"), 3, "0").alias("src"), F.lpad(F.col("b").cast("string"), 3, "0").alias("dst"))
    m = G.cycles(e).select(F.array_sort(F.transform("members", lambda x: x.cast("int"))).alias("m"))
    return m.select(F.col("m")[0].alias("first_nation"), F.size("m").alias("n_members"), F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("members"))


@query("""SELECT p_brand, count(*) FILTER (contains(p_name, '-')) AS kebab, count(*) FILTER (regexp_matches(p_name, '[a-z][A-Z]')) AS camel, count(*) FILTER (contains(p_name, '_') AND NOT starts_with(p_name, '_')) AS snake,
       count(*) FILTER (NOT contains(p_name, '-') AND NOT contains(p_name, '_') AND NOT regexp_matches(p_name, '^[A-Z][a-zA-Z0-9]*$') AND NOT regexp_matches(p_name, '^[a-z][a-zA-Z0-9]*[A-Z]') AND NOT regexp_matches(p_name, '^[a-z][a-z0-9]*$')) AS other
FROM part GROUP BY p_brand""")
def naming_style(spark, sf):
    p = _table(spark, sf, "part").select("p_brand", F.col("p_name"))
    files = p.select(F.col("p_brand").alias("project_id"), F.concat("p_name", F.lit(".ts")).alias("path"), F.lit("").alias("content"))
    other = p.groupBy(F.col("p_brand").alias("project_id")).agg(F.count_if(X.naming_style(F.col("p_name")) == "other").alias("other"))
    return RP.project_meta(files).select("project_id", "kebab", "camel", "snake").join(other, "project_id").withColumnRenamed("project_id", "p_brand")


@query("""WITH l AS (SELECT source, list_bool_or(list_transform(string_split(html, '>'), lambda x: starts_with(x, chr(9)))) AS t, list_bool_or(list_transform(string_split(html, '>'), lambda x: starts_with(x, '  '))) AS s
  FROM (SELECT split_part(url, '/', 3) AS source, html FROM pages))
SELECT source, count(*) FILTER (t AND s) AS mixed, count(*) FILTER (t AND NOT s) AS tabs, count(*) FILTER (s AND NOT t) AS spaces, count(*) FILTER (NOT t AND NOT s) AS none FROM l GROUP BY source""")
def indentation(spark, sf):
    p = _table(spark, sf, "pages").select(F.split("url", "/")[2].alias("source"), X.indentation(F.replace("html", F.lit(">"), F.lit("\n"))).alias("style"), F.col("html"))
    return p.groupBy("source").agg(*(F.count_if(F.col("style") == k).alias(k) for k in ("mixed", "tabs", "spaces", "none")))


@query("""WITH j AS (SELECT (quality = 0) AS e, (len(regexp_extract_all(text, '[#*$%&|<>]')) > 20) AS a FROM documents JOIN labels USING (doc_id)),
c AS (SELECT count(*) FILTER (e AND a) AS tp, count(*) FILTER (a AND NOT e) AS fp, count(*) FILTER (e AND NOT a) AS fn FROM j)
SELECT tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM c""")
def precision_recall(spark, sf):
    d, labels = _table(spark, sf, "documents"), _table(spark, sf, "labels")
    row = lambda df: df.select(F.lit("c").alias("name"), F.col("doc_id").cast("string").alias("file"), F.lit("noise").alias("id"))
    found = d.where(F.regexp_count("text", F.lit("[#*$%&|<>]")) > 20).join(labels.select("doc_id"), "doc_id", "left_semi")
    return A.precision_recall(row(labels.where("quality = 0")), row(found))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
c AS (SELECT page_id, href, 0 AS pos, ltrim(href, '/') || '.ts' AS p FROM l UNION ALL SELECT page_id, href, 1, ltrim(href, '/') || '/index.ts' FROM l),
f AS (SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN ltrim(href, '/') || '.ts' ELSE ltrim(href, '/') || '/index.ts' END AS p FROM l)
SELECT page_id, href, arg_min(c.p, pos) AS dst FROM c JOIN f USING (p) GROUP BY page_id, href""")
def resolve_candidates(spark, sf):
    """Links resolved like imports: candidates in order against the files that exist."""
    links = _table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    raw = F.regexp_replace("href", "^/+", "")
    exists = links.select(F.lit("p").alias("project_id"), F.concat(raw, F.when(F.col("page_id") % 2 == 0, ".ts").otherwise("/index.ts")).alias("path")).distinct()
    rows = links.distinct().select(F.lit("p").alias("project_id"), "page_id", "href", P.import_candidates(raw).alias("candidates"))
    return G.first_existing(rows, ["page_id", "href"], exists).select("page_id", "href", "dst")


@query(f"WITH {_FIND} SELECT ord, row_number() OVER (PARTITION BY project_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, ord)::INTEGER AS place FROM findings")
def report_order(spark, sf):
    f = _findings(spark, sf).withColumnRenamed("ord", "event")
    placed = A.with_ordinal(f.withColumns({"analyzer": F.lit(0), "phase": F.lit(0), "file_ord": F.lit(""), "seq": F.col("event")}))
    return placed.select(F.col("event").alias("ord"), F.col("ord").alias("place"))


@query("""SELECT page_id, CASE WHEN regexp_matches(p, '(^|/)(dist|build|out|gen)/') THEN 'generated' WHEN regexp_matches(p, '(^|/)(vendor|external)/') THEN 'vendor'
  WHEN regexp_matches(p, '(^|/)(mocks|fake)/') THEN 'fixture' WHEN regexp_matches(p, '(^|/)(tests|test)/') THEN 'test' WHEN regexp_matches(p, '(^|/)(demo|assets)/') THEN 'template' ELSE 'source' END AS role
FROM (SELECT page_id, ['src','tests','dist','vendor','mocks','demo','assets','test','out'][page_id % 9 + 1] || '/' || ['a','gen','fake','b','external'][page_id % 5 + 1] || '/' || page_id::VARCHAR || '.ts' AS p FROM pages)""")
def file_roles(spark, sf):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("page_id") % n + 1).cast("int"))
    path = F.concat_ws("/", pick(["src", "tests", "dist", "vendor", "mocks", "demo", "assets", "test", "out"], 9), pick(["a", "gen", "fake", "b", "external"], 5), F.concat(F.col("page_id").cast("string"), F.lit(".ts")))
    return _table(spark, sf, "pages").select("page_id", P.context(path).alias("role"))


@query(f"""WITH v AS (SELECT event_id, {_SEV} AS s, ['source','test','fixture'][event_id % 3 + 1] AS role FROM events)
SELECT event_id, CASE role WHEN 'source' THEN s ELSE CASE s WHEN 'critical' THEN 'medium' WHEN 'high' THEN 'low' ELSE 'info' END END AS severity FROM v WHERE role <> 'fixture'""")
def severity_by_role(spark, sf):
    role = F.element_at(F.array(*map(F.lit, ["source", "test", "fixture"])), (F.col("event_id") % 3 + 1).cast("int"))
    return _table(spark, sf, "events").select("event_id", P.adjusted_severity(lookup(SEVERITY_OF, F.col("event_type")), role).alias("severity")).where("severity is not null")


@query("SELECT event_id, json_extract(props, '$.k')::INTEGER AS k, json_extract(props, '$.k')::INTEGER % 3 = 0 AS pinned FROM events")
def manifest_fields(spark, sf):
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return _table(spark, sf, "events").select("event_id", v.alias("k"), (v % 3 == 0).alias("pinned"))


#: Ignore files of the derived trees, by whether a project's number is even, and the files of a tree by doc_id.
_IGNORE = {0: "# output\n*.log\n!kept.log\n/out/\ncache\n\ndocs/**/draft-?.md\ntmp/*\n!tmp/stay.txt", 1: "*.l*g\n/gen\nsub/cache/\n!dist\n[ab].txt\nlib/**\n!lib/own.ts"}
_TREE = [
    "m{}.log", "kept.log", "out/{}.txt", "src/out/{}.txt", "cache", "src/cache/{}/y.txt", "docs/{}/b/draft-1.md", "docs/draft-22.md", "tmp/stay.txt", "tmp/sub/{}.txt", "src/kept.log/{}.ts", "gen/{}/z.ts", "src/gen/{}.ts", "sub/cache", "sub/cache/{}.ts",
    "dist/{}.js", "src/a.txt/{}", "c.txt", "lib/own.ts", "lib/{}/own.ts", "src/{}.ts", "out", "node_modules/{}/i.js",
]
_FITS = {  # for the SQL: each pattern by hand as (verdict, regular expression of an entry, folders only), in order
    0: [(1, r"(^|/)[^/]*\.log$", 0), (0, r"(^|/)kept\.log$", 0), (1, "^out$", 1), (1, "(^|/)cache$", 0), (1, r"^docs/(.*/)?draft-[^/]\.md$", 0), (1, "^tmp/[^/]*$", 0), (0, r"^tmp/stay\.txt$", 0), (1, "(^|/)(node_modules|dist)$", 0)],
    1: [(1, r"(^|/)[^/]*\.l[^/]*g$", 0), (1, "^gen$", 0), (1, "^sub/cache$", 1), (0, "(^|/)dist$", 0), (1, r"(^|/)[ab]\.txt$", 0), (1, "^lib/.*$", 0), (0, r"^lib/own\.ts$", 0), (1, "(^|/)(node_modules|dist)$", 0)],
}
_VERDICT = "CASE " + " ".join(f"WHEN project % 2 = {k} AND {'is_dir AND ' if only else ''}regexp_matches(entry, '{p}') THEN {v}" for k, fits in _FITS.items() for v, p, only in reversed(fits)) + " ELSE 0 END"
_ENTRIES = "array_to_string(parts[1:n], '/') AS entry, n < len(parts) AS is_dir"


@query(f"""WITH files AS (SELECT DISTINCT doc_id // 40 AS project, replace([{', '.join(f"'{p}'" for p in _TREE)}][(doc_id * 7 + length(coalesce(text, ''))) % {len(_TREE)} + 1], '{{}}', doc_id::VARCHAR) AS path FROM documents),
entries AS (SELECT project, path, {_ENTRIES} FROM (SELECT project, path, string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')) + 1)) AS n FROM files)),
entry AS (SELECT project, entry, bool_or(is_dir) AS is_dir FROM entries GROUP BY ALL), ignored AS (SELECT project, entry FROM entry WHERE {_VERDICT} = 1)
SELECT DISTINCT 'p' || project AS project_id, path FROM entries SEMI JOIN ignored USING (project, entry)""")
def ignored_files(spark, sf):
    """Files of derived trees that their projects' own ignore files name."""
    pick = F.element_at(F.array(*map(F.lit, _TREE)), ((F.col("doc_id") * 7 + F.length(F.coalesce("text", F.lit("")))) % len(_TREE) + 1).cast("int"))
    project = F.floor(F.col("doc_id") / 40)
    files = _table(spark, sf, "documents").select(project.alias("project"), F.replace(pick, F.lit("{}"), F.col("doc_id").cast("string")).alias("path")).distinct()
    rules = files.select("project").distinct().select("project", F.lit(".gitignore").alias("path"), F.when(F.col("project") % 2 == 0, _IGNORE[0]).otherwise(_IGNORE[1]).alias("content"))
    every = files.withColumn("content", F.lit(None).cast("string")).unionByName(rules).withColumn("project_id", F.concat(F.lit("p"), F.col("project").cast("string")))
    return IG.ignored_paths(every, IG.pattern_rows(every, (".gitignore",)))
