"""Reports as JSON, SARIF, JUnit and HTML. All are expressions over a table of reports, so a corpus is rendered in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_xml, wrap_text
from ..schema import CATEGORIES, RULES, SARIF_LEVEL, SARIF_SCORE, SEVERITIES, lookup

TOOL = "auditloom"


#: What the summary of the agent rules calls each of them.
AGENT_RISKS = {"AGT-001": "shell-injection", "AGT-002": "secret-in-prompt", "AGT-003": "unconfirmed-destructive-tool", "AGT-004": "external-content-in-prompt", "AGT-005": "public-mcp-bind", "AGT-006": "fail-open-gate"}


def summaries(findings: DataFrame) -> DataFrame:
    """project_id, category, summary of categories with findings: their number, and for the agent rules that of each."""
    per = findings.groupBy("project_id", "category").agg(F.count("*").alias("n"), *(F.count_if(F.col("id") == i).alias(i) for i in AGENT_RISKS))
    parts = F.concat_ws(", ", *(F.when(F.col(f"`{i}`") > 0, F.concat(F.col(f"`{i}`").cast("string"), F.lit(f" {name}"))) for i, name in AGENT_RISKS.items()))
    plain = F.concat(F.col("n").cast("string"), F.lit(" findings"))
    return per.select("project_id", "category", F.when(F.col("category") == "agentic", F.concat(F.col("n").cast("string"), F.lit(" agent-specific risk(s): "), parts)).otherwise(plain).alias("summary"))


def reports(scores: DataFrame, overall: DataFrame, findings: DataFrame, version: str, paths: dict[str, str] | None = None, more: dict[str, DataFrame | None] | None = None) -> DataFrame:
    """One row a project: overall score, categories in order, findings in report order with instance and advice. paths: where
    a project's tree lies, where that is known. more: field -> table of project_id and that field, null where it has no row."""
    scores = scores.join(summaries(findings), ["project_id", "category"], "left").withColumn("summary", F.coalesce("summary", F.lit("no findings")))
    inner = F.struct("ord", "id", "category", "severity", "title", "file", "line", "instance", "note", lookup({k: r.advice for k, r in RULES.items()}, F.col("id")).alias("suggestion"), "fingerprint")
    listed = findings.groupBy("project_id").agg(F.array_sort(F.collect_list(inner)).alias("findings"))  # a project's findings: what a report holds
    order = lookup({c: i for i, c in enumerate(CATEGORIES)}, F.col("category"))
    cats = scores.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "category", (F.col("tenths") / 10).alias("score"), "summary"))).alias("categories"))
    out = overall.join(cats, "project_id").join(listed, "project_id", "left")
    none = F.lit(None).cast(listed.schema["findings"].dataType)
    more = {name: df for name, df in (more or {}).items() if df is not None}
    for name, df in more.items():
        out = out.join(df.select("project_id", name), "project_id", "left")
    return out.select(
        F.col("project_id").alias("projectName"), (lookup(paths, F.col("project_id")) if paths else F.lit(None).cast("string")).alias("projectPath"), F.lit(version).alias("version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("completedAt"), F.col("overall").alias("overallScore"),
        F.transform("categories", lambda c: F.struct(c["category"].alias("category"), c["score"].alias("score"), c["summary"].alias("summary"))).alias("categories"), F.coalesce("findings", F.filter(none, lambda x: F.lit(False)), F.array().cast(listed.schema["findings"].dataType)).alias("findings"), *more,
    )


def to_json(df: DataFrame) -> DataFrame:
    return df.select("projectName", F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def to_sarif(df: DataFrame) -> DataFrame:
    """SARIF 2.1.0; a rule is told once, as its first finding has it."""
    f = F.col("findings")
    ids = F.array_distinct(F.transform(f, lambda x: x["id"]))
    first = F.transform(ids, lambda i: F.filter(f, lambda x: x["id"] == i)[0])
    rules = F.transform(first, lambda x: F.struct(
        x["id"].alias("id"), x["id"].alias("name"), F.struct(x["title"].alias("text")).alias("shortDescription"),
        F.struct(x["category"].alias("category"), lookup(SARIF_SCORE, x["severity"]).alias("security-severity"), F.array(x["category"], x["severity"]).alias("tags")).alias("properties"),
    ))
    place = lambda x: F.when(x["file"].isNotNull(), F.array(F.struct(F.struct(F.struct(x["file"].alias("uri")).alias("artifactLocation"), F.when(x["line"].isNotNull(), F.struct(x["line"].alias("startLine"))).alias("region")).alias("physicalLocation"))))
    results = F.transform(f, lambda x: F.struct(
        x["id"].alias("ruleId"), lookup(SARIF_LEVEL, x["severity"]).alias("level"), F.struct(F.concat_ws(": ", x["title"], x["suggestion"]).alias("text")).alias("message"), place(x).alias("locations"),
        F.struct(F.concat_ws(":", x["id"], F.coalesce(x["file"], F.lit("")), F.coalesce(x["instance"], F.lit(0)).cast("string")).alias("finding/v1")).alias("partialFingerprints"),
    ))
    driver = F.struct(F.lit(TOOL).alias("name"), F.col("version").alias("version"), rules.alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), results.alias("results"))
    doc = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return df.select("projectName", F.to_json(doc, {"pretty": "true"}).alias("sarif"))


def to_junit(df: DataFrame) -> DataFrame:
    """A suite for each category, a failing case for each finding; clean suites are empty."""

    def case(x: Column) -> Column:
        where = F.when(x["file"].isNull(), F.lit("project")).otherwise(F.concat(x["file"], F.when(x["line"].isNotNull(), F.concat(F.lit(":"), x["line"].cast("string"))).otherwise("")))
        name, cls = escape_xml(F.concat(x["id"], F.lit(": "), x["title"])), escape_xml(x["category"])
        message = escape_xml(F.concat(F.lit("["), x["severity"], F.lit("] "), x["title"], F.lit(" ("), where, F.lit(")")))
        body = escape_xml(F.concat_ws("\n\n", x["title"], F.concat(F.lit("Suggestion: "), x["suggestion"])))
        return F.concat(F.lit('    <testcase name="'), name, F.lit(f'" classname="{TOOL}.'), cls, F.lit('">\n      <failure message="'), message, F.lit('" type="'), escape_xml(x["severity"]), F.lit('">'), body, F.lit("</failure>\n    </testcase>"))

    def suite(c: Column) -> Column:
        mine = F.filter("findings", lambda x: x["category"] == c["category"])
        n = F.size(mine).cast("string")
        head = F.concat(F.lit('  <testsuite name="'), escape_xml(c["category"]), F.lit('" tests="'), n, F.lit('" failures="'), n, F.lit('">'))
        return F.concat(head, F.when(F.size(mine) > 0, F.concat(F.lit("\n"), F.array_join(F.transform(mine, case), "\n"), F.lit("\n  "))).otherwise(""), F.lit("</testsuite>"))

    n = F.size("findings").cast("string")
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<testsuites name="'), escape_xml(F.concat(F.lit(f"{TOOL} "), F.col("projectName"))), F.lit('" tests="'), n, F.lit('" failures="'), n, F.lit('">\n'))
    return df.select("projectName", F.concat(head, F.array_join(F.transform("categories", suite), "\n"), F.lit("\n</testsuites>\n")).alias("junit"))


def band(score: Column) -> Column:
    return F.when(score >= 8, "good").when(score >= 6, "fair").when(score >= 4, "poor").otherwise("bad")


def verdict_of(df: DataFrame, x: Column) -> Column:
    """A finding's verdict and fix as text, null where the report has none."""
    if "verdicts" not in df.columns:
        return F.lit(None).cast("string")
    key = F.concat(F.concat_ws("|", x["id"], F.coalesce(x["file"], F.lit("")), F.coalesce(x["line"].cast("string"), F.lit(""))), F.when(x["instance"] > 0, F.concat(F.lit("#"), x["instance"].cast("string"))).otherwise(""))
    of = lambda name: F.try_element_at(F.filter(name, lambda v: v["findingKey"] == key), F.lit(1))
    return F.concat(of("verdicts")["classification"], F.coalesce(F.concat(F.lit("; fix: "), of("remediations")["fix"]), F.lit("")))


def to_html(df: DataFrame) -> DataFrame:
    """One self-contained page a project, every value escaped."""
    esc = escape_xml
    text = lambda c: c.cast("string")
    cats = F.transform("categories", lambda c: F.concat(F.lit('<tr class="'), band(c["score"]), F.lit('"><td>'), esc(c["category"]), F.lit("</td><td>"), text(c["score"]), F.lit("</td></tr>")))
    rows = F.transform("findings", lambda x: F.concat(F.lit('<li class="'), esc(x["severity"]), F.lit('"><b>'), esc(x["id"]), F.lit("</b> "), esc(x["title"]), F.lit(" <code>"), esc(F.concat_ws(":", x["file"], text(x["line"]))), F.lit("</code><p>"), esc(F.coalesce(x["suggestion"], F.lit(""))), F.lit("</p>"), F.coalesce(F.concat(F.lit("<p>"), esc(verdict_of(df, x)), F.lit("</p>")), F.lit("")), F.lit("</li>")))
    style = "body{font:14px sans-serif;max-width:60em;margin:auto}.good{color:#070}.fair{color:#770}.poor{color:#a50}.bad,.critical{color:#a00}"
    page = F.concat(
        F.lit(f'<!DOCTYPE html><html><head><meta charset="utf-8"><style>{style}</style><title>'), esc(F.col("projectName")), F.lit("</title></head><body><h1>"), esc(F.col("projectName")), F.lit('</h1><p class="'), band(F.col("overallScore")),
        F.lit('">'), text(F.col("overallScore")), F.lit("/10</p><table>"), F.array_join(cats, ""), F.lit("</table><ul>"), F.array_join(rows, ""), F.lit("</ul></body></html>\n"),
    )
    return df.select("projectName", page.alias("html"))


def to_text(df: DataFrame, width: int = 20, columns: int = 88) -> DataFrame:
    """Plain report: a bar for each category, findings in order under their severity, then the summary of a model in lines of
    `columns` characters, warnings, what is suppressed and how many findings of capped rules are left out."""
    bar = lambda c: F.concat(F.rpad(c["category"], 14, " "), F.repeat(F.lit("#"), (c["score"] * width / 10).cast("int")), F.repeat(F.lit("."), width - (c["score"] * width / 10).cast("int")), F.lit(" "), c["score"].cast("string"))
    row = lambda x: F.concat(F.lit("["), x["severity"], F.lit("] "), x["id"], F.lit(" "), x["title"], F.lit(" "), F.concat_ws(":", x["file"], x["line"].cast("string")), F.coalesce(F.concat(F.lit(" ("), verdict_of(df, x), F.lit(")")), F.lit("")))
    head = F.concat(F.col("projectName"), F.lit("  "), F.col("overallScore").cast("string"), F.lit("/10"))
    group = lambda s: F.filter("findings", lambda x: x["severity"] == s)
    groups = [F.when(F.size(group(s)) > 0, F.concat(F.lit(f"{s} ("), F.size(group(s)).cast("string"), F.lit(")\n"), F.array_join(F.transform(group(s), row), "\n"))) for s in SEVERITIES]
    tails = {
        "aiSummary": lambda c: F.array_join(wrap_text(c, columns), "\n"),
        "warnings": lambda c: F.array_join(F.transform(c, lambda w: F.concat(F.lit("warning: "), w)), "\n"),
        "suppressed": lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("suppressed: "), F.concat_ws(" ", x["id"], F.concat_ws(":", x["file"], x["line"].cast("string"))), F.lit(" - "), F.coalesce(x["reason"], F.lit("")))), "\n"),
        "omitted": lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("left out: "), x["n"].cast("string"), F.lit(" more of "), x["id"])), "\n"),
    }
    more = [F.nullif(tail(F.col(name)), F.lit("")) for name, tail in tails.items() if name in df.columns]
    return df.select("projectName", F.concat_ws("\n", head, F.array_join(F.transform("categories", bar), "\n"), *groups, *more).alias("text"))
