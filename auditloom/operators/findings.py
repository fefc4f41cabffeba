"""Algebra of findings: order, keys, instances, fingerprints, suppressions, diffs, gates and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import paths as P
from ..functions import text as X
from ..schema import CAP_TENTHS, CATEGORIES, GATE_RANK, REFUND_TENTHS, SEVERITIES, SUPPRESSIONS, WEIGHT_TENTHS, lookup


def severity_order(severity: Column) -> Column:
    return lookup({s: i for i, s in enumerate(SEVERITIES)}, severity)


REPORT_ORDER = ("rank", "analyzer", "phase", "file_ord", "seq", "line", "id")


def with_ordinal(findings: DataFrame) -> DataFrame:
    """`ord`: place in the project's report, worst first, ties in the order in which rules ran."""
    order = [severity_order(F.col("severity")) if c == "rank" else F.col(c) for c in REPORT_ORDER]
    return findings.withColumn("ord", F.row_number().over(W.partitionBy("project_id").orderBy(*order)))


def with_instances(findings: DataFrame, keys: tuple[str, ...] = ("project_id", "id", "file", "line"), order: str = "ord") -> DataFrame:
    """`instance`: null for the first of those that share a key, then 1, 2, ..."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
    return findings.withColumn("instance", F.nullif(rank, F.lit(0)))


def finding_key(instance: bool = True) -> Column:
    base = F.concat_ws("|", "id", F.coalesce("file", F.lit("")), F.coalesce(F.col("line").cast("string"), F.lit("")))
    return F.concat(base, F.when(F.col("instance") > 0, F.concat(F.lit("#"), F.col("instance").cast("string"))).otherwise("")) if instance else base


def bare_key(key: Column) -> Column:
    """Keys compare without the bars that models tend to trim."""
    return F.regexp_replace(key, r"\|+\z", "")


def with_fingerprints(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Rule, file and the flagged line's normal form; without the line where the file cannot be read."""
    asked = findings.where("file is not null and line is not null").groupBy("project_id", "file").agg(F.collect_set("line").alias("_asked"))  # a file's lines
    text = files.select("project_id", F.col("path").alias("file"), "content").join(asked, ["project_id", "file"])
    # of each flagged file only the flagged lines go on
    shown = text.select("project_id", "file", "_asked", X.lines(F.col("content")).alias("_all")).select("project_id", "file", F.explode(F.transform("_asked", lambda n: F.struct(n.alias("line"), X.normal_line(F.try_element_at(F.col("_all"), n)).alias("_shown")))).alias("_l"))
    rows = findings.join(shown.select("project_id", "file", "_l.*"), ["project_id", "file", "line"], "left")
    return rows.select(*findings.columns, X.fingerprint(F.col("id"), F.col("file"), F.col("_shown")).alias("fingerprint"))


def suppression_table(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """entries: rule, reason, and optionally file (an ignore-file pattern) and expires (YYYY-MM-DD)."""
    import datetime

    rows = [(i, e["rule"], e.get("file"), e["reason"], datetime.date.fromisoformat(e["expires"]) if e.get("expires") else None) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, SUPPRESSIONS)


def active(suppressions: DataFrame, today: Column | None = None) -> DataFrame:
    """A suppression holds through the day on which it expires."""
    return suppressions.where(F.col("expires").isNull() | (F.col("expires") >= (F.current_date() if today is None else today)))


def match_suppressions(findings: DataFrame, suppressions: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """findings with `seq_hit` and `reason` of the first active suppression that fits, null where none does. The table of
    suppressions is configuration: it is joined on the rule, and only its few rows of a rule are compared by file.
    patterns: file pattern -> regular expression; taken from the table where it is not given."""
    if patterns is None:
        patterns = {r["file"]: P.glob_regex(r["file"]) for r in suppressions.select("file").where("file is not null").distinct().collect()}
    regex = suppressions.sparkSession.createDataFrame([*patterns.items()], "file string, regex string")
    rules = suppressions.join(F.broadcast(regex), "file", "left").select(F.upper("rule").alias("_rule"), F.col("seq").alias("_seq"), F.col("file").alias("_file"), "regex", F.col("reason").alias("_reason"))
    by_rule = rules.groupBy("_rule").agg(F.array_sort(F.collect_list(F.struct("_seq", "_file", "regex", "_reason"))).alias("_all"))  # configuration: one short list a rule
    rows = findings.join(F.broadcast(by_rule), F.upper("id") == F.col("_rule"), "left")
    fits = F.filter("_all", lambda s: s["_file"].isNull() | F.coalesce(F.regexp_like(F.col("file"), s["regex"]), F.lit(False)))
    return rows.withColumn("_hit", F.try_element_at(fits, F.lit(1))).withColumns({"seq_hit": F.col("_hit._seq"), "reason": F.col("_hit._reason")}).drop("_rule", "_all", "_hit")


def refunds(matched: DataFrame) -> DataFrame:
    """Tenths that suppressed findings give back, by project and category."""
    return matched.where("seq_hit is not null").groupBy("project_id", "category").agg(F.sum(lookup(REFUND_TENTHS, F.col("severity"))).alias("refund"))


def stale(matched: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Active suppressions that no finding fits."""
    return suppressions.join(matched.select(F.col("seq_hit").alias("seq")).where("seq is not null").distinct(), "seq", "left_anti")


def suppression_warnings(projects: DataFrame, matched: DataFrame, given: DataFrame, rules: DataFrame) -> DataFrame:
    """project_id and warnings: which suppressions have expired, and which of the active ones (rules) fit no finding of the
    project. The table of suppressions is configuration: each project meets its few rows."""
    fits = matched.where("seq_hit is not null").groupBy("project_id").agg(F.collect_set("seq_hit").alias("_hit"))  # of a few suppressions
    of = given.join(rules.select("seq", F.lit(True).alias("_on")), "seq", "left")
    name = F.concat(F.lit("suppression of "), "rule", F.coalesce(F.concat(F.lit(" in "), "file"), F.lit("")))
    every = of.agg(F.array_sort(F.collect_list(F.struct("seq", name.alias("name"), F.coalesce("_on", F.lit(False)).alias("on"), F.col("expires").cast("string").alias("expires")))).alias("all")).first()["all"]
    asked = F.array(*(F.struct(*(F.lit(x[k]).cast(t).alias(k) for k, t in (("seq", "int"), ("name", "string"), ("on", "boolean"), ("expires", "string")))) for x in every))
    idle = F.filter(asked, lambda s: ~s["on"] | ~F.array_contains(F.coalesce("_hit", F.array().cast("array<int>")), s["seq"]))
    told = F.transform(idle, lambda s: F.when(s["on"], F.concat(s["name"], F.lit(" fits no finding"))).otherwise(F.concat(s["name"], F.lit(" expired on "), s["expires"])))
    return projects.join(fits, "project_id", "left").select("project_id", told.alias("warnings"))


def new_findings(current: DataFrame, baseline: DataFrame, key: Column | None = None) -> DataFrame:
    """Findings whose fingerprint the baseline does not hold; repeats stay."""
    key = F.coalesce("fingerprint", finding_key(False)) if key is None else key
    base = baseline.select("project_id", key.alias("_key")).distinct()
    return current.withColumn("_key", key).join(base, ["project_id", "_key"], "left_anti").drop("_key")


def diff(current: DataFrame, baseline: DataFrame, key: Column | None = None) -> DataFrame:
    """Counts of new, fixed and existing findings by project."""
    key = F.coalesce("fingerprint", finding_key(False)) if key is None else key
    tag = lambda df, side: df.select("project_id", key.alias("key")).withColumn("side", F.lit(side))
    per = tag(current, 1).unionByName(tag(baseline, 0)).groupBy("project_id", "key").agg(F.count_if(F.col("side") == 1).alias("now"), F.count_if(F.col("side") == 0).alias("was"))
    return per.groupBy("project_id").agg(
        F.sum(F.when(F.col("was") == 0, F.col("now")).otherwise(0)).alias("n_new"), F.sum(F.when(F.col("now") == 0, F.col("was")).otherwise(0)).alias("n_fixed"), F.sum(F.when(F.col("was") > 0, F.col("now")).otherwise(0)).alias("n_existing")
    )


def penalties(findings: DataFrame) -> DataFrame:
    """Tenths lost by project and category, rules with a cap summed apart."""
    by_rule = findings.groupBy("project_id", "category", "id").agg(F.sum("penalty").alias("lost"))
    cap = F.coalesce(lookup(CAP_TENTHS, F.col("id")), F.lit(2**31 - 1))
    return by_rule.groupBy("project_id", "category").agg(F.sum(F.least("lost", cap)).alias("lost"))


def category_scores(projects: DataFrame, findings: DataFrame, bonus: DataFrame | None = None, categories: tuple[str, ...] = CATEGORIES, refund: DataFrame | None = None) -> DataFrame:
    """project_id, category, tenths: 100 less penalties plus what was earned, within 0 and 100; a fixed score replaces it.
    Every project has a row for every category."""
    spark = projects.sparkSession
    grid = projects.select("project_id").distinct().withColumn("category", F.explode(F.array(*map(F.lit, categories))))
    out = grid.join(penalties(findings), ["project_id", "category"], "left")
    bonus = spark.createDataFrame([], "project_id string, category string, tenths int, fixed int") if bonus is None else bonus
    out = out.join(bonus, ["project_id", "category"], "left")
    refund = spark.createDataFrame([], "project_id string, category string, refund long") if refund is None else refund
    out = out.join(refund, ["project_id", "category"], "left")
    plain = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - F.coalesce("lost", F.lit(0)) + F.coalesce("tenths", F.lit(0))))
    first = F.coalesce("fixed", plain)
    return out.select("project_id", "category", F.least(F.lit(100), first + F.coalesce("refund", F.lit(0))).cast("long").alias("tenths"))


def overall_score(scores: DataFrame) -> DataFrame:
    """Weighted mean of category scores, half up to one decimal; an unknown category weighs 1."""
    weight = F.coalesce(lookup(WEIGHT_TENTHS, F.col("category")), F.lit(10))
    return scores.groupBy("project_id").agg(X.round_tenth(F.sum(F.col("tenths") * weight) / F.sum(weight * 10)).alias("overall"))


def severity_counts(findings: DataFrame, keys: tuple[str, ...] = ("project_id",)) -> DataFrame:
    return findings.groupBy(*keys).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))


def quality_gate(overall: DataFrame, findings: DataFrame, min_score: float = 0.0, fail_on: str | None = None, max_critical: int | None = None, max_high: int | None = None) -> DataFrame:
    """project_id, passed, reasons. Reasons are independent of each other."""
    rows = overall.join(severity_counts(findings), "project_id", "left").fillna(0, list(SEVERITIES))
    over = sum((F.col(s) for s in SEVERITIES if fail_on and GATE_RANK[s] >= GATE_RANK[fail_on]), F.lit(0))
    reasons = [F.when(F.col("overall") < min_score, F.format_string("overall score %s is below %s", F.col("overall").cast("string"), F.lit(str(min_score))))]
    if fail_on:
        reasons.append(F.when(over > 0, F.format_string("%d findings at or above %s", over, F.lit(fail_on))))
    if max_critical is not None:
        reasons.append(F.when(F.col("critical") > max_critical, F.format_string("%d critical findings exceed %d", F.col("critical"), F.lit(max_critical))))
    if max_high is not None:
        reasons.append(F.when(F.col("high") > max_high, F.format_string("%d high findings exceed %d", F.col("high"), F.lit(max_high))))
    all_ = F.array_compact(F.array(*reasons))
    return rows.select("project_id", (F.size(all_) == 0).alias("passed"), all_.alias("reasons"))


def precision_recall(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Both: name, file, id. Distinct triples are compared."""
    both = expected.select("name", "file", "id").distinct().withColumn("e", F.lit(1)).join(actual.select("name", "file", "id").distinct().withColumn("a", F.lit(1)), ["name", "file", "id"], "full")
    tp, fp, fn = F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull()), F.count_if(F.col("e").isNull()), F.count_if(F.col("a").isNull())
    return both.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"))
