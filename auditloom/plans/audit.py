"""The audit of a corpus of projects: files in, findings, scores and reports out."""

from __future__ import annotations

import contextlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..operators import findings as A
from ..operators import rules_files as RF
from ..operators import rules_project as RP
from ..operators import rules_workflow as RW
from ..schema import CATEGORIES, FINDINGS, lookup
from ..sinks import render


@dataclass
class Audit:
    """Tables of an audit. findings carry ord, instance and fingerprint; suppressed ones lie apart. overflow has how many
    findings of capped rules were left out, by project and rule, where structure was audited."""

    meta: DataFrame
    findings: DataFrame
    suppressed: DataFrame
    stale: DataFrame | None
    scores: DataFrame
    overall: DataFrame
    overflow: DataFrame | None = None
    paths: dict[str, str] | None = None
    warnings: DataFrame | None = None
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Let go of what is kept in memory, when nothing of the audit is read any more."""
        for df in self.held:
            df.unpersist()

    def reports(self) -> DataFrame:
        """Beside findings and scores: what is suppressed and why, warnings, and what caps left out. The last is asked for only
        where a rule has reached its cap, as only then can there be any."""
        where = F.struct("ord", "id", "file", "line", "reason")
        told = F.transform(F.array_sort(F.collect_list(where)), lambda x: F.struct(x["id"].alias("id"), x["file"].alias("file"), x["line"].alias("line"), x["reason"].alias("reason")))  # a project's findings
        hidden = self.suppressed.groupBy("project_id").agg(told.alias("suppressed")) if "reason" in self.suppressed.columns else None
        return render.reports(self.scores, self.overall, self.findings, __version__, self.paths, {"suppressed": hidden, "warnings": self.warnings, "omitted": self.omitted()})

    def omitted(self) -> DataFrame | None:
        """project_id and, by rule, the number of findings beyond its cap; None where no rule has reached one."""
        if self.overflow is None:
            return None
        cap = lookup(RP.MAX_FINDINGS, F.col("id"))
        found = self.findings.select("project_id", "id").unionByName(self.suppressed.select("project_id", "id"))
        if not found.groupBy("project_id", "id").count().where(F.col("count") >= cap).take(1):
            return None
        return self.overflow.where("n_cut > 0").groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("id", F.col("n_cut").alias("n")))).alias("omitted"))


def all_findings(files: DataFrame, meta: DataFrame, categories=CATEGORIES, dirs=None, advisories=None, branches=None, rings=None) -> tuple[DataFrame, DataFrame]:
    """Findings of the chosen categories, and what projects earn: project_id, category, tenths, fixed. Categories that are
    not chosen are not planned at all."""
    spark = files.sparkSession
    found, earned = spark.createDataFrame([], FINDINGS), spark.createDataFrame([], "project_id string, category string, tenths int, fixed int")

    def earn(df: DataFrame, category: str) -> None:
        nonlocal earned
        fixed = F.col("fixed") if "fixed" in df.columns else F.lit(None).cast("int")
        earned = earned.unionByName(df.select("project_id", F.lit(category).alias("category"), F.col("tenths").cast("int").alias("tenths"), fixed.cast("int").alias("fixed")))

    for category in categories:
        if category == "structure":
            found = found.unionByName(RP.structure(files, meta, dirs, rings))
            earn(meta.select("project_id", (5 * F.col("has_ci").cast("int") + 3 * F.col("has_docker").cast("int") + 2 * F.col("has_linter").cast("int")).alias("tenths")), category)
        elif category == "security":
            found = found.unionByName(RF.security(files))
        elif category == "dependencies":
            found = found.unionByName(RP.dependencies(files, meta, advisories))
        elif category == "docker":
            rows, extra = RF.docker(files)
            found = found.unionByName(rows)
            earn(extra, category)
        elif category == "tests":
            rows, extra = RF.tests(files)
            found = found.unionByName(rows)
            earn(extra, category)
        elif category == "consistency":
            rows, extra = RF.consistency(files)
            found = found.unionByName(rows)
            earn(extra, category)
        elif category == "agentic":
            found = found.unionByName(RF.agentic(files))
        elif category == "workflow":
            found = found.unionByName(RW.workflow(files, meta, branches))
        else:
            raise ValueError(f"unknown category {category}")
    return found, earned


def run_audit(files: DataFrame, categories=CATEGORIES, suppressions: list[dict] | None = None, dirs=None, advisories=None, branches=None, isolate: bool = False) -> Audit:
    """files: project_id, path, size, content. Everything stays lazy but the table of findings, which is kept once. With `isolate`
    each category is an action of its own; one that fails scores 0 and leaves a finding that says so, in every project."""
    spark = files.sparkSession
    meta = RP.project_meta(files)
    held: list[DataFrame] = []
    rings = None
    if "structure" in categories:
        with contextlib.suppress(Exception) if isolate else contextlib.nullcontext():  # isolated, it fails again inside its category
            rings = RP.import_cycles(files)
    if isolate:
        found, earned = run_isolated(files, meta, held, categories, dirs, advisories, branches, rings)
    else:
        found, earned = all_findings(files, meta, categories, dirs, advisories, branches, rings)
    found = A.with_ordinal(found).persist()
    hidden, stale, refund, warnings = found.limit(0), None, None, None
    if suppressions:
        given = A.suppression_table(spark, suppressions)
        rules = A.active(given)
        matched = A.match_suppressions(found, rules)
        hidden, refund, stale = matched.where("seq_hit is not null"), A.refunds(matched), A.stale(matched, rules)
        warnings = A.suppression_warnings(files.select("project_id").distinct(), matched, given, rules)
        found_kept = matched.where("seq_hit is null").drop("seq_hit", "reason")
    else:
        found_kept = found
    scores = A.category_scores(files.select("project_id"), found, earned, categories, refund)
    kept = A.with_fingerprints(A.with_instances(found_kept), files)
    overflow = RP.structure_overflow(files, rings) if rings is not None else None
    return Audit(meta, kept, hidden, stale, scores, A.overall_score(scores), overflow, warnings=warnings, held=(*held, found))


def run_isolated(files: DataFrame, meta: DataFrame, held: list[DataFrame], categories=CATEGORIES, dirs=None, advisories=None, branches=None, rings=None) -> tuple[DataFrame, DataFrame]:
    """What `all_findings` gives, by one action a category. The rows of a category that fails are one finding a project. held
    gets what is kept in memory."""
    spark, meta = files.sparkSession, meta.persist()
    held.append(meta)
    found, earned = all_findings(files, meta, ())
    for category in categories:
        try:
            rows, more = (x.persist() for x in all_findings(files, meta, (category,), dirs, advisories, branches, rings))
            held += [rows, more]
            rows.count(), more.count()
        except Exception as why:
            note, name = type(why).__name__, f"{category.upper()}-ERROR"
            row = {"category": category, "analyzer": CATEGORIES.index(category), "phase": 0, "file_ord": None, "seq": 0, "id": name, "severity": "high", "title": f"The {category} rules failed", "file": None, "line": None, "penalty": 0, "note": note}
            schema = spark.createDataFrame([], FINDINGS).schema
            ids = files.select("project_id").distinct()
            rows = ids.select("project_id", *(F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in schema.fields if f.name != "project_id"))
            more = ids.select("project_id", F.lit(category).alias("category"), F.lit(0).alias("tenths"), F.lit(0).alias("fixed"))
        found, earned = found.unionByName(rows), earned.unionByName(more)
    return found, earned
