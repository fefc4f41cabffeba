"""Commands: analyze, scan, diff, finding, triage, dashboard, agent, doctor, init. Exit codes: 0 passed, 1 gate failed or findings added, 2 bad input."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..operators import findings as A
from ..operators import triage as T
from ..operators.rules_project import project_meta
from ..schema import CATEGORIES
from ..sinks import agents, render
from ..sinks import dashboard as D
from ..sources import projects, reports
from .audit import run_audit

RENDER = {"json": render.to_json, "sarif": render.to_sarif, "junit": render.to_junit, "html": render.to_html, "text": render.to_text}


def _save(text: str, path: str | None) -> None:
    if not path:
        print(text)
        return
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def analyze(spark: SparkSession, args) -> int:
    root = projects.resolve_target(args.target)
    config = reports.load_config(root, args.config)
    only = tuple(args.only.split(",")) if args.only else None
    opts = reports.effective({"min_score": args.min_score, "fail_on": args.fail_on, "max_critical": args.max_critical, "max_high": args.max_high, "categories": only, "baseline": args.baseline}, config)
    files = projects.scan_project(spark, root).persist()
    names = projects.local_branches(root)
    project = os.path.basename(os.path.abspath(root))
    branches = spark.createDataFrame([(project, b) for b in names], "project_id string, branch string") if names else None
    audit = run_audit(files, tuple(opts["categories"]), list(opts["suppressions"]), projects.scan_folders(root, spark), branches=branches, isolate=True)
    audit.paths = {project: os.path.abspath(root)}
    table = audit.reports().persist()
    for kind, path in ((args.format, args.output), ("sarif", args.sarif), ("junit", args.junit)):
        if kind and (path or kind == args.format):
            _save(RENDER[kind](table).first()[1], path)
    judged = audit.findings
    if opts["baseline"]:
        judged = A.new_findings(judged, _baseline(spark, root, opts["baseline"], tuple(opts["categories"])))
    gate = A.quality_gate(audit.overall, judged, opts["min_score"], opts["fail_on"], opts["max_critical"], opts["max_high"]).first()
    audit.release()
    table.unpersist()
    files.unpersist()
    for reason in gate["reasons"]:
        print(reason, file=sys.stderr)
    return 0 if gate["passed"] else 1


def _baseline(spark: SparkSession, root: str, ref: str, categories: tuple[str, ...]):
    """Findings of a saved report, or of the tree at a commit."""
    if ref.endswith(".json") and os.path.isfile(ref):
        if not _report(spark, ref).take(1):
            raise ValueError(f"{ref} is no saved report")
        return reports.report_findings(_report(spark, ref)).withColumn("project_id", F.lit(os.path.basename(os.path.abspath(root))))
    return run_audit(projects.baseline_files(spark, root, ref), categories).findings


def scan(spark: SparkSession, args) -> int:
    _save(project_meta(projects.scan_project(spark, projects.resolve_target(args.target))).toJSON().first(), None)
    return 0


def _report(spark: SparkSession, path: str):
    folder, name = os.path.split(os.path.abspath(path))
    return reports.load_reports(spark, folder).where(F.col("file_name") == name)


def diff(spark: SparkSession, args) -> int:
    was, now = (reports.report_findings(_report(spark, p)) for p in (args.before, args.after))
    row = A.diff(now, was, A.finding_key()).agg(F.sum("n_new"), F.sum("n_fixed"), F.sum("n_existing")).first()
    added, fixed, same = (int(x or 0) for x in row)
    print(f"{added} added, {fixed} removed, {same} unchanged")
    return int(added > 0)


def finding(spark: SparkSession, args) -> int:
    rows = reports.report_findings(_report(spark, args.report)).withColumn("key", A.finding_key())
    row = rows.where(A.bare_key(F.col("key")) == A.bare_key(F.lit(args.key))).limit(1)
    if args.root and row.count():
        text = projects.scan_project(spark, args.root).select(F.col("path").alias("file"), "content")
        row = row.join(text, "file", "left").withColumn("snippet", F.when(F.col("content").isNotNull() & F.col("line").isNotNull(), snippet(F.col("content"), F.col("line")))).drop("content")
    report = _report(spark, args.report)
    for name, column in (("verdict", "verdicts"), ("remediation", "remediations")):
        given = report.select(F.explode(column).alias("v")).select(A.bare_key(F.col("v.findingKey")).alias("_key"), F.col("v").alias(name)).dropDuplicates(["_key"])
        row = row.join(given, A.bare_key(F.col("key")) == F.col("_key"), "left").drop("_key")
    found = row.toJSON().first()
    print(found or "no such finding")
    return 0 if found else 2


def triage(spark: SparkSession, args) -> int:
    """A saved report with verdicts, fixes and a summary; nothing is scanned or scored anew."""
    if not args.dry_run:
        raise ValueError("no provider client is installed; use --dry-run, or call run_triage with a client")
    report = _report(spark, args.report).persist()
    row = report.first()
    if row is None or not row["projectPath"]:
        raise ValueError(f"{args.report} is no saved report of a project")
    client = T.CannedClient()
    found = reports.report_findings(report)
    files = projects.scan_project(spark, row["projectPath"], row["projectName"])
    verdicts = T.run_triage(found, files, client, verify=not args.no_verify, concurrency=args.concurrency, context=T.project_context(report)).persist()
    fixes = T.remediations(found, files, verdicts, client, args.concurrency)
    dismissed = {r["finding_key"] for r in verdicts.where("classification = 'false-positive'").collect()}  # one report's findings
    told = [(f["severity"], f["id"], f["title"]) for f in found.withColumn("key", A.finding_key()).orderBy("ord").collect() if f["key"] not in dismissed]
    summary = client.summarize(T.digest(row["overallScore"], [(c["category"], c["score"]) for c in row["categories"]], told))
    listed = lambda df, *columns: df.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct(F.col("finding_key").alias("findingKey"), *columns))).alias("all"))
    table = report.drop("file_name", "verdicts", "remediations", "aiSummary")
    for name, df in (("verdicts", listed(verdicts, "classification", "confidence", "reasoning")), ("remediations", listed(fixes, "fix", "effort"))):
        table = table.join(df.select(F.col("project_id").alias("projectName"), F.col("all").alias(name)), "projectName", "left")
    table = table.withColumn("aiSummary", F.lit(summary))
    _save(RENDER[args.format](table).first()[1], args.output)
    verdicts.unpersist()
    report.unpersist()
    return 0


def dashboard(spark: SparkSession, args) -> int:
    """Serves until it is interrupted."""
    with D.server(spark, args.folder, args.port) as served:
        print(f"http://127.0.0.1:{served.server_address[1]}/", flush=True)
        try:
            served.serve_forever()
        except KeyboardInterrupt:
            pass
    return 0


def agent(spark: SparkSession | None, args) -> int:
    path, new = agents.install(args.target, args.folder, args.min_score)
    print(f"{'created' if new else 'updated'} {path}")
    return 0


def doctor(spark: SparkSession | None, args) -> int:
    checks = {"java": bool(shutil.which("java")), "git": bool(shutil.which("git")), "writable": os.access(os.getcwd(), os.W_OK), "python": sys.version_info >= (3, 10)}
    print(json.dumps(checks, indent=2))
    return int(not all(checks.values()))


def init(spark: SparkSession | None, args) -> int:
    path = os.path.join(args.target, reports.CONFIG_NAMES[0])
    if os.path.exists(path):
        print(f"{path} exists", file=sys.stderr)
        return 2
    _save(json.dumps({"minScore": 6, "categories": list(CATEGORIES), "failOn": "critical"}, indent=2) + "\n", path)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="auditloom")
    sub = top.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("target")
    for name in ("config", "only", "output", "sarif", "junit", "baseline"):
        a.add_argument(f"--{name}")
    a.add_argument("--format", choices=[*RENDER], default="text")
    a.add_argument("--min-score", type=float)
    a.add_argument("--fail-on", choices=["critical", "high", "medium", "low", "info"])
    a.add_argument("--max-critical", type=int)
    a.add_argument("--max-high", type=int)
    sub.add_parser("scan").add_argument("target")
    d = sub.add_parser("diff")
    d.add_argument("before")
    d.add_argument("after")
    f = sub.add_parser("finding")
    f.add_argument("report")
    f.add_argument("key")
    f.add_argument("--root")
    t = sub.add_parser("triage")
    t.add_argument("report")
    t.add_argument("--format", choices=["text", "json", "html"], default="text")
    t.add_argument("--output")
    t.add_argument("--no-verify", action="store_true")
    t.add_argument("--concurrency", type=int, default=5)
    t.add_argument("--dry-run", action="store_true")
    b = sub.add_parser("dashboard")
    b.add_argument("folder", nargs="?", default=".")
    b.add_argument("--port", type=int, default=8642)
    g = sub.add_parser("agent")
    g.add_argument("action", choices=["install"])
    g.add_argument("target")
    g.add_argument("folder", nargs="?", default=".")
    g.add_argument("--min-score", type=float, default=6.0)
    sub.add_parser("doctor")
    sub.add_parser("init").add_argument("target", nargs="?", default=".")
    args = top.parse_args(argv)
    command = {"analyze": analyze, "scan": scan, "diff": diff, "finding": finding, "triage": triage, "dashboard": dashboard, "agent": agent, "doctor": doctor, "init": init}[args.command]
    needs = args.command not in ("agent", "doctor", "init")
    try:
        return command(spark or (SparkSession.builder.appName("auditloom").getOrCreate() if needs else None), args)
    except (ValueError, FileNotFoundError) as why:
        print(why, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
