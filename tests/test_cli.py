"""Commands end to end, with their exit codes, and every rendering of a report."""

import json
import xml.dom.minidom

from auditloom.plans.cli import main
from auditloom.streaming.reports import severity_stream


def test_analyze_diff_and_stream(spark, tmp_path):
    root = tmp_path / "proj"
    root.mkdir()
    (root / "package.json").write_text('{"dependencies":{"a":"*"}}')
    (root / "index.ts").write_text("execSync(`rm ${x}`) // <&>\n")
    saved = tmp_path / "saved"
    report, sarif, junit = saved / "a.json", tmp_path / "o.sarif", tmp_path / "o.xml"
    args = ["analyze", str(root), "--format", "json", "--output", str(report), "--sarif", str(sarif), "--junit", str(junit)]
    assert main(args, spark) == 0
    assert main([*args[:3], "html", "--output", str(tmp_path / "o.html"), "--fail-on", "high"], spark) == 1
    doc = json.loads(report.read_text())
    assert doc["projectName"] == "proj" and {f["id"] for f in doc["findings"]} >= {"AGT-001", "DEP-002"}
    runs = json.loads(sarif.read_text())["runs"][0]
    assert len(runs["results"]) == len(doc["findings"]) and len(runs["tool"]["driver"]["rules"]) == len({f["id"] for f in doc["findings"]})
    suites = xml.dom.minidom.parse(str(junit)).getElementsByTagName("testsuite")
    assert len(suites) == 8
    (root / "b.ts").write_text("execSync(cmd + ' -rf')\n")
    later = saved / "b.json"
    assert main(["analyze", str(root), "--format", "json", "--output", str(later)], spark) == 0
    assert main(["diff", str(report), str(later)], spark) == 1
    assert main(["diff", str(report), str(report)], spark) == 0
    key = next(f"{f['id']}|{f['file']}|{f['line']}" for f in doc["findings"] if f["id"] == "AGT-001")
    assert main(["finding", str(report), key, "--root", str(root)], spark) == 0
    assert main(["finding", str(report), "none", "--root", str(root)], spark) == 2
    assert main(["analyze", str(tmp_path / "missing")], spark) == 2
    assert main(["init", str(root)]) == 0 and main(["init", str(root)]) == 2
    q = severity_stream(spark, str(saved)).writeStream.outputMode("complete").format("memory").queryName("sev").start()
    try:
        q.processAllAvailable()
        assert spark.table("sev").first()["high"] >= 2
    finally:
        q.stop()


def test_triage_and_baselines(spark, tmp_path):
    import subprocess

    root = tmp_path / "own"
    (root / "src").mkdir(parents=True)
    (root / "src" / "a.ts").write_text("execSync(`rm ${x}`)\n")
    report, after = tmp_path / "saved" / "r.json", tmp_path / "after" / "t.json"
    only = ["--only", "agentic,docker"]
    assert main(["analyze", str(root), *only, "--format", "json", "--output", str(report)], spark) == 0
    doc = json.loads(report.read_text())
    assert doc["projectPath"] == str(root) and {c["category"]: c["summary"] for c in doc["categories"]}["agentic"] == "1 agent-specific risk(s): 1 shell-injection"
    assert main(["triage", str(report)], spark) == 2
    assert main(["triage", str(report), "--dry-run", "--format", "json", "--output", str(after)], spark) == 0
    told = json.loads(after.read_text())
    assert len(told["verdicts"]) == len(told["remediations"]) == len(doc["findings"]) and told["overallScore"] == doc["overallScore"] and told["aiSummary"]
    page = tmp_path / "t.html"
    assert main(["triage", str(report), "--dry-run", "--format", "html", "--output", str(page)], spark) == 0 and "real; fix: canned" in page.read_text()
    assert main(["finding", str(after), "AGT-001|src/a.ts|1"], spark) == 0
    # a saved report, a commit, and neither as the baseline
    assert main(["analyze", str(root), *only, "--fail-on", "info", "--baseline", str(report)], spark) == 0
    (root / "src" / "b.ts").write_text("execSync(`mv ${y}`)\n")
    assert main(["analyze", str(root), *only, "--fail-on", "info", "--baseline", str(report)], spark) == 1
    assert main(["analyze", str(root), *only, "--baseline", str(tmp_path / "none.json")], spark) == 2
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True, text=True).stdout
    run("init", "-q"), run("add", "."), run("commit", "-qm", "one")
    (root / "src" / "c.ts").write_text("execSync(`cp ${z}`)\n")
    assert main(["analyze", str(root), *only, "--fail-on", "high", "--baseline", "HEAD"], spark) == 1
    assert run("worktree", "list").count("\n") == 1


def test_a_category_that_fails_is_a_finding(spark, monkeypatch):
    from auditloom.operators import rules_files
    from auditloom.plans.audit import run_audit

    def broken(files):
        raise RuntimeError("no")

    monkeypatch.setattr(rules_files, "agentic", broken)
    files = spark.createDataFrame([("p", "README.md", 1, "x")], "project_id string, path string, size long, content string")
    audit = run_audit(files, ("docker", "agentic"), isolate=True)
    assert {r["category"]: r["tenths"] for r in audit.scores.collect()} == {"docker": 100, "agentic": 0}
    assert [(r["id"], r["severity"], r["note"]) for r in audit.findings.collect()] == [("AGENTIC-ERROR", "high", "RuntimeError")]
