"""Workflow rules against plain Python over the same YAML, on documents of every odd shape."""

import random
import re

import yaml

from auditloom.operators import rules_project as RP
from auditloom.operators import rules_workflow as RW

GATE = re.compile("test|lint|audit|security|scan|check|verify|gate", re.I)
OUTSIDE = re.compile(r"\$\{\{\s*github\.(event\.(issue|pull_request|comment|review|discussion|commits|head_commit)|head_ref)[^}]*\}\}")
USES = re.compile(r"^\s*(?:-\s+)?uses:\s*([\w.-]+)/([\w./-]+)@([\w./-]+)", re.M | re.A)


def brute(raw, branches, has_lock):
    """(rule, severity, line), sorted."""
    line = lambda mark: raw[: raw.index(mark)].count("\n") + 1 if mark in raw else None
    try:
        doc = yaml.safe_load(raw)
    except (yaml.YAMLError, ValueError):
        return [("WFL-PARSE", "medium", 1)]
    if "&a" in raw:  # holds itself
        return [("WFL-PARSE", "medium", 1)]
    if not isinstance(doc, dict):
        return []
    on = doc.get("on", doc.get(True))
    events = {on} if isinstance(on, str) else {str(x) for x in on} if isinstance(on, (list, dict)) else set()
    jobs = {str(k): v if isinstance(v, dict) else {} for k, v in doc["jobs"].items()} if isinstance(doc.get("jobs"), dict) else {}
    steps = [s for job in jobs.values() if isinstance(job.get("steps"), list) for s in job["steps"] if isinstance(s, dict)]
    uses = lambda s: s["uses"] if isinstance(s.get("uses"), str) else ""
    given = lambda s: s["with"] if isinstance(s.get("with"), dict) else {}
    out = []
    if "pull_request_target" in events:
        out += [("WFL-001", "critical", line("pull_request_target")) for s in steps if uses(s).startswith("actions/checkout") and isinstance(given(s).get("ref"), str) and "github.event.pull_request.head" in given(s)["ref"]]
    out += [("WFL-002", "high", n) for n, t in enumerate(raw.split("\n"), 1) if OUTSIDE.search(t) and re.search(r"run:|`|\$\(", t)]
    out += [("WFL-003", "high" if m[3] in ("master", "main", "latest") else "medium", line(m[0].strip())) for m in USES.finditer(raw) if m[1] not in ("actions", "github") and not re.fullmatch("[0-9a-f]{40}", m[3])]
    out += [("WFL-004", "medium", 1)] * ("permissions" not in doc and not any("permissions" in j for j in jobs.values()))
    out += [("WFL-005", "high", line("write-all"))] * bool(re.search(r"permissions:\s*write-all", raw))
    for event in ("push", "pull_request"):
        listed = on[event].get("branches") if branches and isinstance(on, dict) and isinstance(on.get(event), dict) else None
        names = [str(b) for b in listed] if isinstance(listed, list) else []
        out += [("WFL-006", "high", line(f"{event}:"))] * bool(names and not any(re.search(r"[*?\[]", b) for b in names) and not set(names) & set(branches))
    out += [("WFL-007", "low", line("jobs:"))] * bool(jobs and not any("timeout-minutes" in j for j in jobs.values()))
    out += [("WFL-008", "low", 1)] * bool(events & {"push", "pull_request"} and "concurrency" not in doc)
    out += [("WFL-009", "high", line("continue-on-error")) for k, j in jobs.items() if j.get("continue-on-error") is True and (GATE.search(k) or GATE.search(str(j.get("name") or "")))]
    out += [("WFL-009", "high", line("continue-on-error")) for s in steps if s.get("continue-on-error") is True and (GATE.search(str(s.get("name") or "")) or GATE.search(str(s.get("run") or "")[:60]))]
    out += [("WFL-010", "low", line("setup-node")) for s in steps if has_lock and uses(s).startswith("actions/setup-node") and "cache" not in given(s)]
    out += [("WFL-011", "medium", line("self-hosted"))] * bool(events & {"pull_request", "pull_request_target"} and re.search(r"runs-on:.*self-hosted", raw))
    return out


ON = ["push", "on: push", "on: [push, 5]", "on: {push: {branches: [main, 7]}, pull_request: {branches: [dev]}}", "on:\n  push:\n    branches: ['rel/*']\n  pull_request:", "on: pull_request_target", "on: [pull_request_target, pull_request]", "on: 5", "on:", "'on': push", "on: {push: {branches: [trunk, x]}}", "on: {push: [main]}"]
TOP = ["", "permissions: write-all", "permissions:\n  contents: read", "concurrency: one", "name: [a", "? {a: b}\n: c", "date: 2024-01-01\nnan: .nan\nbig: 123456789012345678901234567890", "note: \"permissions:   write-all\""]
JOB = ["timeout-minutes: 5", "permissions: {}", "continue-on-error: true", "continue-on-error: 'true'", "name: Security", "name: 5", "runs-on: [self-hosted, x]", "runs-on: here", "steps: nothing", "steps: [text, 5, null, {}]"]
STEP = [
    "uses: actions/checkout@v4\n        with:\n          ref: ${{ github.event.pull_request.head.sha }}", "uses: actions/checkout@v4\n        with: []", "uses: 5", "uses: acme/ship/sub@main", "uses: acme/ship@v1", "uses: acme/ship@" + "0a" * 20, "run: echo ${{ github.head_ref }}",
    "run: |\n          echo `x` ${{ github.event.issue.title }}", "name: Lint it\n        continue-on-error: true", "run: go test\n        continue-on-error: true", "name: no\n        run: " + "x" * 60 + " test\n        continue-on-error: yes", "uses: actions/setup-node@v4", "uses: actions/setup-node@v4\n        with:\n          cache: npm", "uses: actions/setup-node@v4\n        with: {node: 5}", "run: ${{ env.X }}",
]
WHOLE = ["", "- a\n- b", "just text", "{", "a: &a [*a]", "jobs: []\non: push", "jobs: {a: 5, b: null}\non: push", "jobs: {5: {steps: []}}", "on: push\non: pull_request\njobs: {}", "\ttabs: no", "true: push\njobs: {lint: {continue-on-error: true}}"]


def made(r):
    out = [r.choice(ON), r.choice(TOP), "jobs:"]
    for k in range(r.randint(0, 3)):
        out.append(f"  {r.choice(['build', 'lint', '7', 'x.y'])}{k}:")
        own = r.sample(JOB, r.randint(0, 3))
        out += [f"    {x}" for x in own]
        if not any(x.startswith("steps") for x in own) and r.random() < 0.8:
            out += ["    steps:"] + [f"      - {s}" for s in r.sample(STEP, r.randint(1, 4))]
    return "\n".join(x for x in out if x) + r.choice(["", "\n"])


def test_workflow_rules_match_brute_force(spark):
    r = random.Random(12)
    texts = WHOLE + [made(r) for _ in range(200)]
    rows, branches, want = [], [], set()
    for k, text in enumerate(texts):
        known, lock = (["main", "dev"], ["trunk"], [])[k % 3], k % 2 == 0
        rows.append((f"p{k}", ".github/workflows/w.yml", len(text), text))
        rows += [(f"p{k}", "yarn.lock", 0, "")] * lock
        branches += [(f"p{k}", b) for b in known]
        got = brute(text, known, lock)
        want |= {(f"p{k}", *f, got.count(f)) for f in got}
    rows += [("other", ".github/workflows/sub/w.yml", 1, "{"), ("other", "w.yml", 1, "{"), ("null", ".github/workflows/w.yaml", 1, None)]
    files = spark.createDataFrame(rows, "project_id string, path string, size long, content string")
    found = RW.workflow(files, RP.project_meta(files), spark.createDataFrame(branches, "project_id string, branch string"))
    seen = [(x["project_id"], x["id"], x["severity"], x["line"]) for x in found.collect()]
    assert {(*f, seen.count(f)) for f in set(seen)} == want
    assert {f[1] for f in want} == {f"WFL-{k:03}" for k in range(1, 12)} | {"WFL-PARSE"}
