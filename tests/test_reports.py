"""Saved reports: the local page, text with its tails, the order of trees, warnings, and the rule-file block."""

import datetime
import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from auditloom.functions.text import wrap_text
from auditloom.operators import findings as A
from auditloom.sinks import agents, dashboard, render
from auditloom.sources import projects, reports


def saved(folder, file, name, **more):
    finding = {"id": "AGT-001", "category": "agentic", "severity": "high", "title": "A <b> title", "file": "a.ts", "line": 3, "instance": None, "note": None, "suggestion": "s", "fingerprint": "f"}
    doc = {"projectName": name, "completedAt": "2024-05-01T00:00:00Z", "version": "1", "overallScore": 7.5, "categories": [{"category": "agentic", "score": 7.5, "summary": "s"}], "findings": [finding, finding | {"severity": "low", "id": "X-1"}]} | more
    (folder / file).write_text(json.dumps(doc))


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "reports"
    at.mkdir()
    saved(at, "one.json", "alpha")
    saved(at, "two+& 2%41.json", "alpha", completedAt="2024-06-01T00:00:00Z", verdicts=[{"findingKey": "AGT-001|a.ts|3", "classification": "real", "confidence": 1, "reasoning": ""}])
    saved(at, "z.json", "<script>")
    (at / "other.json").write_text('{"x": 1}')
    (at / "broken.json").write_text("{")
    saved(tmp_path, "outside.json", "secret")
    return at


def test_dashboard(spark, folder):
    served = dashboard.server(spark, str(folder))
    host, port = served.server_address[:2]
    assert host == "127.0.0.1"
    threading.Thread(target=served.serve_forever, daemon=True).start()

    def get(path, **headers):
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{port}{path}", headers=headers)) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    try:
        status, page = get("/")
        assert status == 200 and "3 reports" in page and "&lt;script&gt;" in page and "<script>" not in page
        assert page.index("two+&amp; 2%41.json") < page.index("one.json") and "1 real, 0 false, 0 open" in page and "other.json" not in page
        assert get("/report?f=two%2B%26%202%2541.json")[0] == 200 and "A &lt;b&gt; title" in get("/report?f=one.json")[1]
        for path in ("/report?f=../outside.json", "/report?f=%2e%2e%2foutside.json", "/report?f=other.json", "/report?f=", "/report", "/x"):
            assert get(path)[0] == 404, path
        assert get("/", Host="evil.example")[0] == 403 and get("/", Host=f"localhost:{port}")[0] == 200
        saved(folder, "new.json", "beta")  # read anew for each request
        assert "4 reports" in get("/")[1]
    finally:
        served.shutdown()
        served.server_close()
    assert dashboard.respond(spark, str(folder / "none"), "/", "localhost")[2].count("No reports") == 1


def test_local_hosts():
    assert all(map(dashboard.is_local_host, ("localhost", "localhost:80", "127.0.0.1:1", "[::1]", "[::1]:80")))
    assert not any(map(dashboard.is_local_host, (None, "", "example.org", "localhost.example.org", "127.0.0.1.example.org", "[::2]:80")))


def test_text_tails(spark, tmp_path):
    saved(tmp_path, "r.json", "alpha", aiSummary="one two three\nfour", warnings=["w"], omitted=[{"id": "STR-013", "n": 5}], suppressed=[{"id": "SEC-X", "file": "f", "line": 2, "reason": "known"}])
    df = reports.load_reports(spark, str(tmp_path))
    text = render.to_text(df, columns=8).first()["text"]
    assert text.index("high (1)") < text.index("AGT-001") < text.index("low (1)") < text.index("X-1")
    assert text.endswith("one two\nthree\nfour\nwarning: w\nsuppressed: SEC-X f:2 - known\nleft out: 5 more of STR-013")
    saved(tmp_path, "r.json", "alpha")
    assert render.to_text(reports.load_reports(spark, str(tmp_path))).first()["text"].endswith("X-1 A <b> title a.ts:3")


@pytest.mark.parametrize("text,want", [("a b c", ["a b", "c"]), ("abcdef g", ["abcdef", "g"]), ("a\n\nb", ["a", "", "b"]), ("", [""]), (" a", ["a"]), ("abc", ["abc"])])
def test_wrap(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(wrap_text(F.col("t"), 3)).first()[0] == want


def test_wrap_null(spark):
    assert spark.createDataFrame([(None,)], "t string").select(wrap_text(F.col("t"), 3)).first()[0] is None


def test_tree_order(spark, tmp_path):
    for name in ("b/x", "A/x", "é", "z", "f", "E"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("")
    rows = projects.tree(projects.scan_folders(str(tmp_path), spark, "p")).where("parent = ''").orderBy("place").collect()
    assert [r["path"] for r in rows] == ["A", "b", "E", "é", "f", "z"]


def test_warnings_of_suppressions(spark):
    given = A.suppression_table(spark, [{"rule": "r-1", "reason": "a"}, {"rule": "r-2", "file": "x/", "reason": "b"}, {"rule": "r-3", "reason": "c", "expires": "2020-01-02"}])
    rules = A.active(given, F.lit(datetime.date(2024, 1, 1)))
    matched = spark.createDataFrame([("p", 0), ("p", None), ("q", 1)], "project_id string, seq_hit int")
    ids = spark.createDataFrame([("p",), ("q",), ("r",)], "project_id string")
    got = {r["project_id"]: r["warnings"] for r in A.suppression_warnings(ids, matched, given, rules).collect()}
    old, one, two = "suppression of r-3 expired on 2020-01-02", "suppression of r-1 fits no finding", "suppression of r-2 in x/ fits no finding"
    assert got == {"p": [two, old], "q": [one, old], "r": [one, two, old]}


def test_rule_file_block(tmp_path):
    path, new = agents.install("codex", str(tmp_path), 7)
    first = open(path).read()
    assert new and path.endswith("AGENTS.md") and "--min-score 7" in first
    open(path, "w").write("\n# Mine\n\n" + first + "after\n")
    path, new = agents.install("agents", str(tmp_path), 8.5)
    text = open(path).read()
    assert not new and text.startswith("\n# Mine\n\n") and text.endswith("after\n") and "--min-score 8.5" in text and text.count(agents.BEGIN) == 1
    assert agents.upsert_block("x\n\n", "B") == "x\n\nB\n" and agents.upsert_block(agents.END + agents.BEGIN, "B").endswith("\n\nB\n")
    with pytest.raises(ValueError):
        agents.install("none", str(tmp_path))
