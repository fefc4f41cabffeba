"""Every registered query against its SQL, and small tests of the pieces that have none."""

import glob
import math
import os

import pytest
from pyspark.sql import functions as F

from auditloom.functions import paths as P
from auditloom.functions import text as X
from auditloom.operators import findings as A
from auditloom.operators import rules_files as RF
from auditloom.operators import triage as TR
from auditloom.plans.queries import ORACLE_SQL, QUERIES
from auditloom.sources import projects, reports

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", [*ORACLE_SQL])
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda all_: sorted((tuple(plain(v) for v in r) for r in all_), key=repr)
    assert rows(tuple(r[c] for c in cols) for r in got.collect()) == rows(want.select(", ".join(cols)).fetchall())


def test_docker_projects_of_suffixed_build_files_alone(spark, tmp_path):
    """Numbers with gaps, so that half of the projects hold no compose file, and without a number."""
    duckdb = pytest.importorskip("duckdb")
    gaps = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 0 or floor(doc_id / 9) % 2 = 1")
    gaps.withColumn("doc_id", F.when(F.col("doc_id") % 50 != 0, F.col("doc_id"))).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    cols = ["project_id", "file", "id", "line", "severity"]
    got = sorted((tuple(r[c] for c in cols) for r in QUERIES["rules_docker"](spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(con.sql(ORACLE_SQL["rules_docker"]).select(", ".join(cols)).fetchall(), key=repr)
    assert {("p2", "svc/Dockerfile.d22", "DOC-013", None, "low"), ("p", "c/docker-compose.dev.yaml", "DOC-022", None, "low")} <= set(got)


def test_docker_suffixed_build_file_counts_where_asked(spark):
    files = spark.createDataFrame([("p", "svc/Dockerfile.dev", "FROM a:1\n"), ("q", "svc/Dockerfiles", "FROM a:1\n"), ("r", "Dockerfile", "FROM a:1\n")], "project_id string, path string, content string")
    found = lambda **kw: {r["project_id"] for r in RF.docker(files, **kw)[0].collect()}
    assert (found(), found(suffixed=True)) == ({"r"}, {"p", "r"})


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("path,ext,stem,norm", [("a/b.test.ts", ".ts", "b.test", "a/b.test.ts"), (".gitignore", "", ".gitignore", ".gitignore"), ("a/../b/./c.js", ".js", "c", "b/c.js"), ("../x", "", "x", "../x"), ("a.b/c", "", "c", "a.b/c")])
def test_paths(spark, path, ext, stem, norm):
    assert one(spark, P.extname(F.lit(path))) == ext
    assert one(spark, P.stem(F.lit(path))) == stem
    assert one(spark, P.normal(F.lit(path))) == norm


@pytest.mark.parametrize(
    "path,role",
    [("src/a.ts", "source"), (".env.example", "config-template"), ("docs/x.ts", "documentation"), ("src/docs/x.ts", "source"), ("dist/a.js", "generated"), ("vendor/a.js", "vendor"), ("tests/fixtures/a.ts", "fixture"), ("src/a.test.ts", "test"), ("src/a.Test.ts", "source"), ("examples/a.ts", "template"), ("src/my-sample.ts", "template"), ("README.md", "documentation")],
)
def test_roles(spark, path, role):
    assert one(spark, P.context(F.lit(path))) == role


@pytest.mark.parametrize("pattern,hits,misses", [("*.log", ["a.log", "x/y.log"], ["a.logs"]), ("/top", ["top", "top/x"], ["x/top"]), ("dir/", ["dir/x", "a/dir/y"], ["dir"]), ("a/**/z", ["a/z", "a/b/c/z"], ["b/a/z"]), ("[ab].c", ["a.c"], ["c.c"]), ("x?", ["xy"], ["x", "x/"])])
def test_globs(pattern, hits, misses):
    import re

    for h in hits:
        assert re.match(P.glob_regex(pattern), h), h
    for m in misses:
        assert not re.match(P.glob_regex(pattern), m), m


def test_ignored_last_pattern_decides(spark):
    assert one(spark, P.ignored(F.lit("a/b.log"), ["*.log", "!b.log"])) is False
    assert one(spark, P.ignored(F.lit("a/c.log"), ["*.log", "!b.log"])) is True


def test_comments_leave_strings(spark):
    code = "a = 'x // y'; // gone\n/* gone\n*/ b = `t /* stays */`; c = \"q\\\" // in\""
    assert one(spark, X.without_comments(F.lit(code))) == "a = 'x // y'; \n b = `t /* stays */`; c = \"q\\\" // in\""


def test_entropy_and_versions(spark):
    assert one(spark, X.entropy(F.lit("abcd"))) == 2.0
    assert one(spark, X.entropy(F.lit(""))) == 0.0
    assert one(spark, X.is_newer(F.lit("v1.9.0"), F.lit("1.10.0-rc1"))) is True
    assert one(spark, X.is_newer(F.lit("2.0.0"), F.lit("1.99"))) is False


VOTES = [
    (["false-positive"] * 3, "false-positive", 0.5),
    (["real", "real", "uncertain"], "real", 0.5),
    (["false-positive", "false-positive", "real"], "uncertain", 0.0),
    (["real", "false-positive", "uncertain"], "uncertain", 0.5),
    (["real", "real", "uncertain", "uncertain"], "uncertain", 0.5),
    (["false-positive"], "false-positive", 0.5),
]


def test_votes(spark):
    rows = [("p", i, str(k), c, 0.5, f"v{i}") for k, (votes, *_) in enumerate(VOTES) for i, c in enumerate(votes)]
    got = {r["finding_key"]: r for r in TR.panel_vote(spark.createDataFrame(rows, "project_id string, voter int, finding_key string, classification string, confidence double, reasoning string")).collect()}
    for k, (_, want, confidence) in enumerate(VOTES):
        assert (got[str(k)]["classification"], got[str(k)]["confidence"]) == (want, confidence)


class Doubting(TR.CannedClient):
    def triage(self, unit):
        return [{"finding_key": f["key"].rstrip("|"), "classification": "false-positive" if f["id"] == "A" else "real", "confidence": 0.9, "reasoning": "r"} for f in unit["findings"]]

    def verify(self, unit):
        return [{"finding_key": f["key"], "classification": "real", "confidence": 0.7, "reasoning": "second look"} for f in unit["findings"]]


class Failing(TR.CannedClient):
    def triage(self, unit):
        raise RuntimeError("down")


def _found(spark):
    rows = [("p", "A", "high", "t", "f.ts", 1, 1), ("p", "A", "high", "t", "f.ts", 1, 2), ("p", "B", "low", "t", None, None, 3)]
    return spark.createDataFrame(rows, "project_id string, id string, severity string, title string, file string, line int, ord int"), spark.createDataFrame([("p", "f.ts", "x\ny")], "project_id string, path string, content string")


def test_triage(spark):
    found, files = _found(spark)
    got = {r["finding_key"]: r["classification"] for r in TR.run_triage(found, files, Doubting(), verify=False).collect()}
    assert got == {"A|f.ts|1": "false-positive", "A|f.ts|1#1": "false-positive", "B||": "real"}
    got = {r["finding_key"]: r["classification"] for r in TR.run_triage(found, files, Doubting()).collect()}
    assert set(got.values()) == {"real"} and len(got) == 3
    with pytest.raises(RuntimeError):
        TR.run_triage(found, files, Failing())
    verdicts = TR.run_triage(found, files, TR.CannedClient())
    assert TR.remediations(found, files, verdicts, TR.CannedClient()).count() == 3


def test_salvage():
    assert TR.salvage_items('```json\n{"verdicts":[{"a":1},2]}\n```', "verdicts") == [{"a": 1}]
    assert TR.salvage_items("no", "verdicts") == []


def test_gate_reasons(spark):
    overall = spark.createDataFrame([("p", 5.0), ("q", 9.0)], "project_id string, overall double")
    found = spark.createDataFrame([("p", "critical"), ("p", "low")], "project_id string, severity string")
    got = {r["project_id"]: r for r in A.quality_gate(overall, found, 6.0, "high", 0, 0).collect()}
    assert len(got["p"]["reasons"]) == 3 and got["q"]["passed"]


def test_project_scan_and_archive(spark, tmp_path):
    import zipfile

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a b+c.ts").write_text("héllo")
    (tmp_path / "x.log").write_text("no")
    (tmp_path / ".gitignore").write_text("*.log\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "m.js").write_text("no")
    got = {r["path"]: r["content"] for r in projects.scan_project(spark, str(tmp_path), "p").collect()}
    assert got == {"src/a b+c.ts": "héllo", ".gitignore": "*.log\n"}
    bad = tmp_path / "bad.zip"
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../out.txt", "x")
    with pytest.raises(ValueError):
        projects.extract_zip(str(bad))
    for url in ("-x", "ext::sh"):
        with pytest.raises(ValueError):
            projects.assert_safe_git_url(url)


def test_config():
    assert reports.parse_config('{"minScore": 7, "suppressions": [{"rule": "X", "reason": "y"}]}').min_score == 7
    for bad in ('{"a":1}', "{", '{"minScore": 11}', '{"suppressions":[{"rule":"X","reason":""}]}', '{"suppressions":[{"rule":"X","reason":"y","expires":"2024-02-31"}]}', '{"output":{"format":"x"}}'):
        with pytest.raises(ValueError):
            reports.parse_config(bad)
    assert reports.effective({"min_score": None, "fail_on": "low"}, reports.Config(min_score=3, fail_on="high")) ["fail_on"] == "low"
