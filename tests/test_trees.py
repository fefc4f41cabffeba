"""The source of trees and archives, ignore files as joins, and components of edge tables, against plain Python."""

import os
import random
import re
import zipfile

import pytest

from auditloom.functions import paths as P
from auditloom.operators import components, ignores
from auditloom.sources import projects, trees


@pytest.fixture
def shared(tmp_path):
    root = tmp_path / "shared"

    def put(path, content="x"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content if isinstance(content, bytes) else content.encode())

    put("one/.env", "A=1"), put("one/_hidden/_x.ts", "hid"), put("one/src/deep/er/a.ts", "a\r\nb"), put("one/src/latin.txt", b"caf\xe9"), put("one/big.bin", "y" * 200)
    put("one/node_modules/m/i.js"), put("one/src/.cache/c"), put("one/.gitignore", "*.tmp\n"), put("one/src/t.tmp"), put("two/README.md", "two"), put("two/empty.txt", "")
    (root / "two" / "none").mkdir()
    os.symlink(root / "one", root / "two" / "link")
    os.symlink(root / "two" / "README.md", root / "two" / "link.md")
    put("loose.txt", "beside projects")
    with zipfile.ZipFile(root / "three.zip", "w") as z:
        for k in range(40):
            z.writestr(f"src/f{k}.ts", f"file {k} " + "z" * 50)
        z.writestr(".hidden/_a", "h"), z.writestr("dist/x.js", "no"), z.writestr("folder/", ""), z.writestr("large.txt", "y" * 200), z.writestr("twice.txt", "old"), z.writestr("twice.txt", "new")
        link = zipfile.ZipInfo("link")
        link.external_attr = 0o120777 << 16
        z.writestr(link, "/etc/passwd")
    with zipfile.ZipFile(root / "bad.zip", "w") as z:
        z.writestr("fine.txt", "x"), z.writestr("../../out.txt", "leaves")
    put("broken.ZIP", "PK no archive")
    return root


def rows_of(df):
    return {(r["project_id"], r["path"]): (r["size"], r["content"], r["skipped"]) for r in df.collect()}


def expected():
    want = {("one", p): (len(c), c, None) for p, c in ((".env", "A=1"), ("_hidden/_x.ts", "hid"), ("src/deep/er/a.ts", "a\r\nb"), (".gitignore", "*.tmp\n"), ("src/t.tmp", "x"))}
    want |= {("one", "src/latin.txt"): (4, "caf�", None), ("one", "big.bin"): (200, None, "too large"), ("two", "README.md"): (3, "two", None), ("two", "empty.txt"): (0, "", None)}
    want |= {("three", f"src/f{k}.ts"): (len(f"file {k} ") + 50, f"file {k} " + "z" * 50, None) for k in range(40)}
    want |= {("three", ".hidden/_a"): (1, "h", None), ("three", "large.txt"): (200, None, "too large"), ("three", "twice.txt"): (3, "new", None)}
    return want | {("bad", None): (None, None, "unsafe entry path: ../../out.txt"), ("broken", None): (None, None, "no archive: BadZipFile")}


@pytest.mark.parametrize(("depth", "size"), [(0, 1 << 30), (1, 500), (2, 97), (5, 1 << 30)])
def test_trees_and_archives(spark, shared, depth, size):
    df = trees.read_trees(spark, str(shared), depth=depth, range=size, maxRead=150)
    assert df.schema.simpleString() == "struct<project_id:string,path:string,size:bigint,content:string,skipped:string>"
    assert rows_of(df) == expected() and df.count() == len(expected())


def test_partitions_follow_folders_and_ranges(shared):
    reader = trees.TreesReader({"path": str(shared), "range": "500"})
    parts = reader.partitions()
    size = (shared / "three.zip").stat().st_size
    assert sum(isinstance(p, trees.ArchiveRange) and p.project == "three" for p in parts) == -(-size // 500)
    assert {(p.below, p.deep) for p in parts if isinstance(p, trees.Folder) and p.project == "one"} == {("", False), ("_hidden", False), ("src", False), ("src/deep", True)}
    assert all(isinstance(p, trees.Folder) for p in trees.TreesReader({"path": f"file://{shared}/one", "single": "true"}).partitions())


def test_corpus_without_ignored(spark, shared):
    files, skipped = projects.scan_corpus(spark, str(shared), maxRead=150)
    assert {(r["project_id"], r["path"]) for r in files.collect()} == {k for k in expected() if k[1] and k != ("one", "src/t.tmp")}
    assert {(r["project_id"], r["skipped"]) for r in skipped.collect()} == {("one", "too large"), ("three", "too large"), ("bad", "unsafe entry path: ../../out.txt"), ("broken", "no archive: BadZipFile")}
    one = projects.scan_project(spark, str(shared / "three.zip"))
    assert {r["project_id"] for r in one.collect()} == {"three"} and one.count() == 43
    with pytest.raises(ValueError, match="unsafe"):
        projects.scan_project(spark, str(shared / "bad.zip"))


# ignore files


def brute_ignored(path, lines):
    """Folders on the way first; the last pattern that fits an entry decides."""
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        entry, is_dir, verdict = "/".join(parts[:n]), n < len(parts), False
        for line in lines:
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            body = line.removeprefix("!")
            if body.strip("/") and (is_dir or not body.endswith("/")) and re.search(P.glob_regex(body, below=False), entry):
                verdict = not line.startswith("!")
        if verdict:
            return True
    return False


def test_ignore_files_match_brute_force(spark):
    r = random.Random(4)
    names = ["a", "b", "src", "x.log", "y.min.js", "a b", "node_modules", "é", "tmp~", ".env", "lib"]
    pieces = ["a", "b", "src", "*", "**", "*.log", "?", "[ab]", "[!a]", "x*", "*.js", "*~", ".env*", "é", "lib", "\\*"]
    rows, lines = [], {}
    for p in range(60):
        project = f"p{p}"
        first = [r.choice(["", "!"]) + r.choice(["", "/"]) + "/".join(r.choice(pieces) for _ in range(r.randint(1, 3))) + r.choice(["", "", "/"]) for _ in range(r.randint(0, 7))] + r.sample(["# no", "  ", "!", "/", "src/gen.ts "], 2)
        more = ["!node_modules", "!lib"] if p % 3 == 0 else []
        lines[project] = [*first, *trees.ALWAYS_IGNORED, *more]
        rows.append((project, ".gitignore", 1, "\r\n".join(first) if p % 2 else "\n".join(first)))
        if more:
            rows.append((project, ".auditignore", 1, "\n".join(more)))
        rows += [(project, path, 1, None) for path in {"/".join(r.choice(names) for _ in range(r.randint(1, 4))) for _ in range(40)}]
    rows += [("none", "a/x.log", 1, "x"), ("none", "dist/a", 1, "x")]
    lines["none"] = trees.ALWAYS_IGNORED
    files = spark.createDataFrame(rows, "project_id string, path string, size long, content string")
    got = {(x["project_id"], x["path"]) for x in ignores.without_ignored(files).collect()}
    # an entry may be a file of one path and a folder of another in these made-up trees; as a folder it is judged
    folders = {(p, "/".join(path.split("/")[:n])) for p, path, *_ in rows for n in range(1, path.count("/") + 1)}
    want = {(p, path) for p, path, *_ in rows if not brute_ignored(path + "/x" * ((p, path) in folders), lines[p] if (p, path) in folders else lines[p])}
    unsure = {(p, path) for p, path, *_ in rows if (p, path) in folders}
    assert got - unsure == want - unsure


def test_trie_places():
    assert [ignores.trie_place(x) for x in ("/src/gen/", "docs/**/x", "*.log", "cache", "*~", "**/a", "a*.b.c")] == [("path", "src/gen"), ("path", "docs"), ("ext", ".log"), ("name", "cache"), ("path", ""), ("path", ""), ("ext", ".c")]


# components


def brute_components(edges):
    out = {}
    for p in {e[0] for e in edges}:
        to = {}
        for q, a, b in edges:
            if q == p:
                to.setdefault(a, set()).add(b)
        reach = {}
        for n in to:
            seen, stack = set(), [n]
            while stack:
                for m in to.get(stack.pop(), ()):
                    if m not in seen:
                        seen.add(m)
                        stack.append(m)
            reach[n] = seen
        for n in reach:
            if n in reach[n]:
                out[p, n] = min(m for m in reach[n] if n in reach.get(m, ()))
    return out


def test_components_match_brute_force(spark):
    r = random.Random(6)
    edges = [("chain", f"n{k:03}", f"n{k + 1:03}") for k in range(120)] + [("back", f"n{k + 1:03}", f"n{k:03}") for k in range(120)]
    edges += [("ring", f"n{k:03}", f"n{(k * 7 + 7) % 60:03}") for k in range(60)] + [("self", "a", "a"), ("self", "a", "b"), ("pair", "é", "z"), ("pair", "z", "é"), ("pair", "z", "z")]
    for p in range(40):
        n = r.randint(2, 30)
        edges += [(f"r{p}", f"{r.randrange(n):02}", f"{r.randrange(n):02}") for _ in range(r.randint(1, 2 * n))]
    df = spark.createDataFrame(edges, "project_id string, src string, dst string")
    got = {(x["project_id"], x["node"]): x["component"] for x in components.components(df).collect()}
    assert got == brute_components(edges)
    assert components.components(df.limit(0)).collect() == [] and components.components(df.where("project_id = 'chain'")).collect() == []
