"""Path expressions: names, extensions, folders, normal form, and the role that a path gives a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder names and file names that give a file its role.
FIXTURE = ["fixtures", "fixture", "__fixtures__", "samples", "sample", "mocks", "mock", "__mocks__", "stubs", "testdata", "test-data", "test_data", "fake", "fakes"]
TEMPLATE = ["templates", "template", "examples", "example", "demos", "demo", "assets", "snippets", "boilerplate", "scaffold"]
VENDOR = ["node_modules", "vendor", "vendors", "third-party", "third_party", "external"]
GENERATED = ["generated", "__generated__", "gen", ".next", "dist", "build", "out"]
CONFIG_TEMPLATE = [".env.example", ".env.template", ".env.sample", ".env.local.example", "config.example.json", "config.sample.json", "settings.example.py", "settings.sample.py"]
DOCUMENT = ["readme.md", "changelog.md", "contributing.md", "license", "license.md"]
EXCLUDED = ["fixture", "template", "config-template", "documentation", "generated", "vendor", "security-tool"]
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".rs": "rust", ".go": "go",
    ".java": "java", ".rb": "ruby", ".php": "php", ".cs": "csharp", ".swift": "swift", ".kt": "kotlin",
}
CODE_EXTS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".py", ".rs", ".go", ".java"]
SCRIPT_EXTS = [".ts", ".tsx", ".js", ".jsx", ".mjs"]


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extname(path: Column) -> Column:
    """From the last dot of the name on; empty where the name has none after its first character."""
    return F.regexp_extract(basename(path), r"^.+?(\.[^.]*)$", 1)


def dirname(path: Column) -> Column:
    """Folder of a path; empty at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    name, ext = basename(path), extname(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(ext))


def normal(path: Column) -> Column:
    """`.` and empty segments go, `..` takes back the segment before it."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    step = lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def any_segment(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, names)))


def looks_like_test(path: Column) -> Column:
    name = basename(path)
    return name.contains(".test.") | name.contains(".spec.") | name.contains("_test.") | name.contains("_spec.")


def context(path: Column) -> Column:
    """Role of a file by its path alone; the first that fits."""
    name, lower = F.lower(basename(path)), F.lower(path)
    test = looks_like_test(path) | any_segment(path, ["__tests__", "tests", "test"])
    return (
        F.when(name.isin(CONFIG_TEMPLATE), "config-template")
        .when(name.isin(DOCUMENT) | lower.startswith("docs/") | lower.startswith("documentation/"), "documentation")
        .when(any_segment(path, GENERATED), "generated")
        .when(any_segment(path, VENDOR), "vendor")
        .when(any_segment(path, FIXTURE), "fixture")
        .when(test, "test")
        .when(any_segment(path, TEMPLATE) | name.rlike("sample|example|mock|dummy"), "template")
        .otherwise("source")
    )


def adjusted_severity(severity: Column, role: Column) -> Column:
    """Severity in a file's role: two steps down in tests, null (drop) in roles that nobody maintains as code."""
    return F.when(role.isin(EXCLUDED), F.lit(None)).when(role == "test", F.when(severity == "critical", "medium").when(severity == "high", "low").otherwise("info")).otherwise(severity)


#: Extensions tried for an import, and what stands for a compiled one.
RESOLVE_EXTS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cts", ".mts"]
COMPILED = {".js": [".ts", ".tsx"], ".jsx": [".tsx"], ".mjs": [".mts"], ".cjs": [".cts"]}


def import_candidates(raw: Column) -> Column:
    """Paths that an import of `raw` may mean, best first."""
    rewritten = [F.when(raw.endswith(js), F.array(*(F.concat(F.substring(raw, F.lit(1), F.length(raw) - len(js)), F.lit(ts)) for ts in all_ts))).otherwise(F.array().cast("array<string>")) for js, all_ts in COMPILED.items()]
    return F.concat(F.array(raw), *rewritten, F.array(*(F.concat(raw, F.lit(e)) for e in RESOLVE_EXTS)), F.array(*(F.concat(raw, F.lit(f"/index{e}")) for e in RESOLVE_EXTS)))


def glob_regex(pattern: str, below: bool = True) -> str:
    """Regular expression of one ignore-file pattern, for paths relative to its folder; a match covers all below it, unless `below` is
    false: then it is the entry alone that fits. `**` spans folders; a slash before the end anchors; a slash at the end means folders only."""
    import re

    folders_only = pattern.endswith("/")
    body = pattern.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 1 :]:
            end = body.index("]", i + 1)
            inner = body[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[:1] in "!^" else inner) + "]", end + 1
        else:
            if body[i] == "\\" and i + 1 < len(body):
                i += 1
            out, i = out + re.escape(body[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("$" if not below else "/.+$" if folders_only else "(?:/.*)?$")


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether an ignore file's lines ignore a path: the last pattern that fits decides, `!` takes back."""
    out = F.lit(False)
    for line in lines:
        line = line.rstrip("\r\n").strip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        out = F.when(path.rlike(glob_regex(line[1:] if keep else line)), F.lit(not keep)).otherwise(out)
    return out
