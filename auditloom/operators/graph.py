"""Imports of scripts: extraction, resolution, cycles, and files that nothing reaches.

Resolution is a join of ordered candidates with the files that exist; the first candidate wins by a partial minimum. Cycles are
strongly connected components of the edge table (`components`).
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from .components import components

#: Imports that no reader can resolve, and what counts as a file name in other text.
NONLITERAL = r"""\b(?:import|require)\s*\(\s*[^'")\s]"""
FILE_TOKEN = r"[\w@./-]+\.(?:ts|tsx|js|jsx|mjs|cjs|mts|cts)\b"


def imports_of(content: Column) -> Column:
    """(specifier, type_only) of every import, export-from, require and literal dynamic import."""
    code = X.without_comments(content)
    every = lambda pattern, k: F.regexp_extract_all(code, F.lit(pattern), F.lit(k))
    clause = r"""\b(import|export)\b([^'"]*?)\bfrom\s*['"]([^'"]+)['"]"""
    named = F.zip_with(every(clause, 3), every(clause, 2), lambda s, c: F.struct(s.alias("specifier"), c.rlike(r"^\s+type\b").alias("type_only")))
    rest = [F.transform(every(p, 1), lambda s: F.struct(s.alias("specifier"), F.lit(False).alias("type_only"))) for p in (r"""\bimport\s*['"]([^'"]+)['"]""", r"""\brequire\s*\(\s*['"]([^'"]+)['"]\s*\)""", r"""\bimport\s*\(\s*['"]([^'"]+)['"]\s*\)""")]
    return F.concat(named, *rest)


def scripts(files: DataFrame) -> DataFrame:
    return files.where(P.extname(F.col("path")).isin(P.SCRIPT_EXTS) & F.col("content").isNotNull())


def import_rows(files: DataFrame) -> DataFrame:
    """project_id, src, specifier, type_only of every import in a script."""
    return scripts(files).select("project_id", F.col("path").alias("src"), F.explode(imports_of(F.col("content"))).alias("i")).select("project_id", "src", "i.*").distinct()


def first_existing(rows: DataFrame, keys: list[str], files: DataFrame) -> DataFrame:
    """rows: project_id, keys and `candidates`, best first -> project_id, keys and dst, for those of which one exists."""
    there = files.select("project_id", F.col("path").alias("candidate"))
    all_ = rows.select("project_id", *keys, F.posexplode("candidates").alias("pos", "candidate"))
    return all_.join(there, ["project_id", "candidate"]).groupBy("project_id", *keys).agg(F.min_by("candidate", "pos").alias("dst"))


def relative_imports(files: DataFrame) -> DataFrame:
    """project_id, src, specifier, type_only, dst of relative imports that resolve."""
    rows = import_rows(files).where(F.startswith(F.col("specifier"), F.lit(".")))
    raw = P.normal(F.concat(P.dirname(F.col("src")), F.lit("/"), F.col("specifier")))
    return first_existing(rows.withColumn("candidates", P.import_candidates(raw)), ["src", "specifier", "type_only"], files)


def import_graph(files: DataFrame) -> DataFrame:
    """Distinct value edges (project_id, src, dst) between maintained scripts."""
    node = lambda c: P.extname(c).isin(P.SCRIPT_EXTS) & (P.context(c) == "source")
    edges = relative_imports(files).where(~F.col("type_only"))
    return edges.where(node(F.col("src")) & node(F.col("dst"))).select("project_id", "src", "dst").distinct()


def cycles(edges: DataFrame) -> DataFrame:
    """project_id, n (from 0, by first member) and members (last name first) of each cycle: components of two or more files,
    and files that import themselves."""
    found = components(edges).groupBy("project_id", "component").agg(F.sort_array(F.collect_list("node"), False).alias("members"))
    order = W.partitionBy("project_id").orderBy("component")
    return found.select("project_id", (F.row_number().over(order) - 1).alias("n"), "members")


def _jsonc(content: str):
    try:
        return json.loads(content)
    except ValueError:
        plain = re.sub(r"/\*.*?\*/", "", content, flags=re.S)
        plain = re.sub(r"^\s*//.*$", "", plain, flags=re.M)
        return json.loads(re.sub(r",\s*([}\]])", r"\1", plain))


def read_aliases(content: str | None) -> dict | None:
    """base_url and paths of a compiler configuration; None without any, ValueError where it cannot be read."""
    doc = _jsonc(content or "")
    if not isinstance(doc, dict):
        raise ValueError("no object")
    options = doc.get("compilerOptions")
    if not isinstance(options, dict):
        return None
    base = options.get("baseUrl") if isinstance(options.get("baseUrl"), str) else None
    given = options.get("paths") if isinstance(options.get("paths"), dict) else {}
    paths = {k: v for k, v in given.items() if isinstance(v, list) and all(isinstance(x, str) for x in v)}
    return {"base_url": base, "paths": list(paths.items())} if base is not None or paths else None


ALIASES = "project_id string, path string, unparseable boolean, base_url string, patterns array<struct<pattern:string,targets:array<string>>>"


def aliases(files: DataFrame) -> DataFrame:
    """Alias configurations of each project."""

    def run(batches):
        for pdf in batches:
            rows = []
            for project, path, content in zip(pdf["project_id"], pdf["path"], pdf["content"]):
                try:
                    got = read_aliases(content)
                except ValueError:
                    rows.append((project, path, True, None, []))
                    continue
                if got:
                    rows.append((project, path, False, got["base_url"], [{"pattern": k, "targets": v} for k, v in got["paths"]]))
            yield pd.DataFrame(rows, columns=["project_id", "path", "unparseable", "base_url", "patterns"])

    mine = files.where(F.col("path").rlike(r"(^|/)tsconfig[^/]*\.json\z") & F.col("content").isNotNull())
    return mine.select("project_id", "path", "content").mapInPandas(run, ALIASES)


def alias_imports(files: DataFrame, configs: DataFrame) -> DataFrame:
    """project_id, src, specifier, dst of imports through aliases: configurations, patterns and targets in order."""
    rows = import_rows(files).where(~F.startswith(F.col("specifier"), F.lit("."))).select("project_id", "src", "specifier").distinct()
    live = configs.where("not unparseable").withColumn("root", P.normal(F.concat(P.dirname(F.col("path")), F.lit("/"), F.coalesce("base_url", F.lit(".")))))
    both = rows.join(live, "project_id")
    s = F.col("specifier")

    def targets(p):
        star = F.instr(p["pattern"], "*")
        head, tail = F.substring(p["pattern"], F.lit(1), star - 1), F.substring(p["pattern"], star + 1, F.length(p["pattern"]))
        held = F.startswith(s, head) & F.endswith(s, tail) & (F.length(s) >= F.length(p["pattern"]) - 1)
        matched = F.substring(s, F.length(head) + 1, F.length(s) - F.length(head) - F.length(tail))
        got = F.when(star == 0, F.when(s == p["pattern"], F.lit(""))).otherwise(F.when(held, matched))
        filled = F.transform(p["targets"], lambda t: F.when(F.instr(t, "*") > 0, F.concat(F.substring(t, F.lit(1), F.instr(t, "*") - 1), got, F.substring(t, F.instr(t, "*") + 1, F.length(t)))).otherwise(t))
        return F.when(got.isNull(), F.array().cast("array<string>")).otherwise(filled)

    raws = F.concat(F.flatten(F.transform("patterns", targets)), F.when(F.col("base_url").isNotNull(), F.array(s)).otherwise(F.array().cast("array<string>")))
    candidates = F.flatten(F.transform(raws, lambda r: P.import_candidates(P.normal(F.concat(F.col("root"), F.lit("/"), r)))))
    found = first_existing(both.withColumn("candidates", candidates), ["src", "specifier", "path"], files)
    return found.groupBy("project_id", "src", "specifier").agg(F.min_by("dst", "path").alias("dst"))


def string_references(files: DataFrame) -> DataFrame:
    """(project_id, path) of files that some script, page, shell or configuration file names."""
    name = P.basename(F.col("path"))
    mine = files.where((P.extname(F.col("path")).isin(".html", ".yml", ".yaml", ".sh", ".toml", ".json", *P.SCRIPT_EXTS) | name.rlike("^(Dockerfile|Makefile|Justfile)")) & F.col("content").isNotNull())
    tokens = mine.select("project_id", F.col("path").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(FILE_TOKEN), F.lit(0)))).alias("token"))
    token, folder = F.col("token"), P.dirname(F.col("src"))
    clean = F.regexp_replace(token, "^/+", "")
    parts = F.split(clean, "/")
    shorter = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(10)) - 1), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "/"))).otherwise(F.array().cast("array<string>"))
    bases = F.concat(F.array(P.normal(F.concat(folder, F.lit("/"), clean)), clean), shorter)
    bases = F.concat(bases, F.transform(bases, lambda b: F.concat(F.lit("src/"), b)))
    bases = F.when(token.startswith("."), F.array(P.normal(F.concat(folder, F.lit("/"), token)))).otherwise(bases)
    rows = tokens.withColumn("candidates", F.flatten(F.transform(bases, P.import_candidates)))
    return first_existing(rows, ["src", "token"], files).where("dst <> src").select("project_id", F.col("dst").alias("path")).distinct()


def _strings(value) -> list[str]:
    if isinstance(value, str):
        return [value]
    inner = value if isinstance(value, list) else value.values() if isinstance(value, dict) else ()
    return [s for v in inner for s in _strings(v)]


def entry_points(files: DataFrame) -> DataFrame:
    """(project_id, path) of files that a manifest names as entry, binary, export or in a script."""

    def refs(content: str | None) -> list[str]:
        try:
            doc = json.loads(content or "")
        except ValueError:
            return []
        if not isinstance(doc, dict):
            return []
        out = [doc[k] for k in ("main", "module", "types", "browser") if isinstance(doc.get(k), str)]
        binary = doc.get("bin")
        out += [binary] if isinstance(binary, str) else [v for v in binary.values() if isinstance(v, str)] if isinstance(binary, dict) else []
        out += _strings(doc.get("exports"))
        commands = doc.get("scripts")
        for command in commands.values() if isinstance(commands, dict) else ():
            out += re.findall(FILE_TOKEN, command, re.A) if isinstance(command, str) else []
        return out

    def run(batches):
        for pdf in batches:
            rows = []
            for project, path, content in zip(pdf["project_id"], pdf["path"], pdf["content"]):
                folder = path.rpartition("/")[0]
                for r in refs(content):
                    joined = f"{folder}/{r}" if folder else r
                    rows.append((project, re.sub(r"^\./", "", joined).replace("/./", "/")))
            yield pd.DataFrame(rows, columns=["project_id", "path"])

    mine = files.where((P.basename(F.col("path")) == "package.json") & F.col("content").isNotNull()).select("project_id", "path", "content")
    return mine.mapInPandas(run, "project_id string, path string").distinct().join(files.select("project_id", "path"), ["project_id", "path"], "left_semi")


def is_convention_entry(path: Column) -> Column:
    """Files that frameworks and tools find by name or folder."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    name = P.basename(path)
    base = F.regexp_replace(name, r"\.[^.]+\z", "")
    root = name.rlike(r"^index\.[^.]+\z") & P.dirname(path).isin("", "src")
    return (
        F.arrays_overlap(folders, F.array(*map(F.lit, ["pages", "routes", "scripts", "bin", "tools"])))
        | base.isin("page", "layout", "route", "loading", "error", "template", "not-found", "middleware", "instrumentation")
        | name.rlike(r"\.(config|stories|story)\.[^.]+\z")
        | root
    )


def dead_files(files: DataFrame) -> DataFrame:
    """project_id, path, nonliteral: maintained scripts that nothing imports, names, enters or runs. Projects of which an
    alias configuration cannot be read have none."""
    configs = aliases(files)
    path = F.col("path")
    mine = files.where(P.extname(path).isin(P.SCRIPT_EXTS) & (P.context(path) == "source") & ~path.endswith(".d.ts") & ~is_convention_entry(path))
    mine = mine.where(F.coalesce(~F.col("content").startswith("#!"), F.lit(True))).select("project_id", "path")
    imported = relative_imports(files).select("project_id", F.col("dst").alias("path")).unionByName(alias_imports(files, configs).select("project_id", F.col("dst").alias("path")))
    reached = imported.unionByName(string_references(files)).unionByName(entry_points(files))
    dead = mine.join(reached, ["project_id", "path"], "left_anti").join(configs.where("unparseable").select("project_id"), "project_id", "left_anti")
    late = scripts(files).where(F.col("content").rlike(NONLITERAL)).select("project_id").distinct().withColumn("nonliteral", F.lit(True))
    return dead.join(late, "project_id", "left").select("project_id", "path", F.coalesce("nonliteral", F.lit(False)).alias("nonliteral"))


def empty_folders(dirs: DataFrame) -> DataFrame:
    """dirs: project_id, path, parent, of all folders and files -> folders that are no one's parent."""
    return dirs.where("is_dir").join(dirs.select("project_id", F.col("parent").alias("path")), ["project_id", "path"], "left_anti").select("project_id", "path")
