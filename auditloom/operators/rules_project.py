"""Rules over whole projects: structure, dependencies, and the metadata that they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..schema import CATEGORIES, MAX_FINDINGS, RULES
from . import graph
from .rules_files import HIT, each, findings, hit, one, project_rows

GOD_TIERS = ((1500, "high", 10), (900, "medium", 5), (600, "low", 2))
FRAMEWORKS = ("Next.js", "React", "NestJS", "Django", "Docker", "Vitest", "Jest", "Pytest", "GitHub Actions", "Prisma", "Drizzle")


def project_meta(files: DataFrame) -> DataFrame:
    """One row a project: stack, runtime, package manager, frameworks, and flags, in one aggregation plus one for languages."""
    p, name, c = F.col("path"), P.basename(F.col("path")), F.col("content")
    any_ = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    is_ = lambda *names: any_(p.isin(*names))
    has = lambda s: any_(p.contains(s))
    marks = [is_("next.config.js", "next.config.ts", "next.config.mjs"), is_("package.json") & any_(p.endswith(".tsx") | p.endswith(".jsx")), has("nest-cli.json") | has(".module.ts"), is_("manage.py") | has("settings.py"),
             any_(name.isin("Dockerfile", "docker-compose.yml", "docker-compose.yaml")), has("vitest.config"), has("jest.config"), is_("pytest.ini") | has("conftest.py"), any_(p.startswith(".github/workflows/")), has("schema.prisma"), has("drizzle.config")]
    python = p.isin("requirements.txt", "pyproject.toml", "Pipfile", "setup.py")
    express = any_((p == "package.json") & F.coalesce(F.get_json_object(c, "$.dependencies.express"), F.get_json_object(c, "$.devDependencies.express")).isNotNull())
    pytest = any_(python & c.rlike(r"(?i)\bpytest\b|\[tool\.pytest"))
    named = [F.when(m, F.lit(n)) for n, m in zip(FRAMEWORKS, marks)] + [F.when(express, "Express"), F.when(any_(python & c.rlike(r"(?i)\bfastapi\b")), "FastAPI"), F.when(pytest & ~marks[7], "Pytest")]
    manager = F.when(is_("pnpm-lock.yaml"), "pnpm").when(is_("yarn.lock"), "yarn").when(is_("package-lock.json"), "npm").when(is_("Pipfile.lock", "Pipfile"), "pip").when(is_("poetry.lock"), "poetry").when(is_("Cargo.lock"), "cargo")
    ci = any_(p.startswith(".github/workflows/") | (p == ".gitlab-ci.yml") | p.startswith(".circleci/"))
    linter = has("biome.json") | has(".eslintrc") | has("eslint.config") | has(".prettierrc") | has("prettier.config")
    flags = files.groupBy("project_id").agg(
        F.count("*").alias("n_files"), any_(p.startswith(".git/")).alias("has_git"), any_((name == "Dockerfile") | name.startswith("docker-compose")).alias("has_docker"), ci.alias("has_ci"), linter.alias("has_linter"),
        manager.alias("package_manager"), F.array_compact(F.array(*named)).alias("frameworks"), is_("package.json").alias("has_manifest"), is_("package-lock.json", "yarn.lock", "pnpm-lock.yaml").alias("has_lock"), is_("package-lock.json").alias("has_npm_lock"),
        any_(name.isin("package-lock.json", "yarn.lock", "pnpm-lock.yaml")).alias("has_any_lock"), any_(F.lower(p) == "readme.md").alias("readme"), is_(".gitignore").alias("gitignore"), any_(name == "tsconfig.json").alias("tsconfig"),
        F.count_if(~p.contains("/") & P.extname(p).isin(".ts", ".tsx", ".js", ".jsx", ".py", ".rs", ".go")).alias("n_root"), F.count_if(F.size(F.split(p, "/")) > 8).alias("n_deep"), any_(p.startswith("src/")).alias("src"),
        any_(p.rlike("^(tests|test|__tests__)/")).alias("test_dir"), *(F.count_if(P.extname(p).isin(".ts", ".tsx") & t).alias(n) for n, t in (("kebab", P.stem(p).contains("-")), ("camel", P.stem(p).rlike("[a-z][A-Z]")), ("snake", P.stem(p).contains("_") & ~P.stem(p).startswith("_")))),
    )
    return flags.join(languages(files), "project_id", "left").withColumn("primary", F.coalesce("primary", F.lit("unknown"))).withColumn(
        "runtime", F.when(F.col("primary").isin("typescript", "javascript") & F.col("has_manifest"), "node").when(F.col("primary").isin("python", "rust"), F.col("primary"))
    )


def languages(files: DataFrame) -> DataFrame:
    """primary and secondary languages by number of files; ties go to the language met first in path order."""
    from ..schema import lookup

    rows = files.select("project_id", "path", lookup(P.LANGUAGES, P.extname(F.col("path"))).alias("lang")).where("lang is not null")
    counts = rows.groupBy("project_id", "lang").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "lang")))  # at most one row a language
    return counts.groupBy("project_id").agg(order.alias("o")).select("project_id", F.col("o")[0]["lang"].alias("primary"), F.transform(F.slice("o", F.lit(2), F.size("o")), lambda x: x["lang"]).alias("secondary"))


def size_metrics(measured: DataFrame) -> DataFrame:
    """project_id, path, loc -> totals, median, the largest file, and what share the five largest hold. Files are counted by
    length first (with partial sums); what is ordered is a project's distinct lengths."""
    by = measured.groupBy("project_id", "loc").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    project = W.partitionBy("project_id")
    by = by.withColumns({"upto": F.sum("n").over(project.orderBy(F.desc("loc"))), "total": F.sum("n").over(project)})
    at = lambda place: F.sum(F.when((F.col("upto") - F.col("n") < place) & (place <= F.col("upto")), F.col("loc")))
    among = F.greatest(F.lit(0), F.least(F.col("n"), 5 - F.col("upto") + F.col("n")))  # how many of that length are among the five
    median = (at(F.floor((F.col("total") + 1) / 2)) + at(F.floor(F.col("total") / 2) + 1)) / 2
    return by.groupBy("project_id").agg(
        F.sum(F.col("loc") * F.col("n")).alias("total_loc"), F.sum("n").alias("n_measured"), F.floor(median + 0.5).cast("long").alias("median_loc"), F.max_by("path", "loc").alias("largest"), F.max("loc").alias("largest_loc"),
        F.floor(100 * F.sum(F.col("loc") * among) / F.sum(F.col("loc") * F.col("n")) + 0.5).cast("long").alias("top5_pct"),
    )


def measured_files(files: DataFrame) -> DataFrame:
    """Maintained sources with their lines; generated-looking ones (over 500 characters a line) go."""
    mine = files.where(P.extname(F.col("path")).isin(P.CODE_EXTS) & (P.context(F.col("path")) == "source") & F.col("content").isNotNull())
    loc = F.size(X.lines(F.col("content")))
    return mine.where(X.utf16_length(F.col("content")) / loc <= 500).select("project_id", "path", loc.alias("loc"))


def god_tier(loc: Column, tiers=GOD_TIERS) -> Column:
    out = None
    for least, name, _ in tiers:
        out = F.when(loc > least, name) if out is None else out.when(loc > least, name)
    return out


def top_per_project(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(W.partitionBy("project_id").orderBy(*order))).where(F.col("rn") <= n)


def god_files(files: DataFrame) -> DataFrame:
    return measured_files(files).withColumn("tier", god_tier(F.col("loc"))).where("tier is not null")


def import_cycles(files: DataFrame) -> DataFrame:
    """Found in rounds when this is called, and written: `structure` and `structure_overflow` take the same ones."""
    return graph.cycles(graph.import_graph(files))


def structure_overflow(files: DataFrame, rings: DataFrame | None = None) -> DataFrame:
    """project_id, id, n_cut: how many large files, cycles and dead files `structure` leaves out beyond MAX_FINDINGS."""
    found = {"STR-011": god_files(files), "STR-012": import_cycles(files) if rings is None else rings, "STR-013": graph.dead_files(files)}
    out = None
    for rule, rows in found.items():
        n = rows.groupBy("project_id").agg(F.greatest(F.count("*") - MAX_FINDINGS[rule], F.lit(0)).alias("n_cut")).select("project_id", F.lit(rule).alias("id"), "n_cut")
        out = n if out is None else out.unionByName(n)
    return out


def structure(files: DataFrame, meta: DataFrame, dirs: DataFrame | None = None, rings: DataFrame | None = None) -> DataFrame:
    """dirs (project_id, path, parent, is_dir) is known where folders were scanned; without it no folder is empty. rings: `import_cycles`."""
    styles = F.array_compact(F.array(F.when(F.col("kebab") > 0, "k"), F.when(F.col("camel") > 0, "c"), F.when(F.col("snake") > 0, "s")))
    m = meta
    if dirs is not None:
        m = m.join(graph.empty_folders(dirs).groupBy("project_id").agg(F.count("*").alias("n_empty")), "project_id", "left")
    else:
        m = m.withColumn("n_empty", F.lit(0))
    large = F.col("n_files") > 100
    hits = [
        one(~F.col("readme"), "STR-001", "medium", 10),
        one(~F.col("gitignore"), "STR-002", "high", 15),
        one(F.col("n_root") > 5, "STR-003", "medium", 10, note=F.col("n_root")),
        one(F.col("n_deep") > 0, "STR-004", "low", 5, note=F.col("n_deep")),
        one(F.size(styles) > 1, "STR-005", "low", 5),
        one(~F.col("has_linter") & (F.col("primary") != "unknown"), "STR-006", "medium", 5),
        one((F.col("primary") == "typescript") & ~F.col("tsconfig"), "STR-007", "high", 10),
        one(F.coalesce("n_empty", F.lit(0)) > 0, "STR-008", "info", 0, note=F.col("n_empty")),
        one(large & ~F.col("src"), "STR-009", "medium", 10),
        one(large & ~F.col("test_dir"), "STR-010", "medium", 10),
    ]
    out = project_rows(m, hits, 0)
    gods = top_per_project(god_files(files), [F.desc("loc"), F.col("path")], MAX_FINDINGS["STR-011"])
    penalty = F.when(F.col("tier") == "high", 10).when(F.col("tier") == "medium", 5).otherwise(2)
    out = out.unionByName(findings(gods, [F.array(hit("STR-011", F.col("tier"), penalty, note=F.col("loc")))], 1))
    rings = (import_cycles(files) if rings is None else rings).where(F.col("n") < MAX_FINDINGS["STR-012"])
    chain = F.array_join(F.concat("members", F.slice("members", 1, 1)), " > ")
    out = out.unionByName(project_rows(rings, [F.array(hit("STR-012", "medium", 5, note=chain))], 2))
    dead = top_per_project(graph.dead_files(files), [F.col("path")], MAX_FINDINGS["STR-013"])
    return out.unionByName(findings(dead, [F.array(hit("STR-013", "low", 1, note=F.col("nonliteral")))], 3))


def dependencies(files: DataFrame, meta: DataFrame, advisories: DataFrame | None = None) -> DataFrame:
    """advisories: project_id, critical, high, where a check of the lock file was made; absent rows count as not checked."""
    c = F.col("content")
    manifest = files.where((F.col("path") == "package.json") & c.isNotNull()).join(meta.select("project_id", "has_lock", "has_npm_lock"), "project_id")
    doc = F.try_parse_json(c)
    text = lambda path: F.try_variant_get(doc, path, "string")
    versions = lambda path: F.coalesce(F.try_variant_get(doc, path, "map<string,string>"), F.create_map().cast("map<string,string>"))
    run, dev = versions("$.dependencies"), versions("$.devDependencies")
    dropped = F.map_filter(run, lambda k, _: ~F.map_contains_key(dev, k))
    wild = F.map_filter(F.map_concat(dropped, dev), lambda _, v: F.trim(v).isin("*", "latest"))
    found = manifest.withColumns({"ok": doc.isNotNull() & F.schema_of_variant(doc).startswith("OBJECT"), "wild": F.array_sort(F.map_keys(wild)), "n_run": F.size(run), "engines": text("$.engines").isNull() & F.try_variant_get(doc, "$.engines", "map<string,string>").isNull(), "test": text("$.scripts.test")})
    if advisories is not None:
        found = found.join(advisories.select("project_id", "critical", "high").withColumn("checked", F.lit(True)), "project_id", "left")
    else:
        found = found.withColumns({"critical": F.lit(0), "high": F.lit(0), "checked": F.lit(None).cast("boolean")})
    ok, checked = F.col("ok"), F.coalesce("checked", F.lit(False)) & F.col("has_npm_lock")
    hits = [
        one(~ok, "DEP-PARSE-ERR", "high", 20),
        one(ok & ~F.col("has_lock"), "DEP-001", "high", 15),
        F.when(ok, F.transform("wild", lambda n: hit("DEP-002", "high", 5, note=n))).otherwise(F.array().cast(HIT)),
        one(ok & (F.col("n_run") > 30), "DEP-003", "medium", 5, note=F.col("n_run")),
        one(ok & F.col("engines"), "DEP-004", "low", 3),
        one(ok & checked & (F.coalesce("critical", F.lit(0)) > 0), "DEP-AUDIT-CRITICAL", "critical", 20, note=F.col("critical")),
        one(ok & checked & (F.coalesce("high", F.lit(0)) > 0), "DEP-AUDIT-HIGH", "high", 10, note=F.col("high")),
        one(ok & F.col("has_npm_lock") & ~checked, "DEP-AUDIT-SKIP", "info", 0),
        one(ok & (F.coalesce("test", F.lit("")) == "") | (ok & F.col("test").contains("no test specified")), "DEP-005", "medium", 5),
    ]
    required = files.where((F.col("path") == "requirements.txt") & c.isNotNull())
    live = F.filter(X.lines(c), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#"))
    loose = F.size(F.filter(live, lambda x: ~x.contains("==") & ~x.contains(">=") & ~x.contains("~=")))
    return findings(found, hits, 0).unionByName(findings(required, [one(loose > 0, "DEP-PY-001", "medium", 5, note=loose)], 1))
