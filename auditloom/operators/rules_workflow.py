"""Rules over CI workflow files, as expressions over VARIANT.

Python only parses: each file's YAML becomes JSON text, of which jobs and steps are arrays of variants that higher-order
functions walk inside the row. Nothing is shuffled, and a file's findings come in the order of the rules.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import lookup
from .rules_files import HIT, findings, hit, one

#: What names a check, what outsiders control, what refers to an action, and the penalties.
GATE = "(?i)test|lint|audit|security|scan|check|verify|gate"
UNTRUSTED = r"\$\{\{\s*github\.(event\.(issue|pull_request|comment|review|discussion|commits|head_commit)|head_ref)[^}]*\}\}"
USES = r"(?md)^\s*(?:-\s+)?uses:\s*([\w.-]+)/([\w./-]+)@([\w./-]+)"
PENALTY = {"critical": 15, "high": 10, "medium": 5, "low": 2}


#: Levels beyond which a file counts as unreadable, as one does that holds itself.
DEEPEST = 100


def _plain(value, level: int = 0):
    """The value as JSON knows it. A bare `on` is a boolean in YAML 1.1."""
    if level > DEEPEST:
        raise ValueError("nested too deeply")
    if isinstance(value, dict):
        bare = [] if level or "on" in value else [True]
        return {("on" if k in bare and k is True else str(k)): _plain(v, level + 1) for k, v in value.items() if level or k is not True or bare}
    if isinstance(value, (list, tuple, set)):
        return [_plain(v, level + 1) for v in value]
    if value is None or isinstance(value, (bool, str)) or isinstance(value, int) and abs(value) < 10**18 or isinstance(value, float) and math.isfinite(value):
        return value
    return str(value)


def as_json(raw: str) -> tuple[bool, str | None]:
    """(is readable, JSON text where it is a mapping)."""
    import yaml

    try:
        doc = yaml.safe_load(raw)
        return True, json.dumps(_plain(doc)) if isinstance(doc, dict) else None
    except (yaml.YAMLError, ValueError, RecursionError):
        return False, None


def parsed(files: DataFrame) -> DataFrame:
    """files with `readable` and `doc`, a variant."""

    def run(batches):
        for batch in batches:
            got = [as_json(t) for t in batch.column(batch.schema.get_field_index("content")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r for r, _ in got], pa.bool_()), pa.array([j for _, j in got], pa.string())], [*batch.schema.names, "readable", "json"])

    kinds = ", ".join(f"{n} {k}" for n, k in files.dtypes)
    return files.mapInArrow(run, f"{kinds}, readable boolean, json string").withColumn("doc", F.try_parse_json("json")).drop("json")


def _at(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, kind: str) -> Column:
    """Whether a variant is of a kind: OBJECT, ARRAY, STRING, BOOLEAN."""
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def _text(v: Column, path: str) -> Column:
    """The text at a path; empty where there is none or something else."""
    return F.when(_is(_at(v, path, "variant"), "STRING"), _at(v, path, "string")).otherwise("")


def _said(v: Column, path: str) -> Column:
    """Whatever scalar stands at a path, as text."""
    return F.coalesce(_at(v, path, "string"), F.lit(""))


def _true(v: Column, path: str) -> Column:
    return _is(_at(v, path, "variant"), "BOOLEAN") & _at(v, path, "boolean")


def _has(v: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(_at(v, "$", "map<string,variant>"), key), F.lit(False))


def _line(mark: str | Column) -> Column:
    """The first line of the file that holds a mark; null where none does."""
    raw, mark = F.col("content"), F.lit(mark) if isinstance(mark, str) else mark
    return F.when(F.contains(raw, mark), F.size(F.split(F.call_function("substring_index", raw, mark, F.lit(1)), "\n")))


def _hits(id_: str, severity: str, line, items: Column, test=None) -> Column:
    """A finding for each item that passes."""
    return F.transform(items if test is None else F.filter(items, test), lambda x: hit(id_, severity, PENALTY[severity], line=line(x) if callable(line) else line))


def _rule(condition: Column, id_: str, severity: str, line: Column) -> Column:
    return one(F.coalesce(condition, F.lit(False)), id_, severity, PENALTY[severity], line=line)


def _wrong_branches(event: str) -> Column:
    """The event is limited to branches, by names without wildcards, none of which the repository has."""
    listed = F.transform(_at(F.col("on"), f"$.{event}.branches", "array<variant>"), lambda b: b.try_cast("string"))
    return _is(F.col("on"), "OBJECT") & (F.size("branches") > 0) & (F.size(listed) > 0) & ~F.exists(listed, lambda b: b.rlike(r"[*?\[]")) & ~F.arrays_overlap(listed, "branches")


def workflow(files: DataFrame, meta: DataFrame, branches: DataFrame | None = None) -> DataFrame:
    """branches: project_id, branch, where the repository is known."""
    mine = files.where(F.col("path").rlike(r"^\.github/workflows/[^/]+\.ya?ml\z") & F.col("content").isNotNull()).select("project_id", "path", "content")
    mine = mine.join(meta.select("project_id", "has_any_lock"), "project_id")
    none = F.array().cast("array<string>")
    if branches is not None:
        mine = mine.join(branches.groupBy("project_id").agg(F.array_sort(F.collect_set("branch")).alias("branches")), "project_id", "left").withColumn("branches", F.coalesce("branches", none))
    else:
        mine = mine.withColumn("branches", none)
    mine = parsed(mine)
    doc, raw, on = F.col("doc"), F.col("content"), F.col("on")
    mine = mine.withColumns({"on": _at(doc, "$.on", "variant"), "jobs": F.coalesce(F.map_entries(_at(doc, "$.jobs", "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))})
    named = F.transform(_at(on, "$", "array<variant>"), lambda e: e.try_cast("string"))
    events = F.when(_is(on, "STRING"), F.array(_at(on, "$", "string"))).when(_is(on, "ARRAY"), named).when(_is(on, "OBJECT"), F.map_keys(_at(on, "$", "map<string,variant>"))).otherwise(none)
    steps_of = lambda job: F.filter(F.coalesce(_at(job, "$.steps", "array<variant>"), F.array().cast("array<variant>")), lambda s: _is(s, "OBJECT"))
    mine = mine.withColumns({"events": events, "steps": F.flatten(F.transform("jobs", lambda j: steps_of(j["value"])))})

    on_any = lambda *names: F.arrays_overlap(F.col("events"), F.array(*map(F.lit, names)))
    of_job = lambda key: F.exists("jobs", lambda j: _has(j["value"], key))
    checkout = lambda s: F.startswith(_text(s, "$.uses"), F.lit("actions/checkout")) & F.contains(_text(s, "$.with.ref"), F.lit("github.event.pull_request.head"))
    lines = F.transform(F.split(raw, "\n"), lambda t, i: F.struct(t.alias("t"), (i + 1).alias("n")))
    used = F.arrays_zip(*(F.regexp_extract_all(raw, F.lit(USES), F.lit(k)).alias(n) for k, n in ((0, "whole"), (1, "owner"), (3, "ref"))))
    foreign = F.filter(used, lambda u: ~u["owner"].isin("actions", "github") & ~u["ref"].rlike("^[0-9a-f]{40}$"))
    moving = lambda u: F.when(u["ref"].isin("master", "main", "latest"), "high").otherwise("medium")
    gate = lambda *texts: F.array_join(F.array(*texts), "\n").rlike(GATE)
    loose = lambda v: _true(v, "$['continue-on-error']")
    job_gates = lambda j: loose(j["value"]) & gate(j["key"], _said(j["value"], "$.name"))
    step_gates = lambda s: loose(s) & gate(_said(s, "$.name"), F.substring(_said(s, "$.run"), 1, 60))
    uncached = lambda s: F.startswith(_text(s, "$.uses"), F.lit("actions/setup-node")) & ~_has(_at(s, "$.with", "variant"), "cache")
    empty = F.array().cast(HIT)
    when = lambda condition, hits: F.when(condition, hits).otherwise(empty)
    hits = F.concat(
        when(on_any("pull_request_target"), _hits("WFL-001", "critical", _line("pull_request_target"), F.col("steps"), checkout)),
        _hits("WFL-002", "high", lambda x: x["n"], lines, lambda x: x["t"].rlike(UNTRUSTED) & x["t"].rlike(r"run:|`|\$\(")),
        F.transform(foreign, lambda u: hit("WFL-003", moving(u), lookup(PENALTY, moving(u)), line=_line(F.regexp_replace(u["whole"], r"^\s+", "")))),
        _rule(~_has(doc, "permissions") & ~of_job("permissions"), "WFL-004", "medium", F.lit(1)),
        _rule(raw.rlike(r"permissions:\s*write-all"), "WFL-005", "high", _line("write-all")),
        *(_rule(_wrong_branches(e), "WFL-006", "high", _line(f"{e}:")) for e in ("push", "pull_request")),
        _rule((F.size("jobs") > 0) & ~of_job("timeout-minutes"), "WFL-007", "low", _line("jobs:")),
        _rule(on_any("push", "pull_request") & ~_has(doc, "concurrency"), "WFL-008", "low", F.lit(1)),
        _hits("WFL-009", "high", _line("continue-on-error"), F.col("jobs"), job_gates),
        _hits("WFL-009", "high", _line("continue-on-error"), F.col("steps"), step_gates),
        when(F.col("has_any_lock"), _hits("WFL-010", "low", _line("setup-node"), F.col("steps"), uncached)),
        _rule(on_any("pull_request", "pull_request_target") & raw.rlike(r"(?d)runs-on:.*self-hosted"), "WFL-011", "medium", _line("self-hosted")),
    )
    parse = one(~F.col("readable"), "WFL-PARSE", "medium", PENALTY["medium"], line=F.lit(1))
    return findings(mine, [parse, when(F.col("readable") & _is(doc, "OBJECT"), hits)], 0)
