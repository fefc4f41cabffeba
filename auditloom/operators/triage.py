"""Triage by a model: units of work, verdicts aligned to findings, a panel's vote, a second look, and fixes.

A client is any picklable object with `triage`, `verify`, `remediate` (unit -> list of dicts) and `summarize`. Clients run on
executors inside mapInPandas, one unit at a time, at most `concurrency` tasks at once; a unit that fails leaves its findings
uncertain. `CannedClient` needs no network.
"""

from __future__ import annotations

import json
import re
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .findings import bare_key, finding_key, with_instances

MAX_PROMPT_CHARS = 60_000
CLASSES = ("real", "false-positive", "uncertain")


class Client(Protocol):
    def triage(self, unit: dict) -> list[dict]: ...
    def verify(self, unit: dict) -> list[dict]: ...
    def remediate(self, unit: dict) -> list[dict]: ...
    def summarize(self, digest: str) -> str: ...


class CannedClient:
    """Calls everything real with even confidence."""

    def triage(self, unit: dict) -> list[dict]:
        return [{"finding_key": f["key"], "classification": "real", "confidence": 0.5, "reasoning": "canned"} for f in unit["findings"]]

    verify = triage

    def remediate(self, unit: dict) -> list[dict]:
        return [{"finding_key": f["key"], "fix": "canned", "effort": "low"} for f in unit["findings"]]

    def summarize(self, digest: str) -> str:
        return f"{digest.count(chr(10)) + 1} lines"


def salvage_items(reply: str, field: str) -> list[dict]:
    """Objects under `field` of a model's reply, fenced or bare; what is no object goes, and a reply that is no JSON holds none."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", reply, re.S)
    try:
        doc = json.loads(fenced[1] if fenced else reply)
    except ValueError:
        return []
    items = doc.get(field) if isinstance(doc, dict) else doc
    return [x for x in items if isinstance(x, dict)] if isinstance(items, list) else []


def prompt(unit: dict) -> str:
    """What a client is asked: the file, cut to MAX_PROMPT_CHARS, and each finding with its flagged line."""
    content = unit.get("content") or ""
    cut = content if len(content) <= MAX_PROMPT_CHARS else content[:MAX_PROMPT_CHARS] + "\n[cut]"
    lines = content.split("\n")
    told = [f"- {f['key']} [{f['severity']}] {f['title']}" + (f"\n  > {lines[f['line'] - 1][:200]}" if f.get("line") and f["line"] <= len(lines) else "") for f in unit["findings"]]
    context = [unit["context"]] if unit.get("context") else []
    return "\n".join([*context, f"File: {unit['file'] or '(project)'}", cut, "Findings:", *told])


def project_context(reports: DataFrame) -> DataFrame:
    """project_id and context: name, score, and a line for each category, for the units of a project."""
    each = F.transform("categories", lambda c: F.concat_ws(": ", c["category"], F.concat(c["score"].cast("string"), F.lit("/10 - "), F.coalesce(c["summary"], F.lit("")))))
    return reports.select(F.col("projectName").alias("project_id"), F.concat_ws("\n", F.concat(F.lit("Project: "), "projectName"), F.concat(F.lit("Overall: "), F.col("overallScore").cast("string"), F.lit("/10")), F.array_join(each, "\n")).alias("context"))


def units(findings: DataFrame, files: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """One row a project and file, findings in report order; findings without a file form a unit of their own. context:
    project_id, context (a row a project)."""
    keyed = with_instances(findings).withColumn("key", finding_key())
    inner = F.struct("ord", "key", "id", "severity", "title", "line")
    grouped = keyed.groupBy("project_id", "file").agg(F.array_sort(F.collect_list(inner)).alias("findings"))  # a file's findings
    flagged = findings.where("file is not null").select("project_id", "file").distinct()
    text = files.select("project_id", F.col("path").alias("file"), "content").join(flagged, ["project_id", "file"], "left_semi")
    out = grouped.join(text, ["project_id", "file"], "left")
    return out.join(context, "project_id", "left") if context is not None else out.withColumn("context", F.lit(None).cast("string"))


def ask(units_: DataFrame, client: Client, what: str = "triage", concurrency: int = 5, voter: int = 0) -> DataFrame:
    """project_id, voter, finding_key, classification, confidence, reasoning as the client gave them, and failed units."""

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples():
                unit = {"file": row.file, "content": row.content or "", "context": getattr(row, "context", None), "findings": [dict(f) for f in row.findings]}
                try:
                    for seq, v in enumerate(getattr(client, what)(unit)):
                        rows.append((seq, row.project_id, voter, str(v.get("finding_key")), v.get("classification"), float(v.get("confidence") or 0), str(v.get("reasoning") or ""), v.get("fix"), v.get("effort"), False))
                except Exception as why:  # one unit's failure is no other's
                    rows.append((0, row.project_id, voter, None, None, 0.0, type(why).__name__, None, None, True))
            yield pd.DataFrame(rows, columns=["seq", "project_id", "voter", "finding_key", "classification", "confidence", "reasoning", "fix", "effort", "failed"])

    schema = "seq int, project_id string, voter int, finding_key string, classification string, confidence double, reasoning string, fix string, effort string, failed boolean"
    return units_.repartition(concurrency).mapInPandas(run, schema)


def align(keyed: DataFrame, verdicts: DataFrame, keys: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """A verdict for each finding key: the last given (by seq) counts, unknown keys go, missing ones are uncertain."""
    known = verdicts.where(F.col("classification").isin(*CLASSES)).groupBy(*keys, bare_key(F.col("finding_key")).alias("_key")).agg(F.max_by(F.struct("classification", "confidence", "reasoning"), "seq").alias("v"))
    rows = keyed.withColumn("_key", bare_key(F.col("finding_key"))).join(known, [*keys, "_key"], "left")
    return rows.select(*keyed.columns, F.coalesce("v.classification", F.lit("uncertain")).alias("classification"), F.coalesce("v.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("v.reasoning", F.lit("no verdict returned")).alias("reasoning"))


def panel_vote(votes: DataFrame, keys: tuple[str, ...] = ("project_id", "finding_key")) -> DataFrame:
    """votes: keys, voter, classification, confidence, reasoning. All must agree on a false positive, more than half on real.
    Confidence is the mean of the winning votes, the reasoning that of the surest of them (the first on ties); without a
    winning vote both say so. A single vote stands as it is."""
    c = F.col("classification")
    n, fp, real = F.count("*"), F.count_if(c == "false-positive"), F.count_if(c == "real")
    winner = F.when(F.col("n") == 1, F.col("only")).when(F.col("fp") == F.col("n"), "false-positive").when(F.col("real") * 2 > F.col("n"), "real").otherwise("uncertain")
    sums = [F.avg(F.when(c == k, F.col("confidence"))).alias(f"mean_{i}") for i, k in enumerate(CLASSES)]
    says = [F.max_by(F.when(c == k, F.col("reasoning")), F.when(c == k, F.struct("confidence", (-F.col("voter")).alias("v")))).alias(f"says_{i}") for i, k in enumerate(CLASSES)]
    rows = votes.groupBy(*keys).agg(n.alias("n"), fp.alias("fp"), real.alias("real"), F.first("classification").alias("only"), *sums, *says).withColumn("classification", winner)
    pick = lambda p: F.coalesce(*(F.when(F.col("classification") == k, F.col(f"{p}_{i}")) for i, k in enumerate(CLASSES)))
    tally = F.format_string(" [panel: %d real, %d fp, %d uncertain]", "real", "fp", F.col("n") - F.col("real") - F.col("fp"))
    reason = F.when(F.col("n") == 1, pick("says")).otherwise(F.concat(F.coalesce(pick("says"), F.lit("the panel did not agree")), tally))
    return rows.select(*keys, "classification", F.coalesce(pick("mean"), F.lit(0.0)).alias("confidence"), reason.alias("reasoning"))


def tally(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("project_id").agg(*(F.count_if(F.col("classification") == k).alias(k.replace("-", "_")) for k in CLASSES))


def run_triage(findings: DataFrame, files: DataFrame, client: Client, verifiers: list[Client] | None = None, verify: bool = True, concurrency: int = 5, context: DataFrame | None = None) -> DataFrame:
    """project_id, finding_key, classification, confidence, reasoning. False positives of the first pass are looked at
    again by every verifier, and the panel's vote replaces them. Raises where every unit failed."""
    work = units(findings, files, context).persist()
    keyed = work.select("project_id", F.explode("findings").alias("f")).select("project_id", F.col("f.key").alias("finding_key"))
    first = ask(work, client, concurrency=concurrency).persist()
    n, failed = first.select("project_id", "failed").agg(F.count("*"), F.count_if("failed")).first()
    if n and failed == n:
        raise RuntimeError("triage failed for every unit")
    verdicts = align(keyed, first)
    if not verify:
        return verdicts
    doubted = verdicts.where("classification = 'false-positive'").select("project_id", "finding_key")
    again = work.withColumn("f", F.explode("findings")).withColumn("finding_key", F.col("f.key")).join(doubted, ["project_id", "finding_key"], "left_semi")
    again = again.groupBy("project_id", "file", "content", "context").agg(F.array_sort(F.collect_list("f")).alias("findings"))
    votes = None
    for k, voter in enumerate(verifiers or [client]):
        asked = ask(again, voter, "verify", concurrency, k)
        # a voter that failed for a unit abstains; one that left out a finding is uncertain about it
        silent = asked.where("failed").select("project_id").distinct()
        own = align(doubted, asked).withColumn("voter", F.lit(k)).join(silent, "project_id", "left_anti")
        votes = own if votes is None else votes.unionByName(own)
    panel = panel_vote(votes)
    kept = verdicts.join(doubted, ["project_id", "finding_key"], "left_anti")
    unheard = doubted.join(panel, ["project_id", "finding_key"], "left_anti").select("project_id", "finding_key", F.lit("uncertain").alias("classification"), F.lit(0.0).alias("confidence"), F.lit("(unverified)").alias("reasoning"))
    return kept.unionByName(panel).unionByName(unheard)


def remediations(findings: DataFrame, files: DataFrame, verdicts: DataFrame, client: Client, concurrency: int = 5) -> DataFrame:
    """One fix for each finding called real; the first given counts, unknown keys go."""
    real = verdicts.where("classification = 'real'").select("project_id", F.col("finding_key").alias("key"))
    keyed = with_instances(findings).withColumn("key", finding_key()).join(real, ["project_id", "key"], "left_semi").drop("key", "instance")
    got = ask(units(keyed, files), client, "remediate", concurrency).where("fix is not null")
    rank = F.row_number().over(W.partitionBy("project_id", "finding_key").orderBy("seq"))
    return got.withColumn("rn", rank).where("rn = 1").join(real.withColumnRenamed("key", "finding_key"), ["project_id", "finding_key"], "left_semi").select("project_id", "finding_key", "fix", "effort")


def digest(overall: float, scores: list[tuple[str, float]], findings: list[tuple[str, str, str]], limit: int = 40) -> str:
    """Text from which a summary is asked: findings are (severity, id, title), confirmed false positives left out."""
    lines = [f"overall {overall}/10", *(f"{c}: {s}/10" for c, s in scores), *(f"[{s}] {i} {t}" for s, i, t in findings[:limit])]
    return "\n".join(lines + ([f"... and {len(findings) - limit} more"] if len(findings) > limit else []))


