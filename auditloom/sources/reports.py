"""Saved reports and configuration files."""

from __future__ import annotations

import datetime
import json
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CATEGORIES, SEVERITIES

FINDING = "id string, category string, severity string, title string, file string, line int, instance int, note string, suggestion string, fingerprint string"
REPORT = (
    f"projectName string, projectPath string, completedAt string, version string, overallScore double, categories array<struct<category:string,score:double,summary:string>>, findings array<struct<{FINDING.replace(' ', ':').replace(',:', ',')}>>, "
    "verdicts array<struct<findingKey:string,classification:string,confidence:double,reasoning:string>>, remediations array<struct<findingKey:string,fix:string,effort:string>>, aiSummary string, "
    "suppressed array<struct<id:string,file:string,line:int,reason:string>>, warnings array<string>, omitted array<struct<id:string,n:long>>"
)
CONFIG_NAMES = ("audit.config.json", ".auditrc.json")


def plain_name(name: Column) -> Column:
    """Spark gives names of files as they stand in an address, a plus sign as it is."""
    return F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def load_reports(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Reports saved as .json in a folder itself, those that are no reports left out, by name and then latest first."""
    reader = (spark.readStream if stream else spark.read).schema(REPORT).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json")
    rows = reader.json(folder).where("projectName is not null and overallScore is not null and categories is not null and findings is not null").withColumn("file_name", plain_name(F.col("_metadata.file_name")))
    return rows if stream else rows.orderBy("projectName", F.desc("completedAt"))


def report_findings(reports: DataFrame) -> DataFrame:
    return reports.select(F.col("projectName").alias("project_id"), F.posexplode("findings").alias("ord", "f")).select("project_id", "ord", "f.*")


@dataclass(frozen=True)
class Config:
    """What a configuration file may say; None where it says nothing."""

    min_score: float | None = None
    categories: tuple[str, ...] | None = None
    fail_on: str | None = None
    max_critical: int | None = None
    max_high: int | None = None
    baseline: str | None = None
    verbose: bool | None = None
    output: dict = field(default_factory=dict)
    ai: dict = field(default_factory=dict)
    suppressions: tuple[dict, ...] = ()


_KEYS = {"minScore": "min_score", "categories": "categories", "failOn": "fail_on", "maxCritical": "max_critical", "maxHigh": "max_high", "baseline": "baseline", "verbose": "verbose", "output": "output", "ai": "ai", "suppressions": "suppressions"}
_OUTPUT = {"format": ("cli", "json", "html"), "file": None, "junit": None, "sarif": None}
_AI = {"enabled": bool, "provider": str, "model": str, "verify": bool, "remediate": bool, "summary": bool, "concurrency": int, "vote": list}


def parse_config(text: str, name: str = "config") -> Config:
    """Strict: an unknown key or a value out of range raises ValueError that names it."""

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(f"{name}: {what}")

    try:
        doc = json.loads(text)
    except ValueError as why:
        raise ValueError(f"{name}: not valid JSON ({why})") from None
    need(isinstance(doc, dict), "must be an object")
    for k in doc:
        need(k in _KEYS, f"unknown key {k}")
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= 0
    word = lambda v: isinstance(v, str) and v != ""
    if "minScore" in doc:
        need(number(doc["minScore"]) and 0 <= doc["minScore"] <= 10, "minScore must be 0 to 10")
    if "categories" in doc:
        need(isinstance(doc["categories"], list) and doc["categories"] and all(c in CATEGORIES for c in doc["categories"]), "categories must name some of " + ", ".join(CATEGORIES))
    if "failOn" in doc:
        need(doc["failOn"] in SEVERITIES, "failOn must be a severity")
    for k in ("maxCritical", "maxHigh"):
        need(k not in doc or whole(doc[k]), f"{k} must be a whole number")
    need("baseline" not in doc or word(doc["baseline"]), "baseline must be text")
    need("verbose" not in doc or isinstance(doc["verbose"], bool), "verbose must be true or false")
    for k, v in doc.get("output", {}).items() if isinstance(doc.get("output", {}), dict) else [("", None)]:
        need(k in _OUTPUT, f"unknown key output.{k}")
        need(v in _OUTPUT[k] if _OUTPUT[k] else word(v), f"output.{k} is not valid")
    for k, v in doc.get("ai", {}).items() if isinstance(doc.get("ai", {}), dict) else [("", None)]:
        need(k in _AI, f"unknown key ai.{k}")
        need(isinstance(v, _AI[k]) and (k != "concurrency" or v >= 1), f"ai.{k} is not valid")
    for s in doc.get("suppressions", []):
        need(isinstance(s, dict) and set(s) <= {"rule", "file", "reason", "expires"}, "a suppression has rule, file, reason and expires")
        need(word(s.get("rule")), "a suppression needs a rule")
        need(word(s.get("reason")), "a suppression needs a reason")
        need("file" not in s or word(s["file"]), "a suppression's file must be text")
        if "expires" in s:
            need(isinstance(s["expires"], str) and bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", s["expires"])), "expires must be YYYY-MM-DD")
            try:
                datetime.date.fromisoformat(s["expires"])
            except ValueError:
                raise ValueError(f"{name}: expires is no date") from None
    lists = {k: tuple(doc[k]) for k in ("categories", "suppressions") if k in doc}
    return Config(**{_KEYS[k]: v for k, v in (doc | lists).items()})


def load_config(folder: str, explicit: str | None = None) -> Config | None:
    """The file named, or the first of CONFIG_NAMES in the folder; None without one."""
    if explicit and not os.path.isfile(explicit):
        raise FileNotFoundError(explicit)
    for path in [explicit] if explicit else [os.path.join(folder, n) for n in CONFIG_NAMES]:
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                return parse_config(f.read(), os.path.basename(path))
    return None


def effective(given: dict, config: Config | None) -> dict:
    """What the caller gave, else what the file says, else the default."""
    defaults = {"min_score": 0.0, "categories": CATEGORIES, "fail_on": None, "max_critical": None, "max_high": None, "baseline": None, "verbose": False, "suppressions": ()}
    return {k: given[k] if given.get(k) is not None else getattr(config, k) if config and getattr(config, k) not in (None, ()) else d for k, d in defaults.items()}
