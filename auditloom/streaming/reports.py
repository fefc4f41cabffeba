"""A stream of saved reports, fed to the batch functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SEVERITIES
from ..sources.reports import load_reports, report_findings


def severity_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Findings by project and severity over all reports that arrive in a folder."""
    rows = report_findings(load_reports(spark, folder, stream=True))
    return rows.groupBy("project_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
