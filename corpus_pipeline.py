"""Pipeline over `documents`: quality rules, near-duplicates, repeated passages, benchmark copies, packing.

Each stage takes all that the one before kept, is written as Parquet and read again; all but the last return the columns
of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm import decontam, neardup, packing, quality, suffix
from auditloom.llm.common import WorkDir, table

STAGES = [
    ("quality_rules", quality.keep_good),
    ("minhash_neardup", neardup.keep_one),
    ("suffix_dedup", suffix.cut_repeats),
    ("decontamination", decontam.drop_leaks),
    ("packing", packing.pack_documents),
]

#: Learned rules, signatures and tokenizers are no SQL; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work tables of a stage go as soon as its result is written; the last stage's stay, as its result is read from them."""
    work = WorkDir(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        with WorkDir.opened() as opened:
            before, docs = docs, work.cut(stage(spark, docs, sf_dir), name)
        for folder in opened:
            folder.drop()
        if name != STAGES[0][0]:
            work.free(before)
    return STAGES[-1][1](spark, docs, sf_dir)
