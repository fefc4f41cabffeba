"""Tables in the folder that driver and executors share, for jobs in rounds: each round starts from files that outlive executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a session in one process (as in tests) sets one; on a cluster that is an error, as no
    other folder is known to be shared."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if there is None:
        if not sc._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="auditloom-"))
        there = sc.getCheckpointDir()
    return there.rstrip("/")


class Rounds:
    """Written tables of one job. What is left of them goes with `drop`, or when Python ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self._n = spark, f"{shared_dir(spark)}/rounds-{name}-{uuid.uuid4().hex}", 0
        atexit.register(self.drop)

    def write(self, df: DataFrame, counts: dict[str, object] | None = None) -> tuple[DataFrame, dict]:
        """df from its files, and the given aggregates over it, observed while it was written."""
        self._n += 1
        to = f"{self.path}/{self._n:03d}"
        seen = Observation()
        df.observe(seen, *(c.alias(k) for k, c in ({"rows": F.count(F.lit(1))} | (counts or {})).items())).write.parquet(to)
        return self.spark.read.schema(df.schema).parquet(to), seen.get

    def drop(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before Python does
            sc = self.spark.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
