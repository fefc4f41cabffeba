"""Tables, work folders and Arrow batches shared by the operators of this folder."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a numpy kernel works on at a time; a longer text is a slice of its own.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session in one process (as in
    tests) gets a folder of its own; on a cluster that is an error, as no other folder is known to be shared."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if there is None:
        if not sc._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="auditloom-"))
        there = sc.getCheckpointDir()
    return there.rstrip("/")


class WorkDir:
    """A folder of its own below the shared one, for tables that cut lineage. `free` drops tables that nothing reads any more,
    `drop` the folder; what is left goes when Python ends."""

    _seen: contextvars.ContextVar[list[WorkDir] | None] = contextvars.ContextVar("work_dirs", default=None)

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/work-{name}-{uuid.uuid4().hex}"
        self._n = 0
        if (seen := WorkDir._seen.get()) is not None:
            seen.append(self)
        atexit.register(self.drop)

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write and reread: later plans start from files in the shared folder, which outlive executors."""
        self._n += 1
        to = f"{self.path}/{self._n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(to)
        out = self.spark.read.schema(df.schema).parquet(to)
        out._work_table = to
        return out

    def _delete(self, at: str) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def free(self, *tables: DataFrame) -> None:
        for df in tables:
            self._delete(df._work_table)

    def drop(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before Python does
            self._delete(self.path)

    @classmethod
    @contextlib.contextmanager
    def opened(cls) -> Iterator[list[WorkDir]]:
        """The folders that this thread opens inside: for a caller that drops them once it has written what it made of them."""
        token = cls._seen.set([])
        try:
            yield cls._seen.get()
        finally:
            cls._seen.reset(token)


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def row_struct(df: DataFrame, *without: str) -> Column:
    """All columns of a table but some, as one: its fields cannot clash with columns that an operator adds."""
    return F.struct(*(F.col(quoted(c)) for c in df.columns if c not in without))


def text_id() -> Column:
    """128 bits of the SHA-256 of `text`, null counting as empty: names a text whatever its row's doc_id."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256), 1, 32))


def named_texts(docs: DataFrame) -> DataFrame:
    """tid and text of each row."""
    return docs.select(text_id().alias("tid"), F.col("text").alias("text"))


class Seen:
    """Which rows of a task hold a text for the first time in it, or for the first `times` times."""

    def __init__(self, times: int = 1):
        self.times, self.count = times, Counter()

    def __call__(self, tids: pa.Array) -> pa.Array:
        fresh = np.zeros(len(tids), bool)
        for i, t in enumerate(tids.to_pylist()):
            if self.count[t] < self.times:
                self.count[t] += 1
                fresh[i] = True
        return pa.array(fresh)


def first_copies(rows: DataFrame) -> DataFrame:
    """rows with a tid: each task lets a text through once, however many copies it reads."""

    def run(batches):
        seen = Seen()
        for batch in batches:
            yield batch.filter(seen(column(batch, "tid")))

    return rows.mapInArrow(run, rows.schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the n + 1 offsets; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about `limit` bytes."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
