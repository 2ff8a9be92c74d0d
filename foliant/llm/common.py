"""What the operators of this package share: table access, the shared folder, digests."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: str | None = None


#: Rows of an Arrow batch; documents are long, so Spark's default of 10,000 would hold tens of MB in each worker.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """BATCH_ROWS from now on, where the session still has Spark's default."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only a local master, whose executor is the driver, may leave it unset; a temporary folder takes its place there.
    """
    global _OWN_DIR
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _OWN_DIR is None:
        _OWN_DIR = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _OWN_DIR


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Spark's own setting: a query's shuffle files go when the query ends, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str, codec: str = "zstd", path: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends here, and a lost
    executor costs only what it had not yet written."""
    spark, path = df.sparkSession, path or fresh_path(df.sparkSession, what)
    small_batches(spark)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one call, which go together, or one by one, when nothing reads them any more."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.folder, self.paths = spark, fresh_path(spark, what), []

    def written(self, df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}-{what}"
        self.paths.append(path)
        return written(df, what, codec, path)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

    def drop(self, what: str) -> None:
        """Deletes the tables of that name."""
        for path in [p for p in self.paths if p.endswith(f"-{what}")]:
            self._delete(path)

    def clear(self) -> None:
        self._delete(self.folder)


def whole_text(col: str = "text"):
    """A null text counts as the empty one."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def _weights(col: pa.Array) -> np.ndarray:
    if pa.types.is_integer(col.type):
        sizes = col  # it says how large what the row stands for is
    elif pa.types.is_list(col.type):
        sizes = pc.multiply(pc.list_value_length(col), 4)
    else:
        sizes = pc.binary_length(col)
    return pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def by_size(batch: pa.RecordBatch, col: str, most: int = 2 << 20):
    """The batch in slices of about `most` bytes of one column, a row at least, so that Python objects of only these are alive at once."""
    ends = np.cumsum(_weights(batch.column(col)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)))
        yield batch.slice(at, end - at)
        at = end


def slices(batches, col: str, most: int = 2 << 20):
    """All batches by size."""
    for batch in batches:
        yield from by_size(batch, col, most)
