"""A table of the newest rows, used to retrain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from flowdrift.functions.columns import binary_label
from flowdrift.operators.clean import reindex_columns
from flowdrift.operators.ordering import last_n


def log_schema(columns: list[str], label: str = "BinLabel") -> T.StructType:
    return T.StructType(
        [T.StructField(c, T.IntegerType() if c == label else T.DoubleType(), True) for c in columns]
    )


def seed_rows(
    training: DataFrame, max_rows: int, order: str, columns: list[str], label: str = "Label", name: str = "BinLabel"
) -> DataFrame:
    """The newest ``max_rows`` labelled training rows in the columns of the log, with ``seq`` = order."""
    newest = last_n(training, max_rows, [order])
    if name not in newest.columns:
        newest = newest.withColumn(name, binary_label(F.col(label)))
    schema = log_schema(columns, name)
    return reindex_columns(newest.withColumn("seq", F.col(order)), T.StructType([*schema.fields, T.StructField("seq", T.LongType())]))


def check_width(df: DataFrame, columns: list[str]) -> None:
    """Reject rows of another shape than the log."""
    if set(df.columns) != set(columns):
        raise ValueError(f"row width {len(df.columns)} does not fit the log ({len(columns)} columns)")


class RollingLog:
    """Append-only parquet parts, one folder per batch id; reading keeps the newest ``max_rows`` rows.

    Newer is what arrived with a later batch, then what has a larger ``seq`` in its
    batch. Writing a batch twice overwrites its own folder, so a repeated
    micro-batch leaves the log unchanged. ``prune`` deletes parts that hold none of
    the newest rows, which bounds the log.
    """

    def __init__(self, path: str, max_rows: int = 10_000, columns: list[str] | None = None) -> None:
        if max_rows <= 0:
            raise ValueError("max_rows must be positive")
        self.path, self.max_rows, self.columns = path, max_rows, columns

    def append(self, df: DataFrame, batch_id: int) -> None:
        """Append rows that carry a ``seq`` column (larger is newer inside the batch).

        Of a batch larger than the log only the newest ``max_rows`` rows are written.
        """
        if self.columns is not None:
            check_width(df, self.columns)
        last_n(df, self.max_rows, ["seq"]).write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def _newest(self, spark: SparkSession) -> DataFrame | None:
        try:
            rows = spark.read.parquet(self.path)
        except AnalysisException:
            return None
        return last_n(rows, self.max_rows, ["batch_id", "seq"])

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The newest rows, or None before the first append."""
        rows = self._newest(spark)
        return None if rows is None else rows.drop("batch_id")

    def count(self, spark: SparkSession) -> int:
        rows = self.read(spark)
        return 0 if rows is None else rows.count()

    def prune(self, spark: SparkSession) -> list[int]:
        """Delete the parts older than the newest ``max_rows`` rows; returns their batch ids.

        Nothing is rewritten, so a run that is cut short leaves a readable log.
        """
        sizes = spark.read.parquet(self.path).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
        held, gone = 0, []
        for row in sizes.orderBy(F.desc("batch_id")).collect():  # one row for each part that is left
            if held >= self.max_rows:
                gone.append(row["batch_id"])
            held += row["n"]
        for batch in gone:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch_id={batch}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        return gone

    def compact(self, spark: SparkSession, target: str) -> RollingLog:
        """Write the newest rows to a new log at ``target`` and return that log.

        Rows keep the id of the batch they came with, so later batches are appended
        behind them and none is overwritten by a batch of another id.
        """
        rows = self._newest(spark)
        if rows is not None:
            rows.write.partitionBy("batch_id").parquet(target)
        return RollingLog(target, self.max_rows, self.columns)
