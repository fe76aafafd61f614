"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "flowdrift", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``. A temporary
    folder is made only for a local master, where every task runs on this machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="flowdrift-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def materialize(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` once as a table below the checkpoint folder and read it from there.

    Used where two branches of a plan must see exactly the same rows (sampled
    range partitions, generated ids) or where an expensive input is read again.
    Being columnar, the table lets each reader load only the columns it needs.
    It survives lost executors; the folder is cleared by whoever owns it. ``by`` names
    a column of few values whose rows lie apart, so that a filter on it reads no others.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)
