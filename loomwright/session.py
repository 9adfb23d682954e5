"""A session with settings that suit these operators; a cluster's own settings win. What iterative operators keep."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "loomwright", **settings: str) -> SparkSession:
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(app).config(map=defaults | settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset and the master is
    local (tests), a folder under /tmp/checkpoints; on a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return base.rstrip("/")


def settled(df: DataFrame, tag: str = "step") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: later steps start from files, so a lost executor
    costs only its tasks, and know the files' sizes when they choose a join."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_settled(spark: SparkSession) -> None:
    """Remove what ``settled`` has written. DataFrames that read it can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/settled")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
