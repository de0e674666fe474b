"""Tables written between the steps of a job, where driver and executors both reach them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset, a folder below the warehouse, which is shared as well."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"


def stage_folder(spark: SparkSession) -> str:
    """A new folder for the tables of one run. The job leaves them there; who called it removes the folder when its results are stored."""
    return f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write a table that several later steps read, and read it back; without a folder, in a new one of its own.

    The HTML is then parsed once, later plans begin at the written table, and a lost executor costs no more than the tasks that read it.
    """
    path = f"{(folder or stage_folder(df.sparkSession)).rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
