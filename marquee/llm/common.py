"""Reading tables, and writing intermediate tables to the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset, a folder below the warehouse, which is shared as well."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"


def stage(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write a table that later steps read more than once, and read it back.

    Each call writes to a folder of its own, so a retried or repeated run never meets old files.
    A lost executor costs no more than the tasks that read from it.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator works on, as doc_id and text (null text: empty). Others can't clash with its own."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: Stand-ins for null ids lie from here on, so they never are the smallest id beside a real one.
NO_ID = 1 << 62


def key_of(doc_id: Column, text: Column) -> Column:
    """The id as a number; a null one is replaced by a number from 2^62 on, made from the text."""
    return F.coalesce(doc_id.cast("long"), NO_ID + F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(NO_ID)))


def keyed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id as ``key_of`` gives it, text, and ``unnamed``: whether the id is null."""
    return documents(df, id_col, text_col).select(
        key_of(F.col("doc_id"), F.col("text")).alias("doc_id"), "text", F.col("doc_id").isNull().alias("unnamed"))


def numbered(df: DataFrame) -> DataFrame:
    """The table with its columns named c0, c1 and so on, so that no name of theirs can clash with one of an operator."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def with_fields(df: DataFrame, **types: str) -> StructType:
    """The table's schema and these columns."""
    return StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"{n} {t}" for n, t in types.items())).fields])


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
