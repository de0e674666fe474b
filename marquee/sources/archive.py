"""Report archive: writing issues, listing and reading them back.

An archive is two folders. ``data`` holds a folder for each write (``version=...``), with one folder per issue
(``file_name=briefing_001_2026-04-13.md``) whose part files, read in name order, are the document; a large issue may therefore
span several tasks and files. ``manifest`` is an append-only table with one row per part file. A write appends its rows in
one file as its last step, and the newest version that the manifest names is the issue: a reader sees the old or the new one, a write that fails
is never seen, and old versions stay readable to those who began with them. Folders of plain ``*.md`` files can be read as well.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import fixed_values as fv
from marquee.functions.archive_text import issue_of_name

FILES, ISSUES = "files", "issues"
MANIFEST = "file_name string, version string, path string, length long, mtime timestamp"


def write_issues(parts: DataFrame, path: str) -> None:
    """Write document parts (file_name, part_key, text) as one folder per issue, and then name them in the manifest.

    Issues written again replace their old version for readers; all others stay. Versions are ordered by the time of the write.
    The name is made non-nullable so that Spark keeps this sort for the partitioned write and
    adds none of its own, which would not keep the order of the parts.
    """
    spark, root = parts.sparkSession, path.rstrip("/")
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"
    folder = f"{root}/data/version={version}"
    named = parts.withColumn("file_name", F.coalesce("file_name", F.lit("unnamed")))
    (named.repartitionByRange("file_name", "part_key")
     .sortWithinPartitions("file_name", "part_key")
     .select("file_name", "text")
     .write.partitionBy("file_name").text(folder))
    written = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    (written.select(F.url_decode(F.regexp_extract("path", "/file_name=([^/]*)/", 1)).alias("file_name"), F.lit(version).alias("version"), "path", "length",
                    F.col("modificationTime").alias("mtime"))
     .coalesce(1).write.mode("append").parquet(f"{root}/manifest"))


def current_files(spark: SparkSession, path: str, layout: str = ISSUES) -> DataFrame:
    """Files of the newest version of every report (file_name, path, length, mtime); no content is read."""
    if layout == FILES:
        listed = spark.read.format("binaryFile").option("pathGlobFilter", fv.ARCHIVE_GLOB).load(path)
        return listed.select(F.regexp_extract("path", r"[^/]+\z", 0).alias("file_name"), "path", "length", F.col("modificationTime").alias("mtime"))
    manifest = spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifest")
    # the files of a version are gathered on every task first: an issue of very many versions moves one row per task
    newest = manifest.groupBy("file_name").agg(F.max("version").alias("version"))
    return manifest.join(newest, ["file_name", "version"]).select("file_name", "path", "length", "mtime")


def scan_archive(spark: SparkSession, path: str, layout: str = ISSUES) -> DataFrame:
    """Catalogue of archived reports, newest first: the manifest alone is read, or the metadata of plain files."""
    files = current_files(spark, path, layout)
    if layout == ISSUES:
        # keep what the glob would: names the archive does not own are not listed
        files = files.filter(F.col("file_name").rlike(r"\A(?:briefing_.*|step.*_.*)\.md\z")).withColumn("path", F.regexp_replace("path", r"/[^/]+\z", ""))
    return (files.groupBy("file_name", "path")
            .agg(F.sum("length").alias("bytes"), F.max("mtime").alias("mtime"))
            .select("file_name", "path",
                    F.round(F.col("bytes") / 1024, 1).alias("size_kb"),
                    F.date_format("mtime", "yyyy-MM-dd HH:mm").alias("modified"), "mtime")
            .orderBy(F.desc("mtime"), "file_name"))


def read_archive(spark: SparkSession, path: str, wanted: DataFrame | list[str], layout: str = ISSUES) -> DataFrame:
    """Whole text of each wanted file_name; '' when there is no such report.

    The wanted names, a list or a table, are joined with the manifest first, and only the files that this
    gives are opened. Their paths (not their content) pass through the driver, as those of any scan do.
    """
    if not isinstance(wanted, DataFrame):
        wanted = spark.createDataFrame([(n,) for n in wanted], "file_name string")
    files = current_files(spark, path, layout).join(wanted.select("file_name").distinct(), "file_name", "left_semi")
    paths = [f"{r.path}" for r in files.select("path").toLocalIterator()]
    if not paths:
        return wanted.withColumn("text", F.lit(""))
    pieces = spark.read.text(paths, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    name = F.regexp_extract("path", r"[^/]+\z", 0) if layout == FILES else F.regexp_extract("path", "/file_name=([^/]*)/", 1)
    texts = (pieces.withColumn("file_name", F.url_decode(name)).groupBy("file_name")
             .agg(F.array_sort(F.collect_list(F.struct("path", "value"))).alias("p"))
             .select("file_name", F.array_join("p.value", "").alias("text")))
    return wanted.join(texts, "file_name", "left").withColumn("text", F.coalesce("text", F.lit("")))


def next_issue(names: DataFrame) -> DataFrame:
    """One row: the highest issue number among the reports' file_name, plus one; 1 for an empty archive."""
    return names.filter(F.col("file_name").rlike(r"(?s)\Abriefing_.*\.md\z")).agg((F.coalesce(F.max(issue_of_name(F.col("file_name"))), F.lit(0)) + 1).alias("next_issue"))
