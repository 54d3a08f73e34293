"""Scanning source trees into a table of files."""

from __future__ import annotations

import os
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.sources import patterns as P

IGNORE_FILES = (".gitignore", ".siltstoneignore")


def scan_project(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = (), project: str = "default") -> DataFrame:
    """(project, path, content, size, lines, language, extension) of the files below a local or shared folder.

    One read of each file feeds all that is derived from it. Patterns of the ignore files in the
    root come before exclude, so exclude has the last word.
    """
    local = root.removeprefix("file://")
    if "://" not in local and not os.path.isdir(local):
        raise NotADirectoryError(root)
    ignore = [p for f in IGNORE_FILES for p in P.read_ignore_file(os.path.join(local, f))]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # The source gives no row for an empty file; the list of files, which the driver has anyway, names it.
    listed = spark.createDataFrame([(unquote(x),) for x in raw.inputFiles()], "path string").select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"))
    empty = listed.join(raw.select("path"), "path", "left_anti").select("path", F.lit(b"").alias("content"))
    raw = raw.select("path", "content").unionByName(empty)
    base = root.rstrip("/").split("://")[-1].rstrip("/")
    path = F.expr(f"substring_index(path, '{base.replace(chr(39), chr(92) + chr(39))}/', -1)")
    return described(raw.select(F.lit(project).alias("project"), path.alias("path"), "content").where(P.selected(path, include, [*ignore, *exclude])))


def described(files: DataFrame) -> DataFrame:
    """Size, lines, language and extension of files (project, path, content)."""
    return files.select(
        "project",
        "path",
        "content",
        F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("size"),
        F.coalesce(T.line_count(T.decoded(F.col("content"))), F.lit(0).cast("long")).alias("lines"),
        T.language(F.col("path")).alias("language"),
        F.lower(T.suffix(F.col("path"))).alias("extension"),
    )


def totals(files: DataFrame, by: Sequence[str] = ("project",)) -> DataFrame:
    """(by, total_files, total_lines)."""
    return files.groupBy(*by).agg(F.count("*").alias("total_files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("total_lines"))


def language_counts(files: DataFrame, by: Sequence[str] = ("project",)) -> DataFrame:
    """(by, language, files): files without language aren't counted."""
    return files.where("language is not null").groupBy(*by, "language").agg(F.count("*").alias("files"))


def code_files(files: DataFrame) -> DataFrame:
    return files.where(T.is_code(F.col("language")))


def by_language(files: DataFrame, language: str) -> DataFrame:
    return files.where(F.col("language") == language)


def file_of(files: DataFrame, path: str) -> DataFrame:
    """The row of one path, or none."""
    return files.where(F.col("path") == path)


def snapshot_of(files: DataFrame, snapshot_id: str) -> DataFrame:
    """(project, snapshot_id, path, hash, size, lines)."""
    return files.select("project", F.lit(snapshot_id).alias("snapshot_id"), "path", T.sha256(F.col("content")).alias("hash"), "size", "lines")
