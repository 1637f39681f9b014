"""Workspace files by glob, whole texts, clone reports, diagnostics, vector caches and the report sink."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_regex

#: What is scanned, and never scanned, by default.
INCLUDE = ("**/*.{ts,tsx,mts,cts,py}",)
EXCLUDE = ("**/node_modules/**", "**/dist/**")
CONFIG = r"(?:^|/)plumbline\.config\.[a-z]+$"


def any_glob(path, globs):
    """Column: whether a path fits one of the globs."""
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_regex(g))
    return hit


def chosen(files: DataFrame, include=INCLUDE, exclude=()) -> DataFrame:
    """files(path, ...) that a glob includes and none excludes, once each; the default exclusions always count, config files never do."""
    path = F.col("path")
    return files.where(any_glob(path, include) & ~any_glob(path, (*EXCLUDE, *exclude)) & ~path.rlike(CONFIG)).dropDuplicates(["path"])


def workspace(spark: SparkSession, root: str, include=INCLUDE, exclude=()) -> DataFrame:
    """path (relative, with slashes) and text of the files under root.

    Files are listed first, without their contents; only those chosen are then read. Their paths pass the driver, as
    every listing of files does.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("full"))
    here = root.rstrip("/").removeprefix("file:").replace("//", "/")
    relative = lambda path: F.regexp_replace(F.regexp_replace(path, r"^file:/*", "/"), f"^{re.escape(here)}/", "")
    paths = [r["full"] for r in chosen(listed.withColumn("path", relative("full")), include, exclude).collect()]
    if not paths:
        return spark.createDataFrame([], "path string, text string")
    found = spark.read.format("binaryFile").load([_literal(p) for p in paths])
    return found.select(relative("path").alias("path"), F.decode("content", "UTF-8").alias("text"))


def _literal(path: str) -> str:
    """A path whose special characters of globs stand for themselves."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and whole text of a fixed list of files; missing ones are skipped."""
    return spark.read.option("ignoreMissingFiles", True).text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


MEMBER = "struct<file:string,name:string,start_line:int,end_line:int,similarity:double,representative:boolean,test:boolean>"
REPORT = f"schema_version int, clusters array<struct<id:string,similarity:double,test_only:boolean,trait_impl_only:boolean,members:array<{MEMBER}>>>"


def clone_members(reports: DataFrame, files: DataFrame) -> DataFrame:
    """cluster_id, similarity and member columns of clone reports(json): malformed JSON and unknown versions fail the query.

    Clusters of tests or traits alone go, members that are tests or not in files(path) go, two must be left, and
    where no representative is, the first by file and line is made one.
    """
    parsed = reports.select(F.from_json("json", REPORT, {"mode": "FAILFAST"}).alias("r"))
    known = F.when(F.col("r.schema_version").isin(1, 2), F.col("r.clusters")).otherwise(F.raise_error(F.lit("unknown clone report version")).cast(parsed.schema["r"].dataType["clusters"].dataType))
    one = parsed.select(F.explode(known).alias("c")).where("NOT coalesce(c.test_only, false) AND NOT coalesce(c.trait_impl_only, false)")
    members = one.select(F.col("c.id").alias("cluster_id"), F.col("c.similarity").alias("similarity"), F.explode("c.members").alias("m"))
    flat = members.select("cluster_id", "similarity", "m.file", "m.name", "m.start_line", "m.end_line", "m.representative").where("NOT coalesce(m.test, false)")
    flat = flat.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_semi")
    place = F.struct("file", "start_line")
    groups = flat.groupBy("cluster_id").agg(F.count("*").alias("members"), F.bool_or("representative").alias("has"), F.min(place).alias("first")).where("members > 1")
    elected = F.when(F.coalesce("has", F.lit(False)), F.coalesce("representative", F.lit(False))).otherwise(place == F.col("first"))
    return flat.join(groups, "cluster_id").withColumn("representative", elected).drop("has", "first")


def diagnostics(lines: DataFrame) -> DataFrame:
    """rule, file, line, col, message of linter diagnostics, one JSON object a row of lines(json); rows that are not JSON go."""
    shape = "code string, filename string, message string, location struct<row:int,column:int>"
    return lines.select(F.from_json("json", shape).alias("d")).where("d.code IS NOT NULL").select(F.col("d.code").alias("rule"), F.col("d.filename").alias("file"), F.col("d.location.row").alias("line"), F.col("d.location.column").alias("col"), F.coalesce("d.message", F.lit("")).alias("message"))


def read_vectors(spark: SparkSession, path: str, model: str, revision: str) -> DataFrame:
    """hash and vector of the cache's partition for a model's revision; empty where there is none."""
    try:
        return spark.read.parquet(path).where((F.col("model") == model) & (F.col("revision") == revision)).select("hash", "vector")
    except Exception as e:  # the table does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "hash string, vector array<float>")


def write_vectors(vectors: DataFrame, path: str, model: str, revision: str) -> None:
    vectors.select("hash", "vector", F.lit(model).alias("model"), F.lit(revision).alias("revision")).write.mode("append").partitionBy("model", "revision").parquet(path)


def report_lines(rows: DataFrame) -> DataFrame:
    """Violations as text, two lines each, in the order of rows."""
    return rows.select(F.format_string("%s:%d:%d  %s  %s  %s\n    %s", "file", "start_line", "start_col", "severity", "rule_id", "message", "suggestion").alias("value"))
