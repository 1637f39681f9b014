"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict = {}
#: Spark removes an execution's shuffle files when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, as in tests, one folder of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    return _OWN["dir"]


def written(df: DataFrame, name: str) -> DataFrame:
    """df by way of a Parquet table: cuts the lineage, survives lost executors, frees the shuffles behind it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing will read again."""
    jvm, conf, own = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), shared_dir(spark)
    for one in tables:
        for folder in {f.rpartition("/")[0] for f in one.inputFiles()}:
            if folder.startswith((own, own.replace("file://", "file:"))):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
