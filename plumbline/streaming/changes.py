"""Changed files as they arrive: each micro-batch widens to its closure and is checked.

An extension: the checks themselves have no notion of a stream. State is what the tables hold; a batch that
runs again writes the same rows under the same batch id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import closure

FILES = "path string, text string"


def changed(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of FILES written to folder as Parquet."""
    return spark.readStream.schema(FILES).parquet(folder)


def scope(batch: DataFrame, workspace: DataFrame, edges: DataFrame) -> DataFrame:
    """The files of workspace(path, text), the batch's versions first, that a batch can affect by edges(u, v), taken both ways."""
    seeds = batch.select(F.col("path").alias("node")).distinct()
    reached = closure(edges, seeds).select(F.col("node").alias("path"))
    old = workspace.join(seeds.withColumnRenamed("node", "path"), "path", "left_anti").join(reached, "path", "left_semi")
    return batch.select("path", "text").dropDuplicates(["path"]).unionByName(old.select("path", "text"))


def check_stream(stream: DataFrame, workspace: DataFrame, edges: DataFrame, check: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Starts a query that writes check(files in scope) of every batch to out, in a folder of the batch's id."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.limit(1).count():
            check(scope(batch, workspace, edges)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
