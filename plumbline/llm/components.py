"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graphs


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(u, v) that is linked with another one; component is the smallest node reachable."""
    return graphs.components(links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v"))
