"""Components and reachability over undirected edges of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, written


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours. Pre-aggregated before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links(u, v): component is the smallest node reachable.

    Alternating large and small stars, until every edge points from a node to the root of its star. A round is one
    written table, and the one before is deleted. The smallest neighbour of a hub is aggregated before it is shuffled;
    the join that hands it to the hub's edges is one that AQE splits where it is skewed. A node that is linked with
    itself only is a component; nulls are left out.
    """
    spark, old = links.sparkSession, None
    sound = links.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL")
    edges = first = written(sound, "edges")
    edges = edges.where("u <> v")
    while True:
        new = written(_small_star(_large_star(edges)), "stars")
        # A forest of stars: no node has two parents, and no parent one of its own.
        ends = new.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(new.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        again = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1").limit(1).count()
        if old is not None:
            dropped(spark, old)
        if not again:
            break
        edges = old = new
    stars = new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("component")))
    alone = first.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component")).join(stars, "node", "left_anti")
    return stars.unionByName(alone).distinct()


def closure(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node): everything that links(u, v), taken both ways, reach from seeds(node), the seeds included."""
    label = components(links)
    hit = label.join(seeds, "node", "left_semi").select("component").distinct()
    return label.join(hit, "component", "left_semi").select("node").unionByName(seeds.select("node")).distinct()


def resolved_imports(imports: DataFrame, files: DataFrame, extensions: tuple[str, ...] = ("ts", "tsx", "mts", "cts")) -> DataFrame:
    """(u, v) file to file for imports(file, target): the target itself, then with each extension, then its index file."""
    ranked = [F.col("target")] + [x for e in extensions for x in (F.concat("target", F.lit(f".{e}")), F.concat("target", F.lit(f"/index.{e}")))]
    tried = imports.select("file", "target", F.posexplode(F.array(*ranked)).alias("rank", "path"))
    found = tried.join(files.select("path").distinct(), "path").groupBy("file", "target").agg(F.min_by("path", "rank").alias("v"))
    return found.select(F.col("file").alias("u"), "v").where("u <> v").distinct()


def with_companions(closed: DataFrame, pairs: DataFrame, workspace: DataFrame) -> DataFrame:
    """closed(path) and, in one pass, the other end of each of pairs(a, b) that has an end in it and stands in workspace(path)."""
    ends = pairs.select(F.col("a").alias("path"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("path"), F.col("a").alias("other")))
    more = ends.join(closed, "path", "left_semi").select(F.col("other").alias("path")).join(workspace, "path", "left_semi")
    return closed.select("path").unionByName(more).distinct()
