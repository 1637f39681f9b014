"""Engine-level operators: overlays, selections, longest prefixes, ordered patterns, use counts and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlay(settings: DataFrame, keys: list[str], layer: str, value: str) -> DataFrame:
    """The value of the highest layer for each of keys: later configuration wins."""
    return settings.groupBy(*keys).agg(F.max_by(value, layer).alias(value))


def selected(rules: DataFrame, plugins: list[str] = (), without: list[str] = (), names: list[str] = ()) -> DataFrame:
    """rules(plugin, rule) of any of plugins, of none of without, and of any of names; empty lists select everything."""
    out = rules.where(F.col("plugin").isin(list(plugins))) if plugins else rules
    out = out.where(~F.col("plugin").isin(list(without))) if without else out
    return out.where(F.col("rule").isin(list(names))) if names else out


def unknown(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """What is asked for and not known."""
    return asked.select(key).distinct().join(known.select(key), key, "left_anti")


def demand(rules: DataFrame) -> DataFrame:
    """artifact and rules (sorted) for rules(rule, requires): what each artifact is built for."""
    return rules.select("rule", F.explode("requires").alias("artifact")).groupBy("artifact").agg(F.sort_array(F.collect_set("rule")).alias("rules"))


def longest_prefix(rows: DataFrame, key: str, prefixes: DataFrame, rest: str | None = None) -> DataFrame:
    """rows with the longest of prefixes(prefix, ...) that key starts with, null if there is none.

    An equi-join on each of the key's own prefixes, so it needs no range join. rest: a pattern for what follows a
    prefix that is not the whole key.
    """
    k = F.col(key)
    own = rows.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(k), F.lit(1))), lambda n: F.substring(k, F.lit(1), n))))
    fits = own.join(prefixes.select("prefix").distinct(), "prefix")
    if rest:
        fits = fits.where(F.substring(k, F.length("prefix") + 1, F.length(k)).rlike(rest))
    best = fits.groupBy(key).agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    return rows.join(best, key, "left")


def first_by(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The value at the first place of each of keys."""
    return rows.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))


def followed_before(rows: DataFrame, keys: list[str], order: list[str], kind: str, first: str, then: str, guard: str) -> DataFrame:
    """Rows of kind `first` after which `then` comes before the next `guard`, within keys and in order."""
    ahead = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    coming = F.first(F.when(F.col(kind).isin(then, guard), F.col(kind)), ignorenulls=True).over(ahead)
    return rows.withColumn("_next", coming).where((F.col(kind) == first) & (F.col("_next") == then)).drop("_next")


def uses(definitions: DataFrame, references: DataFrame, key: str, most: int = 1) -> DataFrame:
    """definitions that are referred to `most` times or less, with n_uses."""
    counted = references.groupBy(key).agg(F.count("*").alias("n_uses"))
    return definitions.join(counted, key, "left").withColumn("n_uses", F.coalesce("n_uses", F.lit(0))).where(F.col("n_uses") <= most)


def outer_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key and side (left or right) of what only one side has."""
    a, b = (x.select(key, F.lit(True).alias(name)).dropDuplicates([key]) for x, name in ((left, "in_left"), (right, "in_right")))
    return a.join(b, key, "full_outer").where("in_left IS NULL OR in_right IS NULL").select(key, F.when(F.col("in_left"), "left").otherwise("right").alias("side"))


def missing(rows: DataFrame, key: str, value: str, expected: Column) -> DataFrame:
    """key and missing: the expected values that no row of the key has, where there are any."""
    return rows.groupBy(key).agg(F.collect_set(value).alias("seen")).select(key, F.sort_array(F.array_except(expected, "seen")).alias("missing")).where(F.size("missing") > 0)


def flags_of(*lists: tuple[str, DataFrame]) -> DataFrame:
    """path and one boolean for each named list(path): in how many lists a path stands, once a path."""
    out = None
    for name, _ in lists:
        part = next(d for n, d in lists if n == name).select("path", *[F.lit(n == name).alias(n) for n, _ in lists])
        out = part if out is None else out.unionByName(part)
    return out.groupBy("path").agg(*[F.max(n).alias(n) for n, _ in lists])


def languages(files: DataFrame, depth: int = 8, entries: int = 2000) -> DataFrame:
    """Which languages the first entries of a tree hold; the limits are part of the feature."""
    near = files.where(F.size(F.split("path", "/")) <= depth).orderBy("path").limit(entries)
    has = lambda pattern: F.coalesce(F.bool_or(F.col("path").rlike(pattern)), F.lit(False))
    return near.agg(has(r"\.[mc]?ts$").alias("typescript"), has(r"\.tsx$").alias("react"), has(r"\.py$").alias("python"))
