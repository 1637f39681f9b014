"""Rules of the duplicate family over code: clone clusters, similar chunks and constants declared twice."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as X
from ..model import violations
from ..operators import duplicates as D
from ..operators import graphs
from ..sources.python_ast import bindings
from .engine import rule
from .python_rules import is_skipped

DIMS = 256
EMBED_BATCH = 32


def col(name: str) -> Column:
    return F.col(name)


def uni(name: str) -> Column:
    """A column in the order of the Unicode collation."""
    return F.collate(col(name), "UNICODE")


def python_chunks(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """path, name, line, col, end_line, end_col, text and hash of the defs and classes of Python files that are long enough; tests do not count."""
    defs = nodes.where("type IN ('FunctionDef', 'AsyncFunctionDef', 'ClassDef')").where(~X.is_python_test_path(col("file")))
    name = F.when((col("type") == "ClassDef") | (col("class_name") == "") | col("nested"), col("name")).otherwise(F.concat_ws(".", "class_name", "name"))
    start = col("col") + F.when(col("type") == "ClassDef", 6).when(col("type") == "AsyncFunctionDef", 10).otherwise(4)
    lines = F.slice(F.split("source", "\n", -1), col("line"), col("end_line") - col("line") + 1)
    text = X.normalized(F.array_join(lines, "\n"))
    made = defs.join(files.select(col("path").alias("file"), col("text").alias("source")), "file").select(col("file").alias("path"), name.alias("name"), "line", start.alias("col"), col("line").alias("end_line"), (start + F.length(name)).alias("end_col"), text.alias("text"))
    return made.where((F.length("name") > 0) & X.eligible(col("text"))).withColumn("hash", F.sha2("text", 256))


def hash_vector(text: str) -> np.ndarray:
    """A unit vector that stands in for a model: signed counts of identifiers' parts, and of each two in a row, at places given by CRC-32.

    Logarithms of the counts keep a word that a chunk repeats from outweighing the rest.
    """
    parts = [p.casefold() for word in re.findall(r"\w+", text) for p in re.split(r"_+|(?<=[a-z])(?=[A-Z])|(?<=\D)(?=\d)", word) if p]
    counts = Counter(parts) + Counter(map("+".join, zip(parts, parts[1:], strict=False)))
    out = np.zeros(DIMS)
    for feature, n in counts.items():
        code = zlib.crc32(feature.encode())
        out[code % DIMS] += np.log1p(n) * (1 if code >> 31 else -1)
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def embedded(chunks: DataFrame, cache: DataFrame | None = None, embed=hash_vector, dims: int = DIMS) -> DataFrame:
    """chunks with v: from the cache(hash, vector) where it has a vector of dims, else made in batches; bad vectors drop their chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), EMBED_BATCH):
                part = batch.iloc[at : at + EMBED_BATCH]
                yield part[["hash"]].assign(v=[embed(t) for t in part["text"]])

    once = chunks.select("hash", "text").dropDuplicates(["hash"])
    hits = None
    if cache is not None:
        good = cache.where(F.size("vector") == dims).dropDuplicates(["hash"])
        hits = once.join(good, "hash").select("hash", col("vector").cast("array<double>").alias("v"))
        once = once.join(good, "hash", "left_anti")
    made = once.mapInPandas(run, "hash string, v array<double>")
    vectors = made if hits is None else made.unionByName(hits)
    return chunks.join(vectors.where((F.size("v") == dims) & ~F.exists("v", F.isnan)), "hash")


@rule("dry/no-semantic-duplicate", "chunks", options={"type": "object", "properties": {"threshold": {"type": "number", "exclusiveMinimum": 0, "maximum": 1}}})
def no_semantic_duplicate(inputs, options):
    """One report a cluster of chunks(path, name, line, col, end_line, end_col, v), at its first member."""
    chunks = inputs["chunks"].withColumn("id", F.xxhash64("path", "name", "line", "col"))
    found = D.clusters(D.similar_vectors(chunks.select("id", "v"), options.get("threshold", 0.9)))
    member = F.struct(uni("path").alias("a"), uni("name").alias("b"), "line", "path", "name", "col", "end_line", "end_col")
    groups = chunks.join(found, "id").groupBy("primary").agg(F.sort_array(F.collect_list(member)).alias("m"))
    first, others = F.element_at("m", 1), F.slice("m", 2, F.size("m"))
    said = F.array_join(F.transform(others, lambda x: F.concat(F.lit('"'), x["name"], F.lit('" at '), x["path"], F.lit(":"), x["line"].cast("string"))), ", ")
    rows = groups.select(first.alias("f"), F.element_at("m", 2).alias("s"), said.alias("said"))
    return violations(
        rows, "dry/no-semantic-duplicate", F.concat(F.lit('"'), "f.name", F.lit('" is a semantic near-duplicate of '), "said", F.lit(".")),
        F.concat(F.lit('Extract a shared helper, or reuse "'), "s.name", F.lit('" at '), "s.path", F.lit(":"), col("s.line").cast("string"), F.lit(".")),
        file="f.path", line="f.line", col="f.col", end_line="f.end_line", end_col="f.end_col",
    )


def whole_functions(members: DataFrame, rule_id: str) -> DataFrame:
    """Reports of clone members(cluster_id, similarity, file, name, start_line, end_line) that pass the gate, without overlaps."""
    loc = col("end_line") - col("start_line") + 1
    groups = D.gate(members.groupBy("cluster_id").agg(F.count("*").alias("members"), F.min(loc).alias("min_loc"))).where("reported").select("cluster_id")
    w = Window.partitionBy("cluster_id").orderBy(uni("file"), "start_line")
    ranked = members.join(groups, "cluster_id").withColumn("k", F.row_number().over(w))
    rep = ranked.where("k = 1").select("cluster_id", col("name").alias("r_name"), col("file").alias("r_file"), col("start_line").alias("r_line"))
    rows = ranked.where("k > 1").join(rep, "cluster_id").select("file", F.lit("F").alias("arm"), "start_line", F.lit(1).alias("start_col"), "end_line", "name", "similarity", "r_name", "r_file", "r_line")
    where = F.concat("r_file", F.lit(":"), col("r_line").cast("string"))
    percent = F.floor(col("similarity") * 100 + 0.5).cast("string")
    return violations(
        D.without_overlaps(rows), rule_id, F.concat(F.lit('"'), "name", F.lit('" is duplicate logical code of "'), "r_name", F.lit('" in '), where, F.lit(" ("), percent, F.lit("% similar).")),
        F.concat(F.lit('Reuse "'), "r_name", F.lit('" from '), where, F.lit(" instead of reimplementing it.")),
        line="start_line", col=F.lit(1), end_col=F.lit(1),
    )


@rule("dry/no-duplicate-python", "clones")
def no_duplicate_python(inputs, options):
    python = inputs["clones"].where(col("file").endswith(".py") & ~(X.is_python_test_path(col("file")) & ~col("file").rlike(r"(?:^|/)conftest\.py$")))
    return whole_functions(python, "dry/no-duplicate-python")


@rule("dry/no-duplicate-code", "clones")
def no_duplicate_code(inputs, options):
    """The whole-function arm; the arm of statement windows needs a parser."""
    return whole_functions(inputs["clones"].where(col("file").rlike(r"\.[mc]?tsx?$") & ~X.is_js_test_path(col("file"))), "dry/no-duplicate-code")


def name_cards(nodes: DataFrame, packages: DataFrame) -> DataFrame:
    """file, name, value, place and package_dir of module-level names assigned once, to a number."""
    nodes = nodes.where(~is_skipped(col("file")))
    statements = nodes.where("parent = 0 AND type IN ('Assign', 'AnnAssign')").select("file", col("node").alias("stmt"))
    targets = nodes.where("field IN ('targets', 'target')").select("file", col("parent").alias("stmt"), "type", "name", "line", "col", "end_line", "end_col")
    single = targets.join(statements, ["file", "stmt"], "left_semi").withColumn("n", F.count("*").over(Window.partitionBy("file", "stmt"))).where("n = 1 AND type = 'Name'")
    once = single.withColumn("times", F.count("*").over(Window.partitionBy("file", "name"))).where("times = 1")
    values = nodes.where("field = 'value' AND kind IN ('int', 'float')").select("file", col("parent").alias("stmt"), F.expr("try_cast(replace(text, '_', '') AS DOUBLE)").alias("value")).where("value IS NOT NULL AND abs(value) < double('infinity')")
    return once.join(values, ["file", "stmt"]).join(packages, "file", "left").select("file", "name", "value", "line", "col", "end_line", "end_col", F.coalesce("package_dir", F.lit("")).alias("package_dir"))


#: Ranks of the arms, best first.
ARMS = ("exact", "normalized", "embed")
ARM_OPTIONS = {"type": "object", "additionalProperties": False, "properties": {k: {"type": "boolean"} for k in ("exact", "normalized", "embedNames")}}


@rule("python/single-source-threshold", "python", "packages", recommended="off", options={"type": "object", "additionalProperties": False, "properties": {"names": {"type": "array", "items": {"type": "string"}}, "tokenJaccard": {"type": "number", "minimum": 0, "maximum": 1}, "nameCosine": {"type": "number", "exclusiveMinimum": 0, "maximum": 1}, "arms": ARM_OPTIONS}})
def single_source_threshold(inputs, options):
    cards = name_cards(inputs["python"], inputs["packages"])
    arms, patterns = options.get("arms", {}), tuple(options.get("names", ()))
    parts = []
    if arms.get("exact", True):
        parts.append(cards.select("*", F.concat_ws("\0", F.lit("exact"), "package_dir", "name").alias("cluster"), F.lit(0).alias("rank")))
    gated = cards.withColumn("gated", N.gated(col("name"), patterns)).withColumn("form", N.normal(col("name")))
    forms = gated.groupBy("package_dir", "form").agg(F.bool_or("gated").alias("gated"), F.count("*").alias("n")).withColumn("key", F.concat_ws("\0", "package_dir", "form"))
    if arms.get("normalized", True):
        tokens = F.transform(N.tokens(col("form")), lambda t: F.concat_ws("\0", col("package_dir"), t))
        close = D.similar_sets(forms.select("key", tokens.alias("tokens")), options.get("tokenJaccard", N.TOKEN_JACCARD)).select("a", "b")
        parts.append(_clustered(gated, forms, close, 1))
    if arms.get("embedNames", True):
        words = F.lower(F.regexp_replace(F.regexp_replace("name", "([a-z0-9])([A-Z])", "$1 $2"), "_", " "))
        once = gated.select("package_dir", "name").distinct().select("package_dir", "name", words.alias("text"), F.xxhash64("package_dir", "name").alias("id"), F.sha2(words, 256).alias("hash"))
        vectors = embedded(once)
        near = D.similar_vectors(vectors.select("id", "v", "package_dir"), options.get("nameCosine", N.NAME_COSINE), within="package_dir")
        side = lambda k: once.select(col("id").alias(k), col("package_dir").alias(f"{k}_dir"), F.concat_ws("\0", "package_dir", "name").alias(f"{k}_key"))
        close = near.join(side("a"), "a").join(side("b"), "b").where("a_dir = b_dir").select(col("a_key").alias("a"), col("b_key").alias("b"))
        named = gated.withColumn("form", col("name"))
        by_name = named.groupBy("package_dir", "form").agg(F.bool_or("gated").alias("gated"), F.count("*").alias("n")).withColumn("key", F.concat_ws("\0", "package_dir", "form"))
        some = named.join(vectors.select("package_dir", "name").distinct(), ["package_dir", "name"], "left_semi")
        parts.append(_clustered(some, by_name, close, 2))
    hits = None
    for p in parts:
        hits = p if hits is None else hits.unionByName(p)
    if hits is None:
        hits = cards.select("*", F.lit("").alias("cluster"), F.lit(0).alias("rank")).limit(0)
    w = Window.partitionBy("rank", "cluster").orderBy(uni("file"), uni("name"))
    ordered = hits.withColumn("k", F.row_number().over(w))
    first = ordered.where("k = 1").select("rank", "cluster", col("name").alias("c_name"), col("file").alias("c_file"), col("value").alias("c_value"))
    extra = ordered.where("k > 1").join(first, ["rank", "cluster"])
    # Silent where the extra's file imports the canonical name from a file of the cluster that defines it.
    defining = hits.select("rank", "cluster", col("file").alias("target_file"), col("name").alias("c_name"))
    told = bindings(inputs["python"], inputs["packages"]).select("file", "target_file", col("target_name").alias("c_name"))
    quiet = defining.join(told, ["target_file", "c_name"]).select("rank", "cluster", "c_name", "file").distinct()
    best = D.first_arm(extra.join(quiet, ["rank", "cluster", "c_name", "file"], "left_anti"), ["file", "name"], col("rank"), [uni("c_file"), uni("c_name")])
    where = F.concat("c_name", F.lit(" at "), "c_file")
    disagree = F.when(col("value") != col("c_value"), " Values disagree — confirm split-brain.").otherwise("")
    message = F.concat(F.lit('"'), "name", F.when(col("rank") == 0, '" is a second definition of ').otherwise('" redeclares the same threshold as '), where, F.lit(". Define it once and import it."), disagree)
    return violations(best, "python/single-source-threshold", message, F.concat(F.lit("Import the canonical name (or re-export from one module) instead of redeclaring it. Canonical: "), where, F.lit(".")))


def _clustered(cards: DataFrame, forms: DataFrame, close: DataFrame, rank: int) -> DataFrame:
    """cards with cluster: forms joined by close(a, b) pairs of which one side sets a threshold, or a form that does and stands twice."""
    flag = forms.select("key", "gated")
    links = close.join(flag.withColumnRenamed("key", "a").withColumnRenamed("gated", "g"), "a").join(flag.withColumnRenamed("key", "b").withColumnRenamed("gated", "h"), "b").where("g OR h")
    label = graphs.components(links.select(col("a").alias("u"), col("b").alias("v")))
    alone = forms.where("gated AND n > 1").select(col("key").alias("node"), col("key").alias("component")).join(label, "node", "left_anti")
    named = label.unionByName(alone).select(col("node").alias("key"), col("component").alias("cluster"))
    return cards.withColumn("key", F.concat_ws("\0", "package_dir", "form")).join(named, "key").select("file", "name", "value", "line", "col", "end_line", "end_col", "package_dir", "cluster", F.lit(rank).alias("rank"))
