"""Rules on hash functions that a configuration names, over the table of Python nodes.

A hash function is followed into the defs of its module that it calls by name, two calls deep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import violations
from ..sources.python_ast import bindings
from ..storage import written
from .engine import rule
from .indirection_rules import name_place
from .provenance_rules import STRINGS, inside, schema
from .python_rules import calls, col, last

DEFS = "type IN ('FunctionDef', 'AsyncFunctionDef')"
#: Callees that take what is hashed, names of the parameter that holds a configuration, and names of versions.
HASHERS = ("update", "sha256", "sha1", "md5", "blake2b", "blake2s", "dumps", "hash")
CONFIGS = ("config", "cfg")
VERSION = r"(?i)(schema_)?version|_VERSION$"
CODE = ("CODE_VERSION", "GIT_SHA", "git_sha")
HOPS = 2


def bound_functions(nodes: DataFrame, packages: DataFrame, names: list[str]) -> DataFrame:
    """fq, file, node and the def's columns for each of names, module.function or module.Class.method.

    The module is looked for at the root, in packages, and beside any file, and in src of these; of several splits of
    a name the one with the longest module counts, of several files the one nearest to the root.
    """
    spark = nodes.sparkSession
    splits = []
    for fq in names:
        parts = [p for p in fq.split(".") if p]
        for k in range(len(parts) - 1, 0, -1):
            if len(parts) - k <= 2:
                splits.append((fq, len(parts) - k, "/".join(parts[:k]), parts[k] if len(parts) - k == 2 else "", parts[-1]))
    asked = spark.createDataFrame(splits, "fq string, rank int, path string, cls string, name string")
    files = nodes.select("file").distinct()
    folders = packages.select(col("package_dir").alias("folder")).unionByName(files.select(F.regexp_replace("file", "/?[^/]*$", "").alias("folder"))).unionByName(spark.createDataFrame([("",)], "folder string")).distinct()
    tried = folders.unionByName(folders.select(F.concat(F.when(col("folder") == "", F.lit("")).otherwise(F.concat("folder", F.lit("/"))), F.lit("src")).alias("folder"))).distinct()
    # The names are few, so each folder is tried with each of them.
    ways = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(asked.columns, s, strict=True)]) for s in splits])
    paths = tried.select("folder", F.explode(ways).alias("s")).select("folder", "s.*").withColumn("root", F.concat(F.when(col("folder") == "", F.lit("")).otherwise(F.concat("folder", F.lit("/"))), "path"))
    paths = paths.withColumn("file", F.explode(F.array(F.concat("root", F.lit(".py")), F.concat("root", F.lit("/__init__.py")))))
    classes = nodes.where("type = 'ClassDef' AND parent = 0").select("file", col("node").alias("parent"), col("name").alias("cls"))
    defs = nodes.where(DEFS)
    top = defs.where("parent = 0").withColumn("cls", F.lit(""))
    methods = defs.where("field = 'body'").join(classes, ["file", "parent"])
    found = paths.join(top.unionByName(methods.select(*top.columns)), ["file", "cls", "name"])
    near = F.struct("rank", F.length("folder").alias("l"), "file", "node")
    best = found.groupBy("fq").agg(F.min(near).alias("b")).select("fq", col("b.file").alias("file"), col("b.node").alias("node"))
    return best.join(nodes, ["file", "node"])


def followed(nodes: DataFrame, start: DataFrame, forwarded) -> DataFrame:
    """fq, file, node, a, z and state of the functions start(fq, file, node, a, z, state) and those reached from them; forwarded gives the next state, or null."""
    callables = nodes.where("parent = 0").where(DEFS).groupBy("file", col("name").alias("callee")).agg(F.max(F.struct("node", "post", "params")).alias("d"))
    by_name = nodes.where("field = 'func' AND type = 'Name'").select("file", col("parent").alias("node"), col("name").alias("callee"))
    edges = calls(nodes).join(by_name, ["file", "node"]).join(callables, ["file", "callee"]).select("file", col("node").alias("call"), "d", "args", "keywords")
    reached = level = start
    for _ in range(HOPS):
        step = level.join(edges, "file").where("a <= call AND call <= z").withColumn("next", forwarded(col("state"), col("d.params"), col("args"), col("keywords"))).where("next IS NOT NULL")
        level = step.select("fq", "file", col("d.node").alias("node"), col("d.node").alias("a"), col("d.post").alias("z"), col("next").alias("state")).distinct()
        reached = reached.unionByName(level)
    return written(reached.distinct(), "followed")


def unbound(nodes: DataFrame, rule_id: str) -> DataFrame:
    """The report that no function is named, at the first file."""
    first = nodes.agg(F.min("file").alias("file")).where("file IS NOT NULL")
    return violations(first, rule_id, f"{rule_id} is enabled but hashFunctions is empty.", "Name at least one fully-qualified callable in hashFunctions, or turn the rule off.", severity="warn", line=F.lit(1), col=F.lit(1), end_line=F.lit(1), end_col=F.lit(1))


def start_of(functions: DataFrame, state: Column) -> DataFrame:
    return functions.select("fq", "file", "node", col("node").alias("a"), col("post").alias("z"), state.alias("state"))


def payload_rule(inputs, options: dict, rule_id: str, matches, message: str, hint: str) -> DataFrame:
    """Hash functions into whose payload no name or text goes that matches."""
    nodes, names = inputs["python"], [x for x in options.get("hashFunctions", []) if x]
    if not names:
        return unbound(nodes, rule_id)
    functions = bound_functions(nodes, inputs["packages"], names)
    reached = followed(nodes, start_of(functions, F.lit("")), lambda state, *_: state)
    hashers = inside(calls(nodes).where(last().isin(*HASHERS)), reached.select("fq", "file", "a", "z")).select("fq", "file", col("node").alias("call")).distinct()
    given = nodes.where("field IN ('args', 'keywords')").select("file", col("parent").alias("call"), col("node").alias("a"), col("post").alias("z"))
    said = nodes.where("type IN ('Name', 'Attribute') OR kind = 'str'").withColumn("said", F.when(col("kind") == "str", col("text")).otherwise(col("name"))).where(matches(col("said"))).select("file", "node")
    good = inside(said, hashers.join(given, ["file", "call"])).select("fq").distinct()
    rows = name_place(functions.join(good, "fq", "left_anti"))
    return violations(rows, rule_id, F.concat(F.lit('Hash function "'), "fq", F.lit(f'" {message}')), hint)


@rule("fingerprint/versioned-hash-payload", "python", "packages", options=schema(hashFunctions=STRINGS, versionKeys=STRINGS))
def versioned_hash_payload(inputs, options):
    extra = options.get("versionKeys", [])
    matches = lambda said: said.rlike(VERSION) | said.isin(*extra) if extra else said.rlike(VERSION)
    return payload_rule(inputs, options, "fingerprint/versioned-hash-payload", matches, "does not fold a version contribution into the hash payload.", "Fold a schema_version / *_VERSION constant (or a versionKeys name) into the hash input.")


@rule("fingerprint/hash-includes-code-version", "python", "packages", options=schema(hashFunctions=STRINGS, codeVersionNames=STRINGS))
def hash_includes_code_version(inputs, options):
    known = [*CODE, *options.get("codeVersionNames", [])]
    hint = "Fold CODE_VERSION, GIT_SHA, or git_sha (or a codeVersionNames symbol) into the hash payload. Config-only fingerprints mean same knobs, not same data."
    return payload_rule(inputs, options, "fingerprint/hash-includes-code-version", lambda said: said.isin(*known), "does not fold a code version into the hash payload.", hint)


def passed_on(state: Column, params: Column, args: Column, keywords: Column) -> Column:
    """The name under which a call hands on the name state: a positional parameter, or else a keyword."""
    positional = F.filter(params, lambda p: p["role"].isin("pos", "arg"))
    is_state = lambda x: (x["type"] == "Name") & (F.get(x["chain"], F.lit(0)) == state)
    names = F.transform(args, lambda x, i: F.when(is_state(x), F.get(positional, i)["name"]))
    by_place = F.get(F.filter(names, lambda x: x.isNotNull() & ~x.isin("self", "cls")), F.lit(0))
    by_keyword = F.get(F.map_keys(F.map_filter(keywords, lambda _, v: is_state(v))), F.lit(0))
    return F.coalesce(by_place, by_keyword)


def class_fields(nodes: DataFrame, packages: DataFrame, starts: DataFrame) -> DataFrame:
    """fq and field of the annotated fields of classes starts(fq, file, node) and of all their bases in the workspace."""
    classes = nodes.where("type = 'ClassDef' AND parent = 0").groupBy("file", "name").agg(F.min("node").alias("node"))
    imported = bindings(nodes, packages).select("file", col("local").alias("base"), col("target_file").alias("t_file"), col("target_name").alias("name"))
    bases = nodes.where("field = 'bases'").select("file", col("parent").alias("node"), last().alias("base")).where("base IS NOT NULL")
    local = bases.join(classes.select("file", col("name").alias("base"), col("node").alias("t_node")), ["file", "base"]).select("file", "node", col("file").alias("t_file"), "t_node", "base")
    other = bases.join(local.select("file", "node", "base"), ["file", "node", "base"], "left_anti").join(imported, ["file", "base"]).join(classes.select(col("file").alias("t_file"), "name", col("node").alias("t_node")), ["t_file", "name"])
    edges = written(local.drop("base").unionByName(other.select("file", "node", "t_file", "t_node")).distinct(), "bases")
    seen = level = written(starts.select("fq", "file", "node").distinct(), "classes")
    while level.limit(1).count():  # as many rounds as there are bases above each other
        level = written(level.join(edges, ["file", "node"]).select("fq", col("t_file").alias("file"), col("t_node").alias("node")).distinct().join(seen, ["fq", "file", "node"], "left_anti"), "classes")
        seen = seen.unionByName(level)
    fields = nodes.where("field = 'body' AND type = 'AnnAssign'").select("file", col("parent").alias("node"), col("node").alias("stmt"))
    named = nodes.where("field = 'target' AND type = 'Name'").select("file", col("parent").alias("stmt"), col("name").alias("field_name")).where(~col("field_name").rlike(r"^__\w+__$"))
    noted = nodes.where("field = 'annotation' AND type = 'Subscript'").select("file", col("parent").alias("stmt"), col("node").alias("parent"))
    class_var = nodes.where("field = 'value'").where(last() == "ClassVar").join(noted, ["file", "parent"]).select("file", "stmt")
    return seen.join(fields, ["file", "node"]).join(named, ["file", "stmt"]).join(class_var, ["file", "stmt"], "left_anti").select("fq", col("field_name").alias("field")).distinct()


@rule("fingerprint/hash-covers-every-config-field", "python", "packages", options=schema(hashFunctions=STRINGS, excludeFields={"type": "object", "additionalProperties": True}))
def hash_covers_every_config_field(inputs, options):
    nodes, names, rule_id = inputs["python"], [x for x in options.get("hashFunctions", []) if x], "fingerprint/hash-covers-every-config-field"
    if not names:
        return unbound(nodes, rule_id)
    functions = bound_functions(nodes, inputs["packages"], names)
    takes = F.filter("params", lambda p: p["role"].isin("pos", "arg", "kwonly"))
    param = F.coalesce(F.get(F.filter(takes, lambda p: p["name"].isin(*CONFIGS)), F.lit(0)), F.get(F.filter(takes, lambda p: ~p["name"].isin("self", "cls")), F.lit(0)))
    functions = functions.withColumn("param", param).where("param.core IS NOT NULL")
    typed = functions.select("fq", "file", col("param.core").alias("base"))
    classes = nodes.where("type = 'ClassDef' AND parent = 0").groupBy("file", "name").agg(F.min("node").alias("node"))
    local = typed.join(classes.withColumnRenamed("name", "base"), ["file", "base"]).select("fq", "file", "node", col("base").alias("name"))
    imported = bindings(nodes, inputs["packages"]).select("file", col("local").alias("base"), "target_file", "target_name")
    other = typed.join(local.select("fq"), "fq", "left_anti").join(imported, ["file", "base"]).select("fq", col("target_file").alias("file"), col("target_name").alias("name")).join(classes, ["file", "name"]).select("fq", "file", "node", "name")
    starts = local.unionByName(other)
    fields = class_fields(nodes, inputs["packages"], starts)
    holes = [(t, f) for t, some in options.get("excludeFields", {}).items() if isinstance(some, list) for f in some if isinstance(f, str)]
    if holes:
        excluded = starts.join(nodes.sparkSession.createDataFrame(holes, "name string, field string"), "name").select("fq", "field")
        fields = fields.join(excluded, ["fq", "field"], "left_anti")
    reached = followed(nodes, start_of(functions, col("param.name")), passed_on)
    spans = reached.select("fq", "file", "a", "z", "state")
    held = nodes.where("field = 'value' AND type = 'Name'").select("file", col("parent").alias("node"), col("name").alias("holder"))
    attributes = nodes.where("type = 'Attribute'").select("file", "node", col("name").alias("field")).join(held, ["file", "node"])
    sliced = nodes.where("field = 'slice' AND kind = 'str'").select("file", col("parent").alias("node"), col("text").alias("field")).join(held, ["file", "node"]).join(nodes.where("type = 'Subscript'").select("file", "node"), ["file", "node"], "left_semi")
    first, second = F.get("args", F.lit(0)), F.get("args", F.lit(1))
    got = calls(nodes).where((last() == "getattr") & (first["type"] == "Name") & (second["kind"] == "str")).select("file", "node", second["text"].alias("field"), F.get(first["chain"], F.lit(0)).alias("holder"))
    reads = inside(attributes.unionByName(sliced).unionByName(got), spans).where("holder = state").select("fq", "field").distinct()
    lacking = fields.join(reads, ["fq", "field"], "left_anti").groupBy("fq").agg(F.array_join(F.sort_array(F.collect_set("field")), ", ").alias("lacking"))
    rows = name_place(functions.join(lacking, "fq"))
    message = F.concat(F.lit('Hash function "'), "fq", F.lit('" does not read config fields: '), "lacking", F.lit("."))
    return violations(rows, rule_id, message, "Read each missing field on the config object inside the hash function (or name it in excludeFields).")
