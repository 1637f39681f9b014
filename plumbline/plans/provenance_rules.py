"""Rules on what training code records, seeds and fits, over the table of Python nodes.

A scope is a def, a main guard or the module; its own body is what stands in its statements, outside defs and
classes within. Every join is on the file, and intervals of nodes say what stands inside what.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from ..model import violations
from ..sources.python_ast import bindings
from .engine import rule
from .python_rules import calls, col, is_test, kids, last, methods, sources

PLACE = ("line", "col", "end_line", "end_col")
DEFS = "type IN ('FunctionDef', 'AsyncFunctionDef')"

#: Names of entry points, of the writer, of keys that pin the code, modes that write, and calls that compare.
ENTRIES = ("train", "main")
WRITER = "save_metadata"
VERSION_KEYS = ("git_commit", "git_sha", "git_rev", "code_version", "code_rev", "behaviour_version", "behavior_version")
WRITE_MODES = ("w", "wb", "a")
EQUAL_CALLS = ("assertEqual", "assert_equal", "equal", "allclose")
SEEDS = ("seed", "train_seed", "split_seed")

STRINGS = {"type": "array", "items": {"type": "string"}}
WRITER_OPTIONS = {"writerName": {"type": "string"}, "entryPoints": STRINGS}


def schema(**properties) -> dict:
    return {"type": "object", "additionalProperties": False, "properties": properties}


def entry_names(options: dict) -> list[str]:
    """The names that count as entry points: the usual ones, and the last part of each that the options name."""
    given = [re.split(r"[./]", re.sub(r"\.py$", "", x.replace("\\", "/")))[-1] for x in options.get("entryPoints", []) if x]
    return [*ENTRIES, *given]


def string(value: Column) -> Column:
    """The text of a value that is a string literal, else null."""
    return F.when(value["kind"] == "str", value["text"])


def argument(k: int) -> Column:
    return F.get("args", F.lit(k))


def keyword(name: str) -> Column:
    return F.try_element_at("keywords", F.lit(name))


def training_files(nodes: DataFrame) -> DataFrame:
    loaders = calls(nodes).where(last() == "DataLoader").select("file")
    return methods(nodes, "backward").select("file").unionByName(loaders).distinct()


def inside(nodes: DataFrame, around: DataFrame) -> DataFrame:
    """nodes within each of around(file, a, z, ...): an interval join within the file."""
    return nodes.join(around, "file").where("a <= node AND node <= z")


def entries(nodes: DataFrame, options: dict) -> DataFrame:
    """file, node, name and place of a file's entry points: top-level defs of such names, or else the first main guard that calls one."""
    wanted = entry_names(options)
    top = nodes.where("parent = 0")
    defs = top.where(DEFS).where(col("name").isin(wanted)).select("file", "node", "name", *PLACE)
    tests = nodes.where("field = 'test' AND type = 'Compare'").select("file", col("parent").alias("node"), col("node").alias("test"))
    named = nodes.where("field = 'left' AND type = 'Name' AND name = '__name__'").select("file", col("parent").alias("test"))
    main = nodes.where("field = 'comparators' AND kind = 'str' AND text = '__main__'").select("file", col("parent").alias("test")).distinct()
    guards = top.where("type = 'If'").join(tests, ["file", "node"]).join(named, ["file", "test"]).join(main, ["file", "test"])
    called = calls(nodes).where(last().isin(wanted)).select("file", col("node").alias("call"), last().alias("name"))
    found = guards.drop("name").join(called, "file").where("node < call AND call <= post").groupBy("file", "node", *PLACE).agg(F.min_by("name", "call").alias("name"))
    first = found.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("node"))).where("k = 1").select(*defs.columns)
    return defs.unionByName(first.join(defs.select("file").distinct(), "file", "left_anti"))


def is_save() -> Column:
    first = F.get("chain", F.lit(0))
    return F.coalesce((first == "torch") & (last() == "save") | (first == "joblib") & (last() == "dump"), F.lit(False))


def with_enclosing(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows with enclosing: the last top-level def whose lines hold the row's, or 0, the module."""
    defs = nodes.where("parent = 0").where(DEFS).select("file", col("node").alias("d"), col("line").alias("d_line"), col("end_line").alias("d_end"))
    near = rows.select("file", "node", "line").join(defs, "file").where("d_line <= line AND line <= d_end").groupBy("file", "node").agg(F.max("d").alias("enclosing"))
    return rows.join(near, ["file", "node"], "left").withColumn("enclosing", F.coalesce("enclosing", F.lit(0)))


def gate_sites(nodes: DataFrame, options: dict) -> DataFrame:
    """file, scope_node and place of what must leave a record: entry points of training files, and saves of artifacts, one for each scope. Written, as rules read it several times."""
    trained = entries(nodes, options).join(training_files(nodes), "file", "left_semi").select("file", col("node").alias("scope_node"), F.lit(0).alias("order"), "node", *PLACE)
    saved = with_enclosing(calls(nodes).where(is_save()), nodes).select("file", col("enclosing").alias("scope_node"), F.lit(1).alias("order"), "node", *PLACE)
    w = Window.partitionBy("file", "scope_node").orderBy("order", "node")
    return storage.written(trained.unionByName(saved).withColumn("k", F.row_number().over(w)).where("k = 1").select("file", "scope_node", *PLACE), "sites")


def bodies(nodes: DataFrame) -> DataFrame:
    """file, scope_node, owner, a and z of the body of every def, if and module; owner is the scope that its nodes name."""
    parts = nodes.where("field = 'body'").groupBy("file", col("parent").alias("scope_node")).agg(F.min("node").alias("a"), F.max("post").alias("z"))
    owners = nodes.where("type IN ('FunctionDef', 'AsyncFunctionDef', 'If', 'Module')").select("file", col("node").alias("scope_node"), F.when(col("type") == "If", col("scope")).when(col("type") == "Module", F.lit(0)).otherwise(col("node")).alias("owner"))
    return parts.join(owners, ["file", "scope_node"])


def own(nodes: DataFrame, scopes: DataFrame) -> DataFrame:
    """nodes of the own bodies of scopes(file, scope_node), with scope_node."""
    spans = bodies(nodes).join(scopes.select("file", "scope_node").distinct(), ["file", "scope_node"], "left_semi")
    return nodes.join(spans, (nodes["file"] == spans["file"]) & (F.coalesce(nodes["scope"], F.lit(0)) == spans["owner"])).drop(spans["file"]).where("a <= node AND node <= z").drop("owner", "a", "z")


def writers(nodes: DataFrame, packages: DataFrame, name: str) -> DataFrame:
    """file, w_file, a and z: the top-level def of that name which a file has, or imports. Written, as rules read it several times."""
    tops = nodes.where("parent = 0").where(DEFS)
    defs = tops.groupBy("file", "name").agg(F.min(F.struct("node", "post")).alias("d")).select("file", "name", col("d.node").alias("a"), col("d.post").alias("z"))
    local = defs.where(col("name") == name).select("file", col("file").alias("w_file"), "a", "z")
    taken = bindings(nodes, packages).where(col("local") == name).select("file", col("target_file").alias("w_file"), col("target_name").alias("name"))
    other = taken.join(defs.withColumnRenamed("file", "w_file"), ["w_file", "name"]).select("file", "w_file", "a", "z").dropDuplicates(["file"])
    return storage.written(local.unionByName(other.join(local, "file", "left_anti")), "writers")


def reaching(edges: DataFrame, target: str) -> DataFrame:
    """(file, name) of the defs of edges(file, name, callee) from which calls within the file reach target. A file's defs are one group."""

    def spread(rows: pd.DataFrame) -> pd.DataFrame:
        found, todo = set(), [target]
        by_callee = rows.groupby("callee")["name"].agg(list).to_dict()
        while todo:
            for name in by_callee.get(todo.pop(), ()):
                if name not in found:
                    found.add(name)
                    todo.append(name)
        return pd.DataFrame([(rows["file"].iloc[0], name) for name in sorted(found)], columns=["file", "name"], dtype=object)

    return edges.groupBy("file").applyInPandas(spread, "file string, name string")


def report(rows: DataFrame, rule_id: str, message, hint: str) -> DataFrame:
    return violations(rows, rule_id, message, hint)


@rule("ml/metadata-writer-required", "python", "packages", options=schema(**WRITER_OPTIONS))
def metadata_writer_required(inputs, options):
    nodes, name = sources(inputs), options.get("writerName") or WRITER
    sites, found = gate_sites(nodes, options), writers(nodes, inputs["packages"], name)
    mode = F.coalesce(string(keyword("mode")), string(argument(1)), F.lit(""))
    in_writer = inside(calls(nodes).withColumnRenamed("file", "w_file").withColumn("file", col("w_file")), found.select(col("w_file").alias("file"), "a", "z").distinct())
    has = lambda *names: F.bool_or(F.coalesce(last().isin(*names), F.lit(False)))
    opens = F.bool_or(F.coalesce((last() == "open") & mode.isin(*WRITE_MODES), F.lit(False)))
    writes = in_writer.groupBy("w_file", "a").agg((has("dump", "safe_dump") | has("write_text", "write_bytes") | opens & has("write")).alias("writes"))
    tops = nodes.where("parent = 0").where(DEFS).groupBy("file", "name").agg(F.max("node").alias("scope_node"))
    called = calls(own(nodes, tops.unionByName(sites.select("file", F.lit("").alias("name"), "scope_node")).select("file", "scope_node"))).select("file", "scope_node", last().alias("callee")).where("callee IS NOT NULL").distinct()
    called = storage.written(called, "called")
    edges = called.join(tops, ["file", "scope_node"]).select("file", "name", "callee")
    good = reaching(edges, name).select("file", col("name").alias("callee")).unionByName(nodes.select("file").distinct().withColumn("callee", F.lit(name))).distinct()
    reached = called.join(good, ["file", "callee"], "left_semi").select("file", "scope_node", F.lit(True).alias("reached")).distinct()
    rows = sites.join(found.select("file", "w_file", "a"), "file", "left").join(writes, ["w_file", "a"], "left").join(reached, ["file", "scope_node"], "left")
    quoted = f'"{name}"'
    message = (
        F.when(col("a").isNull(), f"No metadata writer {quoted} is defined or imported.")
        .when(~F.coalesce("writes", F.lit(False)), f"Metadata writer {quoted} does not write a run record.")
        .when(col("reached").isNull(), f"Metadata writer {quoted} is not called from the training entry / save path.")
    )
    return report(rows.withColumn("said", message).where("said IS NOT NULL"), "ml/metadata-writer-required", col("said"), f"Define {name} that writes the run record, and call it from the training entry / save path.")


def payloads(nodes: DataFrame, sites: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """sites that have a writer, with proven, keys and names of what it is given: dicts and environment keys within it, and arguments of its calls."""
    sited = sites.join(found, "file")
    texts = nodes.where("field = 'keys' AND kind = 'str'").select("file", col("parent").alias("node"), col("text").alias("key"))
    values = nodes.where("field = 'values' AND type = 'Name'").select("file", col("parent").alias("node"), col("name").alias("value"))
    dicts = nodes.where("type = 'Dict'").select("file", "node")
    none = F.lit(None).cast("string")
    of_dict = (
        dicts.join(texts, ["file", "node"]).select("file", "node", "key", none.alias("value"))
        .unionByName(dicts.join(values, ["file", "node"]).select("file", "node", none.alias("key"), "value"))
        .unionByName(dicts.select("file", "node", none.alias("key"), none.alias("value")))
    )
    environ = nodes.where("field = 'value' AND array_contains(chain, 'environ')").select("file", col("parent").alias("node"))
    sliced = nodes.where("field = 'slice' AND kind = 'str'").select("file", col("parent").alias("node"), col("text").alias("key")).join(environ, ["file", "node"], "left_semi").join(nodes.where("type = 'Subscript'").select("file", "node"), ["file", "node"], "left_semi")
    got = calls(nodes).where((last() == "getenv") | (last() == "get") & F.array_contains("chain", "environ")).select("file", "node", string(argument(0)).alias("key"))
    of_env = sliced.unionByName(got).where("key IS NOT NULL").select("file", "node", "key", none.alias("value"))
    # Within the writer.
    spans = sited.select("w_file", "a", "z").distinct().withColumnRenamed("w_file", "file")
    within = lambda rows, proven: inside(rows, spans).select(col("file").alias("w_file"), "a", "key", "value", F.lit(proven).alias("proven"))
    given = sited.select("file", "scope_node", "w_file", "a").join(within(of_dict, True).unionByName(within(of_env, False)), ["w_file", "a"]).select("file", "scope_node", "key", "value", "proven")
    given = storage.written(given, "given")
    # At its calls in the site's scope.
    body = own(nodes, sited)
    asked = storage.written(calls(body).where(last() == name).select("file", "scope_node", col("node").alias("call")), "asked")
    keywords = nodes.where("type = 'keyword'").select("file", col("parent").alias("call"), col("node").alias("kw"), col("name").alias("key"))
    kw_values = nodes.where("field = 'value' AND type = 'Name'").select("file", col("parent").alias("kw"), col("name").alias("value"))
    by_keyword = asked.join(keywords, ["file", "call"]).join(kw_values, ["file", "kw"], "left").select("file", "scope_node", "key", "value", col("key").isNotNull().alias("proven"))
    args = asked.join(nodes.where("field = 'args'").select("file", col("parent").alias("call"), "node", "type", "name"), ["file", "call"])
    # A name stands for the dict that the scope's own statements bound to it last.
    statements = nodes.where("field = 'body' AND type IN ('Assign', 'AnnAssign')").select("file", col("parent").alias("scope_node"), col("node").alias("stmt"))
    targets = nodes.where("(field = 'target' OR field = 'targets' AND ordinal = 0) AND type = 'Name'").select("file", col("parent").alias("stmt"), "name")
    bound = statements.join(targets, ["file", "stmt"]).join(nodes.where("field = 'value'").select("file", col("parent").alias("stmt"), col("node").alias("d"), col("type").alias("d_type")), ["file", "stmt"])
    bound = bound.groupBy("file", "scope_node", "name").agg(F.max_by(F.struct("d", "d_type"), "stmt").alias("b")).where("b.d_type = 'Dict'").select("file", "scope_node", "name", col("b.d").alias("node"))
    direct = args.where("type = 'Dict'").select("file", "scope_node", "node").unionByName(args.where("type = 'Name'").drop("node").join(bound, ["file", "scope_node", "name"]).select("file", "scope_node", "node"))
    by_arg = direct.join(of_dict, ["file", "node"]).select("file", "scope_node", "key", "value", F.lit(True).alias("proven"))
    every = given.unionByName(by_keyword).unionByName(by_arg)
    payload = every.groupBy("file", "scope_node").agg(F.bool_or("proven").alias("proven"), F.collect_set("key").alias("keys"), F.collect_set("value").alias("names"))
    return storage.written(sites.join(payload, ["file", "scope_node"]), "payloads")


@rule("ml/record-code-version", "python", "packages", options=schema(**WRITER_OPTIONS))
def record_code_version(inputs, options):
    nodes, name = sources(inputs), options.get("writerName") or WRITER
    found = payloads(nodes, gate_sites(nodes, options), writers(nodes, inputs["packages"], name), name)
    versioned = F.exists(F.array_union("keys", "names"), lambda x: F.lower(x).isin(*VERSION_KEYS))
    return report(found.where(col("proven") & ~versioned), "ml/record-code-version", f'Metadata writer "{name}" does not record a code version.', "Record git_commit / code_version (or equivalent allowlisted key) in the metadata writer payload.")


def required_names(nodes: DataFrame, sites: DataFrame) -> DataFrame:
    """file, scope_node, place and name of what a run takes: options of the file's parsers, and fields of the one config class that the scope makes."""
    texts = F.transform(F.filter("args", lambda x: x["kind"] == "str"), lambda x: x["text"])
    plain = F.get(F.filter(texts, lambda x: x.startswith("--") | ~x.startswith("-")), F.lit(0))
    short = F.get(F.filter(texts, lambda x: x.startswith("-")), F.lit(0))
    flag = F.when(plain.startswith("--"), F.translate(F.substring(plain, 3, 1 << 20), "-", "_")).otherwise(F.coalesce(plain, F.translate(F.regexp_replace(short, "^-", ""), "-", "_")))
    dests = calls(nodes).where(last() == "add_argument").select("file", col("node").alias("place"), F.coalesce(string(keyword("dest")), flag).alias("name")).where("name IS NOT NULL")
    bases = nodes.where((col("field") == "bases") & (last() == "BaseModel")).select("file", col("parent").alias("node")).distinct().withColumn("model", F.lit(True))
    classes = nodes.where("parent = 0 AND type = 'ClassDef'").join(bases, ["file", "node"], "left").where(F.arrays_overlap("decorators", F.array(F.lit("dataclass"), F.lit("define"))) | F.coalesce("model", F.lit(False)))
    classes = classes.groupBy("file", "name").agg(F.max("node").alias("cls"))
    made = calls(own(nodes, sites)).select("file", "scope_node", last().alias("name")).join(classes, ["file", "name"]).groupBy("file", "scope_node").agg(F.count_distinct("cls").alias("n"), F.min("cls").alias("cls")).where("n = 1")
    annotated = nodes.where("field = 'body' AND type = 'AnnAssign'").select("file", col("parent").alias("cls"), col("node").alias("stmt"))
    fields = annotated.join(nodes.where("field = 'target' AND type = 'Name'").select("file", col("parent").alias("stmt"), "name"), ["file", "stmt"])
    of_class = made.join(fields, ["file", "cls"]).select("file", "scope_node", (col("stmt") + (1 << 30)).alias("place"), "name")
    return sites.select("file", "scope_node").join(dests, "file").unionByName(of_class).groupBy("file", "scope_node", "name").agg(F.min("place").alias("place"))


@rule("ml/run-metadata-completeness", "python", "packages", options=schema(**WRITER_OPTIONS, allowExclusions=STRINGS))
def run_metadata_completeness(inputs, options):
    nodes, name = sources(inputs), options.get("writerName") or WRITER
    sites = gate_sites(nodes, options)
    found = payloads(nodes, sites, writers(nodes, inputs["packages"], name), name).where("proven")
    excluded = options.get("allowExclusions", [])
    lacking = found.join(required_names(nodes, sites), ["file", "scope_node"]).where(~F.array_contains("keys", col("name")))
    lacking = lacking.where(~col("name").isin(excluded)) if excluded else lacking
    rows = lacking.groupBy("file", "scope_node", *PLACE).agg(F.sort_array(F.collect_list(F.struct("place", "name"))).alias("m"))
    said = F.array_join(F.transform("m", lambda x: F.concat(F.lit('"'), x["name"], F.lit('"'))), ", ")
    return report(rows, "ml/run-metadata-completeness", F.concat(F.lit("Run metadata is missing "), said, F.lit(".")), f"Pass the missing dest/field into {name} or add it to allowExclusions if it does not affect results.")


@rule("ml/seed-must-reach-framework-rng", "python")
def seed_must_reach_framework_rng(inputs, options):
    nodes = sources(inputs)
    nodes = nodes.join(training_files(nodes), "file", "left_semi")
    scopes = nodes.where("type = 'Module' OR (type IN ('FunctionDef', 'AsyncFunctionDef') AND NOT nested)").select("file", col("node").alias("scope_node"))
    is_seed = lambda x: x["type"].isin("Name", "Attribute") & F.element_at(x["chain"], -1).isin(*SEEDS)
    takes = F.exists("args", is_seed) | F.exists(F.map_values("keywords"), is_seed)
    kind = (
        F.when(last().isin("train_test_split", "Random"), "nonsink")
        .when(last().isin("manual_seed", "seed") | (last() == "Generator") & F.map_contains_key("keywords", "seed") | (last() == "DataLoader") & F.map_contains_key("keywords", "generator") | F.array_contains("chain", "manual_seed"), "sink")
        .otherwise("unknown")
    )
    asked = calls(own(nodes, scopes)).where(takes).withColumn("k", kind)
    found = asked.groupBy("file", "scope_node").agg(F.bool_and(col("k") == "nonsink").alias("lost"), F.min_by(F.struct(*PLACE), "node").alias("at")).where("lost").select("file", "at.*")
    return report(found, "ml/seed-must-reach-framework-rng", "Seed value is used for split/local RNG but never reaches a framework RNG.", "Pass the seed into torch.manual_seed / numpy / random / loader generator.")


@rule("ml/determinism-test-required", "python", options=schema(entryPoints=STRINGS))
def determinism_test_required(inputs, options):
    nodes, tests = sources(inputs), inputs["python"].where(is_test(col("file")))
    wanted = entries(nodes, options).join(training_files(nodes), "file", "left_semi")
    named = tests.where("type IN ('Name', 'Attribute', 'alias')")
    refs = named.select(col("file").alias("test"), "name").unionByName(named.where("type = 'alias'").select(col("file").alias("test"), col("text").alias("name"))).where("name IS NOT NULL").distinct()
    counts = calls(tests).select(col("file").alias("test"), last().alias("callee")).groupBy("test", "callee").agg(F.count("*").alias("n"))
    usual = counts.where(col("callee").isin(*ENTRIES)).groupBy("test").agg(F.sum("n").alias("usual"))
    state = tests.where("array_contains(chain, 'state_dict') OR type = 'Attribute' AND name = 'state_dict'").select("file", col("node").alias("s"))
    compared = tests.where("type = 'Compare' AND array_contains(split(text, ','), 'Eq')").join(state, "file").where("node <= s AND s <= post").select(col("file").alias("test"))
    equal = calls(tests).where(last().isin(*EQUAL_CALLS)).select(col("file").alias("test")).unionByName(compared).distinct()
    names = wanted.select("name").distinct()
    twice = refs.join(names, "name").join(equal, "test", "left_semi").join(counts.select("test", col("callee").alias("name"), "n"), ["test", "name"], "left").join(usual, "test", "left")
    total = F.coalesce("usual", F.lit(0)) + F.when(col("name").isin(*ENTRIES), 0).otherwise(F.coalesce("n", F.lit(0)))
    found = wanted.join(twice.where(total >= 2).select("name").distinct(), "name", "left_anti")
    message = F.concat(F.lit('Training entry point "'), "name", F.lit('" has no test that runs twice and asserts identical weights.'))
    return report(found, "ml/determinism-test-required", message, "Add a test that runs the entry point twice under a fixed seed and asserts identical weights.")


#: What names an artifact.
ARTIFACT = r"(?i)checkpoint|artifact|weights|output|model\.pt|\.ckpt|\.safetensors|\.pth$|\.pt$|\.joblib$|\.pkl$"


@rule("ml/no-inplace-artifact-clobber", "python", "git")
def no_inplace_artifact_clobber(inputs, options):
    """git: path, from the root of the work tree, of the files that it tracks or that are dirty."""
    nodes = sources(inputs)
    first = F.get("chain", F.lit(0))
    saved = F.when((first == "torch") & (last() == "save"), string(F.coalesce(argument(1), keyword("f")))).when((first == "joblib") & (last() == "dump"), string(F.coalesce(argument(1), keyword("filename"))))
    mode = F.coalesce(string(keyword("mode")), string(argument(1)), F.lit(""))
    opened = F.when((last() == "open") & mode.isin("w", "wb"), string(argument(0)))
    paths = nodes.where("field = 'value' AND type = 'Call'").where(last() == "Path").select("file", col("parent").alias("func"), string(argument(0)).alias("path"))
    written = nodes.where("field = 'func' AND type = 'Attribute' AND name = 'write_bytes'").select("file", col("parent").alias("node"), col("node").alias("func")).join(paths, ["file", "func"]).select("file", "node", "path")
    sites = calls(nodes).join(written, ["file", "node"], "left").withColumn("saved", saved).withColumn("dest", F.coalesce("saved", opened, "path")).where("dest IS NOT NULL")
    sites = with_enclosing(sites, nodes)
    every = with_enclosing(calls(nodes), nodes).select("file", "enclosing", is_save().alias("is_save"), F.when(last() == "replace", string(F.coalesce(argument(1), argument(0)))).alias("target"))
    # The module as a scope holds every call of the file.
    every = every.unionByName(every.withColumn("enclosing", F.lit(0))).distinct()
    saves = every.where("is_save").select("file", "enclosing", F.lit(True).alias("saves")).distinct()
    replaced = every.where("target IS NOT NULL").select("file", "enclosing", col("target").alias("dest")).distinct()
    found = sites.join(saves, ["file", "enclosing"], "left").where(col("saved").isNotNull() | col("dest").rlike(ARTIFACT) | F.coalesce("saves", F.lit(False)))
    found = found.join(replaced, ["file", "enclosing", "dest"], "left_anti")
    bare = F.regexp_replace(F.translate("dest", "\\", "/"), r"^\./", "")
    beside = F.when(~bare.startswith("/"), F.concat(F.regexp_replace("file", "[^/]*$", ""), bare))
    tried = found.select("file", "node", *PLACE, F.posexplode(F.array(bare, beside)).alias("rank", "key")).where("key IS NOT NULL").join(inputs["git"].select(col("path").alias("key")).distinct(), "key")
    rows = tried.groupBy("file", "node", *PLACE).agg(F.min_by("key", "rank").alias("key"))
    message = F.concat(F.lit('In-place write clobbers tracked or dirty artifact path "'), "key", F.lit('".'))
    return report(rows, "ml/no-inplace-artifact-clobber", message, "Write to a staging path and os.replace onto the final name (or write under a unique run directory); do not clobber a tracked or dirty artifact path in place.")


#: Classes that fit, parts of names that infer, and paths that do.
TRANSFORMERS = (
    "StandardScaler", "MinMaxScaler", "RobustScaler", "Normalizer", "QuantileTransformer", "PowerTransformer", "PolynomialFeatures", "OneHotEncoder",
    "LabelEncoder", "OrdinalEncoder", "SimpleImputer", "KNNImputer", "PCA", "TruncatedSVD", "Pipeline", "make_pipeline",
)
HINTS = ("infer", "predict", "serve", "deploy", "forward_eval", "policy_step")
INFER_PATH = r"(?:^|/)(infer|inference|serving|deploy|predict)(?:/|_|\.py$)"


def hinted(name: Column) -> Column:
    return (name == "act") | name.rlike(rf"(?:^|_)(?:{'|'.join(HINTS)})(?:_|$)")


def is_model_call() -> Column:
    first, second = F.get("chain", F.lit(0)), F.get("chain", F.lit(1))
    named = (F.size("chain") == 1) & (first == "model") | (F.size("chain") == 2) & (first == "self") & second.isin("model", "policy", "net")
    return ~F.arrays_overlap("chain", F.array(F.lit("jit"), F.lit("trace"), F.lit("script"))) & ((last() == "forward") | named)


def aliases(nodes: DataFrame, scopes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(file, scope_node, name, source): names that a scope's own statements, in their order, bind to a node of seeds(file, node), or to such a name.

    A def's names include the module's. A file's statements are one group.
    """
    statements = nodes.where("field = 'body' AND type IN ('Assign', 'AnnAssign')").select("file", col("parent").alias("scope_node"), col("node").alias("stmt")).join(scopes.select("file", "scope_node").distinct(), ["file", "scope_node"], "left_semi")
    targets = nodes.where("(field = 'target' OR field = 'targets' AND ordinal = 0) AND type = 'Name'").select("file", col("parent").alias("stmt"), col("name").alias("target"))
    values = nodes.where("field = 'value'").select("file", col("parent").alias("stmt"), "node", F.when(col("type") == "Name", col("name")).alias("value")).join(seeds.select("file", "node", F.lit(True).alias("seed")).distinct(), ["file", "node"], "left")
    rows = statements.join(targets, ["file", "stmt"]).join(values, ["file", "stmt"]).select("file", "scope_node", "stmt", "target", "node", "value", F.coalesce("seed", F.lit(False)).alias("seed"))

    def follow(group: pd.DataFrame) -> pd.DataFrame:
        out, module = [], {}
        for scope, own_rows in sorted(group.groupby("scope_node"), key=lambda x: x[0]):
            known = module if scope == 0 else dict(module)
            for r in own_rows.sort_values("stmt").itertuples():
                source = r.node if r.seed else known.get(r.value)
                if source is not None:
                    known[r.target] = source
            out += [(group["file"].iloc[0], scope, name, source) for name, source in known.items()]
        return pd.DataFrame(out, columns=["file", "scope_node", "name", "source"]).astype({"file": object, "name": object})

    return rows.groupBy("file").applyInPandas(follow, "file string, scope_node int, name string, source int")


@rule("ml/no-refit-at-inference", "python")
def no_refit_at_inference(inputs, options):
    nodes = sources(inputs)
    loads = calls(nodes).where(last().isin("load_state_dict", "from_pretrained") | (last() == "load") & F.array_contains("chain", "torch")).select("file")
    infer = nodes.where(col("file").rlike(INFER_PATH)).select("file").unionByName(loads).distinct()
    defs = nodes.where(DEFS).select("file", col("node").alias("scope_node"), "post", "name", "class_name")
    forward = calls(nodes).where(is_model_call()).select("file", col("node").alias("f"))
    by_name = defs.where(hinted(col("name")) | hinted(col("class_name"))).join(forward, "file").where("scope_node < f AND f <= post").select("file", "scope_node")
    whole = nodes.where("type = 'Module'").select("file", col("node").alias("scope_node")).unionByName(defs.select("file", "scope_node")).join(infer, "file", "left_semi")
    scopes = whole.unionByName(by_name).distinct()
    body = own(nodes, scopes)
    fitting = nodes.where(last().isin(*TRANSFORMERS) & (col("type") != "Name"))
    names = aliases(nodes, scopes.unionByName(nodes.where("type = 'Module'").select("file", col("node").alias("scope_node"))), fitting)
    module = names.where("scope_node = 0").select("file", "name").distinct()
    known = names.select("file", "scope_node", "name").unionByName(scopes.join(module, "file").select("file", "scope_node", "name")).distinct().withColumn("known", F.lit(True))
    funcs = nodes.where("field = 'func' AND type = 'Attribute' AND name IN ('fit', 'fit_transform')").select("file", col("parent").alias("node"), col("node").alias("func"))
    holders = nodes.where("field = 'value'").select("file", col("parent").alias("func"), F.when(col("type") == "Name", col("name")).alias("name"), F.coalesce(last().isin(*TRANSFORMERS) & (col("type") != "Name"), F.lit(False)).alias("fits"))
    fits = calls(body).drop("name").join(funcs, ["file", "node"]).join(holders, ["file", "func"]).join(known, ["file", "scope_node", "name"], "left").where(col("fits") | F.coalesce("known", F.lit(False)))
    hint = "Use stats/transforms stored with the checkpoint (or fit only in training entry points); at serve call .transform with frozen parameters, never .fit / .fit_transform."
    refits = report(fits, "ml/no-refit-at-inference", "Transformer .fit/.fit_transform on an inference path recomputes batch statistics.", hint)
    stats = calls(body).where(last().isin("mean", "std") & (F.arrays_overlap("chain", F.array(F.lit("torch"), F.lit("np"), F.lit("numpy"))) | (F.size("chain") >= 2))).select("file", "scope_node", col("node").alias("source"), *PLACE)
    bound = aliases(nodes, scopes, stats.select("file", col("source").alias("node"))).withColumnRenamed("source", "bound")
    arithmetic = body.where("type IN ('BinOp', 'AugAssign') AND text IN ('Sub', 'Div')").select("file", "scope_node", col("node").alias("parent"))
    operands = nodes.where("field IN ('left', 'right', 'value')").select("file", "parent", "node", F.when(col("type") == "Name", col("name")).alias("name"))
    used = arithmetic.join(operands, ["file", "parent"]).join(bound, ["file", "scope_node", "name"], "left").select("file", "scope_node", F.coalesce("bound", "node").alias("source")).distinct()
    again = stats.join(used, ["file", "scope_node", "source"], "left_semi")
    return refits.unionByName(report(again, "ml/no-refit-at-inference", "Batch mean/std normalization on an inference path recomputes statistics from the current batch.", hint))
