"""Rules over Python syntax nodes, each a relational expression over one flat table.

nodes is the table of sources.python_ast; every join is on the file, so a file's nodes meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import violations
from ..sources.python_ast import bindings, module_bindings
from .. import storage
from .engine import rule

CUDA = r"^cuda(:[0-9]+)?\z"
INIT = r"(?:^|/)__init__\.py$"


def col(name: str) -> Column:
    return F.col(name)


def is_test(path: Column) -> Column:
    return path.rlike(r"(?:^|/)(?:conftest\.py|[^/]*_test\.py|test_[^/]*\.py)$") | path.rlike(r"(?:^|/)(?:tests|__tests__)(?:/|$)")


def is_skipped(path: Column) -> Column:
    return path.endswith(".pyi") | is_test(path) | path.rlike(r"(?:^|/)(?:fixtures|__pycache__)(?:/|$)")


def sources(inputs) -> DataFrame:
    return inputs["python"].where(~is_skipped(col("file")))


def last() -> Column:
    return F.when(F.size("chain") > 0, F.element_at("chain", -1))


def calls(nodes: DataFrame) -> DataFrame:
    return nodes.where("type = 'Call'")


def kids(nodes: DataFrame, field: str, prefix: str) -> DataFrame:
    """Children in a field: file, parent and the columns most asked for, under a prefix."""
    return nodes.where(col("field") == field).select("file", col("parent").alias("node"), *[col(c).alias(f"{prefix}{c}") for c in ("node", "type", "name", "ordinal", "kind", "text", "chain", "line", "col", "end_line", "end_col")])


def methods(nodes: DataFrame, *names: str) -> DataFrame:
    """Calls of an attribute of one of these names."""
    funcs = nodes.where((col("field") == "func") & (col("type") == "Attribute") & col("name").isin(*names)).select("file", col("parent").alias("node"), col("name").alias("method"))
    return calls(nodes).join(funcs, ["file", "node"])


def first_in(rows: DataFrame, *keys: str) -> DataFrame:
    """The first row by place for each of keys."""
    w = Window.partitionBy(*keys).orderBy("line", "col", "node")
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


# --- python/

#: Constructors of mutable collections, and methods that change a list of paths.
MUTABLE, MUTATORS = ("list", "dict", "set"), ("insert", "append", "extend")


@rule("python/no-bare-except", "python")
def no_bare_except(inputs, options):
    nodes = sources(inputs)
    handlers = nodes.where("type = 'ExceptHandler'")
    types = kids(nodes, "type", "t_")
    base = (col("t_type") == "Name") & (col("t_name") == "BaseException")
    # Names of a tuple or list are the children of the handler's type.
    inside = nodes.where("field = 'elts' AND type = 'Name' AND name = 'BaseException'").select("file", col("parent").alias("t_node"), F.lit(True).alias("has")).distinct()
    found = handlers.join(types, ["file", "node"], "left").join(inside, ["file", "t_node"], "left")
    bare = col("t_node").isNull()
    found = found.where(bare | base | (col("t_type").isin("Tuple", "List") & F.coalesce("has", F.lit(False))))
    message = F.when(bare, "Bare except: catches BaseException, including KeyboardInterrupt and SystemExit.").otherwise("except BaseException catches KeyboardInterrupt and SystemExit.")
    return violations(found, "python/no-bare-except", message, "Catch a specific exception type (or Exception if that is intended) and re-raise BaseException subclasses that must not be swallowed.")


def _siblings(nodes: DataFrame, *types: str) -> DataFrame:
    """file, node and the type and value of the statement behind each statement of these types."""
    blocks = nodes.where(col("field").isin("body", "orelse", "finalbody"))
    w = Window.partitionBy("file", "parent", "field").orderBy("ordinal")
    valued = kids(nodes, "value", "v_").select("file", "node", F.lit(True).alias("valued"))
    return blocks.join(valued, ["file", "node"], "left").select("file", "node", "type", "post", F.lead("type").over(w).alias("next_type"), F.lead("valued").over(w).alias("next_valued")).where(col("type").isin(*types))


@rule("python/no-silent-except", "python")
def no_silent_except(inputs, options):
    nodes = sources(inputs)
    handlers = nodes.where("type = 'ExceptHandler'")
    constants = kids(nodes, "value", "v_").where("v_type = 'Constant'").select("file", "node", col("v_kind").alias("v"), col("v_text").alias("t"))
    body = nodes.where("field = 'body'").join(constants, ["file", "node"], "left")
    text = (col("type") == "Expr") & (col("v") == "str")
    kind = (
        F.when((col("type") == "Pass") | (col("type") == "Expr") & ((col("v") == "ellipsis") | text & (col("t") == "Ellipsis")), "pass")
        .when(col("type") == "Continue", "continue")
        .when(text, "string")
    )
    silent = body.withColumn("k", kind).groupBy("file", col("parent").alias("node")).agg(F.count("*").alias("n"), F.count("k").alias("noops"), F.collect_set("k").alias("kinds")).where("n = noops")
    found = handlers.join(silent, ["file", "node"])
    # The innermost loop, and the innermost try, around a handler: an interval join within the file.
    around = _siblings(nodes, "For", "AsyncFor", "While", "Try", "TryStar").select("file", col("node").alias("a"), col("post").alias("z"), col("type").alias("a_type"), "next_type", "next_valued")
    inner = found.select("file", "node").join(around, "file").where("a < node AND node <= z")
    is_try = col("a_type").isin("Try", "TryStar")
    pick = lambda which: F.max(F.when(which, F.struct("a", "next_type", "next_valued")))
    inner = inner.groupBy("file", "node").agg(pick(~is_try).alias("loop"), pick(is_try).alias("attempt"))
    found = found.join(inner, ["file", "node"], "left")
    only = lambda k: (F.size("kinds") == 1) & F.array_contains("kinds", k)
    after = col("attempt.next_type")
    quiet = only("continue") & col("loop.next_type").isin("Raise", "Return") | only("pass") & (after.isin("Return", "Raise", "Assign") | (after == "AnnAssign") & F.coalesce(col("attempt.next_valued"), F.lit(False)))
    return violations(found.where(~F.coalesce(quiet, F.lit(False))), "python/no-silent-except", "Exception handler body is only pass, ellipsis, continue, or a string — the exception is swallowed.", "Log and re-raise, catch a narrower type, or handle with a real branch, return, or raise.")


@rule("python/no-open-without-with", "python")
def no_open_without_with(inputs, options):
    nodes = sources(inputs)
    opens = nodes.where("type = 'Name' AND name = 'open' AND field = 'func'").select("file", col("parent").alias("node"))
    parents = nodes.select("file", col("node").alias("parent"), col("type").alias("p_type"))
    targets = nodes.where("field IN ('targets', 'target')").groupBy("file", "parent").agg(F.bool_and(col("type") == "Name").alias("named"))
    found = calls(nodes).where("field = 'value'").join(opens, ["file", "node"]).join(parents, ["file", "parent"]).join(targets, ["file", "parent"], "left")
    return violations(found.where("p_type = 'Expr' OR (p_type IN ('Assign', 'AnnAssign') AND named)"), "python/no-open-without-with", "open(...) is not used as a with / async with context manager.", "Use with open(...) as …: (or pathlib.Path.open in with).")


def listed_names(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The string nodes of each file's one plain __all__, and the files that have any __all__ at all."""
    stored = nodes.where("type = 'Name' AND name = '__all__' AND field IN ('targets', 'target')").select("file", col("parent").alias("stmt"))
    statements = stored.join(nodes.where("parent = 0 AND type IN ('Assign', 'AnnAssign', 'AugAssign')").select("file", col("node").alias("stmt"), col("type").alias("s_type")), ["file", "stmt"])
    counted = statements.groupBy("file").agg(F.count("*").alias("n"), F.bool_or(col("s_type") == "AugAssign").alias("grown"), F.first("stmt").alias("stmt"))
    lists = nodes.where("field = 'value' AND type IN ('List', 'Tuple')").select("file", col("parent").alias("stmt"), col("node").alias("list"))
    items = nodes.where("field = 'elts'").withColumnRenamed("parent", "list")
    plain = items.groupBy("file", "list").agg(F.bool_and(F.coalesce(col("kind") == "str", F.lit(False))).alias("plain")).where("plain").select("file", "list")
    good = counted.where("n = 1 AND NOT grown").join(lists, ["file", "stmt"]).join(plain, ["file", "list"]).select("file", "list")
    return items.join(good, ["file", "list"], "left_semi"), counted.select("file")


def public_callables(nodes: DataFrame) -> DataFrame:
    """Defs that others may call: not nested, no private name or class, no overload; in an __init__ only those that one plain __all__ lists."""
    defs = nodes.where("type IN ('FunctionDef', 'AsyncFunctionDef') AND NOT nested AND NOT startswith(name, '_') AND NOT startswith(class_name, '_')").where(~F.array_contains("decorators", "overload"))
    names = listed_names(nodes)[0].groupBy("file").agg(F.collect_set("text").alias("names"))
    in_init = col("file").rlike(INIT)
    return defs.join(names, "file", "left").where(~in_init | F.coalesce(F.expr("array_contains(names, name)"), F.lit(False)))


@rule("python/public-exports-tested", "python", "packages")
def public_exports_tested(inputs, options):
    """Public names of an __init__ that no test refers to, neither by that name nor by the one it was imported from."""
    nodes, packages = inputs["python"], inputs["packages"]
    inits = sources(inputs).where(col("file").rlike(INIT))
    listed, stated = listed_names(inits)
    place = ("line", "col", "end_line", "end_col")
    top = inits.where("parent = 0").select("file", col("node").alias("parent"), col("type").alias("p_type"))
    reexported = inits.where("type = 'alias' AND name <> '*'").join(top.where("p_type = 'ImportFrom'"), ["file", "parent"]).select("file", F.coalesce("text", "name").alias("export"), *place)
    single = inits.where("field = 'targets'").groupBy("file", "parent").agg(F.count("*").alias("n")).where("n = 1").select("file", "parent")
    assigned = inits.where("field = 'targets' AND type = 'Name'").join(top.where("p_type = 'Assign'"), ["file", "parent"]).join(single, ["file", "parent"])
    source = inits.where("field = 'value' AND type = 'Name'").select("file", "parent", col("name").alias("source"))
    aliased = assigned.join(source, ["file", "parent"]).select("file", col("name").alias("export"), "source", *place)
    free = reexported.unionByName(aliased.drop("source")).join(stated, "file", "left_anti")
    public = listed.select("file", col("text").alias("export"), *place).unionByName(free).where("NOT startswith(export, '_')")
    tests = nodes.where(is_test(col("file")))
    named = storage.written(bindings(nodes, packages), "bindings")
    in_tests = tests.select("file").distinct()
    direct = named.join(in_tests, "file", "left_semi").select(col("target_file").alias("t_file"), col("target_name").alias("t_name"))
    attributes = tests.where("type = 'Attribute' AND size(chain) = 2").select("file", col("chain")[0].alias("local"), col("name").alias("t_name"))
    by_module = attributes.join(module_bindings(nodes, packages), ["file", "local"]).select(col("target_file").alias("t_file"), "t_name")
    tested = direct.unionByName(by_module).distinct()
    origin = named.select("file", col("local").alias("export"), col("target_file").alias("o_file"), col("target_name").alias("o_name"))
    through = aliased.select("file", "export", "source").join(named.withColumnRenamed("local", "source"), ["file", "source"]).select("file", "export", col("target_file").alias("o_file"), col("target_name").alias("o_name"))
    by_name = tested.select(col("t_file").alias("file"), col("t_name").alias("export"))
    by_origin = origin.unionByName(through).join(tested, (col("o_file") == col("t_file")) & (col("o_name") == col("t_name"))).select("file", "export")
    found = public.join(by_name.unionByName(by_origin).distinct(), ["file", "export"], "left_anti")
    return violations(found, "python/public-exports-tested", F.concat(F.lit('Public export "'), "export", F.lit('" is not referenced from a test.')), F.concat(F.lit('Add a test import of "'), "export", F.lit('", or stop exporting it.')))


def at_name(rows: DataFrame) -> DataFrame:
    """rows of defs whose place is that of the name."""
    start = col("col") + F.when(col("type") == "AsyncFunctionDef", 10).otherwise(4)
    return rows.withColumns({"col": start, "end_line": col("line"), "end_col": start + F.length("name")})


@rule("python/require-typed-public", "python")
def require_typed_public(inputs, options):
    bare = F.exists("params", lambda p: ~p["name"].isin("self", "cls") & p["annotation"].isNull()) | col("returns").isNull()
    found = at_name(public_callables(sources(inputs)).where(bare))
    return violations(found, "python/require-typed-public", F.concat(F.lit('"'), "name", F.lit('" is public and is missing parameter or return annotations.')), "Add type annotations to every parameter (including *args/**kwargs) and the return type.")


@rule("python/no-public-any", "python")
def no_public_any(inputs, options):
    nodes = sources(inputs)
    top = nodes.where("parent = 0")
    imported = nodes.where("type = 'alias' AND name = 'Any'").join(top.where("type = 'ImportFrom' AND name = 'typing'").select("file", col("node").alias("parent")), ["file", "parent"])
    imported = imported.where("text IS NOT NULL").select("file", col("text").alias("alias"))
    anys = kids(nodes, "value", "v_").where("(v_type = 'Name' AND v_name = 'Any') OR v_chain = array('typing', 'Any')").select("file", "node")
    assigned = top.where("type = 'Assign'").join(anys, ["file", "node"]).join(kids(nodes, "targets", "t_").where("t_type = 'Name'").select("file", "node", "t_name"), ["file", "node"]).select("file", col("t_name").alias("alias"))
    aliases = imported.unionByName(assigned).groupBy("file").agg(F.collect_set("alias").alias("aliases"))
    known = F.coalesce("aliases", F.array().cast("array<string>"))
    is_any = lambda v: v.isNotNull() & ((v["type"] == "Name") & ((v["chain"][0] == "Any") | F.array_contains(known, v["chain"][0])) | (v["type"] == "Attribute") & (v["chain"] == F.array(F.lit("typing"), F.lit("Any"))))
    bare = F.exists("params", lambda p: p["role"].isin("pos", "arg", "kwonly") & F.coalesce(is_any(p["annotation"]), F.lit(False))) | F.coalesce(is_any(col("returns")), F.lit(False))
    found = at_name(public_callables(nodes).join(aliases, "file", "left").where(bare))
    return violations(found, "python/no-public-any", F.concat(F.lit('"'), "name", F.lit('" is public and annotates a parameter or return type as Any.')), "Replace Any with a real type, object, or a Protocol/TypedDict as appropriate.")


@rule("python/no-mutable-default", "python")
def no_mutable_default(inputs, options):
    nodes = sources(inputs)
    top = nodes.where("parent = 0")
    made = kids(nodes, "value", "v_").where((col("v_type") == "Name") & col("v_name").isin(*MUTABLE)).select("file", "node")
    targets = nodes.where("field IN ('targets', 'target')").groupBy("file", col("parent").alias("node")).agg(F.count("*").alias("n"), F.first("name").alias("alias"), F.first("type").alias("t"))
    assigned = top.where("type IN ('Assign', 'AnnAssign')").join(made, ["file", "node"]).join(targets.where("n = 1 AND t = 'Name'"), ["file", "node"]).select("file", "alias")
    func = kids(nodes, "func", "f_").where("f_type = 'Name'").select("file", "node", "f_name")
    literal = nodes.where("type IN ('List', 'Dict', 'Set')").select("file", "node")
    made_call = calls(nodes).join(func.where(col("f_name").isin(*MUTABLE)), ["file", "node"]).select("file", "node")
    mutable = literal.unionByName(made_call)
    # A factory is a top-level def whose body is one return of such an expression.
    body = nodes.where("field = 'body'").groupBy("file", col("parent").alias("fn_node")).agg(F.count("*").alias("n"), F.first("type").alias("t"), F.first("node").alias("parent")).where("n = 1 AND t = 'Return'")
    returned = nodes.where("field = 'value'").join(mutable, ["file", "node"]).select("file", "parent").join(body, ["file", "parent"]).select("file", col("fn_node").alias("node"))
    factories = top.where("type IN ('FunctionDef', 'AsyncFunctionDef')").join(returned, ["file", "node"]).select("file", col("name").alias("alias"))
    named = assigned.unionByName(factories).distinct()
    called = calls(nodes).join(func.join(named, (func["file"] == named["file"]) & (func["f_name"] == named["alias"])).select(func["file"], "node"), ["file", "node"]).select("file", "node")
    defaults = nodes.where("field IN ('defaults', 'kw_defaults')")
    arguments = nodes.where("type = 'arguments'").join(nodes.where("type IN ('FunctionDef', 'AsyncFunctionDef')").select("file", col("node").alias("parent")), ["file", "parent"]).select("file", col("node").alias("parent"))
    found = defaults.join(mutable.unionByName(called).distinct(), ["file", "node"]).join(arguments, ["file", "parent"])
    return violations(found, "python/no-mutable-default", "Mutable default argument is shared across calls.", "Use None as the default and assign a new list/dict/set inside the body, or use an immutable default.")


@rule("python/no-sys-path-hack", "python")
def no_sys_path_hack(inputs, options):
    nodes = sources(inputs)
    owner = nodes.where("type IN ('Import', 'ImportFrom')").select("file", col("node").alias("parent"), col("type").alias("p_type"), col("name").alias("module"))
    alias = nodes.where("type = 'alias'").join(owner, ["file", "parent"]).select("file", col("node").alias("at"), col("name"), F.coalesce("text", "name").alias("local"), "p_type", "module")
    binds = alias.select("file", "at", "local", F.when((col("p_type") == "Import") & (col("name") == "sys"), "sys").when((col("p_type") == "ImportFrom") & (col("module") == "sys") & (col("name") == "path"), "path").when((col("p_type") == "ImportFrom") & (col("module") == "sys") & (col("name") == "path_hooks"), "hooks").alias("bound")).where("bound IS NOT NULL")
    changed = methods(nodes, *MUTATORS).select("file", "node", F.slice("chain", 1, F.size("chain") - 1).alias("target"))
    written = nodes.where("field IN ('targets', 'target')").join(nodes.where("type IN ('Assign', 'AugAssign')").select("file", col("node").alias("parent")), ["file", "parent"])
    inner = kids(nodes, "value", "v_").select("file", "node", "v_chain")
    stored = written.join(inner, ["file", "node"], "left").select("file", col("parent").alias("node"), F.when(col("type") == "Subscript", col("v_chain")).otherwise(col("chain")).alias("target"))
    sites = changed.unionByName(stored).where("size(target) IN (1, 2)").withColumn("local", col("target")[0])
    # A bind counts for what stands behind it in the walk.
    hit = sites.join(binds, ["file", "local"]).where("at < node")
    tail = F.when(F.size("target") == 2, F.element_at("target", 2))
    kind = F.when((F.size("target") == 1) & (col("bound") != "sys"), col("bound")).when((col("bound") == "sys") & (tail == "path"), "path").when((col("bound") == "sys") & (tail == "path_hooks"), "hooks")
    found = nodes.join(hit.withColumn("kind_", kind).where("kind_ IS NOT NULL").select("file", "node", "kind_").distinct(), ["file", "node"])
    message = F.concat(F.lit("sys."), F.when(col("kind_") == "path", "path").otherwise("path_hooks"), F.lit(" is mutated at runtime to fix imports."))
    return violations(found, "python/no-sys-path-hack", message, "Install the package editable or use a proper package layout; do not mutate sys.path at runtime.")


# --- ml/

#: Names that optimizers go by, casts that return a new tensor, and receivers that are modules.
OPTIMIZERS = ("optimizer", "opt", "optim")
CASTS, MODULES = ("to", "cuda", "cpu", "float", "half", "double", "bfloat16"), ("model", "self", "net", "module")


def in_functions(nodes: DataFrame) -> DataFrame:
    """What stands in a def's own body: not in defs or classes within."""
    defs = nodes.where("type IN ('FunctionDef', 'AsyncFunctionDef')").select("file", col("node").alias("scope"))
    return nodes.join(defs, ["file", "scope"], "left_semi")


@rule("ml/optimizer-zero-grad", "python")
def optimizer_zero_grad(inputs, options):
    body = in_functions(sources(inputs))
    holder = F.slice("chain", 1, F.greatest(F.size("chain") - 1, F.lit(0)))
    step = (last() == "step") & (F.coalesce(F.lower(F.when(F.size("chain") > 1, F.element_at("chain", -2))).isin(*OPTIMIZERS), F.lit(False)) | F.arrays_overlap(holder, F.array(F.lit("optimizer"), F.lit("Optimizer"))))
    backward = methods(body, "backward").select("file", "scope").distinct()
    zero = calls(body).where(last() == "zero_grad").select("file", "scope").distinct()
    found = first_in(calls(body).where(step), "file", "scope").join(backward, ["file", "scope"], "left_semi").join(zero, ["file", "scope"], "left_anti")
    return violations(found, "ml/optimizer-zero-grad", "Training step calls backward and optimizer.step without zero_grad.", "Call optimizer.zero_grad() before each accumulation window (or once per step if not accumulating).")


@rule("ml/train-mode-restored", "python")
def train_mode_restored(inputs, options):
    steps = methods(in_functions(sources(inputs)), "eval", "train", "backward")
    ahead = Window.partitionBy("file", "scope").orderBy(F.desc("line"), F.desc("col"), F.desc("node")).rowsBetween(Window.unboundedPreceding, -1)
    # Behind the call, at a later place: the nearest backward, and the nearest train.
    place = lambda kind: F.last(F.when(col("method") == kind, F.struct("line", "col")), ignorenulls=True).over(ahead)
    after = steps.withColumn("b", place("backward")).withColumn("t", place("train")).where("method = 'eval' AND b IS NOT NULL")
    found = after.where(col("t").isNull() | (col("b") <= col("t")))
    return violations(found, "ml/train-mode-restored", "model.eval() in a training function is not followed by model.train() before the next backward.", "Call model.train() after the validation/eval pass before the next training step.")


def literal_cuda(value: Column) -> Column:
    return F.coalesce((value["kind"] == "str") & value["text"].rlike(CUDA), F.lit(False))


@rule("ml/no-cuda-hardcoded", "python")
def no_cuda_hardcoded(inputs, options):
    nodes = sources(inputs)
    method = methods(nodes, "cuda").select("file", "node", F.lit(True).alias("is_cuda"))
    found = calls(nodes).join(method, ["file", "node"], "left")
    hit = col("is_cuda").isNotNull() | literal_cuda(F.try_element_at("keywords", F.lit("device"))) | last().isin("to", "device") & literal_cuda(F.get("args", F.lit(0)))
    return violations(found.where(F.coalesce(hit, F.lit(False))), "ml/no-cuda-hardcoded", "CUDA device is hardcoded; this breaks CPU-only environments.", 'Take device from config/arg; use torch.device("cuda" if torch.cuda.is_available() else "cpu") or equivalent resolved device.')


@rule("ml/dataloader-worker-seeding", "python")
def dataloader_worker_seeding(inputs, options):
    workers = F.try_element_at("keywords", F.lit("num_workers"))
    many = (workers["kind"] == "int") & (F.expr("try_cast(element_at(keywords, 'num_workers').text AS INT)") > 0)
    seeded = F.map_contains_key("keywords", "worker_init_fn") | F.map_contains_key("keywords", "generator")
    found = calls(sources(inputs)).where((last() == "DataLoader") & F.coalesce(many, F.lit(False)) & ~seeded)
    return violations(found, "ml/dataloader-worker-seeding", "DataLoader(num_workers>0) is missing worker_init_fn and generator.", "Add worker_init_fn and/or generator= seeded from the run seed.")


@rule("ml/tensor-to-device-result-ignored", "python")
def tensor_to_device_result_ignored(inputs, options):
    nodes = sources(inputs)
    alone = nodes.where("type = 'Expr'").select("file", col("node").alias("parent"))
    found = calls(nodes).where("field = 'value'").join(alone, ["file", "parent"], "left_semi")
    moved = (last() != "to") | (F.size("args") > 0) | F.map_contains_key("keywords", "device") | F.map_contains_key("keywords", "dtype")
    quiet = last().isin("to", "cuda") & F.coalesce(F.when(F.size("chain") > 1, F.element_at("chain", -2)).isin(*MODULES), F.lit(False))
    return violations(found.where(last().isin(*CASTS) & moved & ~quiet), "ml/tensor-to-device-result-ignored", "tensor.to/cuda/cpu/float result is ignored; the call does not mutate in place.", "Assign the result (x = x.to(device)), or use in-place only on modules.")


@rule("ml/tf32-must-be-explicit", "python")
def tf32_must_be_explicit(inputs, options):
    nodes = sources(inputs)
    flags = nodes.where((col("field") == "targets") & (last() == "allow_tf32")).groupBy("file").agg(F.bool_or(F.array_contains("chain", "matmul")).alias("matmul"), F.bool_or(F.array_contains("chain", "cudnn")).alias("cudnn"))
    arg = F.get("args", F.lit(0))
    made = calls(nodes).where((col("field") == "args") & (col("ordinal") == 0) & (last() == "device") & (literal_cuda(F.get("args", F.lit(0))) | F.get("args", F.lit(0)).isNull() & literal_cuda(F.try_element_at("keywords", F.lit("type"))))).select("file", col("parent").alias("node"), F.lit(True).alias("by_device"))
    moves = calls(nodes).join(made, ["file", "node"], "left").where(F.coalesce((last() == "cuda") | literal_cuda(F.try_element_at("keywords", F.lit("device"))) | (last() == "to") & (literal_cuda(arg) | F.coalesce("by_device", F.lit(False))), F.lit(False)))
    w = Window.partitionBy("file").orderBy("node")
    found = moves.withColumn("_k", F.row_number().over(w)).where("_k = 1").join(flags.where("matmul AND cudnn"), "file", "left_anti")
    return violations(found, "ml/tf32-must-be-explicit", "CUDA device move without explicit torch.backends.cuda.matmul.allow_tf32 and torch.backends.cudnn.allow_tf32.", "Set both allow_tf32 flags explicitly next to device setup.")


@rule("ml/no-network-in-tests", "python")
def no_network_in_tests(inputs, options):
    weights, pretrained = (F.try_element_at("keywords", F.lit(k)) for k in ("weights", "pretrained"))
    by_weights = (weights["type"] == "Attribute") | (weights["kind"] == "str") | (weights["kind"] == "bool") & (weights["text"] == "True")
    hit = last().isin("from_pretrained", "hf_hub_download") | (last() == "load") & F.array_contains("chain", "hub") | (pretrained["kind"] == "bool") & (pretrained["text"] == "True") | by_weights
    found = calls(inputs["python"].where(is_test(col("file")))).where(F.coalesce(hit, F.lit(False)))
    return violations(found, "ml/no-network-in-tests", "Test module downloads weights (pretrained/from_pretrained/hub).", "Build encoders/models with pretrained=False / weights=None in tests; use fixtures or local tiny weights.")


def training(nodes: DataFrame) -> DataFrame:
    """The first node by place, for each file that trains: a backward call or a data loader."""
    loaders = calls(nodes).where(last() == "DataLoader").select(*nodes.columns)
    return first_in(loaders.unionByName(methods(nodes, "backward").select(*nodes.columns)), "file")


@rule("ml/deterministic-algorithms-opt-in", "python", recommended="off")
def deterministic_algorithms_opt_in(inputs, options):
    nodes = sources(inputs)
    called = calls(nodes).where(last() == "use_deterministic_algorithms").select("file")
    true = nodes.where("field = 'value' AND kind = 'bool' AND text = 'True'").select("file", "parent")
    flags = nodes.where(col("field").isin("targets", "target") & (last() == "deterministic") & F.array_contains("chain", "cudnn")).join(true, ["file", "parent"]).select("file")
    found = training(nodes).join(called.unionByName(flags), "file", "left_anti")
    return violations(found, "ml/deterministic-algorithms-opt-in", "Training module does not call torch.use_deterministic_algorithms or set cudnn.deterministic.", "Call torch.use_deterministic_algorithms(True) or set cudnn.deterministic.")


def module_binds(nodes: DataFrame) -> DataFrame:
    """file, local, module and imported (null for a whole module) of imports at the top level."""
    stated = nodes.where("parent = 0 AND type IN ('Import', 'ImportFrom')").where("type = 'Import' OR (text = '0' AND name IS NOT NULL)").select("file", col("node").alias("parent"), col("type").alias("how"), col("name").alias("module"))
    found = nodes.where("type = 'alias' AND name <> '*'").join(stated, ["file", "parent"])
    whole = col("how") == "Import"
    return found.select("file", F.coalesce("text", F.when(whole, F.split("name", r"\.")[0]).otherwise(col("name"))).alias("local"), F.when(whole, col("name")).otherwise(col("module")).alias("module"), F.when(~whole, col("name")).alias("imported"))


@rule("ml/require-global-seed", "python")
def require_global_seed(inputs, options):
    nodes = sources(inputs)
    first = training(nodes)
    binds = module_binds(nodes)
    of = lambda name: (col("module") == name) | col("module").startswith(f"{name}.")
    size, seeds = F.size("chain"), calls(nodes).withColumn("local", F.get("chain", F.lit(0))).join(binds, ["file", "local"])
    seed = last() == "seed"
    torch = (col("module") == "torch") & (col("imported") == "manual_seed") & (size == 1) | (last() == "manual_seed") & (F.coalesce(F.get("chain", F.lit(1)), F.lit("")) != "cuda") & of("torch") & col("imported").isNull()
    random = seed & ((col("module") == "random") & (col("imported") == "seed") & (size == 1) | (size == 2) & of("random") & col("imported").isNull())
    numpy = seed & (col("module").isin("numpy", "numpy.random") & (col("imported") == "seed") & (size == 1) | (size > 1) & ((col("module") == "numpy.random") | (col("imported") == "random") & (col("module") == "numpy") | of("numpy") & F.array_contains("chain", "random")))
    kind = F.when(F.coalesce(torch, F.lit(False)), "torch.manual_seed").when(F.coalesce(random, F.lit(False)), "random.seed").when(F.coalesce(numpy, F.lit(False)), "np.random.seed")
    seeds = seeds.withColumn("seed", kind).where("seed IS NOT NULL").dropDuplicates(["file", "node"])
    seeded = seeds.groupBy("file").agg(F.collect_set("seed").alias("seeded"))
    needed = binds.groupBy("file").agg(F.bool_or(of("random")).alias("random"), F.bool_or(of("numpy")).alias("numpy"))
    none = F.lit(None).cast("string")
    required = F.array_compact(F.array(F.lit("torch.manual_seed"), F.when(col("random"), "random.seed").otherwise(none), F.when(col("numpy"), "np.random.seed").otherwise(none)))
    state = first.join(needed, "file", "left").join(seeded, "file", "left").withColumn("missing", F.array_except(required, F.coalesce("seeded", F.array().cast("array<string>"))))
    hint = "Call torch.manual_seed (and random.seed / np.random.seed as needed) before loaders/model init."
    short = violations(state.where(F.size("missing") > 0), "ml/require-global-seed", F.concat(F.lit("Training module is missing "), F.array_join("missing", ", "), F.lit(" before DataLoader or model init.")), hint)
    # What consumes randomness first: a loader, or where there is none a torch.nn construction.
    uses = calls(nodes).select("file", F.when(last() == "DataLoader", 0).when((size > 1) & (F.get("chain", F.greatest(size - 2, F.lit(0))) == "nn"), 1).alias("rank"), F.struct("line", "col").alias("at")).where("rank IS NOT NULL")
    consumer = uses.groupBy("file").agg(F.min(F.struct("rank", "at")).alias("use")).select("file", col("use.at").alias("at"))
    late = seeds.join(state.where(F.size("missing") == 0).select("file"), "file", "left_semi").join(consumer, "file").where(F.struct("line", "col") >= col("at"))
    w = Window.partitionBy("file").orderBy("node")
    late = late.withColumn("_k", F.row_number().over(w)).where("_k = 1")
    return short.unionByName(violations(late, "ml/require-global-seed", "Seed calls appear after the first DataLoader or torch.nn construction.", hint))


#: Names that recurrent layers go by.
RECURRENT = ("rnn", "lstm", "gru")


@rule("ml/pack-padded-sequence-before-rnn", "python")
def pack_padded_sequence_before_rnn(inputs, options):
    body = in_functions(sources(inputs))
    lower = F.transform("chain", F.lower)
    is_rnn = F.coalesce(F.lower(last()).isin(*RECURRENT) | (F.lower(last()) == "forward") & F.arrays_overlap(lower, F.array(*[F.lit(x) for x in RECURRENT])), F.lit(False))
    at = F.struct("line", "col")
    packs = calls(body).where(last().isin("pack_padded_sequence", "pack_sequence")).groupBy("file", "scope").agg(F.min(at).alias("packed"))
    rnns = calls(body).where(is_rnn).join(packs, ["file", "scope"], "left").where(col("packed").isNull() | (at <= col("packed")))
    ones = body.where("field = 'slice' AND kind = 'int' AND text = '1'").select("file", "parent")
    indexed = body.where("type = 'Subscript'").select("file", "scope", col("node").alias("parent"), at.alias("used")).join(ones, ["file", "parent"])
    direct = rnns.where("field = 'value'").join(indexed.select("file", "parent"), ["file", "parent"], "left_semi").select("file", "node")
    # The value of an assignment: its name indexed by one later, or the names of its second target read later.
    stored = rnns.where("field = 'value'").join(body.where("type IN ('Assign', 'AnnAssign')").select("file", col("node").alias("parent"), at.alias("stored")), ["file", "parent"]).select("file", "scope", "node", col("parent").alias("stmt"), "stored")
    targets = body.where("field IN ('targets', 'target')").select("file", col("parent").alias("stmt"), col("node").alias("target"), col("type").alias("t_type"), col("name").alias("t_name"))
    aimed = stored.join(targets, ["file", "stmt"])
    by_name = body.where("field = 'value' AND type = 'Name'").select("file", "scope", "parent", col("name").alias("t_name")).join(indexed, ["file", "scope", "parent"])
    by_index = aimed.where("t_type = 'Name'").join(by_name, ["file", "scope", "t_name"]).where("stored < used").select("file", "node")
    second = body.where("field = 'elts' AND ordinal = 1").select("file", col("parent").alias("target"), col("node").alias("inner"), col("type").alias("i_type"), col("name").alias("i_name"))
    pairs = aimed.where("t_type = 'Tuple'").join(second, ["file", "target"])
    inside = body.where("field = 'elts' AND type = 'Name'").select("file", col("parent").alias("inner"), col("name").alias("hidden"))
    names = pairs.where("i_type = 'Name'").select("file", "scope", "node", "stored", col("i_name").alias("hidden")).unionByName(pairs.where("i_type = 'Tuple'").join(inside, ["file", "inner"]).select("file", "scope", "node", "stored", "hidden")).where("hidden <> '_'")
    written = body.where("type = 'Name' AND field IN ('targets', 'target')").select("file", "node")
    reads = body.where("type = 'Name'").join(written, ["file", "node"], "left_anti").select("file", "scope", col("name").alias("hidden"), at.alias("used"))
    by_unpack = names.join(reads, ["file", "scope", "hidden"]).where("stored < used").select("file", "node")
    found = rnns.join(direct.unionByName(by_index).unionByName(by_unpack).distinct(), ["file", "node"], "left_semi")
    return violations(found, "ml/pack-padded-sequence-before-rnn", "RNN/LSTM/GRU consumes h_n from a padded sequence without pack_padded_sequence.", "Call pack_padded_sequence (or pack_sequence) before the RNN when consuming h_n.")


#: Contexts and decorators that switch gradients off.
GUARDS = ("no_grad", "inference_mode")


@rule("ml/inference-mode-required", "python")
def inference_mode_required(inputs, options):
    nodes = sources(inputs)
    defs = nodes.where("type IN ('FunctionDef', 'AsyncFunctionDef')").select("file", col("node").alias("scope"), col("post").alias("d_post"), F.arrays_overlap("decorators", F.array(*[F.lit(g) for g in GUARDS])).alias("decorated"))
    backward = methods(nodes, "backward").select("file", col("node").alias("b"))
    trains = defs.join(backward, "file").where("scope < b AND b <= d_post").select("file", "scope").distinct()
    own = in_functions(nodes).join(trains, ["file", "scope"], "left_anti")
    lambdas = own.where("type = 'Lambda'").select("file", "scope", col("node").alias("l"), col("post").alias("l_post"))
    inside = calls(own).select("file", "scope", "node").join(lambdas, ["file", "scope"]).where("l < node AND node <= l_post").select("file", "node").distinct()
    called = calls(own).join(inside, ["file", "node"], "left_anti")
    size = F.size("chain")
    pair = (size == 2) & (F.get("chain", F.lit(0)) == "self") & F.get("chain", F.lit(1)).isin("model", "policy", "net")
    traced = F.arrays_overlap("chain", F.array(F.lit("jit"), F.lit("trace"), F.lit("script")))
    forward = called.where(F.coalesce((last() == "forward") | (size == 1) & (last() == "model") & (F.get("chain", F.lit(0)) == "model") | pair, F.lit(False)) & ~traced)
    evals = called.where(last() == "eval").groupBy("file", "scope").agg(F.min(F.struct("line", "col")).alias("first_eval"))
    # A with statement guards its body, not its items; the innermost one that says anything counts.
    items = own.where("type = 'withitem'").select("file", col("node").alias("item"), "parent", "ordinal", "post")
    said = own.where("field = 'context_expr'").select("file", col("parent").alias("item"), F.when(last().isin(*GUARDS), True).when(last() == "enable_grad", False).alias("on"))
    told = items.join(said, ["file", "item"]).groupBy("file", col("parent").alias("w")).agg(F.max("post").alias("after"), F.max_by("on", F.when(col("on").isNotNull(), col("ordinal"))).alias("on")).where("on IS NOT NULL")
    withs = own.where("type IN ('With', 'AsyncWith')").select("file", "scope", col("node").alias("w"), col("post").alias("w_post")).join(told, ["file", "w"])
    guard = forward.select("file", "scope", "node").join(withs, ["file", "scope"]).where("after < node AND node <= w_post").groupBy("file", "node").agg(F.max_by("on", "w").alias("on"))
    losses = own.where("field IN ('targets', 'target') AND type = 'Name' AND name = 'loss'").select("file", "parent").distinct()
    values = own.where("field = 'value'").join(losses, ["file", "parent"]).select("file", "scope", col("node").alias("v"), col("post").alias("v_post"))
    in_loss = forward.select("file", "scope", "node").join(values, ["file", "scope"]).where("v <= node AND node <= v_post").select("file", "node").distinct()
    state = forward.join(in_loss, ["file", "node"], "left_anti").join(guard, ["file", "node"], "left").join(evals, ["file", "scope"], "left").join(defs.select("file", "scope", "decorated"), ["file", "scope"])
    guarded = F.coalesce("on", "decorated")
    evaluated = F.coalesce(col("first_eval") < F.struct("line", "col"), F.lit(False))
    none = F.lit(None).cast("string")
    missing = F.array_join(F.array_compact(F.array(F.when(~guarded, "torch.inference_mode()/no_grad").otherwise(none), F.when(~evaluated, "model.eval()").otherwise(none))), " and ")
    return violations(state.withColumn("missing", missing).where("missing <> ''"), "ml/inference-mode-required", F.concat(F.lit("Inference forward is missing "), "missing", F.lit(".")), "Wrap inference forwards in torch.inference_mode() (or no_grad) and call model.eval() before serve/predict.")
