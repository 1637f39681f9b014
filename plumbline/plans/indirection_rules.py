"""Defs and classes that do not pay for their indirection: who uses what, within a package, over the table of Python nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import violations
from ..sources.python_ast import bindings, module_bindings
from ..storage import written
from .engine import rule
from .python_rules import INIT, calls, col, is_test, sources


def name_place(rows: DataFrame) -> DataFrame:
    """rows with end_line, col and end_col of the name that a def or class statement gives."""
    start = col("col") + F.when(col("type") == "ClassDef", 6).when(col("type") == "AsyncFunctionDef", 10).otherwise(4)
    return rows.withColumns({"col": start, "end_line": col("line"), "end_col": start + F.length("name")})


#: The columns of nodes that these rules read.
READ = ("file", "node", "parent", "field", "type", "name", "chain", "scope", "class_name", "nested", "line", "col", "end_line", "traits")


def units(inputs) -> DataFrame:
    """Nodes of sources and, as they may use them, of the tests of the same package, with pkg; written, as a rule reads them at some twenty places."""
    tests = inputs["python"].where(is_test(col("file")) & ~col("file").rlike(r"(?:^|/)(?:fixtures|__pycache__)(?:/|$)"))
    packages = inputs["packages"].select("file", col("package_dir").alias("pkg"))
    return written(sources(inputs).unionByName(tests).select(*READ).join(packages, "file", "left").withColumn("pkg", F.coalesce("pkg", F.lit(""))), "units")


def bound(inputs) -> tuple[DataFrame, DataFrame]:
    """(names, modules) that sources import from others of their package, at the top level; written, as they are joined again and again."""
    nodes, packages = sources(inputs), inputs["packages"]
    top = nodes.where("NOT (type IN ('Import', 'ImportFrom') AND parent <> 0)")
    own = packages.select("file", col("package_dir").alias("pkg"))
    other = packages.select(col("file").alias("target_file"), col("package_dir").alias("pkg"))
    same = lambda rows: rows.join(own, "file").join(other, ["target_file", "pkg"]).drop("pkg")
    return tuple(written(same(make(top, packages)).dropDuplicates(["file", "local"]), "bound") for make in (bindings, module_bindings))


def loads(nodes: DataFrame) -> DataFrame:
    """Names, and attributes of names, that are read and not called: file, pkg, name, owner, class_name, line, is_base."""
    read = nodes.where("array_contains(traits, 'load') AND (type = 'Name' OR type = 'Attribute' AND size(chain) = 2)")
    # An attribute's chain has two names only if it hangs on a name, or on what is none; the latter has no owner.
    held = nodes.where("field = 'value' AND type = 'Name'").select("file", col("parent").alias("node"), col("name").alias("owner"))
    rows = read.join(held, ["file", "node"], "left").where("type = 'Name' OR owner IS NOT NULL")
    return rows.select("file", "pkg", "name", F.when(col("type") == "Attribute", col("owner")).alias("owner"), "class_name", "line", F.array_contains("traits", "base").alias("is_base"))


def called(nodes: DataFrame) -> DataFrame:
    """Calls of names, of attributes of names, of made objects, and of attributes of self: file, pkg, name, owner, ctor, attr, class_name, line."""
    funcs = nodes.where("field = 'func'").select("file", col("parent").alias("node"), col("node").alias("func"), col("type").alias("f_type"), col("name").alias("f_name"))
    held = nodes.where("field = 'value'").select("file", col("parent").alias("func"), col("node").alias("v"), col("type").alias("v_type"), col("name").alias("v_name"), col("chain").alias("v_chain"))
    made = nodes.where("field = 'func' AND type = 'Name'").select("file", col("parent").alias("v"), col("name").alias("made"))
    rows = calls(nodes).drop("name").join(funcs, ["file", "node"]).join(held, ["file", "func"], "left").join(made, ["file", "v"], "left")
    is_name, on = col("f_type") == "Name", lambda kind: (col("f_type") == "Attribute") & (col("v_type") == kind)
    on_self = on("Attribute") & (F.size("v_chain") == 2) & F.get("v_chain", F.lit(0)).isin("self", "cls")
    kept = rows.where(is_name | on("Name") | on("Call") & col("made").isNotNull() | on_self)
    return kept.select("file", "pkg", col("f_name").alias("name"), F.when(on("Name"), col("v_name")).alias("owner"), F.when(on("Call"), col("made")).alias("ctor"), F.when(on_self, col("v_name")).alias("attr"), "class_name", "line")


def once(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, d_file and d_node of the definitions rows(file, node, ...) that are the only one of their keys."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(col("file").alias("d_file"), col("node").alias("d_node"))).alias("d"))
    return found.where("n = 1").select(*keys, "d.d_file", "d.d_node")


def attribute_classes(nodes: DataFrame, classes: DataFrame, names: DataFrame) -> DataFrame:
    """(file, class_name, attr, o_file, o_name): the class whose object, or which, a class's attribute is bound to, by its body or its __init__."""
    in_body = nodes.where("field = 'body'").select("file", col("parent").alias("at"), col("node").alias("stmt"), "type", "name")
    of_class = in_body.join(classes.select("file", col("node").alias("at"), col("name").alias("class_name")), ["file", "at"])
    inits = of_class.where("type IN ('FunctionDef', 'AsyncFunctionDef') AND name = '__init__'").select("file", col("at").alias("cls"), "class_name", col("stmt").alias("at"))
    statements = of_class.select("file", col("at").alias("cls"), "class_name", "stmt", F.lit(True).alias("plain")).unionByName(inits.join(in_body, ["file", "at"]).select("file", "cls", "class_name", "stmt", F.lit(False).alias("plain")))
    targets = nodes.where("field IN ('target', 'targets')").select("file", col("parent").alias("stmt"), "type", "name", "chain")
    on_self = (col("type") == "Attribute") & (F.size("chain") == 2) & F.get("chain", F.lit(0)).isin("self", "cls")
    bound_to = statements.join(targets, ["file", "stmt"]).where((col("type") == "Name") & col("plain") | on_self).select("file", "cls", "class_name", "stmt", col("name").alias("attr"))
    made = nodes.where("field = 'func' AND type = 'Name'").select("file", col("parent").alias("v"), col("name").alias("made"))
    values = nodes.where("field = 'value'").select("file", col("parent").alias("stmt"), col("node").alias("v"), F.when(col("type") == "Name", col("name")).alias("plain_name")).join(made, ["file", "v"], "left")
    values = values.join(nodes.where("type IN ('Assign', 'AnnAssign')").select("file", col("node").alias("stmt")), ["file", "stmt"], "left_semi").select("file", "stmt", F.coalesce("plain_name", "made").alias("rhs"))
    found = bound_to.join(values, ["file", "stmt"]).groupBy("file", "cls", "class_name", "attr").agg(F.bool_or(col("rhs").isNull()).alias("bad"), F.collect_set("rhs").alias("rhs")).where("NOT bad AND size(rhs) = 1").withColumn("rhs", F.get("rhs", F.lit(0)))
    found = found.join(once(classes, "file", "name").select("file", col("name").alias("class_name"), col("d_node").alias("cls")), ["file", "class_name", "cls"])
    # The class of that name: imported, or of the file, or the only one of the package.
    imported = names.select("file", col("local").alias("rhs"), col("target_file").alias("i_file"), col("target_name").alias("i_name"))
    here = classes.groupBy("file", col("name").alias("rhs")).agg(F.count("*").alias("here"))
    anywhere = once(classes, "pkg", "name").select("pkg", col("name").alias("rhs"), col("d_file").alias("p_file"))
    found = found.join(classes.select("file", "pkg").distinct(), "file").join(imported, ["file", "rhs"], "left").join(here, ["file", "rhs"], "left").join(anywhere, ["pkg", "rhs"], "left")
    o_file = F.when(col("i_file").isNotNull(), col("i_file")).when(col("here") == 1, col("file")).when(col("here").isNull(), col("p_file"))
    return found.select("file", "class_name", "attr", o_file.alias("o_file"), F.coalesce("i_name", "rhs").alias("o_name")).where("o_file IS NOT NULL")


def outside(place: str = "ref_line") -> Column:
    """Whether a reference's line is not one of the definition's."""
    return ~((col("d_line") <= col(place)) & (col(place) <= col("d_end")))


def cost(rows: DataFrame, rule_id: str, uses: Column, unused: str, hints: tuple[str, str]) -> DataFrame:
    quoted = F.concat(F.lit('"'), "name", F.lit('"'))
    message = F.when(uses == 0, F.concat(quoted, F.lit(f" {unused} and does not pay for the indirection."))).otherwise(F.concat(quoted, F.lit(" is only used once and does not pay for the indirection.")))
    return violations(name_place(rows), rule_id, message, F.when(uses == 0, hints[0]).otherwise(hints[1]))


@rule("python/no-unnecessary-def", "python", "packages")
def no_unnecessary_def(inputs, options):
    nodes = units(inputs)
    plain = nodes.where(~is_test(col("file")))
    scopes = plain.where("type = 'ClassDef'").select("file", col("node").alias("scope"), col("name").alias("cls"))
    defs = plain.where("type IN ('FunctionDef', 'AsyncFunctionDef')").join(scopes, ["file", "scope"], "left").withColumn("cls", F.coalesce("cls", F.lit("")))
    classes = plain.where("type = 'ClassDef'")
    names, modules = bound(inputs)
    none = F.lit(None).cast("string")
    refs = called(nodes).withColumn("is_call", F.lit(True)).unionByName(loads(nodes).drop("is_base").withColumns({"ctor": none, "attr": none, "is_call": F.lit(False)}))
    own_class = written(attribute_classes(plain, classes, names), "attributes")
    rows = (
        refs.join(names.select("file", col("local").alias("name"), col("target_file").alias("n_file"), col("target_name").alias("n_name")), ["file", "name"], "left")
        .join(modules.select("file", col("local").alias("owner"), col("target_file").alias("m_file")), ["file", "owner"], "left")
        .join(own_class, ["file", "class_name", "attr"], "left")
    )
    is_self = F.coalesce(col("owner").isin("self", "cls"), F.lit(False))
    simple, owned = col("ctor").isNull() & col("attr").isNull(), col("owner").isNotNull()
    where = lambda own, module, imported, here, attribute: F.when(col("attr").isNotNull(), attribute).when(simple & is_self, own).when(simple & owned, module).when(simple & col("n_file").isNotNull(), imported).when(simple, here)
    rows = rows.withColumns({
        "w_file": where(col("file"), col("m_file"), col("n_file"), col("file"), col("o_file")),
        "w_name": where(col("name"), col("name"), col("n_name"), col("name"), col("name")),
        "w_cls": where(col("class_name"), F.lit(""), F.lit(""), F.lit(""), col("o_name")),
        "loose": simple & owned & ~is_self & col("m_file").isNull(),
    })
    exact = once(defs, "file", "name", "cls").select(col("file").alias("w_file"), col("name").alias("w_name"), col("cls").alias("w_cls"), col("d_file").alias("e_file"), col("d_node").alias("e_node"))
    methods = defs.where("cls <> ''")
    by_name = once(methods, "pkg", "name").select("pkg", "name", col("d_file").alias("g_file"), col("d_node").alias("g_node"))
    by_ctor = once(methods, "pkg", "cls", "name").select("pkg", col("cls").alias("ctor"), "name", col("d_file").alias("c_file"), col("d_node").alias("c_node"))
    rows = rows.join(exact, ["w_file", "w_name", "w_cls"], "left").join(by_name, ["pkg", "name"], "left").join(by_ctor, ["pkg", "ctor", "name"], "left")
    pick = lambda x: F.when(col("ctor").isNotNull(), col(f"c_{x}")).when(col("loose"), col(f"g_{x}")).otherwise(col(f"e_{x}"))
    rows = written(rows.select("pkg", col("file").alias("ref_file"), col("line").alias("ref_line"), "name", "attr", "loose", "is_call", pick("file").alias("d_file"), pick("node").alias("d_node")), "refs")
    spans = defs.select("pkg", "name", "cls", col("file").alias("d_file"), col("node").alias("d_node"), col("line").alias("d_line"), col("end_line").alias("d_end"))
    hit = rows.where("d_node IS NOT NULL").drop("pkg", "name").join(spans, ["d_file", "d_node"])
    uses = hit.where(col("is_call") & ((col("ref_file") != col("d_file")) | outside())).groupBy("d_file", "d_node").agg(F.count("*").alias("uses"))
    read = hit.where(~col("is_call") & outside()).select("d_file", "d_node")
    # What could be any of several methods counts as read for all of them.
    several = methods.groupBy("pkg", "name").agg(F.count("*").alias("n"))
    open_refs = rows.where("d_node IS NULL").drop("d_file", "d_node").join(several, ["pkg", "name"]).where(col("loose") & (col("n") >= 2) | col("attr").isNotNull())
    open_refs = open_refs.join(spans.where("cls <> ''"), ["pkg", "name"]).where((col("ref_file") != col("d_file")) | outside()).select("d_file", "d_node")
    read = read.unionByName(open_refs).distinct()
    # Methods of classes whose bases all come from elsewhere answer to them.
    bases = plain.where("field = 'bases'").select("file", col("parent").alias("node"), "type", "name", "chain")
    known = classes.select(col("file").alias("k_file"), col("name").alias("k_name")).distinct()
    base = F.when(col("type") == "Name", col("name")).when((col("type") == "Attribute") & (F.size("chain") == 2), F.get("chain", F.lit(0)))
    bases = bases.withColumn("local", base).join(names.select("file", "local", col("target_file").alias("n_file"), "target_name"), ["file", "local"], "left").join(modules.select("file", "local", col("target_file").alias("m_file")), ["file", "local"], "left")
    is_name = col("type") == "Name"
    bases = bases.withColumns({"k_file": F.when(is_name, F.coalesce("n_file", "file")).otherwise(col("m_file")), "k_name": F.when(is_name, F.coalesce("target_name", "name")).otherwise(col("name"))})
    bases = bases.join(known.withColumn("ours", F.lit(True)), ["k_file", "k_name"], "left")
    foreign = bases.groupBy("file", "node").agg(F.bool_or(F.coalesce("ours", F.lit(False))).alias("ours")).where("NOT ours").join(classes.select("file", "node", col("name").alias("cls")), ["file", "node"]).select("file", "cls").distinct()
    dunder = col("name").rlike(r"^__\w+__$")
    found = defs.where(~col("file").rlike(INIT) & ~dunder & F.arrays_overlap("traits", F.array(F.lit("passes"), F.lit("small"))))
    key = lambda rows: rows.withColumnRenamed("d_file", "file").withColumnRenamed("d_node", "node")
    found = found.join(foreign, ["file", "cls"], "left_anti").join(key(read), ["file", "node"], "left_anti").join(key(uses), ["file", "node"], "left").withColumn("uses", F.coalesce("uses", F.lit(0))).where("uses <= 1")
    hints = ("Remove this helper, or wait for a second real use before keeping the indirection.", "Inline at its only use, or keep only if the name still hides real complexity; wait for a second real use before keeping a pass-through.")
    return cost(found, "python/no-unnecessary-def", col("uses"), "is not used", hints)


@rule("python/no-unnecessary-class", "python", "packages")
def no_unnecessary_class(inputs, options):
    nodes = units(inputs)
    classes = nodes.where(~is_test(col("file"))).where("type = 'ClassDef' AND NOT nested")
    names, modules = bound(inputs)
    # A base may be subscripted.
    bases = nodes.where("field = 'bases'").select("file", "pkg", "node", "type", "name", "chain", "line")
    inner = nodes.where("field = 'value'").select("file", col("parent").alias("node"), col("type").alias("i_type"), col("name").alias("i_name"), col("chain").alias("i_chain"), col("line").alias("i_line"))
    sub = bases.where("type = 'Subscript'").join(inner, ["file", "node"]).select("file", "pkg", col("i_type").alias("type"), col("i_name").alias("name"), col("i_chain").alias("chain"), col("i_line").alias("line"))
    either = bases.where("type <> 'Subscript'").select(*sub.columns).unionByName(sub)
    based = either.where("type = 'Name' OR type = 'Attribute' AND size(chain) = 2").select("file", "pkg", "name", F.when(col("type") == "Attribute", F.get("chain", F.lit(0))).alias("owner"), "line")
    used = called(nodes).where("ctor IS NULL AND attr IS NULL").select("file", "pkg", "name", "owner", "line").unionByName(based)
    refs = used.withColumn("is_use", F.lit(True)).unionByName(loads(nodes).where("NOT is_base").select(*used.columns).withColumn("is_use", F.lit(False)))
    rows = refs.join(names.select("file", col("local").alias("name"), col("target_file").alias("n_file"), col("target_name").alias("n_name")), ["file", "name"], "left").join(modules.select("file", col("local").alias("owner"), col("target_file").alias("m_file")), ["file", "owner"], "left")
    owned = col("owner").isNotNull()
    rows = rows.select(col("file").alias("ref_file"), col("line").alias("ref_line"), "is_use", F.when(owned, col("m_file")).otherwise(F.coalesce("n_file", "file")).alias("file"), F.when(owned, col("name")).otherwise(F.coalesce("n_name", "name")).alias("name"))
    spans = classes.select(col("file").alias("d_file"), col("node").alias("d_node"), col("line").alias("d_line"), col("end_line").alias("d_end"))
    hit = rows.join(once(classes, "file", "name"), ["file", "name"]).join(spans, ["d_file", "d_node"])
    key = lambda rows: rows.withColumnRenamed("d_file", "file").withColumnRenamed("d_node", "node")
    uses = key(hit.where(col("is_use") & ((col("ref_file") != col("d_file")) | outside())).groupBy("d_file", "d_node").agg(F.count("*").alias("uses")))
    read = key(hit.where(~col("is_use") & outside()).select("d_file", "d_node").distinct())
    found = classes.where(~F.array_contains("traits", "stands") & F.arrays_overlap("traits", F.array(F.lit("thin"), F.lit("passes"))))
    found = found.join(read, ["file", "node"], "left_anti").join(uses, ["file", "node"], "left").withColumn("uses", F.coalesce("uses", F.lit(0))).where("uses <= 1")
    hints = ("Remove this class, or wait for a second instantiation or subclass before keeping the indirection.", "Inline at its only instantiation or subclass, or wait for a second use before keeping the class.")
    return cost(found, "python/no-unnecessary-class", col("uses"), "is not instantiated or subclassed", hints)
