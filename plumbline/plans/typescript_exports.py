"""Rules over what TypeScript files declare, import and call, and their chunks.

Inputs: declarations, import_names and call_sites (sources.typescript_decls), and files (path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import violations
from .engine import rule

EXTENSIONS = ("ts", "tsx", "mts", "cts")


def col(name: str) -> Column:
    return F.col(name)


def is_test(file: Column) -> Column:
    return file.rlike(r"\.(?:test|spec)\.[^/]*$") | file.rlike(r"(?:^|/)__tests__/")


def is_declaration(file: Column) -> Column:
    return file.rlike(r"\.d\.(?:ts|mts|cts)$")


def own(rows: DataFrame) -> DataFrame:
    return rows.where(~is_test(col("file")) & ~is_declaration(col("file")))


def public_name() -> Column:
    return F.when(col("is_default") | col("name").isNull(), F.lit("default")).otherwise(col("name"))


@rule("ts/explicit-public-return-types", "declarations")
def explicit_public_return_types(inputs, options):
    """A variable with a written type counts as typed, as what that type is cannot be inferred here."""
    rows = own(inputs["declarations"]).where("exported AND NOT declared AND NOT typed")
    functions = rows.where("top AND kind IN ('function', 'default_function') OR top AND kind = 'arrow' AND annotation IS NULL").withColumn("said", public_name())
    members = rows.where("kind IN ('method', 'getter') AND NOT hidden").withColumn("said", F.concat(F.coalesce("owner", F.lit("default")), F.lit("."), "name"))
    # An arrow function is reported where it stands, others at their names.
    found = functions.unionByName(members)
    places = {c: F.when(col("kind") == "arrow", col(f"whole.{c}")).otherwise(col(c)) for c in ("line", "col", "end_line", "end_col")}
    message = F.concat(F.lit('Public export "'), "said", F.lit('" is missing an explicit return type.'))
    return violations(found.withColumns(places), "ts/explicit-public-return-types", message, "Add an explicit return type annotation.")


#: Types that say nothing.
LOOSE = ("any", "any[]", "Function", "Object")


@rule("ts/no-public-any", "declarations")
def no_public_any(inputs, options):
    rows = own(inputs["declarations"]).where("exported AND top AND kind IN ('function', 'arrow', 'var', 'default', 'default_function')")
    typed = rows.select("file", public_name().alias("said"), F.explode("types").alias("t")).where(col("t.text").isin(*LOOSE))
    message = F.concat(F.lit('Public export "'), "said", F.lit('" is typed as any.'))
    return violations(typed.select("file", "said", "t.*"), "ts/no-public-any", message, "Replace any with a real type or unknown, then narrow.")


def import_targets(names: DataFrame, files: DataFrame) -> DataFrame:
    """names(file, said, ...) of relative imports with target: the file said, the same with a TypeScript ending, or its index."""
    relative = names.where("said LIKE './%' OR said LIKE '../%' OR said IN ('.', '..')")
    parts = F.concat(F.expr("slice(split(file, '/'), 1, size(split(file, '/')) - 1)"), F.split("said", "/"))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x.isin(".", ""), done).otherwise(F.concat(done, F.array(x))))
    path = F.array_join(walked, "/")
    stem = F.regexp_replace(path, r"\.[mc]?[jt]sx?$", "")
    tried = F.array(path, *[x for e in EXTENSIONS for x in (F.concat(stem, F.lit(f".{e}")), F.concat(path, F.lit(f"/index.{e}")))])
    ranked = relative.select(*names.columns, F.posexplode(tried).alias("rank", "target"))
    keys = names.columns
    return ranked.join(files.select(col("path").alias("target")).distinct(), "target").groupBy(*keys).agg(F.min_by("target", "rank").alias("target"))


@rule("ts/public-exports-tested", "declarations", "import_names", "files")
def public_exports_tested(inputs, options):
    rows = own(inputs["declarations"]).where("exported AND top AND kind <> 'expression'").withColumn("said", public_name())
    tests = inputs["import_names"].where(is_test(col("file")) & col("imported").isNotNull())
    used = import_targets(tests, inputs["files"]).select(col("target").alias("file"), col("imported").alias("said")).distinct()
    first = rows.groupBy("file", "said").agg(F.min_by(F.struct("line", "col", "end_line", "end_col"), "ord").alias("at")).select("file", "said", "at.*")
    found = first.join(used, ["file", "said"], "left_anti")
    message = F.concat(F.lit('Public export "'), "said", F.lit('" in '), "file", F.lit(" is not referenced from a test file."))
    return violations(found, "ts/public-exports-tested", message, F.concat(F.lit('Import "'), "said", F.lit('" from a test path (*.test.*, *.spec.*, or a __tests__/ directory).')))


#: Hooks that run effects, packages that fetch, and their methods.
EFFECTS, CLIENTS, METHODS = ("useEffect", "useLayoutEffect"), "axios|ky|got", ("get", "post", "put", "patch", "delete")


@rule("react/no-fetch-in-useeffect", "declarations", "import_names", "call_sites")
def no_fetch_in_useeffect(inputs, options):
    calls, names = inputs["call_sites"], inputs["import_names"]
    react = names.where("said = 'react' OR said LIKE 'react/%'")
    hooks = react.where(col("imported").isin(*EFFECTS)).select("file", col("local").alias("name"))
    spaces = react.where("imported IN ('default', '*')").select("file", col("local").alias("owner"))
    plain = calls.where("owner IS NULL").join(hooks, ["file", "name"])
    owned = calls.where(col("name").isin(*EFFECTS)).join(spaces, ["file", "owner"])
    effects = plain.unionByName(owned.select(*plain.columns)).where("callback IS NOT NULL").select("file", col("callback").alias("fn")).distinct()
    clients = names.where(col("said").rlike(f"^(?:{CLIENTS})(?:/|$)")).select("file", "local").distinct()
    local = inputs["declarations"].where("name = 'fetch' AND top AND kind IN ('function', 'arrow', 'var')").select("file").distinct()
    fetches = calls.where("owner IS NULL AND name = 'fetch'").join(local, "file", "left_anti").withColumn("api", F.lit("fetch"))
    direct = calls.where("owner IS NULL").join(clients.withColumnRenamed("local", "name"), ["file", "name"]).withColumn("api", col("name"))
    through = calls.where(col("name").isin(*METHODS)).join(clients.withColumnRenamed("local", "owner"), ["file", "owner"]).withColumn("api", F.concat("owner", F.lit("."), "name"))
    apis = fetches.unionByName(direct.select(*fetches.columns)).unionByName(through.select(*fetches.columns))
    found = apis.join(effects, ["file", "fn"])
    message = F.concat(F.lit("Do not call "), "api", F.lit(" inside useEffect or useLayoutEffect."))
    return violations(found, "react/no-fetch-in-useeffect", message, "Load this data with TanStack Query, SWR, a route loader, or an RSC fetch — not inside useEffect.")


def typescript_chunks(declared: DataFrame) -> DataFrame:
    """path, name, line, col, end_line, end_col, text and hash of the functions, methods, constructors and classes that are long enough; tests do not count."""
    rows = declared.where(~X.is_js_test_path(col("file"))).where("kind IN ('function', 'class', 'method', 'constructor', 'arrow') AND name IS NOT NULL")
    name = F.when(col("owner").isNotNull(), F.concat_ws(".", "owner", "name")).otherwise(col("name"))
    made = rows.where(X.eligible(col("text"))).select(col("file").alias("path"), name.alias("name"), "line", "col", "end_line", "end_col", X.normalized(col("text")).alias("text"))
    return made.withColumn("hash", F.sha2("text", 256))
