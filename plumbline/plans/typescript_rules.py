"""Rules over TypeScript tokens: those that words and brackets can decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import NO_SUGGESTION, violations
from .engine import rule


def col(name: str) -> Column:
    return F.col(name)


def checked(inputs) -> DataFrame:
    """Tokens of files that are no declarations or tests; fixtures count."""
    file = col("file")
    return inputs["typescript"].where(~file.rlike(r"\.d\.(?:ts|mts|cts)$") & ~file.rlike(r"\.(?:test|spec)\.[^/]*$") & ~file.rlike(r"(?:^|/)__tests__/"))


def with_near(tokens: DataFrame, behind: int = 0, ahead: int = 0) -> DataFrame:
    """tokens with the tokens around: p1, p2, ... before and n1, n2, ... behind, as structs."""
    w = Window.partitionBy("file").orderBy("ord")
    token = F.struct("kind", "text", "pair", "line", "col", "end_line", "end_col", "ord")
    near = {f"p{k}": F.lag(token, k).over(w) for k in range(1, behind + 1)} | {f"n{k}": F.lead(token, k).over(w) for k in range(1, ahead + 1)}
    return tokens.withColumns(near)


def at(tokens: DataFrame, prefix: str) -> DataFrame:
    """tokens keyed by file and {prefix}_ord, for a join on a place."""
    return tokens.select("file", col("ord").alias(f"{prefix}_ord"), *[col(c).alias(f"{prefix}_{c}") for c in ("text", "kind", "pair", "end_line", "end_col")])


@rule("ts/no-empty-catch", "typescript")
def no_empty_catch(inputs, options):
    tokens = checked(inputs)
    catches = with_near(tokens, 1, 1).where("kind = 'word' AND text = 'catch' AND coalesce(p1.text, '') NOT IN ('.', '?.')")
    body = F.when(col("n1.text") == "(", col("n1.pair") + 1).when(col("n1.text") == "{", col("ord") + 1)
    found = catches.withColumn("b_ord", body).join(at(tokens, "b"), ["file", "b_ord"]).where("b_text = '{' AND b_pair = b_ord + 1").withColumn("z_ord", col("b_pair"))
    found = found.join(at(tokens, "z"), ["file", "z_ord"])
    return violations(found, "ts/no-empty-catch", "Empty catch swallows errors.", "Handle the error, rethrow, or throw.", end_line="z_end_line", end_col="z_end_col")


@rule("ts/no-export-star", "typescript")
def no_export_star(inputs, options):
    found = with_near(checked(inputs), 0, 6).where("kind = 'word' AND text = 'export'")
    plain = (col("n1.text") == "*") & (col("n2.text") == "from")
    named = (col("n1.text") == "*") & (col("n2.text") == "as") & (col("n4.text") == "from")
    typed = (col("n1.text") == "type") & (col("n2.text") == "*")
    typed_plain, typed_named = typed & (col("n3.text") == "from"), typed & (col("n3.text") == "as") & (col("n5.text") == "from")
    end = F.when(plain, col("n3")).when(named, col("n5")).when(typed_plain, col("n4")).when(typed_named, col("n6"))
    found = found.withColumn("z", end).where("z.kind = 'string'")
    return violations(found, "ts/no-export-star", "Star export hides the public surface.", 'Replace with explicit named re-exports (export { A, B } from "…").', end_line="z.end_line", end_col="z.end_col")


#: Words that stand where an operand may follow, so that a ! behind them negates.
NO_OPERANDS = ("return", "typeof", "case", "in", "of", "new", "delete", "void", "throw", "do", "else", "yield", "await", "instanceof", "if", "while", "export", "default", "extends", "as", "is", "keyof")


@rule("ts/no-non-null-assertion", "typescript")
def no_non_null_assertion(inputs, options):
    found = with_near(checked(inputs), 1, 1).where("kind = 'mark' AND text = '!' AND p1.end_line = line")
    operand = ((col("p1.kind") == "word") & ~col("p1.text").isin(*NO_OPERANDS)) | col("p1.text").isin(")", "]") | col("p1.kind").isin("string", "template")
    # A definite assignment (name!: type) is no expression.
    found = found.where(operand & (F.coalesce(col("n1.text"), F.lit("")) != ":"))
    return violations(found, "ts/no-non-null-assertion", "Non-null assertion hides an undefined or null possibility.", "Narrow with a type guard, provide a default, or throw.", line="p1.line", col="p1.col")


@rule("ts/no-unsafe-assertion", "typescript")
def no_unsafe_assertion(inputs, options):
    near = with_near(checked(inputs), 1, 4)
    operand = (col("p1.kind") != "mark") | col("p1.text").isin(")", "]", "}", "!")
    part = F.coalesce(col("n2.text"), F.lit("")).isin(".", "[", "<", "|", "&")
    as_any = (col("text") == "as") & operand & (col("n1.text") == "any") & ~part
    through = (col("text") == "as") & operand & (col("n1.text") == "unknown") & ((col("n2.text") == "as") | (col("n2.text") == ")") & (col("n3.text") == "as"))
    angle = (col("text") == "<") & (col("n1.text") == "any") & (col("n2.text") == ">") & ~F.coalesce((col("p1.kind") == "word") & ~col("p1.text").isin(*NO_OPERANDS), F.lit(False)) & ((col("n3.kind") != "mark") | col("n3.text").isin("(", "[", "{"))
    found = near.where(F.coalesce((col("kind") == "word") & (as_any | through) | (col("kind") == "mark") & angle, F.lit(False)))
    return violations(found, "ts/no-unsafe-assertion", "Unsafe type assertion erases type safety.", "Narrow with a type guard, schema parse, or fix the upstream type.", end_line="n1.end_line", end_col="n1.end_col")


@rule("dev/concrete-suggestion", "typescript")
def concrete_suggestion(inputs, options):
    """Reports whose suggestion is the sentinel for none: its text, or its name, also as a member. A name that an import has changed is not followed."""
    near = with_near(checked(inputs), 0, 5)
    reports = near.where("kind = 'word' AND text = 'report' AND n1.text = '(' AND n2.text = '{' AND n2.pair IS NOT NULL").select("file", col("n2.ord").alias("a"), col("n2.pair").alias("z"))
    ends = lambda token: token["text"].isin(",", "}")
    said = col("n2.kind").isin("string", "template") & (F.expr("substring(n2.text, 2, length(n2.text) - 2)") == NO_SUGGESTION) & ends(col("n3"))
    named = (col("n2.text") == "NO_SUGGESTION") & ends(col("n3"))
    member = (col("n3.text") == ".") & (col("n4.text") == "NO_SUGGESTION") & ends(col("n5"))
    given = near.where("kind = 'word' AND text = 'suggestion' AND n1.text = ':'").where(F.coalesce(said | named | member, F.lit(False))).withColumn("last", F.when(member, col("n4")).otherwise(col("n2")))
    found = given.join(reports, "file").where("a < ord AND ord < z").dropDuplicates(["file", "ord"])
    message = "Product rules must not report the NO_SUGGESTION sentinel."
    return violations(found, "dev/concrete-suggestion", message, "Pass a concrete suggestion that tells another agent how to fix the violation.", line="n2.line", col="n2.col", end_line="last.end_line", end_col="last.end_col")
