"""Text functions with the white-space rules of the checks: all of Unicode's, not blanks only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_LINES, MIN_TOKENS = 5, 20
#: The characters that Unicode calls white space.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def normalized(text: Column) -> Column:
    """Trimmed, with runs of blank lines reduced to one blank line."""
    return F.regexp_replace(trimmed(text), r"\n(?:[ \t]*\n)+", "\n\n")


def filled_lines(text: Column) -> Column:
    """The number of lines that are not blank."""
    return F.size(F.filter(F.split(text, "\n", -1), lambda x: trimmed(x) != ""))


def token_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+", -1), lambda x: x != ""))


def eligible(text: Column) -> Column:
    """Whether a chunk is long enough to be compared."""
    return (filled_lines(text) >= MIN_LINES) & (token_count(text) >= MIN_TOKENS)


def is_js_test_path(path: Column) -> Column:
    """Declarations, tests and fixtures of TypeScript."""
    return path.rlike(r"\.d\.(?:ts|mts|cts)$") | path.rlike(r"\.(?:test|spec)\.[^/]*$") | path.rlike(r"(?:^|/)(?:__tests__|fixtures)/")


def is_python_test_path(path: Column) -> Column:
    """Stubs, tests and fixtures of Python, as chunk extraction skips them."""
    return path.rlike(r"(?:^|/)(?:conftest\.py|test_[^/]*|[^/]*(?:\.pyi|_test\.py|\.test\.py|\.spec\.py))$") | path.rlike(r"(?:^|/)(?:tests|__tests__|fixtures|__pycache__)/")


def glob_regex(glob: str) -> str:
    """A path glob with **, *, ? and {a,b} as a regular expression for whole paths."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 2
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 1
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += "\\" + c if c in r".+^$()[]|\{}" else c
        i += 1
    return f"^{out}$"
