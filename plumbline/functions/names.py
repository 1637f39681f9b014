"""Names of constants: normal form, tokens and gates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One prefix and one suffix are taken off, the first that fits.
PREFIXES = ("DEFAULT_", "LEGACY_", "CFG_", "CONFIG_")
SUFFIXES = ("_SECONDS", "_STEPS", "_COUNT", "_SEC", "_MS", "_S", "_N")
#: Words of names that set a threshold, the token that does too, and the default limits.
LEXICON = ("cap", "budget", "threshold", "timeout", "tolerance", "deadline", "limit", "max_steps", "min_steps")
FORCE = "FORCE"
TOKEN_JACCARD, NAME_COSINE = 0.85, 0.92


def normal(name: Column) -> Column:
    """Upper snake case without one prefix and one suffix, unless nothing were left."""
    upper = F.upper(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))
    bare = F.regexp_replace(upper, f"^(?:{'|'.join(PREFIXES)})(?=.)", "")
    return F.regexp_replace(bare, f"(?<=.)(?:{'|'.join(SUFFIXES)})$", "")


def tokens(name: Column) -> Column:
    """The distinct parts of the normal form."""
    return F.array_distinct(F.filter(F.split(normal(name), "_"), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays taken as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def gated(name: Column, patterns: tuple[str, ...] = ()) -> Column:
    """Whether a name sets a threshold: by a pattern with *, a word of the lexicon, or the forcing token."""
    hit = F.array_contains(tokens(name), FORCE)
    for form in (F.lower(name), F.lower(normal(name))):
        for term in LEXICON:
            hit = hit | form.contains(term)
    for p in filter(None, patterns):
        hit = hit | name.rlike("^" + ".*".join(map(re.escape, p.split("*"))) + "$")
    return hit
