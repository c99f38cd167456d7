"""Path, glob and text helpers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """`*` and `?` stay in a segment, `**` spans any number of them, {a,b} are alternatives."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
            continue
        if c == "*":
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
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def glob(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("unknown")
    for name, exts in LANGUAGES.items():
        out = F.when(ext.isin(*exts.split()), F.lit(name)).otherwise(out)
    return out


# Endings of the languages.
LANGUAGES = {"typescript": "ts tsx mts cts", "javascript": "js jsx mjs cjs", "json": "json", "python": "py", "rust": "rs", "go": "go", "java": "java"}


def similarity_distance(a: Column, b: Column) -> Column:
    """0 for equal, 1 for entirely different: edit distance over the longer length."""
    return F.when(a == b, 0.0).otherwise(F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def normalise_path(path: Column) -> Column:
    """Resolve `.` and `..` segments."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(done, "/")
