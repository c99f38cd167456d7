"""Symbols of source files: patterns over lines for scripts, Rust, Go and Java, top keys of JSON, the syntax tree for Python."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import language

#: Kind and the pattern of a script's line that declares it; the first that fits counts.
SCRIPT_LINES = {
    "function": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)",
    "class": r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)",
    "interface": r"^\s*(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)",
    "type": r"^\s*(?:export\s+)?type\s+([A-Za-z_$][\w$]*)\s*[=<]",
    "enum": r"^\s*(?:export\s+)?(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)",
    "variable": r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)",
}
#: The same for languages that have no parser here, over lines; the name is the pattern's group.
RUST_LINES = {
    "method": r"^\s+(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe)\s+)*(?:extern\s+\"[^\"]*\"\s+)?fn\s+(\w+)",
    "function": r"^(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe)\s+)*(?:extern\s+\"[^\"]*\"\s+)?fn\s+(\w+)",
    "class": r"^\s*(?:(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|union)|(?:unsafe\s+)?impl(?:\s*<[^{]*?>)?(?:\s+[\w:<>, ]+\s+for)?)\s+(\w+)",
    "interface": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)",
    "type": r"^(?:pub(?:\([^)]*\))?\s+)?type\s+(\w+)",
    "variable": r"^(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(\w+)\s*:",
}
GO_LINES = {
    "function": r"^func\s+(?:\([^)]*\)\s*)?(\w+)",
    "class": r"^\s*(?:type\s+)?(\w+)(?:\[[^\]]*\])?\s+struct\s*\{",
    "interface": r"^\s*(?:type\s+)?(\w+)(?:\[[^\]]*\])?\s+interface\s*\{",
    "type": r"^type\s+(\w+)\s+[^\s=(]",
    "variable": r"^(?:var|const)\s+(\w+)",
}
JAVA_LINES = {
    "interface": r"^\s*(?:(?:public|protected|private|static|abstract|sealed|strictfp)\s+)*(?:@interface|interface)\s+(\w+)",
    "class": r"^\s*(?:(?:public|protected|private|static|abstract|final|sealed|strictfp)\s+)*(?:class|enum|record)\s+(\w+)",
    "function": r"^\s+(?:(?:public|protected|private)\s+)?([A-Z]\w*)\s*\([^)]*\)\s*(?:throws\s+[\w., ]+)?\{",
    "method": r"^\s+(?:(?:public|protected|private|static|abstract|final|synchronized|native|default)\s+)*(?:<[^>]+>\s+)?(?!return\b|new\b|else\b|throw\b)[\w.]+(?:<[^()=;]*>)?(?:\[\])*\s+(\w+)\s*\([^;{]*\)?[^;={]*[{;]",
    "variable": r"^\s+(?:(?:public|protected|private|static|final|volatile|transient)\s+)+[\w.]+(?:<[^()=;]*>)?(?:\[\])*\s+(\w+)\s*[=;]",
}
COLUMNS = "path string, kind string, name string, line int, exported boolean"


def _of_lines(files: DataFrame, patterns: dict[str, str], exported) -> DataFrame:
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("i", "s"))
    kind, name = F.lit(None).cast("string"), F.lit("")
    for k, pattern in reversed(patterns.items()):
        fits = F.col("s").rlike(pattern)
        kind, name = F.when(fits, k).otherwise(kind), F.when(fits, F.regexp_extract("s", pattern, 1)).otherwise(name)
    out = lines.select("path", kind.alias("kind"), name.alias("name"), (F.col("i") + 1).alias("line"), "s")
    return out.filter("kind is not null").select("path", "kind", "name", "line", exported(F.col("s"), F.col("name")).alias("exported"))


def script_symbols(files: DataFrame) -> DataFrame:
    """(path, kind, name, line, exported) of (path, content)."""
    return _of_lines(files, SCRIPT_LINES, lambda s, _: s.rlike(r"^\s*export\s"))


def rust_symbols(files: DataFrame) -> DataFrame:
    """Only a bare `pub` exports; an `impl` block is a class that isn't exported. Lines in block comments and strings are read as code."""
    return _of_lines(files, RUST_LINES, lambda s, _: s.rlike(r"^\s*pub\s"))


def go_symbols(files: DataFrame) -> DataFrame:
    """An upper-case first letter exports; methods are functions. Members of `var (...)` and `const (...)` groups and of interfaces have no row."""
    return _of_lines(files, GO_LINES, lambda _, name: name.rlike(r"^\p{Lu}"))


def java_symbols(files: DataFrame) -> DataFrame:
    """`public` exports; enumerations and records are classes, annotations interfaces, constructors functions."""
    return _of_lines(files, JAVA_LINES, lambda s, _: s.rlike(r"^\s*public\s"))


def json_symbols(files: DataFrame) -> DataFrame:
    """Top keys as exported variables; what isn't an object has none."""
    keys = files.select("path", F.explode(F.json_object_keys("content")).alias("name"))
    return keys.select("path", F.lit("variable").alias("kind"), "name", F.lit(1).alias("line"), F.lit(True).alias("exported"))


def _walk(body: list, exports: set | None, depth: int):
    for node in body:
        kind = "class" if isinstance(node, ast.ClassDef) else "function" if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef) else None
        if kind:
            public = (node.name in exports) if exports is not None and not depth else not node.name.startswith("_")
            yield "method" if depth and kind == "function" else kind, node.name, node.lineno, public
            if kind == "class" and depth < 2:
                yield from _walk(node.body, None, depth + 1)
        elif isinstance(node, ast.Assign) and not depth:
            for target in node.targets:
                if isinstance(target, ast.Name) and target.id != "__all__":
                    yield "variable", target.id, node.lineno, (target.id in exports) if exports is not None else not target.id.startswith("_")


def _exports(tree: ast.Module) -> set | None:
    for node in tree.body:
        if isinstance(node, ast.Assign) and any(isinstance(x, ast.Name) and x.id == "__all__" for x in node.targets):
            if isinstance(node.value, ast.List | ast.Tuple):
                return {x.value for x in node.value.elts if isinstance(x, ast.Constant)}
    return None


def python_symbols(files: DataFrame) -> DataFrame:
    """Like `script_symbols`; a file that doesn't parse gives one row of kind `partial` with the reason as its name."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    tree = ast.parse(content or "")
                    rows += [(path, *s) for s in _walk(tree.body, _exports(tree), 0)]
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append((path, "partial", type(e).__name__, 0, False))
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "line", "exported"])

    return files.select("path", "content").mapInPandas(run, COLUMNS)


def all_symbols(files: DataFrame) -> DataFrame:
    """Symbols of (path, content) by each file's language; files of others have none, and one that fails gives its `partial` row only."""
    known = files.select("path", "content").withColumn("__lang", language(F.col("path")))
    out = None
    for names, read in (
        (("typescript", "javascript"), script_symbols), (("json",), json_symbols), (("python",), python_symbols), (("rust",), rust_symbols), (("go",), go_symbols), (("java",), java_symbols),
    ):
        part = read(known.filter(F.col("__lang").isin(*names)).drop("__lang"))
        out = part if out is None else out.unionByName(part)
    return out
