"""Source trees as tables: the walk, file contents, manifests and commit logs."""

from __future__ import annotations

import os
import subprocess
import tomllib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WALK = "path string, uri string, mtime_ms long, size long"
CONTENTS = "path string, content string, reason string"
SCRIPTS = "path string, name string, module string, function string"
COMMITS = "commit string, date string, path string"
MOST_COMMITS = 10_000


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, uri, mtime_ms, size) of the files below `root`, on any store that Hadoop reads.

    Hidden folders other than `.github`, symbolic links and folders that can't be
    read are left out. The driver lists names, as Spark's own file index does;
    Spark's readers aren't used, since they skip names that begin with `_` or `.`.
    """
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toString().rstrip("/")
    rows, waiting = [], [top]
    while waiting:
        try:
            found = fs.listStatus(waiting.pop())
        except Exception as e:
            if "java.io" not in str(e) and "AccessControlException" not in str(e):
                raise
            continue
        for status in found:
            path, name = status.getPath(), status.getPath().getName()
            if status.isSymlink() or path.toUri().getScheme() == "file" and os.path.islink(path.toUri().getPath()):
                continue
            if not status.isDirectory():
                uri = fs.makeQualified(path).toString()
                rows.append((uri[len(base) + 1 :], uri, status.getModificationTime(), status.getLen()))
            elif not name.startswith(".") or name == ".github":
                waiting.append(path)
    return spark.createDataFrame(rows, WALK)


def contents(files: DataFrame) -> DataFrame:
    """(path, content, reason) of (path, uri): UTF-8 texts; a file that can't be read or decoded has a null text and a reason."""

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for path, uri in zip(batch["path"], batch["uri"], strict=True):  # one file at a time: files may be large
                text, reason = None, None
                try:
                    store, place = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
                    with store.open_input_stream(place) as f:
                        text = f.read().decode("utf-8")
                except (OSError, UnicodeDecodeError, ValueError) as e:
                    reason = type(e).__name__
                yield pd.DataFrame([(path, text, reason)], columns=["path", "content", "reason"])

    return files.select("path", "uri").mapInPandas(run, CONTENTS)


def package_manifests(files: DataFrame) -> DataFrame:
    """(path, name, dependencies, dev_dependencies) of (path, content): package.json in at most three path segments; what isn't an object has nulls."""
    own = files.filter(F.col("path").rlike(r"^(?:[^/]+/){0,2}package\.json$"))
    read = F.from_json("content", "name string, dependencies map<string,string>, devDependencies map<string,string>")
    return own.select("path", read.alias("m")).select("path", "m.name", F.map_keys("m.dependencies").alias("dependencies"), F.map_keys("m.devDependencies").alias("dev_dependencies"))


def project_scripts(files: DataFrame) -> DataFrame:
    """(path, name, module, function) of the scripts and GUI scripts of (path, content): pyproject.toml; one that doesn't parse has none."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    project = tomllib.loads(content or "").get("project", {})
                except tomllib.TOMLDecodeError:
                    continue
                for part in ("scripts", "gui-scripts"):
                    for name, target in (project.get(part) or {}).items():
                        module, _, function = str(target).partition(":")
                        rows.append((path, name, module.strip(), function.strip() or None))
            yield pd.DataFrame(rows, columns=["path", "name", "module", "function"])

    return files.filter(F.col("path").rlike(r"(?:^|/)pyproject\.toml$")).select("path", "content").mapInPandas(run, SCRIPTS)


def commits(spark: SparkSession, root: str, depth: int) -> DataFrame:
    """(commit, date, path) of the last `depth` commits (0 to 10,000) of a local work tree; none where it has no history."""
    n = max(0, min(MOST_COMMITS, depth))
    out = subprocess.run(["git", "-C", root, "log", f"-n{n}", "--name-only", "-z", "--format=%x01%H%x09%aI%x02"], capture_output=True, text=True, errors="replace")
    rows = []
    for block in out.stdout.split("\x01")[1:] if out.returncode == 0 else []:
        head, _, names = block.partition("\x02")
        rows += [(*head.split("\t"), name.strip("\n")) for name in names.split("\0") if name.strip("\n")]
    return spark.createDataFrame(rows, COMMITS)
