"""Which paths are left out: secrets always, then configured globs, then ignore files, where the last match decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import glob_regex

# Names that hold secrets.
SECRET_GLOBS = [
    ".env", ".env.*", "*.key", "*.pem", "*.p12", "*.pfx", "credentials.*", "secret*", ".npmrc", ".pypirc", "*.keystore",
    "id_rsa", "id_rsa.*", "id_ed25519", "id_ed25519.*", "*.secrets",
]


def ignore_regex(line: str) -> tuple[str, bool] | None:
    """(regex, negated) of a line of an ignore file; None for blanks and comments.

    A pattern with a slash is anchored at the root, another one fits at any depth;
    a trailing slash is taken off first.
    """
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    body = line[negated:].removesuffix("/")
    return glob_regex(body.removeprefix("/") if "/" in body else f"**/{body}"), negated


def _any(path: Column, globs: list[str]) -> Column:
    found = [r for r in map(ignore_regex, globs) if r]
    return path.rlike("|".join(f"(?:{r})" for r, _ in found)) if found else F.lit(False)


def excluded(path: Column, config: list[str] = (), ignore: list[str] = ()) -> Column:
    """Why a path is left out: secret, config or ignore; null if it stays (null paths too)."""
    verdict = F.lit(False)
    for rule in map(ignore_regex, ignore):
        if rule:
            verdict = F.when(path.rlike(rule[0]), F.lit(not rule[1])).otherwise(verdict)
    return F.when(_any(path, SECRET_GLOBS), "secret").when(_any(path, list(config)), "config").when(verdict & path.isNotNull(), "ignore")
