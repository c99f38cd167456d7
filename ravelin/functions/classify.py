"""What a file, a symbol or a configuration value is, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and endings of the file classes, asked in this order.
TEST_PATHS = r"\.test\.[tj]sx?$|\.spec\.[tj]sx?$|__tests__/|/test/|/tests/"
GENERATED_PATHS = r"\.d\.ts$|\.min\.[jt]s$|/dist/|/build/|\.generated\."
CONFIG_NAMES = (
    r"^tsconfig.*\.json$|^\.eslintrc|^\.prettierrc|^jest\.config|^vitest\.config|^webpack\.config|^rollup\.config|^vite\.config|^babel\.config|^\.babelrc"
    r"|^package\.json$|^viewer\.config\.json$|^\.editorconfig$|^\.gitignore$|^\.npmrc$|^Makefile$|^Dockerfile$|^docker-compose"
)
ENDINGS = {
    "doc": ".md .txt .rst .adoc .org",
    "asset": ".png .jpg .jpeg .gif .svg .ico .woff .woff2 .ttf .eot .mp3 .mp4 .wav .pdf",
    "source": ".ts .tsx .js .jsx .mjs .cjs .mts .cts .py .rs .go .java .c .cpp .h .hpp .cs .rb .swift .kt",
    "config": ".json",
}
# Names that mark a root, and what they mark.
ROOT_MARKERS = {
    "package": ["package.json"], "tsconfig": ["tsconfig.json"], "git": [".git"],
    "config": ["viewer.config.json", "Cargo.toml", "pyproject.toml", "go.mod", "pom.xml", "build.gradle", "setup.py"],
}
# Names of files where programs start.
ENTRY_NAMES = r"^(index|main|app|server|cli)\.[tj]sx?$|^bin/"
# How secrets in configuration begin, and what they look like.
SECRET_STARTS = ["sk-", "ghp_", "gho_", "ghs_", "ghr_", "Bearer ", "token-", "key-", "api-", "xox", "AKIA"]
SECRET_FORMS = r"(?i:(key|token|password|secret|credential|auth)[=:])|^[0-9a-fA-F]{24,}$|^[A-Za-z0-9+/]{20,}={0,3}$"
# Metadata keys that hold decorators, the longest embedding text, and the ids of the hash tokenizer.
DECORATOR_KEYS = ["decorators", "attributes", "annotations"]
TEXT_LENGTH = 512
CLS, SEP, IDS, FIRST_ID, TOKENS = 101, 102, 30000, 1000, 128


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def extname(path: Column) -> Column:
    """The last dot of the name and what follows; a name that only starts with a dot has none."""
    return F.regexp_extract(basename(path), r"^.+?(\.[^.]*)$", 1)


def relative_to(path: Column, folder: Column) -> Column:
    """The way from a folder to a path, both normal: up to the last folder they share, then down."""
    a, b = (F.filter(F.split(x, "/"), lambda s: s != "") for x in (folder, path))
    pairs = F.zip_with(F.slice(a, F.lit(1), F.least(F.size(a), F.size(b))), F.slice(b, F.lit(1), F.least(F.size(a), F.size(b))), lambda x, y: x == y)
    shared = F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, same: F.struct((s["n"] + F.when(s["on"] & same, 1).otherwise(0)).alias("n"), (s["on"] & same).alias("on")), lambda s: s["n"])
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(a) - shared), F.slice(b, shared + 1, F.size(b))), "/")


def file_class(path: Column) -> Column:
    out = F.when(path.rlike(TEST_PATHS), "test").when(path.rlike(GENERATED_PATHS), "generated").when(basename(path).rlike(CONFIG_NAMES), "config")
    for name, endings in ENDINGS.items():
        out = out.when(extname(path).isin(*endings.split()), name)
    return out.otherwise("other")


def likely_entrypoint(path: Column) -> Column:
    return basename(path).rlike(ENTRY_NAMES) | path.rlike(ENTRY_NAMES)


def root_marker(entry: Column) -> Column:
    """What a bare name marks; null for others and for paths."""
    out = F.lit(None).cast("string")
    for kind, names in ROOT_MARKERS.items():
        out = F.when(entry.isin(*names), kind).otherwise(out)
    return out


def decorator_names(metadata: Column) -> Column:
    """All decorators, attributes and annotations in JSON text, in this order; none in text that isn't JSON."""
    lists = [F.coalesce(F.from_json(F.get_json_object(metadata, f"$.{k}"), "array<string>"), F.array().cast("array<string>")) for k in DECORATOR_KEYS]
    return F.filter(F.concat(*lists), lambda x: x.isNotNull())


def hint_matches(pattern: str, decorator: Column) -> Column:
    """A pattern that ends in `.*` fits what it starts; others fit themselves."""
    return decorator.startswith(pattern[:-1]) if pattern.endswith(".*") else decorator == pattern


def looks_secret(value: Column) -> Column:
    starts = F.lit(False)
    for s in SECRET_STARTS:
        starts = starts | value.startswith(s)
    return F.coalesce((F.length(value) > 12) & (starts | value.rlike(SECRET_FORMS)), F.lit(False))


def redacted(values: Column) -> Column:
    """A map of configuration values without secrets."""
    return F.transform_values(values, lambda _, v: F.when(looks_secret(v), "[REDACTED]").otherwise(v))


def embedding_text(kind: str, *parts: Column) -> Column:
    """Text that stands for a file (path, language), a symbol (name, kind, path) or a claim (statement, type)."""
    names = {"file": ["file: ", " language: "], "symbol": ["symbol: ", " kind: ", " in: "], "claim": ["claim: ", " type: "]}[kind]
    return F.substring(F.concat(*[x for n, p in zip(names, parts, strict=True) for x in (F.lit(n), p)]), 1, TEXT_LENGTH)


def token_ids(text: Column) -> Column:
    """Ids of the hash tokenizer without padding: a signed 32-bit polynomial of each word's letters."""
    words = F.slice(F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\w\s]", " "), r"\s+"), lambda t: t != ""), 1, TOKENS - 2)

    def one(word: Column) -> Column:
        h = F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda s, c: (s * 31 + F.ascii(c)).bitwiseAND(F.lit(0xFFFFFFFF)))
        return F.abs(F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)) % IDS + FIRST_ID

    return F.concat(F.array(F.lit(CLS).cast("long")), F.transform(words, one), F.array(F.lit(SEP).cast("long")))
