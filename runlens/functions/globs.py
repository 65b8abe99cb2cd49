"""Path rules: globs as regular expressions, and which paths a list of them excludes."""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Generated files and noise folders that are never worth reading, at any depth.
DEFAULT_EXCLUDES = ["*.g.dart", "*.freezed.dart", "*.d.ts", "*.pb.go", "*_pb2.py", "*.generated.*", "*.snap", "node_modules/**", ".venv/**", "venv/**", "build/**", "dist/**", ".dart_tool/**", "__pycache__/**", ".git/**", "tests/**"]
#: Names by which tool caches are known.
CACHE_FOLDERS, CACHE_NAME, CACHE_ENDING = ("__pycache__", ".pytest_cache", ".ruff_cache"), ".DS_Store", ".pyc"
FALLBACK_PATTERNS = ["*.py", "*.js", "*.jsx", "*.ts", "*.tsx", "*.dart"]


def glob_regex(glob: str) -> str:
    """A glob as a regular expression over whole path segments at any depth: ** is anything, * and ? stay in a segment, a/ is all below a folder."""
    body = re.sub(r"^(\*\*/)+", "", glob)
    body = f"{body}**" if body.endswith("/") else body
    parts = re.split(r"(\*\*|\*|\?)", body)
    return "(^|/)" + "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p) or re.escape(p) for p in parts) + "$"


def matches(path: Column, globs: list[str]) -> Column:
    """Whether some glob matches."""
    return path.rlike("|".join(map(glob_regex, globs))) if globs else F.lit(False)


def excluded(path: Column, rules: list[str], defaults: list[str] | None = None) -> Column:
    """Whether the last rule that matches excludes the path; rules come after the defaults, and !rule takes back in."""
    out = F.lit(False)
    for back, some in groupby([*(DEFAULT_EXCLUDES if defaults is None else defaults), *rules], lambda r: r.startswith("!")):
        out = F.when(matches(path, [r.removeprefix("!") for r in some]), F.lit(not back)).otherwise(out)
    return out


def is_cache(path: Column) -> Column:
    """Whether a path is a tool's cache: a folder of one on its way, or a name or ending of one."""
    parts = F.split(path, "/")
    return F.arrays_overlap(parts, F.array(*map(F.lit, CACHE_FOLDERS))) | (F.element_at(parts, -1) == CACHE_NAME) | path.endswith(CACHE_ENDING)


def selected(files: DataFrame, include: list[str], exclude: list[str] | None = None) -> DataFrame:
    """files (path, ...) that some include glob matches and the excludes (with the defaults) don't."""
    return files.where(matches(F.col("path"), include) & ~excluded(F.col("path"), exclude or []))


def unignored(files: DataFrame, ignored: DataFrame) -> DataFrame:
    """files without the paths that version control ignores (path); with none, all of them."""
    return files.join(ignored.select("path").distinct(), "path", "left_anti")


def detected_patterns(text: Column) -> Column:
    """(patterns, source) of a project's configuration: the items of its block project_index_globs without **/, or the fallback and why."""
    block = F.regexp_extract(text, r"(?m)^project_index_globs:[ \t]*\n((?:[ \t]*-[^\n]*(?:\n|\z))*)", 1)
    items = F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-[ \t]*['\"]?([^'\"\n]+?)['\"]?[ \t]*$"), 1), lambda g: F.regexp_replace(g, r"^(\*\*/)+", ""))
    found = F.size(F.coalesce(items, F.array().cast("array<string>"))) > 0
    why = F.when(text.isNull(), "fallback (no configuration, index the project)").otherwise("fallback (no globs, index the project)")
    return F.struct(F.when(found, items).otherwise(F.array(*map(F.lit, FALLBACK_PATTERNS))).alias("patterns"), F.when(found, "detected").otherwise(why).alias("source"))


def empty_selection(source: Column) -> Column:
    """The error of a selection without files; fallback patterns name the fix, patterns that were asked for don't."""
    return F.concat(F.lit("no file matches"), F.when(source.startswith("fallback"), "; index the project so that its languages are known").otherwise(""))


def stack(files: DataFrame, key: str = "project") -> DataFrame:
    """files (project, path, text of manifests or null) -> (project, platform, test_framework), the first rule that holds: mobile by pubspec.yaml, mobile by native folders, web by a browser package, else unknown."""
    path, text = F.col("path"), F.coalesce("text", F.lit(""))
    has = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    flags = files.groupBy(key).agg(
        has(path.rlike(r"(^|/)pubspec\.yaml$")).alias("pubspec"),
        has(path.rlike(r"(^|/)(android|ios)/")).alias("native"),
        has(path.rlike(r"(^|/)package\.json$") & text.rlike(r'"(react|next|vue|svelte|@angular/core)"\s*:')).alias("browser"),
        has(path.rlike(r"(^|/)(pyproject\.toml|requirements\.txt)$")).alias("python"),
        has(path.rlike(r"(^|/)go\.mod$")).alias("go"),
    )
    runner = F.when(F.col("pubspec"), "flutter-skill").when(F.col("native"), "maestro").when(F.col("browser"), "playwright").when(F.col("python"), "pytest").when(F.col("go"), "go test").otherwise("unknown")
    platform = F.when(F.col("pubspec") | F.col("native"), "mobile").when(F.col("browser"), "web").otherwise("unknown")
    return flags.select(key, platform.alias("platform"), runner.alias("test_framework"))
