"""Scalar expressions over texts, ids, hashes and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a placeholder or a reference to the environment, and the name of a script in a command line.
PLACEHOLDER = r"^(REPLACE_WITH_|OPTIONAL_|\$\{)"
SCRIPT = r"([\w.-]+\.py)"

#: Patterns and what stands in their place.
REDACTIONS = [
    (r"(?i)\b(token|secret|password|api_?key)(\s*[:=]\s*)(\"?)[^\s\"]+", "$1$2$3[redacted]"),
    (r"\b[0-9]{16}\b", "[number]"),
    (r"[A-Za-z0-9.]+@[A-Za-z0-9.]+", "[address]"),
]


def redact(text: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    for pattern, by in rules or REDACTIONS:
        text = F.regexp_replace(text, pattern, by)
    return text


def script_name(command: Column) -> Column:
    """The script that a command line runs; null without one."""
    return F.nullif(F.regexp_extract(command, SCRIPT, 1), F.lit(""))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def is_placeholder(text: Column) -> Column:
    return text.rlike(PLACEHOLDER)


def normalized(text: Column) -> Column:
    """Lower case, white space collapsed, ends stripped."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def k_of_n(text: Column) -> Column:
    """(seen, total, partial) of `k of N`; null where there is none."""
    seen = F.regexp_extract(text, r"(\d+) of (\d+)", 1).try_cast("int")
    total = F.regexp_extract(text, r"(\d+) of (\d+)", 2).try_cast("int")
    return F.when(seen.isNotNull(), F.struct(seen.alias("seen"), total.alias("total"), (seen < total).alias("partial")))


def section_tags(text: Column) -> Column:
    """Numbers of tags like [§9, §3], in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"§(\d+)"), 1), lambda x: x.cast("int"))


def set_front_matter(text: Column, key: str, value: Column) -> Column:
    """The text with a key of its leading --- block set, added if missing; unchanged without a block."""
    block = rf"(?s)\A(---\n(?:(?!---\n).*?\n)??){key}:[^\n]*\n"
    has = text.rlike(block) & (F.length(F.regexp_extract(text, rf"(?s)\A---\n(.*?\n)??---", 0)) >= F.length(F.regexp_extract(text, block, 0)))
    quoted = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    changed = F.regexp_replace(text, F.lit(block), F.concat(F.lit(f"$1{key}: "), quoted, F.lit("\n")))
    added = F.concat(F.lit(f"---\n{key}: "), value, F.lit("\n"), F.substr(text, F.lit(5)))
    return F.when(has, changed).when(text.startswith("---\n"), added).otherwise(text)


def replace_block(text: Column, begin: str, end: str, body: Column) -> Column:
    """What stands between two marker lines replaced by body; without the markers the block is put at the end."""
    block = F.concat(F.lit(f"{begin}\n"), body, F.lit(f"\n{end}"))
    quoted = F.replace(F.replace(block, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    pattern = F.lit(rf"(?s)\Q{begin}\E\n.*?\Q{end}\E")
    return F.when(text.contains(begin) & text.contains(end), F.regexp_replace(text, pattern, quoted)).otherwise(F.concat(text, F.lit("\n"), block))


def block_keys(text: Column, block: str) -> Column:
    """Map of the indented keys under a top-level key; the block ends at the next top-level line; a blank value stays blank."""
    body = F.regexp_extract(text, rf"(?m)^{block}:[ \t]*\n((?:[ \t]+[^\n]*(?:\n|\Z)|[ \t]*\n)*)", 1)
    rows = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"^\s+[\w-]+\s*:"))
    pair = lambda x: F.struct(F.regexp_extract(x, r"^\s+([\w-]+)\s*:", 1), F.regexp_extract(x, r"^\s+[\w-]+\s*:\s*([^#]*?)\s*(?:#.*)?$", 1))
    return F.map_from_entries(F.transform(rows, pair))


def top_keys(text: Column) -> Column:
    """Top-level keys of a configuration text, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^([A-Za-z_][\w-]*):"), 1)


def result_size(response: Column) -> Column:
    """Characters of a JSON response: a string's length; for an object its content (a string, or a list of text parts), else the lengths of its strings together; anything else its JSON text's length; null, {} and no response 0."""
    parsed = F.try_parse_json(response)
    kind = F.schema_of_variant(parsed)
    text = F.try_variant_get(parsed, "$", "string")
    content = F.try_variant_get(parsed, "$.content", "string")
    parts = F.try_variant_get(parsed, "$.content", "array<struct<text:string>>")
    strings = F.try_variant_get(parsed, "$", "map<string,variant>")
    add = lambda values: F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(F.length(x), F.lit(0)))
    plain = F.map_values(F.transform_values(strings, lambda k, v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))))
    summed = add(plain)
    size = (
        F.when(response.isNull() | parsed.isNull() | (kind == "VOID"), 0)
        .when(kind == "STRING", F.length(text))
        .when(F.size(F.coalesce(F.map_keys(strings), F.array())) == 0, F.when(kind.startswith("OBJECT"), 0).otherwise(F.length(response)))
        .when(parts.isNotNull(), add(F.transform(parts, lambda p: p["text"])))
        .when(content.isNotNull() & F.array_contains(F.map_keys(strings), "content"), F.length(content))
        .when(summed > 0, summed)
        .otherwise(F.length(response))
    )
    return size.cast("long")
