"""Columns read from documents: front matter, review bodies, sections, credentials in configurations, times."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions.text import PLACEHOLDER

#: Flags whose value is a credential, and endings of names in the environment that hold one.
CREDENTIAL_FLAGS = ["--access-token", "--dsn", "--project-ref", "--api-key", "--token"]
CREDENTIAL_NAME = r"(?i)(TOKEN|KEY|SECRET|PASSWORD|DSN|PAT)$"
SERVERS = "mcpServers map<string,struct<command:string,args:array<string>,env:map<string,string>>>"


def _scalar(value: Column) -> Column:
    """A value without its quotes; a comment after an unquoted one goes."""
    double, single = r'^"((?:[^"\\]|\\.)*)".*$', r"^'([^']*)'.*$"
    return F.when(value.rlike(double), F.regexp_extract(value, double, 1)).when(value.rlike(single), F.regexp_extract(value, single, 1)).otherwise(F.trim(F.regexp_replace(value, r"(^|\s+)#.*$", "")))


def _items(value: Column) -> Column:
    """The items of [a, b] or of a single value."""
    inside = F.regexp_extract(value, r"^\[(.*)\]", 1)
    parts = F.regexp_extract_all(inside, F.lit(r"""\s*("(?:[^"\\]|\\.)*"|'[^']*'|[^,]*)\s*(?:,|$)"""), 1)  # a quoted comma parts nothing
    some = F.filter(F.transform(parts, lambda x: _scalar(F.trim(x))), lambda x: x != "")
    return F.when(value.rlike(r"^\["), some).when(_scalar(value) == "", F.array().cast("array<string>")).otherwise(F.array(_scalar(value)))


def front_matter(text: Column) -> Column:
    """Map from the keys of a leading --- block to their values, as a list each: scalars, [flow, lists] and lists of - items. Null without a block."""
    body = F.regexp_extract(text, r"(?s)\A---[ \t]*\n(.*?\n)??---[ \t]*(?:\n|\z)", 1)
    entry, none = "struct<key:string,value:array<string>>", F.array().cast("array<struct<key:string,value:array<string>>>")

    def fold(so_far: Column, line: Column) -> Column:
        last = F.try_element_at(so_far, F.lit(-1))
        grown = F.struct(last["key"].alias("key"), F.concat(last["value"], F.array(_scalar(F.regexp_extract(line, r"^\s*-\s+(.*)$", 1)))).alias("value")).cast(entry)
        new = F.struct(F.regexp_extract(line, r"^([\w-]+):", 1).alias("key"), _items(F.trim(F.regexp_extract(line, r"^[\w-]+:(.*)$", 1))).alias("value")).cast(entry)
        return F.when(line.rlike(r"^[\w-]+:"), F.concat(so_far, F.array(new))).when(line.rlike(r"^\s*-\s+") & last.isNotNull(), F.concat(F.slice(so_far, 1, F.size(so_far) - 1), F.array(grown))).otherwise(so_far)

    pairs = F.aggregate(F.split(F.coalesce(body, F.lit("")), "\n"), none, fold)
    whole = F.aggregate(pairs, F.create_map().cast("map<string,array<string>>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["key"]), F.map_from_arrays(F.array(p["key"]), F.array(p["value"]))))
    return F.when(text.rlike(r"(?s)\A---[ \t]*\n(.*?\n)??---[ \t]*(\n|\z)"), whole)


def scalar(matter: Column, key: str) -> Column:
    """A key's only value in a front matter; null if missing or blank."""
    return F.try_element_at(F.try_element_at(matter, F.lit(key)), F.lit(1))


def review_body(text: Column) -> Column:
    """The body of the section Review without comments; null if nothing is left."""
    body = F.regexp_extract(text, r"(?ims)^## Review[ \t]*\n(.*?)(?=^## |\z)", 1)
    return F.nullif(F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", ""), r"\A\s+|\s+\z", ""), F.lit(""))


def section_block(text: Column, key: str) -> Column:
    """A top-level key of a configuration with the comments right before it and all that is below it; null if missing."""
    return F.nullif(F.regexp_extract(text, rf"(?m)((?:^#[^\n]*\n)*^{re.escape(key)}:[^\n]*(?:\n(?:[ \t]+[^\n]*|[ \t]*(?=\n[ \t]))$)*)", 1), F.lit(""))


def utc_stamp(time: Column) -> Column:
    """A time in UTC to the second, with Z."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def holds_secret(config: Column) -> Column:
    """Whether a configuration of servers (JSON) has a credential in it: a credential's flag before a literal, or a variable named like one with a literal. Unreadable ones count as holding one."""
    servers = F.from_json(config, SERVERS)["mcpServers"]
    literal = lambda x: ~F.coalesce(x.rlike(PLACEHOLDER), F.lit(False))
    flagged = lambda args: F.exists(F.sequence(F.lit(1), F.size(args)), lambda i: F.array_contains(F.array(*map(F.lit, CREDENTIAL_FLAGS)), F.element_at(args, i.cast("int"))) & (i < F.size(args)) & literal(F.try_element_at(args, (i + 1).cast("int"))))
    own = lambda s: F.coalesce(F.when(F.size(s["args"]) > 0, flagged(s["args"])), F.lit(False)) | F.coalesce(F.size(F.map_filter(s["env"], lambda k, v: k.rlike(CREDENTIAL_NAME) & literal(v))) > 0, F.lit(False))
    readable = F.try_parse_json(config).isNotNull()
    return F.when(config.isNull(), False).when(~readable, True).otherwise(F.coalesce(F.exists(F.map_values(servers), own), F.lit(False)))


def missing_credentials(config: Column, known: list[str]) -> Column:
    """By server of a configuration: (server, status, detail), warn where an argument or variable is an unfilled placeholder or names a variable that isn't among `known`, else ok."""
    servers = F.from_json(config, SERVERS)["mcpServers"]

    def judge(entry: Column) -> Column:
        values = F.array_compact(F.concat(F.coalesce(entry["value"]["args"], F.array().cast("array<string>")), F.coalesce(F.map_values(entry["value"]["env"]), F.array().cast("array<string>"))))
        unfilled = F.filter(values, lambda v: v.rlike("^REPLACE_WITH_"))
        named = F.flatten(F.transform(values, lambda v: F.regexp_extract_all(v, F.lit(r"\$\{(\w+)"), 1)))
        gone = F.array_sort(F.array_distinct(F.concat(unfilled, F.array_except(named, F.array(*map(F.lit, known)).cast("array<string>")))))
        return F.struct(entry["key"].alias("server"), F.when(F.size(gone) > 0, "warn").otherwise("ok").alias("status"), F.array_join(gone, ", ").alias("detail"))

    return F.transform(F.map_entries(servers), judge)
