"""Nested front matter as rows: an indentation stack over maps, lists, flow lists and maps, quoted scalars and block scalars."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.shared import prepare

_BLOCK = re.compile(r"\A---[ \t]*\n(.*?\n)??---[ \t]*(?:\n|\Z)", re.S)
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'[^']*'|[^\s:#\[\]{},"'][^:#]*?)\s*:(?:\s+(.*))?$""")
_QUOTED = re.compile(r""""((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'""")
_ROWS = "keys array<string>, value string"


def _scalar(text: str) -> str:
    """A value without its quotes; behind an unquoted one a comment goes."""
    quoted = _QUOTED.match(text)
    if quoted:
        return re.sub(r"\\(.)", r"\1", quoted[1]) if quoted[1] is not None else quoted[2].replace("''", "'")
    return re.sub(r"(^|\s+)#.*$", "", text).strip()


def _parts(text: str) -> list[str]:
    """What commas part in a flow list or map, but for those in quotes or brackets."""
    out, own, depth, i = [], "", 0, 0
    while i < len(text):
        quoted = _QUOTED.match(text, i)
        piece = quoted[0] if quoted and not own.strip().strip("[{") else text[i]
        depth += (piece in ("[", "{")) - (piece in ("]", "}"))
        if piece == "," and not depth:
            out.append(own)
            own = ""
        elif piece == ":" and not depth:
            own += piece
        else:
            own += piece
        i += len(piece)
    return [p.strip() for p in [*out, own] if p.strip()]


def _values(text: str, path: tuple[str, ...]) -> Iterator[tuple[tuple[str, ...], str]]:
    text = text.strip()
    if text[:1] == "[" and "]" in text:
        for i, part in enumerate(_parts(text[1 : text.rindex("]")])):
            yield from _values(part, (*path, str(i)))
    elif text[:1] == "{" and "}" in text:
        for part in _parts(text[1 : text.rindex("}")]):
            found = _KEY.match(part)
            if found:
                yield from _values(found[2] or "", (*path, _scalar(found[1])))
    else:
        yield path, _scalar(text)


def nested_values(text: str) -> Iterator[tuple[tuple[str, ...], str]]:
    """(path, value) of each leaf of a text's leading --- block; a list's items have their numbers as keys. A key without a value that nothing is nested in gives an empty value."""
    block = _BLOCK.match(text)
    rows = (block[1] or "").split("\n") if block else []
    stack: list[tuple[int, tuple[str, ...], bool]] = [(-1, (), False)]
    counts: dict[tuple[str, ...], int] = {}
    waiting: tuple[str, ...] | None = None
    i = 0
    while i < len(rows):
        body = rows[i].lstrip(" ")
        indent, i = len(rows[i]) - len(body), i + 1
        body = body.rstrip()
        if not body or body[0] == "#":
            continue
        begin = len(stack)
        while body == "-" or body.startswith("- "):
            while stack[-1][0] > indent or stack[-1][0] == indent and stack[-1][2]:
                stack.pop()
            parent = stack[-1][1]
            counts[parent] = counts.get(parent, -1) + 1
            stack.append((indent, (*parent, str(counts[parent])), True))
            rest = body[1:].lstrip(" ")
            indent, body = indent + len(body) - len(rest), rest
        found = _KEY.match(body) if body[:1] not in "[{" else None
        if found:
            while stack[-1][0] >= indent and len(stack) > 1:
                stack.pop()
            path = (*stack[-1][1], _scalar(found[1]))
            stack.append((indent, path, False))
            value = (found[2] or "").strip()
        else:
            path, value = stack[-1][1], body
        if waiting is not None and path[: len(waiting)] != waiting:
            yield waiting, ""
        waiting = None
        if value in ("|", ">", "|-", ">-"):
            held = []
            while i < len(rows) and (not rows[i].strip() or len(rows[i]) - len(rows[i].lstrip(" ")) > indent):
                held.append(rows[i].strip())
                i += 1
            yield path, ("\n" if value[0] == "|" else " ").join(held).strip()
        elif value and not value.startswith("#"):
            yield from _values(value, path)
        elif found or len(stack) == begin:
            waiting = path
    if waiting is not None:
        yield waiting, ""


def nested_rows(docs: DataFrame, key: str = "path") -> DataFrame:
    """(key, keys, value) of docs (key, text): a row for each leaf of a document's front matter; texts that are null or have none give no row."""
    prepare(docs.sparkSession)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, list(path), value) for i, text in enumerate(batch.column(1).to_pylist()) for path, value in nested_values(text or "")]
            at, keys, values = zip(*found, strict=True) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.list_(pa.string())), pa.array(values, pa.string())], [key, "keys", "value"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(parse, f"{key} {kind}, {_ROWS}")


def at(*keys: str) -> Column:
    """The value at a path, in an aggregate over a document's rows; of several the last by value."""
    return F.max(F.when(F.col("keys") == F.array(*map(F.lit, keys)), F.nullif(F.col("value"), F.lit(""))))


def listed(*keys: str) -> Column:
    """The values of the list at a path, in its order, in an aggregate over a document's rows."""
    own = (F.size("keys") == len(keys) + 1) & (F.slice("keys", 1, len(keys)) == F.array(*map(F.lit, keys)))
    place = F.struct(F.element_at("keys", -1).try_cast("int").alias("i"), F.col("value").alias("v"))
    return F.transform(F.array_sort(F.collect_list(F.when(own & (F.col("value") != ""), place))), lambda x: x["v"])


def structs(fields: list[str], *keys: str) -> Column:
    """The maps of the list at a path, as structs of these fields, in its order, in an aggregate over a document's rows."""
    own = (F.size("keys") == len(keys) + 2) & (F.slice("keys", 1, len(keys)) == F.array(*map(F.lit, keys)))
    place = F.get("keys", F.lit(len(keys))).try_cast("int")
    entries = F.collect_list(F.when(own, F.struct(place.alias("i"), F.element_at("keys", -1).alias("k"), F.col("value").alias("v"))))
    one = lambda all_, i: F.struct(*[F.get(F.transform(F.filter(all_, lambda e: (e["i"] == i) & (e["k"] == f)), lambda e: e["v"]), F.lit(0)).alias(f) for f in fields])  # noqa: E731, B023
    return F.transform(F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["i"]))), lambda i: one(entries, i))


#: What a case document says at single places, as (column, path).
_SINGLE = [*((k, (k,)) for k in ("id", "title", "kind", "surface", "runner", "status", "command", "flake_reason", "revision")), ("exit_code", ("expect", "exit_code")), ("last_result", ("last_run", "result")), ("last_commit", ("last_run", "commit"))]
_LISTS = {"assertions": ("expect", "assertions"), "requirements": ("covers", "requirements")}


def _place(key: str) -> int | None:
    return int(key) if re.fullmatch(r"\d{1,9}", key, re.A) else None


def _case(leaves: list[tuple[tuple[str, ...], str]]) -> tuple[list, list, list]:
    """A document's single values, lists and history: what at, listed and structs give of its rows."""
    single: dict[tuple[str, ...], str] = {}
    lists: dict[tuple[str, ...], list] = {path: [] for path in _LISTS.values()}
    history: dict[int | None, dict[str, str]] = {}
    for path, value in leaves:
        if value != "":
            single[path] = max(value, single.get(path, value))
            if path[:-1] in lists:
                place = _place(path[-1])
                lists[path[:-1]].append((place is not None, place or 0, value))
        if len(path) == 3 and path[0] == "history":
            place = _place(path[1])
            entry = history.setdefault(place, {})
            if place is not None:
                entry.setdefault(path[2], value)
    entries = [history[i] for i in sorted(history, key=lambda i: (i is None, i))]
    return [single.get(path) for _, path in _SINGLE], [[v for *_, v in sorted(rows)] for rows in lists.values()], [(e.get("result"), e.get("commit")) for e in entries]


def cases(docs: DataFrame, key: str = "path") -> DataFrame:
    """Case documents (key, text) as rows: id, title, kind, status, revision, expect, covers, last_run and history; documents without front matter are left out.

    A document is read and put together in one place: nothing is exchanged, and documents of one key stay apart.
    """
    prepare(docs.sparkSession)
    names = [key, *(name for name, _ in _SINGLE), *_LISTS, "history"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 2000):
                batch = whole.slice(low, 2000)
                leaves = [list(nested_values(text or "")) for text in batch.column(1).to_pylist()]
                at = [i for i, found in enumerate(leaves) if found]
                told = [_case(leaves[i]) for i in at]
                singles = [pa.array(column, pa.string()) for column in zip(*(t[0] for t in told), strict=True)] if told else [pa.array([], pa.string())] * len(_SINGLE)
                lists = [pa.array([t[1][i] for t in told], pa.list_(pa.string())) for i in range(len(_LISTS))]
                ends = np.cumsum([0, *(len(t[2]) for t in told)]).astype(np.int32)
                entries = [pa.array([e[i] for t in told for e in t[2]], pa.string()) for i in range(2)]
                history = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(entries, ["result", "commit"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *singles, *lists, history], names)

    kind = docs.schema[key].dataType.simpleString()
    schema = ", ".join([f"`{key}` {kind}", *(f"{name} string" for name, _ in _SINGLE), *(f"{name} array<string>" for name in _LISTS), "history array<struct<result: string, commit: string>>"])
    return docs.select(key, "text").mapInArrow(parse, schema).select(
        key,
        *[k for k, path in _SINGLE[:8]],
        F.col("revision").try_cast("int").alias("revision"),
        F.struct(F.col("exit_code").try_cast("int").alias("exit_code"), "assertions").alias("expect"),
        "requirements",
        F.struct(F.col("last_result").alias("result"), F.col("last_commit").alias("commit")).alias("last_run"),
        "history",
    )
