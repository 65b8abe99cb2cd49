"""Texts as evidence: sections, lists, tables, symbols, re-run searches and citations, coverage and drift."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.shared import prepare


def section(text: Column, name: str) -> Column:
    """Body of a second-level section, third-level ones included; null if missing or blank."""
    body = F.regexp_extract(text, rf"(?ims)^## {re.escape(name)}[ \t]*\n(.*?)(?=^## |\z)", 1)
    return F.nullif(F.trim(F.regexp_replace(body, r"^\s+|\s+\z", "")), F.lit(""))


def lines(docs: DataFrame, key: str = "path") -> DataFrame:
    """(key, line, text), lines counted from 1."""
    return docs.select(key, F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1)


def checklist(docs: DataFrame, key: str = "path") -> DataFrame:
    """(key, line, done, item) of task-list lines."""
    pattern = r"^\s*[-*] \[([ xX])\]\s+(.*?)\s*$"
    found = lines(docs, key).where(F.col("text").rlike(pattern))
    return found.select(key, "line", (F.regexp_extract("text", pattern, 1) != " ").alias("done"), F.regexp_extract("text", pattern, 2).alias("item"))


def table_rows(docs: DataFrame, key: str = "path") -> DataFrame:
    """(key, line, cells) of pipe-table rows; header and rule lines are left out, an escaped pipe is part of its cell."""
    return line_cells(lines(docs, key), key).select(key, "line", "cells")


def line_cells(text_lines: DataFrame, key: str = "path") -> DataFrame:
    """text_lines (key, line, text, more) of whole documents or sections -> those that are pipe-table rows, with cells in place of text (see table_rows)."""
    rows = text_lines.where(F.col("text").rlike(r"^\s*\|.*\|\s*$"))
    order = Window.partitionBy(key).orderBy("line")
    rule = F.coalesce(F.col("text").rlike(r"^[\s|:-]+$"), F.lit(False))
    header = F.coalesce(F.lead(rule).over(order), F.lit(False)) & (F.lead("line").over(order) == F.col("line") + 1)
    kept = rows.withColumn("_skip", rule | F.coalesce(header, F.lit(False))).where("NOT _skip").drop("_skip")
    cells = F.split(F.regexp_replace("text", r"^\s*\||\|\s*$", ""), r"(?<!\\)\|", -1)
    return kept.withColumn("cells", F.transform(cells, lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))).drop("text")


def sites(text: Column) -> Column:
    """Distinct path:line places that a text names; ratios and versions have no file ending before the colon."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\w./-]+\.[A-Za-z]\w*:\d+)"), 1))


_BRACES = {"js", "ts", "java", "go", "rs", "kt", "dart"}
_SYMBOL = "path string, name string, kind string, line int, end_line int"


def _symbols(text: str, ext: str) -> Iterator[tuple[str, str, int, int]]:
    rows = text.split("\n")
    for i, row in enumerate(rows):
        found = re.match(r"(\s*)(?:export\s+|public\s+|async\s+)*(def|class|function|func|fn|interface|type)\s+([A-Za-z_]\w*)", row)
        if not found:
            continue
        deep, word, name = len(found[1]), found[2], found[3]
        kind = "class" if word == "class" else "type" if word in ("interface", "type") else "method" if deep else "function"
        end, level = i, 0
        if ext == "py":
            while i and re.match(rf"\s{{{deep}}}@", rows[i - 1]):
                i -= 1
            for j in range(end + 1, len(rows)):
                if rows[j].strip() and len(rows[j]) - len(rows[j].lstrip()) <= deep:
                    break
                end = j if rows[j].strip() else end
        else:
            for j in range(i, len(rows)):
                bare = re.sub(r"\"(\\.|[^\"\\])*\"|'(\\.|[^'\\])*'|//.*", "", rows[j])
                level += bare.count("{") - bare.count("}")
                end = j
                if level <= 0 and ("{" in bare or "}" in bare):
                    break
        yield name, kind, i + 1, end + 1


def symbols(docs: DataFrame) -> DataFrame:
    """(path, name, kind, line, end_line) of docs (path, ext, text): by indents for py, by braces for some others; no row for other endings."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, *s) for path, ext, text in frame.itertuples(index=False) for s in _symbols(text, ext)]
            yield pd.DataFrame(rows, columns=["path", "name", "kind", "line", "end_line"])

    prepare(docs.sparkSession)
    return docs.where(F.col("ext").isin("py", *_BRACES) & F.col("text").isNotNull()).select("path", "ext", "text").mapInPandas(find, _SYMBOL)


def searched(claims: DataFrame, text_lines: DataFrame) -> DataFrame:
    """claims (claim_id, dir, pattern, without, also, mode, claimed), text_lines (dir, path, line, text) -> claims with actual, status.

    A search counts the lines of a folder that match pattern and don't match `without`; in mode files, the files that
    have such a line, and, with `also`, another line that matches it. status is failed where the folder has no file,
    as that is no zero; uncited without a pattern, unverified without a claimed number; else reproduced or mismatch.
    """
    c = claims.select("claim_id", F.col("dir").alias("_dir"), "pattern", "without", "also", "mode", "claimed")
    hit = F.regexp_like("text", F.col("pattern")) & ~F.coalesce(F.regexp_like("text", F.col("without")), F.lit(False))
    other = F.coalesce(F.regexp_like("text", F.col("also")), F.col("also").isNull())
    per_file = text_lines.join(c, F.col("dir") == F.col("_dir")).groupBy("claim_id", "path").agg(F.count_if(hit).alias("n"), F.bool_or(other).alias("also"))
    counted = per_file.groupBy("claim_id").agg(F.sum(F.when(F.col("also"), F.col("n")).otherwise(0)).alias("n_lines"), F.count_if((F.col("n") > 0) & F.col("also")).alias("n_files"))
    told = claims.join(counted, "claim_id", "left").withColumn("actual", F.when(F.col("mode") == "files", F.col("n_files")).otherwise(F.col("n_lines")))
    status = F.when(F.col("pattern").isNull(), "uncited").when(F.col("n_lines").isNull(), "failed").when(F.col("claimed").isNull(), "unverified").when(F.col("actual") == F.col("claimed"), "reproduced").otherwise("mismatch")
    return told.withColumn("status", status).withColumn("is_failing", F.col("status").isin("mismatch", "uncited", "failed")).drop("n_lines", "n_files")


def coverage_status(expected: DataFrame, rows: DataFrame, key: str = "list") -> DataFrame:
    """expected (list, item), rows (list, item): by list how many items, how many covered, and complete, incomplete or missing; no-checklist for rows without a list."""
    left = expected.select(key, "item").distinct().withColumn("_e", F.lit(1))
    right = rows.select(key, "item").distinct().withColumn("_r", F.lit(1))
    counted = left.join(right, [key, "item"], "full_outer").groupBy(key).agg(F.count("_e").alias("items"), F.count_if(F.col("_e").isNotNull() & F.col("_r").isNotNull()).alias("covered"))
    status = F.when(F.col("items") == 0, "no-checklist").when(F.col("covered") == 0, "missing").when(F.col("covered") < F.col("items"), "incomplete").otherwise("complete")
    return counted.withColumn("status", status)


def undeclared(reported: DataFrame, declared: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Rows of reported (key, item, command, ...) that don't use what is declared for their item (key, item, command), with status.

    substituted: another command than any declared, but for white space; uncited: none (command is empty then). Items
    without a declaration are no concern of this, nor are reports without any: their coverage tells of them.
    """
    on = [*(key or []), "item"]
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    d = declared.where("command IS NOT NULL").groupBy(*on).agg(F.collect_set(flat(F.col("command"))).alias("_declared"))
    used = reported.join(d, on).withColumn("_used", flat(F.col("command"))).where(~F.array_contains("_declared", F.col("_used")))
    none = F.col("_used") == ""
    return used.withColumns({"command": F.when(none, "").otherwise(F.col("command")), "status": F.when(none, "uncited").otherwise("substituted")}).select(*reported.columns, "status")


def baseline_drift(results: DataFrame, suspect: float = 0.5) -> DataFrame:
    """Adds drift to (kind, baseline, actual): violations regressed, progress, closed; candidates search-broken at 0, search-suspect below suspect * baseline; else null."""
    b, a = F.col("baseline"), F.col("actual")
    violations = F.when(a > b, "regressed").when((a == 0) & (b > 0), "closed").when(a < b, "progress")
    candidates = F.when((a == 0) & (b > 0), "search-broken").when(a < b * suspect, "search-suspect")
    return results.withColumn("drift", F.when(F.col("kind") == "violations", violations).otherwise(candidates))
