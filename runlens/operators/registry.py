"""Regression cases: validation, run history, regressions, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULTS = ("pass", "fail", "error")
HISTORY_CAP = 10


def regressions(results: DataFrame, key: str = "case_id") -> DataFrame:
    """(case, last_result, verdict): regression if the last result is no pass but an earlier one was, gap if none ever was, else ok."""
    last = F.max_by("result", F.struct("ts", "event_id"))
    counted = results.groupBy(key).agg(last.alias("last_result"), F.count_if(F.col("result") == "pass").alias("passes"), F.count("*").alias("runs"))
    verdict = F.when(F.col("last_result") == "pass", "ok").when(F.col("passes") > 0, "regression").otherwise("gap")
    return counted.withColumn("verdict", verdict)


def capped_history(results: DataFrame, cap: int = HISTORY_CAP, key: str = "case_id") -> DataFrame:
    """(case, last_run, history): the newest result, and up to cap results before it, newest first."""
    order = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    newest = results.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap + 1)
    listed = newest.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "result"))).alias("all"))
    return listed.select(key, F.col("all")[0]["result"].alias("last_run"), F.transform(F.slice("all", 2, cap), lambda x: x["result"]).alias("history"))


def record(cases: DataFrame, runs: DataFrame, cap: int = HISTORY_CAP) -> DataFrame:
    """cases with runs (id, ts, result, commit) recorded in order of time: each moves the last_run before it to the front of history, which keeps cap entries; nothing else changes.

    Runs of unknown cases or with unknown results are left out (see rejected_runs).
    """
    none = F.array().cast("array<struct<result:string,commit:string>>")
    order = Window.partitionBy("id").orderBy(F.desc("ts"), F.desc("commit"), "result")
    newest = runs.where(F.col("result").isin(*RESULTS)).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap + 1)
    known = newest.groupBy(F.col("id").alias("_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "result", "commit"))), lambda x: F.struct(x["result"].alias("result"), x["commit"].alias("commit"))).alias("_runs"))
    joined = cases.join(known, cases["id"] == known["_id"], "left")
    before = F.concat(F.when(F.col("last_run").isNotNull(), F.array("last_run")).otherwise(none), F.coalesce("history", none))
    ran = F.col("_runs").isNotNull()
    pushed = F.slice(F.concat(F.slice("_runs", 2, cap), before), 1, cap)
    new = {"last_run": F.when(ran, F.col("_runs")[0]).otherwise(F.col("last_run")), "history": F.when(ran, pushed).otherwise(F.col("history"))}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in cases.columns])


def rejected_runs(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, result, reason) of runs that record leaves out."""
    known = cases.select(F.col("id").alias("_id")).distinct()
    joined = runs.join(known, runs["id"] == known["_id"], "left")
    reason = F.when(F.col("_id").isNull(), "unknown case").when(~F.coalesce(F.col("result").isin(*RESULTS), F.lit(False)), "unknown result")
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").select("id", "result", "reason")


def case_problems(cases: DataFrame) -> DataFrame:
    """(id, problem): what is wrong with case definitions (id, filename, command, body, status, flake_reason, exit_code, n_assertions)."""
    rule = lambda test, name: F.when(F.coalesce(test, F.lit(False)), F.lit(name))
    text = F.concat_ws("\n", "command", "body")
    rules = [
        rule(F.col("id").isNull(), "unreadable"),
        rule(text.rlike(r"(?i)\b(date\.now|datetime\.now|time\.time|current_timestamp)\b|\$\(date"), "uses the clock"),
        rule(text.rlike(r"(/home/|/Users/|[A-Z]:\\\\)"), "machine-local path"),
        rule(F.col("exit_code").isNull() & (F.coalesce("n_assertions", F.lit(0)) == 0), "no expectation"),
        rule((F.col("status") == "quarantined") & (F.trim(F.coalesce("flake_reason", F.lit(""))) == ""), "quarantined without a reason"),
        rule(F.col("id") != F.regexp_extract("filename", r"([^/]+)\.md$", 1), "id differs from the file name"),
    ]
    found = cases.select("id", F.explode(F.array_compact(F.array(*rules))).alias("problem"))
    twice = cases.where("id IS NOT NULL").groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("problem"))
    return found.unionByName(twice)


def next_id(names: DataFrame, column: str, prefix: str, width: int = 3) -> DataFrame:
    """One row: the id after the largest number that follows `prefix-`; names of other forms don't count."""
    number = F.regexp_extract(column, rf"^\Q{prefix}\E-?#?(\d+)$", 1).try_cast("long")
    largest = names.agg(F.coalesce(F.max(number), F.lit(0)).alias("largest"))
    return largest.select("largest", padded(prefix, F.col("largest") + 1, width).alias("next_id"))


def padded(prefix: str, number: Column, width: int) -> Column:
    """Numbers longer than width stay whole."""
    digits = number.cast("string")
    return F.concat(F.lit(f"{prefix}-"), F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that stand more than once, with their number."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
