"""The driver tables in the shape of the event model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tool_log(events: DataFrame) -> DataFrame:
    """Each event as a tool call: a day is a run, a user a task, the event type a tool; small signups count as denied."""
    return events.select(
        "event_id",
        "ts",
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"),
        F.col("user_id").cast("string").alias("task_id"),
        F.lit(None).cast("string").alias("event"),
        F.col("event_type").alias("tool"),
        (F.col("event_type") != "error").alias("ok"),
        F.when((F.col("event_type") == "signup") & (F.col("value") < 1), "too small").alias("deny_reason"),
        F.floor(F.col("value") * 100).cast("long").alias("res_chars"),
        F.col("props").alias("args"),
    )


def transcript(conversations: DataFrame) -> DataFrame:
    """Each conversation as a transcript: a turn's text is its output, the text of the turn before its input."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return conversations.select(
        F.col("conv_id").cast("string").alias("session"),
        F.col("turn").alias("pos"),
        F.col("role").alias("type"),
        (F.col("conv_id") % 5 == 0).alias("isSidechain"),
        F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("haiku-"), F.col("turn") % 2)).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("sonnet-"), F.col("turn") % 2)).otherwise("other-1").alias("model"),
        F.when(F.col("role") == "assistant", F.struct(F.coalesce(F.length(F.lag("text").over(order)), F.lit(0)).cast("long").alias("input_tokens"), F.length("text").cast("long").alias("output_tokens"), F.lit(0).cast("long").alias("cache_read_input_tokens"), F.col("turn").alias("cache_creation_input_tokens"))).alias("usage"),
    )


def file_tree(documents: DataFrame) -> DataFrame:
    """Each document as a file of its source's folder; without a source or language that part is empty."""
    source, lang = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    return documents.select(F.concat(source, F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 10, "0"), F.lit("."), lang).alias("path"), F.col("n_chars"), source.alias("dir"), lang.alias("ext"))


def lines(documents: DataFrame) -> DataFrame:
    """(path, line, text): every line of every document, from 1."""
    return documents.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1)
