"""Sinks for events and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.shared import carried, discard, materialize
from runlens.sources.readers import missing


def generations(events: DataFrame, max_bytes: int = 5_000_000, before: DataFrame | None = None, hours: str = "hour") -> DataFrame:
    """Adds generation: how often a run's log was full before a record, by the bytes of the JSON lines before it in order of (ts, event_id).

    before (run_id, bytes) is what each run's log holds already. Sizes are summed up by hours first, so no task gets more than an hour of a run.
    """
    size = F.octet_length(F.to_json(F.struct(*events.columns))) + 1
    own = carried(events.withColumn("_size", size.cast("long")), ["run_id"], {"_carried": (F.sum("_size"), F.sum)}, hours)
    if before is not None:
        own = own.join(before.select(F.col("run_id").alias("_run"), F.col("bytes").alias("_there")), F.col("run_id").eqNullSafe(F.col("_run")), "left").drop("_run")
    else:
        own = own.withColumn("_there", F.lit(0))
    order = Window.partitionBy("run_id", "_bucket").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce("_there", F.lit(0)) + F.coalesce("_carried", F.lit(0)) + F.coalesce(F.sum("_size").over(order), F.lit(0))
    return own.withColumn("generation", F.floor(upto / max_bytes).cast("long")).select(*events.columns, "generation")


def append_events(events: DataFrame, path: str, max_bytes: int = 5_000_000) -> None:
    """Adds events as JSON lines under path/log, a folder for each run and in it one for each generation of about max_bytes (see read_events).

    What an append adds to each run's log is written first, under path/bytes, with the append's number; the append counts once its record
    is there, so one that failed half way leaves rows that read_events doesn't see, and is done again from the same sizes. However events are split into
    appends, in order, they get the same generations. One append runs at a time.
    """
    spark = events.sparkSession
    sizes = _sizes(spark, path)
    number = (sizes.agg(F.max("append")).first()[0] or 0) + 1
    before = sizes.groupBy("run_id").agg(F.sum("bytes").alias("bytes"))
    told = materialize(generations(events, max_bytes, before), "append")
    line = F.octet_length(F.to_json(F.struct(*events.columns))) + 1
    told.withColumn("run", F.col("run_id")).write.mode("overwrite").partitionBy("run", "generation").json(f"{path}/log/append={number}")
    told.groupBy("run_id").agg(F.sum(line).cast("long").alias("bytes")).write.mode("overwrite").json(f"{path}/bytes/append={number}")
    discard(told)


def _sizes(spark: SparkSession, path: str) -> DataFrame:
    kind = "run_id string, bytes long, append int"
    try:
        return spark.read.schema(kind).json(f"{path}/bytes")
    except AnalysisException as error:
        if not missing(error):
            raise
        return spark.createDataFrame([], kind)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All records that append_events has added, with append and generation; a path without any is an error."""
    done = _sizes(spark, path).select("append").distinct()
    return spark.read.json(f"{path}/log").drop("run").join(done, "append", "left_semi")


def write_report(report: DataFrame, path: str) -> None:
    """A report's rows as JSON lines, replacing those before."""
    report.write.mode("overwrite").json(path)


def index_document(cases: DataFrame) -> DataFrame:
    """(id, status, last_result) of cases as one index document, by id; a registry lists hand-written cases, so it is as small as these."""
    entry = F.struct("id", F.struct("status", "last_result"))
    return cases.agg(F.to_json(F.struct(F.count("*").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("cases"))).alias("json"))


def manifest_document(entries: DataFrame) -> DataFrame:
    """(path, tpl, cur) as one manifest document; a manifest lists installed files, so it is as small as these."""
    entry = F.struct("path", F.struct("tpl", "cur"))
    return entries.agg(F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("files"))).alias("json"))
