"""Readers of logs, transcripts, documents, file trees and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from runlens import schemas


def missing(error: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(error)


def jsonl(spark: SparkSession, path: str, schema: str = schemas.EVENT, strict: bool = False) -> DataFrame:
    """Rows of a JSON-lines path; blank and malformed lines are left out, a missing path is empty. strict keeps malformed lines in _corrupt_record."""
    try:
        lines = spark.read.text(path).where("trim(value) <> ''")
    except AnalysisException as error:
        if not missing(error):
            raise
        lines = spark.createDataFrame([], "value string")
    rows = lines.select(F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("_row")).select("_row.*")
    return rows if strict else rows.where("_corrupt_record IS NULL").drop("_corrupt_record")


def parse_jsonl(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """The same for lines that are already in a column: malformed and blank ones are left out."""
    parsed = F.from_json(column, f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.withColumn("_row", parsed).where(F.col("_row").isNotNull() & F.col("_row._corrupt_record").isNull() & (F.trim(F.col(column)) != ""))
    return rows


def text_or_null(column: Column) -> Column:
    """Stripped text; blank is null."""
    return F.nullif(F.regexp_replace(column, r"^\s+|\s+$", ""), F.lit(""))


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of each file, stripped, null where blank; a missing path is empty."""
    try:
        rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), text_or_null(F.col("value")).alias("text"))
        rows.schema  # noqa: B018  resolves the path
    except AnalysisException as error:
        if not missing(error):
            raise
        rows = spark.createDataFrame([], "path string, text string")
    return rows


def run_ids(paths: DataFrame) -> DataFrame:
    """Run ids of log paths; the dispatch log, the log of calls without a run and rotated generations are no runs."""
    name = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    named = paths.select(name.alias("id")).where((F.col("id") != "") & ~F.col("id").isin("dispatch", "_no-run") & ~F.col("id").rlike(r"\.\d+$"))
    return named.distinct()


def ambient(calls: DataFrame, log_ambient: bool = False) -> DataFrame:
    """Calls without a run are left out, or go to _no-run when asked for."""
    return calls.withColumn("run_id", F.coalesce("run_id", F.lit("_no-run"))) if log_ambient else calls.where("run_id IS NOT NULL")


def newest_transcript(files: DataFrame) -> DataFrame:
    """files (session, path, mtime, subagent, and direct or not) -> (session, path): a path that was named directly as it is, else the newest of a session's subagent files, else null."""
    named = "max_by(path, struct(mtime, path)) FILTER (WHERE direct)" if "direct" in files.columns else "cast(null AS string)"
    kind = files.schema["path"].dataType.simpleString()
    return files.groupBy("session").agg(F.expr(f"coalesce(cast({named} AS {kind}), max_by(path, struct(mtime, path)) FILTER (WHERE subagent))").alias("path"))


def agent_turns(turns: DataFrame) -> DataFrame:
    """A session's subagent turns, or its sidechain turns where it has no subagent file. turns has subagent and isSidechain."""
    has = turns.where("subagent").select(F.col("session").alias("_s")).distinct()
    joined = turns.join(has, turns["session"] == has["_s"], "left")
    return joined.where(F.when(F.col("_s").isNotNull(), F.col("subagent")).otherwise(F.coalesce("isSidechain", F.lit(False)))).drop("_s")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_bytes, mtime) of all files below a folder; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("length").alias("n_bytes"), F.col("modificationTime").alias("mtime"))


def manifest(documents: DataFrame, column: str = "json") -> DataFrame:
    """(path, tpl, cur): entries of manifest documents."""
    return documents.select(F.explode(F.from_json(column, f"files {schemas.MANIFEST}")["files"]).alias("path", "entry")).select("path", "entry.tpl", "entry.cur")
