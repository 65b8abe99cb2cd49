"""Tables written to the folder that driver and executors share, to cut lineage in loops."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: list[str] = []
#: What Spark holds of a table at once to send it to a Python worker; its own limit of 10,000 rows is one of 64 MB where rows are whole documents.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: For each settled that is at work, the tables written for it so far.
_SETTLING: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors see.

    Where it is unset, a session in one process (local mode) gets a temporary folder; on a cluster that is an error,
    as no folder of one machine would do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="runlens-", dir="/tmp"))
    return f"file://{_OWN[0]}"


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package where it isn't installed on them by other means, and sends them 4 MB at a time unless the session has a limit of its own."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, "4m")
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH"), root) if x)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: later steps survive lost executors and never compute it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    for made in _SETTLING[-1:]:
        made.append(path)
    return out


def exchanged(df: DataFrame, name: str) -> DataFrame:
    """What materialize gives, for joins that exchange both sides: files of ids are small, but what is read from them isn't, and a broadcast goes through the driver."""
    written = materialize(df, name)
    out = written.hint("merge")
    out._written = written._written
    return out


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that materialize wrote (the very results of it), once nothing will read them again."""
    for table in tables:
        path = None if table is None else vars(table).get("_written")
        if path:
            _delete(table.sparkSession, path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make returns, written by materialize; all other tables that were written on the way to it, also by what it calls, are deleted."""
    made: list[str] = []
    _SETTLING.append(made)
    try:
        out = materialize(make(), name)
    finally:
        _SETTLING.pop()
    for path in made[:-1]:
        _delete(spark, path)
    for outer in _SETTLING[-1:]:
        outer.append(out._written)
    return out


def positions(rows: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """rows, written, with _at (place from 0 in the order of these columns) and for each name in sums the sum of its column over all rows before.

    Rows are dealt by ranges; what each range counts and sums is added up over the ranges, a row for each, so no task gets more than a range.
    """
    ranged = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    per_range = ranged.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_of_{k}") for k, c in sums.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select("_range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_n", *[f"_of_{k}" for k in sums])])
    own = Window.partitionBy("_range").orderBy(*order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    told = ranged.join(offsets, "_range").withColumn("_at", F.col("_n") + F.row_number().over(own) - 1)
    for k, c in sums.items():
        told = told.withColumn(k, F.col(f"_of_{k}") + F.coalesce(F.sum(c).over(before), F.lit(0)))
    return told.drop("_range", "_n", *[f"_of_{k}" for k in sums])


def carried(rows: DataFrame, key: list[str], told: dict[str, tuple[Column, Callable[[str], Column]]], width: str = "hour", time: str = "ts") -> DataFrame:
    """rows with _bucket (their hour, say) and, for each name in told, what all earlier buckets of the key say together.

    told has for each name an aggregate over a bucket's rows and one over the buckets before. A window over (key, _bucket) that adds
    these is one over the whole key, but no task ever gets more of a key's rows than a bucket has, and a row for each bucket. What a bucket
    is told comes to it as one more row, so rows are exchanged once, by (key, _bucket), as the windows after it need them.
    """
    own = rows.withColumn("_bucket", F.date_trunc(width, time))
    before = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy(*key, "_bucket").agg(*[first.alias(name) for name, (first, _) in told.items()])
    upto = sums.select(*key, "_bucket", F.lit(True).alias("_upto"), *[then(name).over(before).alias(name) for name, (_, then) in told.items()])
    both = own.withColumn("_upto", F.lit(False)).unionByName(upto, allowMissingColumns=True)
    bucket = Window.partitionBy(*key, "_bucket")
    return both.withColumns({name: F.first(name, ignorenulls=True).over(bucket) for name in told}).where("NOT _upto").drop("_upto")


def salted_join(rows: DataFrame, told: DataFrame, key: str, counts: DataFrame, by: list[str], per: int = 100_000, most: int = 200_000) -> DataFrame:
    """rows joined with told on key; counts (key, n) has the number of rows of each key, and is a written table. by: columns of rows that deal a key's rows.

    Keys with more than `per` rows, and more than all rows / `most`, are dealt over as many salts on both sides, so that
    no task gets more rows of a key. Fewer than `most` keys can have that many rows, so their table is broadcast.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(per, -(-total // most))
    heavy = counts.where(F.col("n") > limit).select(F.col(key).alias("_heavy"), F.ceil(F.col("n") / limit).cast("int").alias("_salts"))
    heavy = F.broadcast(heavy)
    one = told.join(heavy, F.col(key) == F.col("_heavy"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_heavy", "_salts")
    salt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.col("_salts"))).cast("int")
    many = rows.join(heavy, F.col(key) == F.col("_heavy"), "left").withColumn("_salt", salt).drop("_heavy", "_salts")
    return many.join(one, [key, "_salt"]).drop("_salt")
