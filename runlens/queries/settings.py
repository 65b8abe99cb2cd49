"""Settings documents made from events: merged with a template, and stripped of what is managed, read back as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators import settings
from runlens.queries import query, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), "event_type", F.date_format("ts", "yyyy-MM").alias("month"), F.get_json_object("props", "$.k").cast("long").alias("k"), "event_id")


@query("""
WITH e AS (SELECT user_id AS doc, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
u AS (SELECT doc, event_type, count(*) AS n, min(k) AS low FROM e WHERE doc % 7 > 0 GROUP BY ALL), t AS (SELECT event_type, max(k) AS high FROM e GROUP BY ALL),
d AS (SELECT DISTINCT doc FROM e UNION SELECT c_custkey FROM customer)
SELECT d.doc AS user_id, t.event_type, coalesce(n, 0) AS n, low, CASE WHEN u.n = 1 THEN 0 ELSE high END AS high FROM d CROSS JOIN t LEFT JOIN u ON u.doc = d.doc AND u.event_type = t.event_type
""")
def merged_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user's document says of an event type stays, its limit of 0 too; the template has all types, and customers without a document take it."""
    events = _events(spark, sf_dir)
    counted = events.where("doc % 7 > 0").groupBy("doc", "event_type").agg(F.count("*").alias("n"), F.min("k").alias("low"))
    said = counted.select("doc", "event_type", F.struct("n", "low", F.when(F.col("n") == 1, 0).alias("high")).alias("v"))
    document = lambda entries: F.to_json(F.map_from_entries(F.collect_list(entries)))
    user = said.groupBy("doc").agg(document(F.struct("event_type", "v")).alias("text"))
    whole = events.groupBy("event_type").agg(F.max("k").alias("high")).select(document(F.struct("event_type", F.struct(F.lit(0).alias("n"), "high"))).alias("text"))
    docs = events.select("doc").union(table(spark, sf_dir, "customer").select("c_custkey")).distinct()
    template = docs.withColumn("_one", F.lit(1)).join(F.broadcast(whole.withColumn("_one", F.lit(1))), "_one").select("doc", "text")
    merged = settings.merged_documents(user, template)
    read = merged.select("doc", F.explode(F.from_json("text", "map<string, struct<n: long, low: long, high: long>>")).alias("event_type", "v"))
    return read.select(F.col("doc").alias("user_id"), "event_type", "v.n", "v.low", "v.high")


@query("""
WITH e AS (SELECT user_id, event_type, strftime(ts, '%Y-%m') AS month, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
g AS (SELECT user_id, event_type, month, count(*) AS n, sum(k)::BIGINT AS k FROM e WHERE k % 20 = 0 GROUP BY ALL)
SELECT user_id, event_type, month, n, k FROM (SELECT DISTINCT user_id FROM e) LEFT JOIN g USING (user_id)
""")
def stripped_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each user: by event type a list of months, each with its runs, of which 19 in 20 are managed; a month without others goes."""
    run = F.struct("k", F.when(F.col("k") % 20 > 0, True).alias("_managed"))
    months = _events(spark, sf_dir).groupBy("doc", "event_type", "month").agg(F.collect_list(run).alias("run"))
    types = months.groupBy("doc", "event_type").agg(F.collect_list(F.struct("month", "run")).alias("entries"))
    docs = types.groupBy("doc").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("event_type", "entries"))).alias("on"))).alias("text"))
    left = settings.without_managed(docs).select("doc", F.from_json("text", "on map<string, array<struct<month: string, run: array<struct<k: long>>>>>").alias("d"))
    entries = left.select("doc", F.explode_outer("d.on").alias("event_type", "entries")).select("doc", "event_type", F.explode_outer("entries").alias("e"))
    runs = F.col("e.run.k")
    return entries.select(F.col("doc").alias("user_id"), "event_type", "e.month", F.when(F.col("e").isNotNull(), F.size(runs).cast("long")).alias("n"), F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + x).alias("k"))
