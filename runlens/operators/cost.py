"""Token usage of transcripts and what it costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_input_tokens", "cache_write": "cache_creation_input_tokens"}
#: Dollars a million tokens (input, output, cache read, cache write) by model prefix; the empty prefix is the fallback. Only the second line's are fixed values, the others are our defaults.
RATES = {"opus": (15.0, 75.0, 1.5, 18.75), "sonnet": (3.0, 15.0, 0.3, 3.75), "haiku": (1.0, 5.0, 0.1, 1.25), "": (3.0, 15.0, 0.3, 3.75)}


def tokens(usage: Column) -> Column:
    """Usage counters under our names, missing ones 0."""
    return F.struct(*[F.coalesce(usage[source], F.lit(0)).cast("long").alias(axis) for axis, source in AXES.items()])


def main_thread(turns: DataFrame) -> DataFrame:
    return turns.where(~F.coalesce("isSidechain", F.lit(False)))


def usage(turns: DataFrame, by: str = "session") -> DataFrame:
    """Turns and tokens of assistant turns with usage; the last of them names the model. Groups without such a turn are missing."""
    counted = turns.where("type = 'assistant' AND usage IS NOT NULL").withColumn("tokens", tokens(F.col("usage")))
    return counted.groupBy(by).agg(F.count("*").alias("turns"), F.max_by("model", "pos").alias("model"), *[F.sum(f"tokens.{a}").alias(a) for a in AXES])


def unbilled(turns: DataFrame, cursors: DataFrame, by: str = "session") -> DataFrame:
    """Turns beyond a transcript's cursor (session, billed); one without a cursor begins at its first turn."""
    told = cursors.select(F.col(by).alias("_k"), "billed")
    return turns.join(told, F.col(by) == F.col("_k"), "left").where("billed IS NULL OR pos > billed").drop("_k", "billed")


def rates_table(spark, rates: dict[str, tuple[float, float, float, float]] | None = None) -> DataFrame:
    rows = [(k, *map(float, v)) for k, v in (rates or RATES).items()]
    return spark.createDataFrame(rows, "prefix string, r_input double, r_output double, r_cache_read double, r_cache_write double")


def rate(model: Column, rates: dict[str, tuple[float, float, float, float]] | None = None) -> Column:
    """The rates of the longest prefix that a model's name starts with: a CASE, as a rate card is short."""
    rates = rates or RATES
    out = None
    for prefix in sorted(rates, key=lambda p: (-len(p), p)):
        if prefix:
            value = F.array(*map(F.lit, rates[prefix]))
            out = F.when(model.startswith(prefix), value) if out is None else out.when(model.startswith(prefix), value)
    fallback = F.array(*map(F.lit, rates[""]))
    return fallback if out is None else out.otherwise(fallback)


def cost(used: DataFrame, rates: dict[str, tuple[float, float, float, float]] | None = None) -> DataFrame:
    """Adds cost_usd: tokens times rate over the four axes, for a million tokens."""
    r = rate(F.col("model"), rates)
    total = sum((F.col(a) * r[i] for i, a in enumerate(AXES)), F.lit(0.0))
    return used.withColumn("cost_usd", total / F.lit(1e6))


def prefix_join(used: DataFrame, rates: DataFrame) -> DataFrame:
    """The same match as a join, for rate cards that are tables: the longest prefix wins. Only distinct models meet the rates; every row of used stays."""
    names = used.select(F.col("model").alias("_model")).distinct()
    best = names.join(rates, F.col("_model").startswith(F.col("prefix"))).groupBy("_model").agg(F.max_by(F.struct(*rates.columns), F.length("prefix")).alias("_rate"))
    return used.join(best, F.col("model").eqNullSafe(F.col("_model")), "left").select(*used.columns, "_rate.*")
