"""Running budgets, rate limits and repeat limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.shared import carried

#: Default thresholds.
CALLS = (150, 300, 500)
RESULT_CHARS = (500_000, 1_500_000, 3_000_000)


def budget_events(events: DataFrame, axis: str, thresholds: tuple[int, ...], key: tuple[str, ...] = ("run_id", "task_id")) -> DataFrame:
    """A row for each call at which a task's running total first reaches a higher threshold than ever warned of on this axis.

    axis is calls or result_chars. Calls of no task have no budget. Earlier warnings in events (event = budget) count;
    one without an axis is about calls. A jump past several thresholds warns once, of the highest.
    """
    call = F.col("event").isNull()
    amount = F.when(call, F.lit(1) if axis == "calls" else F.coalesce("res_chars", F.lit(0))).otherwise(0)
    for name, kind in (("axis", "string"), ("threshold", "bigint")):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast(kind))
    warned = F.when((F.col("event") == "budget") & (F.coalesce("axis", F.lit("calls")) == axis), F.col("threshold"))
    own = carried(events.where("task_id IS NOT NULL").withColumns({"_amount": amount, "_warned": warned}), list(key), {"_total": (F.sum("_amount"), F.sum), "_most": (F.max("_warned"), F.max)})
    order = Window.partitionBy(*key, "_bucket").orderBy("ts", "event_id")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    total = own.withColumn("total", F.coalesce("_total", F.lit(0)) + F.sum("_amount").over(upto)).withColumn("warned", F.greatest(F.coalesce("_most", F.lit(0)), F.coalesce(F.max("_warned").over(before), F.lit(0))))

    def reached(amount: Column) -> Column:
        level = F.lit(0)
        for t in sorted(thresholds):
            level = F.when(amount >= t, t).otherwise(level)
        return level

    # totals never fall, so what was reached before a call is what the total before it reaches
    told = total.withColumn("reached", F.when(call, reached(F.col("total"))).otherwise(0)).withColumn("so_far", F.greatest("warned", reached(F.col("total") - F.col("_amount"))))
    return told.where("reached > so_far").select(*key, "ts", "event_id", F.lit(axis).alias("axis"), F.col("reached").cast("long").alias("threshold"), F.col("total").cast("long").alias("total"))


def rate_limit(calls: DataFrame, tool: str, max_calls: int = 2, key: tuple[str, ...] = ("run_id", "task_id", "dispatched_at")) -> DataFrame:
    """Adds call_number and allowed: only the first max_calls of a tool for each task and dispatch; other tools and calls of no task are free."""
    counts = (F.col("tool") == tool) & F.col("task_id").isNotNull()
    order = Window.partitionBy(*key, counts).orderBy("ts", "event_id")
    return calls.withColumn("call_number", F.when(counts, F.row_number().over(order))).withColumn("allowed", F.coalesce(F.col("call_number") <= max_calls, F.lit(True)))


def repeat_guard(calls: DataFrame, limit: int = 8, tool: str = "Edit", exempt: str | None = None, run: str = "run_id", task: str = "task_id", target: str = "file") -> DataFrame:
    """Adds episode, attempt and denied: in an episode (a stretch of one task) the call after `limit` of a tool on one file is denied, once; files that match exempt are free."""
    at = F.struct("ts", "event_id")
    own = carried(calls.withColumn("_task", F.struct(F.col(task).alias("t"))), [run], {"_before": (F.max_by("_task", at), lambda name: F.last(name))})
    order = Window.partitionBy(run, "_bucket").orderBy("ts", "event_id")
    last = F.coalesce(F.lag("_task").over(order), F.col("_before"))
    flagged = own.withColumn("_new", F.when(last.isNull() | ~last["t"].eqNullSafe(F.col(task)), 1).otherwise(0)).drop("_bucket", "_before", "_task")
    counted = carried(flagged, [run], {"_episodes": (F.sum("_new"), F.sum)})
    episodes = counted.withColumn("episode", F.coalesce("_episodes", F.lit(0)) + F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "_episodes", "_bucket")
    counts = (F.col("tool") == tool) & (~F.col(target).rlike(exempt) if exempt else F.lit(True))
    attempt = F.row_number().over(Window.partitionBy(run, "episode", target, counts).orderBy("ts", "event_id"))
    return episodes.withColumn("attempt", F.when(counts, attempt)).withColumn("denied", F.coalesce(F.col("attempt") == limit + 1, F.lit(False)))
