"""Dependency planning: order, circles, runnable and blocked tasks, resolved tasks, and the proof of batches (see filling)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions import documents
from runlens.plans import order
from runlens.shared import discard, exchanged, settled


def edges(tasks: DataFrame) -> DataFrame:
    """(id, needs): one row for each dependency."""
    return tasks.select("id", F.explode("depends_on").alias("needs")).distinct()


def invalid_deps(tasks: DataFrame) -> DataFrame:
    """(id, missing): dependencies that no task has."""
    known = tasks.select(F.col("id").alias("needs")).distinct().hint("merge")
    return edges(tasks).join(known, "needs", "left_anti").groupBy("id").agg(F.array_sort(F.collect_list("needs")).alias("missing"))


def levels(tasks: DataFrame) -> DataFrame:
    """(id, level): the length of the longest way of dependencies below each task; null on a circle or above one (see order). Dangling dependencies don't count."""
    ids = tasks.select("id").distinct()
    known = edges(tasks).join(ids.select(F.col("id").alias("needs")).hint("merge"), "needs").select("id", "needs")
    return settled(tasks.sparkSession, "levels", lambda: order.levels(ids, known))


def _settled(state: DataFrame, spread: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """state (id, label) after as many steps of spread (id, label) as change something; each id takes the greatest label."""
    while True:
        after = exchanged(state.unionByName(spread(state)).groupBy("id").agg(F.max("label").alias("label")), "labels")
        changed = after.join(state.withColumnRenamed("label", "_old").hint("merge"), "id", "left").where("_old IS NULL OR label <> _old")
        done = changed.isEmpty()
        discard(state)
        state = after
        if done:
            return state


def on_circles(tasks: DataFrame) -> DataFrame:
    """(id): tasks on a circle of dependencies.

    Contraction (see order) first takes off what is on none and makes chains one step. What is left is coloured by the greatest
    task that leads to each; a colour's tasks that lead back to that task are on circles with it (or it alone, if it needs itself), and
    go. Only dependencies within a colour can be on further circles. So there are as many rounds as circles stand one behind another.
    """
    return settled(tasks.sparkSession, "on-circles", lambda: _on_circles(tasks))


def _on_circles(tasks: DataFrame) -> DataFrame:
    ids = tasks.select("id").distinct()
    state = order.contract(ids, edges(tasks).join(ids.select(F.col("id").alias("needs")).hint("merge"), "needs").select("id", "needs"))
    left, found = state.edges.select("id", "needs"), [state.nodes.limit(0).select("id", F.col("id").alias("circle"))]
    while not left.isEmpty():
        nodes = exchanged(left.select("id").union(left.select("needs")).distinct().select("id", F.col("id").alias("label")), "labels")
        colour = _settled(nodes, lambda state: left.join(state.withColumnRenamed("id", "_n"), F.col("id") == F.col("_n")).select(F.col("needs").alias("id"), "label"))  # noqa: B023
        own = left.join(colour.select(F.col("id"), F.col("label").alias("_a")), "id").join(colour.select(F.col("id").alias("needs"), F.col("label").alias("_b")), "needs")
        inside = exchanged(own.where("_a = _b").select("id", "needs"), "edges")
        roots = exchanged(colour.where("id = label"), "labels")
        back = _settled(roots, lambda state: inside.join(state.withColumnRenamed("id", "_n"), F.col("needs") == F.col("_n")).select("id", "label"))  # noqa: B023
        left = exchanged(inside.join(back.select("id"), "id", "left_anti").join(back.select(F.col("id").alias("needs")), "needs", "left_anti").select("id", "needs"), "edges")
        many = back.join(inside.where("id = needs").select("id", F.lit(True).alias("_self")), "id", "left").join(back.groupBy("label").agg(F.count("*").alias("_size")), "label")
        found.append(exchanged(many.where("_size > 1 OR _self").select("id", F.col("label").alias("circle")), "on-circles"))
    return order.on_circles(functools.reduce(DataFrame.unionByName, found), state)


def readiness(tasks: DataFrame) -> DataFrame:
    """(id, state) of pending tasks: runnable if every dependency is done, blocked_by_dep if one is blocked or deferred, invalid if one is missing, else waiting."""
    status = tasks.select(F.col("id").alias("needs"), F.col("status").alias("_status")).hint("merge")
    pending = tasks.where("status = 'pending'").select("id", F.explode_outer("depends_on").alias("needs"))
    told = pending.join(status, "needs", "left").groupBy("id").agg(
        F.bool_or(F.col("needs").isNotNull() & F.col("_status").isNull()).alias("missing"),
        F.bool_or(F.coalesce(F.col("_status").isin("blocked", "deferred"), F.lit(False))).alias("blocked"),
        F.bool_and(F.col("needs").isNull() | F.coalesce(F.col("_status") == "done", F.lit(False))).alias("ready"),
    )
    state = F.when(F.col("missing"), "invalid").when(F.col("blocked"), "blocked_by_dep").when(F.col("ready"), "runnable").otherwise("waiting")
    return told.select("id", state.alias("state"))


def next_task(tasks: DataFrame) -> DataFrame:
    """The first runnable task by id, and how many there are: one row, with status 0, or 4 if nothing can run."""
    counted = readiness(tasks).agg(F.min(F.when(F.col("state") == "runnable", F.col("id"))).alias("id"), F.count_if(F.col("state") == "runnable").alias("runnable"), F.count_if(F.col("state") == "blocked_by_dep").alias("blocked"))
    return counted.withColumn("exit_code", F.when(F.col("runnable") > 0, 0).otherwise(4))


def routed(role: Column, complexity: Column, models: dict[str, str], ladder: list[str], low_cap: str, high_floor: str, never_downgrade: list[str]) -> Column:
    """The model of a role: no higher than low_cap for low complexity, no lower than high_floor for high; an unknown model ranks in the middle."""
    base = F.element_at(F.create_map(*[F.lit(x) for pair in models.items() for x in pair]), role)
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in zip(ladder, range(len(ladder)), strict=True) for x in pair]), base), F.lit(len(ladder) // 2))
    low = (complexity == "low") & ~role.isin(*never_downgrade) & (rank > ladder.index(low_cap))
    high = (complexity == "high") & (rank < ladder.index(high_floor))
    return F.when(low, low_cap).when(high, high_floor).otherwise(base)


def resolve(tasks: DataFrame, models: dict[str, str], ladder: list[str], low_cap: str, high_floor: str, never_downgrade: list[str], role_k: dict[str, int], default_k: int = 6, allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds model, baseline, applied, k (the task's, else its role's, else the default) and skills (those that the role's group allows, all without a group)."""
    lookup = lambda d: F.element_at(F.create_map(*[F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)) for pair in d.items() for x in pair]), F.col("role")) if d else F.lit(None)
    model, base, group = routed(F.col("role"), F.coalesce("complexity", F.lit("medium")), models, ladder, low_cap, high_floor, never_downgrade), lookup(models), lookup(allowed or {})
    skills = F.col("skills_to_load")
    return tasks.withColumns({"model": model, "baseline": base, "applied": model != base, "k": F.coalesce("k", lookup(role_k), F.lit(default_k)), "skills": F.when(group.isNull(), skills).otherwise(F.array_intersect(skills, group)) if allowed else skills})


def coverage(planned: DataFrame, reported: DataFrame) -> DataFrame:
    """planned (batch, path), reported (batch) -> one row: batches, files, those reported, and whether all are, with exit_code 0, 1 or (nothing planned) 2."""
    told = reported.select("batch").distinct().withColumn("told", F.lit(1))
    all_batches = planned.groupBy("batch").agg(F.count("*").alias("files")).join(told, "batch", "left")
    counts = all_batches.agg(F.count("*").alias("batches"), F.count("told").alias("reported"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum(F.when(F.col("told") == 1, F.col("files"))), F.lit(0)).alias("covered"))
    return counts.withColumn("exit_code", F.when(F.col("batches") == 0, 2).when(F.col("batches") == F.col("reported"), 0).otherwise(1))


#: What a task's status may become.
TRANSITIONS = {"pending": ["running", "deferred"], "running": ["done", "blocked"], "blocked": ["pending", "deferred"], "deferred": ["pending"], "done": []}
#: Exit codes of a plan.
OK, FAILED, NOTHING, CIRCLE, NOT_RUNNABLE = range(5)


def invalid_transitions(changes: DataFrame) -> DataFrame:
    """changes (id, seq, status) -> (id, seq, before, status) where a task's next status isn't one that may follow; the first has to be pending."""
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    told = changes.withColumn("before", F.lag("status").over(Window.partitionBy("id").orderBy("seq")))
    fits = F.when(F.col("before").isNull(), F.col("status") == "pending").otherwise(F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("before")), F.col("status")), F.lit(False)))
    return told.where(~F.coalesce(fits, F.lit(False))).select("id", "seq", "before", "status")


def plan(tasks: DataFrame) -> DataFrame:
    """One row: exit_code 3 and nothing to run where dependencies make a circle, else what next_task says."""
    circle = on_circles(tasks).agg(F.count("*").alias("on_circles"))
    both = next_task(tasks).unionByName(circle, allowMissingColumns=True)
    told = both.agg(*[F.max(c).alias(c) for c in both.columns])
    broken = F.col("on_circles") > 0
    return told.select(F.when(~broken, F.col("id")).alias("id"), F.when(broken, 0).otherwise(F.col("runnable")).alias("runnable"), "blocked", "on_circles", F.when(broken, CIRCLE).otherwise(F.col("exit_code")).alias("exit_code"))


def single_task(tasks: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (id) -> (id, exit_code, error): 0 for a runnable task; 4 where dependencies are pending, or it isn't pending or unknown."""
    told = wanted.select("id").join(readiness(tasks).hint("merge"), "id", "left")
    runs = F.coalesce(F.col("state") == "runnable", F.lit(False))
    return told.select("id", F.when(runs, OK).otherwise(NOT_RUNNABLE).alias("exit_code"), F.when(~runs, F.concat("id", F.lit(" is not runnable: "), F.coalesce("state", F.lit("not pending")))).alias("error"))


def from_documents(docs: DataFrame, key: str = "path") -> DataFrame:
    """(key, id, role, status, intent, depends_on, skills_to_load, complexity, k) of task documents (key, text) by their front matter; documents without one are left out."""
    fm = documents.front_matter(F.col("text"))
    told = docs.select(key, fm.alias("_fm")).where("_fm IS NOT NULL")
    listed = lambda k: F.coalesce(F.try_element_at("_fm", F.lit(k)), F.array().cast("array<string>")).alias(k)
    one = lambda k: documents.scalar(F.col("_fm"), k).alias(k)
    return told.select(key, one("id"), one("role"), one("status"), one("intent"), listed("depends_on"), listed("skills_to_load"), one("complexity"), documents.scalar(F.col("_fm"), "k").try_cast("int").alias("k"))


def partition_faults(files: DataFrame, planned: DataFrame) -> DataFrame:
    """(path, n): files that aren't in exactly one batch of planned (batch, path), and planned paths that are no file (n is null)."""
    counted = planned.groupBy("path").agg(F.count("*").alias("n"))
    told = files.select("path").distinct().withColumn("_there", F.lit(True)).join(counted, "path", "full_outer")
    return told.where("_there IS NULL OR n IS NULL OR n <> 1").select("path", F.when(F.col("_there"), F.coalesce("n", F.lit(0))).alias("n"))


def is_strict_subset(keys: Column, of: Column) -> Column:
    """Whether all of keys are in the other list, which has more."""
    return (F.size(F.array_except(keys, of)) == 0) & (F.size(F.array_except(of, keys)) > 0)
