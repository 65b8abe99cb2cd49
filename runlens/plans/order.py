"""The order of dependent tasks by contraction: levels and circles in rounds that don't grow with the length of chains.

A round takes off tasks that need nothing (their level is known), puts off those that nothing needs, and contracts chains, in which each
task has one need and that need one follower: by doubling, each learns the end of its chain and how its level follows from the end's
as max(base, level + weight). Chains, trees and what hangs on circles take as many rounds as their number has digits; a lattice
still takes a round for each of its levels.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.shared import discard, exchanged


@dataclass
class Contracted:
    """What rounds leave: nodes (id, base) and edges (id, needs, weight) on or between circles, tasks settled (id, level), and those put off, the last ones last."""

    nodes: DataFrame
    edges: DataFrame
    settled: list[DataFrame] = field(default_factory=list)
    put_off: list[DataFrame] = field(default_factory=list)
    closed: list[DataFrame] = field(default_factory=list)
    rounds: int = 0


def _without(rows: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select(F.col("id").alias("_gone")), F.col(column) == F.col("_gone"), "left_anti")


def _raised(nodes: DataFrame, by: DataFrame) -> DataFrame:
    """nodes with base no less than by (id, base) says."""
    most = by.groupBy("id").agg(F.max("base").alias("_base"))
    return nodes.join(most.hint("merge"), "id", "left").select("id", F.greatest("base", F.coalesce("_base", F.lit(0))).alias("base"))


def _chains(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(links, closed): links (id, end, base, weight) of all tasks in chains but their ends; closed (id) of chains without an end, which are circles."""
    one = lambda c: edges.groupBy(c).agg(F.count("*").alias("_n")).where("_n = 1").select(F.col(c).alias(f"_{c}"))
    single = edges.join(one("id"), F.col("id") == F.col("_id")).join(one("needs"), F.col("needs") == F.col("_needs"))
    links = exchanged(single.join(nodes, "id").select("id", F.col("needs").alias("end"), "base", "weight"), "links")
    n = links.count()
    if not n:
        discard(links)
        return None
    for _ in range(n.bit_length() + 1):
        ahead = links.select(F.col("id").alias("_at"), F.col("end").alias("_end"), F.col("base").alias("_base"), F.col("weight").alias("_weight"))
        both = links.join(ahead, F.col("end") == F.col("_at"), "left")
        there = F.col("_at").isNotNull()
        longer = both.select("id", F.coalesce("_end", "end").alias("end"), F.when(there, F.greatest("base", F.col("weight") + F.col("_base"))).otherwise(F.col("base")).alias("base"), (F.col("weight") + F.coalesce("_weight", F.lit(0))).alias("weight"))
        after = exchanged(longer, "links")
        open_ = after.join(after.select(F.col("id").alias("end")), "end", "left_semi")
        discard(links)
        links = after
        if open_.isEmpty():
            break
    linked = links.select(F.col("id").alias("_linked"))
    closed = exchanged(links.join(linked, F.col("end") == F.col("_linked"), "left_semi").select("id"), "closed")
    ended = exchanged(links.join(linked, F.col("end") == F.col("_linked"), "left_anti"), "links")
    discard(links)
    return ended, closed


def contract(tasks: DataFrame, needs: DataFrame) -> Contracted:
    """tasks (id) and needs (id, needs), both without repeats and all ids known."""
    state = Contracted(exchanged(tasks.select("id", F.lit(0).cast("long").alias("base")), "nodes"), exchanged(needs.select("id", "needs", F.lit(1).cast("long").alias("weight")), "edges"))
    while True:
        state.rounds += 1
        nodes, edges, changed = state.nodes, state.edges, False
        free = exchanged(nodes.join(edges.select("id").distinct(), "id", "left_anti").select("id", F.col("base").alias("level")), "settled")
        if free.isEmpty():
            discard(free)
        else:
            changed = True
            state.settled.append(free)
            told = edges.join(free.select(F.col("id").alias("needs"), "level"), "needs").select("id", (F.col("level") + F.col("weight")).alias("base"))
            nodes = exchanged(_raised(_without(nodes, "id", free), told), "nodes")
            edges = exchanged(_without(edges, "needs", free), "edges")
        tops = exchanged(nodes.join(edges.select(F.col("needs").alias("id")).distinct(), "id", "left_anti").join(edges, "id").select("id", F.col("needs").alias("end"), "base", "weight", F.lit(None).cast(nodes.schema["id"].dataType).alias("follower")), "put-off")
        if tops.isEmpty():
            discard(tops)
        else:
            changed = True
            state.put_off.append(tops)
            nodes, edges = (exchanged(_without(x, "id", tops.select("id").distinct()), "rest") for x in (nodes, edges))
        found = _chains(nodes, edges)
        if found:
            links, closed = found
            changed = True
            state.closed.append(closed)
            whole = links.join(edges.select(F.col("id").alias("_by"), F.col("needs").alias("_to")), F.col("id") == F.col("_to"), "left")
            # Inside a chain the follower is a link itself; the chain's is that of its top, whose follower is none.
            top = whole.join(links.select(F.col("id").alias("_by")), "_by", "left_anti").select("end", F.col("_by").alias("follower"))
            state.put_off.append(exchanged(links.join(top, "end", "left").select("id", "end", "base", "weight", "follower"), "put-off"))
            gone = links.select("id").union(closed.select("id"))
            outer = _without(edges, "id", gone)
            via = outer.join(links.select(F.col("id").alias("needs"), "end", "base", F.col("weight").alias("_more")), "needs", "left")
            raised = via.where("end IS NOT NULL").select("id", (F.col("base") + F.col("weight")).alias("base"))
            shorter = via.select("id", F.coalesce("end", "needs").alias("needs"), (F.col("weight") + F.coalesce("_more", F.lit(0))).alias("weight"))
            nodes = exchanged(_raised(_without(nodes, "id", gone), raised), "nodes")
            edges = exchanged(shorter.groupBy("id", "needs").agg(F.max("weight").alias("weight")), "edges")
            discard(links)
        if state.nodes is not nodes:
            discard(state.nodes)
        if state.edges is not edges:
            discard(state.edges)
        state.nodes, state.edges = nodes, edges
        if not changed or nodes.isEmpty():
            return state


def levels(tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """(id, level): the length of the longest way of needs below each task; null on a circle or above one."""
    state = contract(tasks, needs)
    none = F.lit(None).cast("long").alias("level")
    known = state.nodes.select("id", none)
    for part in state.settled:
        known = known.union(part)
    for part in state.closed:
        known = known.union(part.select("id", none))
    known = exchanged(known, "levels")
    for part in reversed(state.put_off):
        told = part.join(known.select(F.col("id").alias("end"), F.col("level").alias("_level")), "end").groupBy("id").agg(F.bool_and(F.col("_level").isNotNull()).alias("_known"), F.max(F.greatest("base", F.col("_level") + F.col("weight"))).alias("level"))
        after = exchanged(known.union(told.select("id", F.when(F.col("_known"), F.col("level")).alias("level"))), "levels")
        discard(known)
        known = after
    return known


def on_circles(circles: DataFrame, state: Contracted) -> DataFrame:
    """circles (id, circle) of what is left of state -> (id) of all tasks on circles: those of a chain are on one if its end and its follower are on the same."""
    known = circles
    for part in state.closed:
        known = known.union(part.select("id", F.col("id").alias("circle")))
    known = exchanged(known, "circles")
    for part in reversed(state.put_off):
        label = lambda c: known.select(F.col("id").alias(c), F.col("circle").alias(f"_{c}"))  # noqa: B023, E731
        told = part.join(label("end"), "end").join(label("follower"), "follower").where("_end = _follower").select("id", F.col("_end").alias("circle")).distinct()  # a top may have several followers
        after = exchanged(known.union(told), "circles")
        discard(known)
        known = after
    return known.select("id")
