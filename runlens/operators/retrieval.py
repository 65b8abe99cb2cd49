"""Exact nearest vectors by cosine; vectors.py has the approximate ones, and exact ones of many queries without a scope."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.shared import prepare


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null where one has no length or no direction."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def scoped(chunks: DataFrame, scope: list | None, enabled: list | None = None, column: str = "skill") -> DataFrame:
    """Chunks of the scope asked for, else of the enabled ones; an empty list doesn't restrict."""
    wanted = scope or enabled
    return chunks.where(F.col(column).isin(*wanted)) if wanted else chunks


def retrieve(chunks: DataFrame, vector: list[float], k: int = 6, key: str = "id") -> DataFrame:
    """The k chunks nearest to one vector, ties by key; chunks of other dimensions are left out (see mismatched)."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    near = chunks.where(F.size("embedding") == len(vector)).withColumn("similarity", cosine(F.col("embedding"), query))
    return near.where("similarity IS NOT NULL").orderBy(F.desc("similarity"), key).limit(k)


def mismatched(chunks: DataFrame, dimensions: int) -> DataFrame:
    """One row: how many chunks a query of so many dimensions has to skip."""
    return chunks.agg(F.count_if(F.coalesce(F.size("embedding"), F.lit(-1)) != dimensions).alias("skipped"), F.count("*").alias("chunks"))


def _cosines(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What cosine says of each line of a with each of b, to the last bit, as it adds in the same order; and where it is null."""
    out, squares = np.zeros((len(a), len(b))), [np.zeros(len(a)), np.zeros(len(b))]
    for x, y in zip(a.T, b.T, strict=True):
        out += np.multiply.outer(x, y)
        squares[0] += x * x
        squares[1] += y * y
    lengths = np.multiply.outer(*map(np.sqrt, squares))
    with np.errstate(all="ignore"):
        return out / lengths, lengths == 0


def _first(order: np.ndarray, k: int) -> np.ndarray:
    """Which of each line are its k largest; of equal ones, those that come first."""
    if order.shape[1] <= k:
        return np.ones(order.shape, bool)
    last = -np.partition(-order, k - 1, 1)[:, k - 1 : k]
    more, equal = order > last, order == last
    return more | equal & (np.cumsum(equal, 1) <= k - more.sum(1, keepdims=True))


def retrieve_many(chunks: DataFrame, queries: DataFrame, k: int = 6, key: str = "id", scope: str = "skill", rows_a_block: int = 4096, queries_a_block: int = 1024) -> DataFrame:
    """For each row of queries (query, embedding, scope) the k nearest chunks of its scope, ties by key: (query, key, similarity, place).

    A scope's rows and queries are dealt into blocks of about so many, and each block of rows meets each of queries in one group,
    which keeps k rows a query. So a task holds two blocks and the scores of 64 queries, however large a scope is; only scopes of
    more than one block have a row in a table that is broadcast. Every pair of a scope is compared, which is quadratic by nature.
    """
    prepare(chunks.sparkSession)
    there = (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull()) & F.col(scope).isNotNull()
    rows = chunks.where(there).select(F.col(scope).alias("_s"), F.size("embedding").alias("_d"), F.col(key).alias("_key"), F.col("embedding").alias("_v"))
    asked = queries.where(there).select(F.col(scope).alias("_s"), F.size("embedding").alias("_d"), "query", F.col("embedding").alias("_v"))
    blocks = lambda df, per, name: df.groupBy("_s").agg(F.ceil(F.count("*") / per).cast("int").alias(name)).where(F.col(name) > 1)
    large = F.broadcast(blocks(rows, rows_a_block, "_rows").join(blocks(asked, queries_a_block, "_queries"), "_s", "full_outer"))

    def dealt(df: DataFrame, by: str, own: str, other: str):  # noqa: ANN202
        n = lambda name: F.coalesce(name, F.lit(1))
        told = df.join(large, "_s", "left").withColumns({own: F.pmod(F.xxhash64(by), n(own)).cast("int"), other: F.explode(F.sequence(F.lit(0), n(other) - 1))})
        return told.groupBy("_s", "_d", "_rows", "_queries")

    def vectors(column: pa.ChunkedArray) -> np.ndarray:
        return np.asarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if left.num_rows and right.num_rows:
            left = left.take(pc.sort_indices(left, sort_keys=[("_key", "ascending")], null_placement="at_start"))
            own, q = vectors(left["_v"]), vectors(right["_v"])
            for low in range(0, len(q), 64):
                scores, null = _cosines(q[low : low + 64], own)
                order = np.where(null, -np.inf, np.where(np.isnan(scores), np.inf, scores))  # what isn't a number comes first, as in Spark
                query, row = np.nonzero(_first(order, k) & ~null)
                for column, values in zip(found, (query + low, row, scores[query, row]), strict=True):
                    column.append(values)
        query, row, score = map(np.concatenate, found)
        return pa.table([right["query"].take(pa.array(query)), left["_key"].take(pa.array(row)), pa.array(score)], ["query", key, "similarity"])

    kinds = [asked.schema["query"].dataType.simpleString(), rows.schema["_key"].dataType.simpleString()]
    both = dealt(rows, "_key", "_rows", "_queries").cogroup(dealt(asked, "query", "_queries", "_rows"))
    best = both.applyInArrow(nearest, f"query {kinds[0]}, {key} {kinds[1]}, similarity double")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query", key, "similarity", "place")
