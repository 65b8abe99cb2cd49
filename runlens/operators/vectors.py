"""An inverted file of vectors: lists around centroids, product codes of what is left, and exact ranking of a shortlist."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators.retrieval import cosine
from runlens.shared import materialize, prepare


def _kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """k centers; a center without points moves to the point that is farthest from its own."""
    rng = np.random.default_rng(seed)
    centers = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        nearest, far = _nearest(points, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, points)
        n = np.bincount(nearest, minlength=len(centers))
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
        for empty, worst in zip(np.flatnonzero(n == 0), np.argsort(-far), strict=False):
            centers[empty] = points[worst]
    return centers


def _nearest(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest center and its squared distance."""
    square = (centers * centers).sum(1) - 2 * points @ centers.T
    best = square.argmin(1)
    return best, square[np.arange(len(points)), best] + (points * points).sum(1)


@dataclass
class Codebook:
    """centroids (lists x dimensions) and, for each slice of the dimensions, the centers that what is left of a vector is coded by."""

    centroids: np.ndarray
    slices: list[np.ndarray]
    words: list[np.ndarray]

    def code(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of unit vectors; codes have a byte for each slice."""
        own = _nearest(vectors, self.centroids)[0]
        left = vectors - self.centroids[own]
        return own, np.stack([_nearest(left[:, s], w)[0] for s, w in zip(self.slices, self.words, strict=True)], 1).astype(np.uint8)

    def scores(self, queries: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate cosines, queries x rows: the list's centroid's own and, for each slice, that of the code's center."""
        out = (queries @ self.centroids.T)[:, lists]
        for i, (s, w) in enumerate(zip(self.slices, self.words, strict=True)):
            out += (queries[:, s] @ w.T)[:, codes[:, i]]
        return out


def _units(column: pa.Array, dimensions: int) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dimensions)
    return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-30)


def _searchable(rows: DataFrame, dimensions: int) -> DataFrame:
    """Rows whose embedding has so many dimensions, no null in it, and a direction."""
    return rows.where((F.size("embedding") == dimensions) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0))


def fit(chunks: DataFrame, dimensions: int, key: str = "id", lists: int = 64, slices: int = 16, most_rows: int = 20_000) -> Codebook:
    """A codebook fitted on the driver to at most most_rows vectors, those of the smallest hashes of their keys; centers are at most lists and 256 a slice."""
    rows = _searchable(chunks, dimensions).select("embedding").orderBy(F.xxhash64(key)).limit(most_rows).toArrow()
    points = _units(rows.column(0).combine_chunks(), dimensions) if rows.num_rows else np.zeros((1, dimensions))
    centroids = _kmeans(points, lists)
    left = points - centroids[_nearest(points, centroids)[0]]
    cut = np.array_split(np.arange(dimensions), min(slices, dimensions))
    return Codebook(centroids, cut, [_kmeans(left[:, s], 256) for s in cut])


def index(chunks: DataFrame, book: Codebook, key: str = "id") -> DataFrame:
    """(key, list, code), a written table, of every row that can be searched: its list and a byte for each slice."""
    dimensions = book.centroids.shape[1]
    prepare(chunks.sparkSession)
    kind = chunks.select(key).schema[0].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, codes = book.code(_units(batch.column(1), dimensions))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], [key, "list", "code"])

    coded = _searchable(chunks, dimensions).select(key, "embedding").mapInArrow(code, f"{key} {kind}, list int, code binary")
    return materialize(coded, "vector-index")


def _top(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each line of scores with their keys; where more are as good as the last, those of the smallest keys."""
    if scores.shape[1] <= k:
        return scores, keys
    top = np.argpartition(-scores, k - 1, 1)[:, :k]
    last = np.take_along_axis(scores, top, 1).min(1)
    for line in np.flatnonzero(((scores >= last[:, None]).sum(1) > k) & np.isfinite(last)):
        ties = np.flatnonzero(scores[line] >= last[line])
        top[line] = sorted(ties.tolist(), key=lambda i: (-scores[line, i], keys[line, i]))[:k]
    return np.take_along_axis(scores, top, 1), np.take_along_axis(keys, top, 1)


def _best(rows: DataFrame, queries: DataFrame, key: str, k: int, score: Callable[[np.ndarray, pa.RecordBatch], np.ndarray], per_block: int, dimensions: int, per_piece: int = 1024) -> DataFrame:
    """(query, key, score): for each query the k best rows of each partition, queries in blocks of per_block, each block broadcast and held against all rows; a task holds the scores of a block with k rows and per_piece more."""
    spark = rows.sparkSession
    kinds = [queries.select("query").schema[0].dataType.simpleString(), rows.select(key).schema[0].dataType.simpleString()]
    schema = f"query {kinds[0]}, {key} {kinds[1]}, score double"
    n = queries.count()
    blocks = max(1, -(-n // per_block))
    out = spark.createDataFrame([], schema)
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).select("query", "embedding").toArrow()
        if not part.num_rows:
            continue
        sent = spark.sparkContext.broadcast((part.column(0).combine_chunks(), _units(part.column(1).combine_chunks(), dimensions)))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, vectors = sent.value
            kept, scores = None, np.zeros((len(ids), 0))
            for batch in batches:
                for low in range(0, batch.num_rows, per_piece):
                    piece = batch.slice(low, per_piece)
                    new = np.broadcast_to(np.asarray(piece.column(0).to_pylist(), object), (len(ids), piece.num_rows))
                    scores = np.concatenate([scores, score(vectors, piece)], 1)
                    kept = new if kept is None else np.concatenate([kept, new], 1)
                    scores, kept = _top(scores, kept, k)
            if kept is not None:
                there = np.isfinite(scores)
                rows_, _ = np.nonzero(there)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows_)), pa.array(kept[there].tolist()), pa.array(scores[there])], ["query", key, "score"])

        found = rows.mapInArrow(scan, schema)
        out = found if blocks == 1 else out.unionByName(found)
    return out


def exact(chunks: DataFrame, queries: DataFrame, dimensions: int, k: int = 6, key: str = "id", per_block: int = 1000) -> DataFrame:
    """For each row of queries (query, embedding) the k chunks of all that are nearest by cosine: (query, key, similarity, place), ties by key.

    Queries come in blocks of per_block; a task keeps the 2 k best of its rows for each, so what is shuffled is 2 k rows a query and task.
    """
    prepare(chunks.sparkSession)
    near = lambda vectors, batch: np.round(vectors @ _units(batch.column(1), dimensions).T, 12)
    best = _best(_searchable(chunks, dimensions).select(key, "embedding"), _searchable(queries, dimensions), key, 2 * k, near, per_block, dimensions)
    return _ranked(best.select("query", key), chunks, queries, k, key)


def _ranked(pairs: DataFrame, chunks: DataFrame, queries: DataFrame, k: int, key: str) -> DataFrame:
    both = pairs.join(chunks.select(key, "embedding"), key).join(queries.select("query", F.col("embedding").alias("_q")), "query")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
    ranked = both.withColumn("similarity", cosine(F.col("embedding"), F.col("_q"))).where("similarity IS NOT NULL").withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= k).select("query", key, "similarity", "place")


def approximate(chunks: DataFrame, queries: DataFrame, dimensions: int, k: int = 6, key: str = "id", lists: int = 64, probes: int = 48, shortlist: int = 200, per_block: int = 1000) -> DataFrame:
    """Like exact, but only `shortlist` rows a query are ranked by their vectors: the best by their codes in the `probes` lists nearest to the query.

    The lists and codes are fitted to a bounded sample (see fit), every row is indexed. Fewer probes and a longer shortlist suit vectors
    in clusters; those without clusters need most lists. Queries for which the lists hold fewer than k rows are answered by exact.
    Rows and queries of other dimensions, with nulls, or without direction are left out. No rows or queries give no rows.
    """
    book = fit(chunks, dimensions, key, lists)
    coded = index(chunks, book, key)

    def near(vectors: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        own, codes = batch.column(1).to_numpy(), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        scores = book.scores(vectors, own, codes)
        by_list = vectors @ book.centroids.T
        if probes < by_list.shape[1]:
            probed = by_list >= -np.partition(-by_list, probes - 1, 1)[:, probes - 1 : probes]
            scores[~probed[:, own]] = -np.inf
        return scores

    asked = _searchable(queries, dimensions)
    best = _best(coded, asked, key, shortlist, near, per_block, dimensions)
    order = Window.partitionBy("query").orderBy(F.desc("score"), key)
    short = best.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= shortlist).select("query", key)
    found = materialize(_ranked(short, chunks, queries, k, key), "nearest")
    enough = found.where(F.col("place") == k).select("query")
    few = asked.join(enough, "query", "left_anti")
    if few.isEmpty():
        return found
    return found.join(few.select("query"), "query", "left_anti").unionByName(exact(chunks, few, dimensions, k, key, per_block))
