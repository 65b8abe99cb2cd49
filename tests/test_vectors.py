"""Nearest vectors: exact ones against plain sorting, approximate ones by recall and by how many rows are ranked."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.operators import retrieval, vectors


def frame(spark, points, name="id"):
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], f"{name} long, embedding array<float>").repartition(4)


def nearest(points, queries, k=6):
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit(queries) @ unit(points).T
    return {(q, i) for q in range(len(queries)) for i in np.argsort(-near[q], kind="stable")[:k].tolist()}


@pytest.mark.parametrize(("kind", "probes", "share"), [("random", 48, 0.1), ("clusters", 8, 0.05)])
def test_recall_with_few_rows_ranked(spark, kind, probes, share):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(4000, 64)) if kind == "random" else rng.normal(size=(50, 64))[rng.integers(0, 50, 4000)] + 0.25 * rng.normal(size=(4000, 64))
    points = points.astype(np.float32)
    queries = points[::100]
    chunks, asked = frame(spark, points), frame(spark, queries, "query")
    got = {(r["query"], r["id"]) for r in vectors.approximate(chunks, asked, 64, probes=probes, shortlist=int(share * len(points))).collect()}
    want = nearest(points, queries)
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)
    assert {(r["query"], r["id"]) for r in vectors.exact(chunks, asked, 64, per_block=15).collect()} == want


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [1.0, 0.0, 0.0]), (7, [0.0, 0.0]), (8, [None, 1.0]), (9, [float("nan"), 1.0]), (10, [2.0, 0.0])]
    chunks = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = spark.createDataFrame([("q", [3.0, 0.0]), ("z", [0.0, 0.0]), ("n", None)], "query string, embedding array<float>")
    for find in (vectors.exact, vectors.approximate):
        assert [(r["query"], r["id"], r["place"]) for r in find(chunks, asked, 2, k=3).orderBy("place").collect()] == [("q", 1, 1), ("q", 3, 2), ("q", 10, 3)]
        assert sorted(r["id"] for r in find(chunks, asked, 2, k=9).collect()) == [1, 2, 3, 10]
        assert find(chunks.limit(0), asked, 2).count() == 0 and find(chunks, asked.limit(0), 2).count() == 0
    copies = spark.range(0, 50).selectExpr("50 - id AS id", "array(float(1), float(2)) AS embedding")
    assert sorted(r["id"] for r in vectors.exact(copies, asked, 2, k=2).collect()) == [1, 2]


def test_scoped_search_meets_by_blocks(spark):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(size=(300, 5)), np.ones((60, 5)), 3 * np.ones((40, 5))]).astype(np.float32)  # many as near as the last that counts
    rows = [(i, p.tolist(), "a" if i % 3 else "b") for i, p in enumerate(points)]
    odd = [(900, [0.0] * 5, "a"), (901, None, "a"), (902, [], "a"), (903, [1.0, None, 1.0, 1.0, 1.0], "a"), (904, [float("nan")] + [1.0] * 4, "b"), (905, [1.0, 2.0], "a"), (906, [1.0] * 5, None), (907, [1.0] * 5, "alone")]
    chunks = spark.createDataFrame(rows + odd, "id long, embedding array<float>, skill string").repartition(4)
    asked = chunks.where("id % 9 = 0 OR id > 890").withColumnRenamed("id", "query")
    both = chunks.join(asked.select("query", F.col("embedding").alias("q"), F.col("skill").alias("s"), F.size("embedding").alias("n")), F.expr("skill = s AND size(embedding) = n"))
    near = both.select("query", "id", retrieval.cosine(F.col("embedding"), F.col("q")).alias("similarity")).where("similarity IS NOT NULL")
    told = near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))).where("place <= 6")
    want = sorted(map(str, told.collect()))
    for per in ((4096, 1024), (30, 7), (1000, 1)):
        found = retrieval.retrieve_many(chunks, asked, rows_a_block=per[0], queries_a_block=per[1])
        assert sorted(map(str, found.select("query", "id", "similarity", "place").collect())) == want
    assert "aggregate(" not in found._jdf.queryExecution().toString()  # no cosine of a row for each pair
    assert retrieval.retrieve_many(chunks, asked.limit(0)).count() == 0 and retrieval.retrieve_many(chunks.limit(0), asked).count() == 0
