"""Near-dedup: min-max hashing finds candidates, full shingle sets confirm them, components group them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm.common import discard, materialize, prepare, salted_join, utf8
from runlens.llm.shingles import mix, shingle_sets


def band_plan(percent: int, miss: float = 1e-6) -> tuple[int, int]:
    """(rows, bands) with which a pair at the threshold misses every band with odds of at most miss."""
    rows = 5 if percent >= 85 else 4
    return rows, math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def signature(shingles: np.ndarray, keys: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Minima of the set under all permutations, then its maxima: two values for each hash that is computed.

    A band takes values that follow one another, so it has each permutation once.
    """
    low, high = np.full(len(keys), 2**64 - 1, np.uint64), np.zeros(len(keys), np.uint64)
    for i in range(0, len(shingles), 16384):
        h = (shingles[None, i : i + 16384] ^ keys[:, None]) * odd[:, None]
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    return np.concatenate([low, high])


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n], seeds[n:] | np.uint64(1)


def _node(shingles: np.ndarray) -> bytes:
    """A name of 128 bits for a shingle set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(docs: DataFrame, words: int, percent: int, key: int = 0, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, the columns keep, n_shingles, node, bands, sketch): node names the shingle set, sketch has 16 bits of each signature value."""
    prepare(docs.sparkSession)
    rows, bands = band_plan(percent)
    keys, odd = permutations(-(-rows * bands // 2))
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
    names = ["doc_id", *(keep or [])]
    told = T.StructType().add("n_shingles", "long").add("node", "binary").add("bands", T.ArrayType(T.LongType())).add("sketch", "binary")
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in names), *told])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, size, begin = utf8(batch.column(len(names))), 0, 0
            for end, text in enumerate(texts, 1):
                size += len(text)
                if size < 1 << 20 and end < len(texts):
                    continue
                sets = shingle_sets(texts[begin:end], words, key)
                nodes, found, sketches = [], [], []
                for s in sets:
                    if not len(s):
                        nodes.append(None), found.append(None), sketches.append(None)
                        continue
                    values = signature(s, keys, odd)[: rows * bands]
                    band = salt.copy()
                    for j in range(rows):
                        band = mix(band * np.uint64(3) + values.reshape(bands, rows)[:, j])
                    nodes.append(_node(s))
                    found.append(band.view(np.int64))
                    sketches.append((values >> np.uint64(40)).astype("<u2").tobytes())
                counts = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.slice(begin, end - begin) for c in batch.columns[:-1]), counts, pa.array(nodes, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], schema.names)
                begin, size = end, 0

    return docs.select(*names, F.col("text").cast("string").alias("_text")).mapInArrow(sign, schema)


def _full_sets(docs: DataFrame, words: int, key: int = 0) -> DataFrame:
    """(node, shingles) of docs (node, text), where the text is the node's: one doc_id can have unlike texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, texts, size, begin = batch.column(0).to_pylist(), utf8(batch.column(1)), 0, 0
            for end, text in enumerate(texts, 1):
                size += len(text)
                if size < 1 << 20 and end < len(texts):
                    continue
                own = [(n, s.tobytes()) for n, s in zip(nodes[begin:end], shingle_sets(texts[begin:end], words, key), strict=True) if _node(s) == n]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in own], pa.binary()) for i in range(2)], ["node", "shingles"])
                begin, size = end, 0

    return docs.select("node", "text").mapInArrow(sets, "node binary, shingles binary")


def _prefixes(sets: DataFrame, opened: DataFrame, percent: int) -> DataFrame:
    """(shingle, node, n, place, label): for each node of opened (node, label) the rarest of its shingles, by how many opened nodes have them.

    All nodes order shingles alike, by that number and then by value, and place is a shingle's place in the node's
    order. Sets of n and m shingles that share k have a common one at a place of at most n - k and m - k, so shingles
    at later places are left out, like those that no other node has.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                found = [np.frombuffer(x, np.int64) for x in part.column("shingles").to_pylist()]
                if found:
                    sizes = np.array([len(x) for x in found])
                    owner = pa.array(np.repeat(np.arange(len(found)), sizes))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), part.column("node").take(owner), pa.array(np.repeat(sizes, sizes)), part.column("label").take(owner)], ["shingle", "node", "n", "label"])

    spread = materialize(sets.join(opened, "node").mapInArrow(rows, "shingle long, node binary, n long, label binary"), "shingles")
    shared = materialize(spread.groupBy("shingle").agg(F.count("*").alias("among")).where("among > 1"), "shared-shingles")
    own = Window.partitionBy("node")
    place = F.row_number().over(own.orderBy("among", "shingle")) - 1 + F.col("n") - F.count("*").over(own)
    placed = spread.join(shared, "shingle").withColumn("place", place)
    out = materialize(placed.where(f"100 * (n - place) >= {percent} * n").select("shingle", "node", "n", "place", "label"), "prefixes")
    discard(spread, shared)
    return out


def _prefix_pairs(prefixes: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of nodes with unlike labels whose prefixes meet early enough for a link.

    Of each shingle's nodes, those with its most frequent label aren't compared with each other, so that a large group
    of linked nodes costs no more than its number for each node outside of it.
    """
    counted = prefixes.groupBy("shingle", "label").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.max(F.struct("c", "label"))["label"].alias("main"), F.count("*").alias("labels"), F.sum("c").alias("n"))
    mixed = materialize(counted.where("labels > 1").select("shingle", "main", "n"), "mixed-shingles")
    named = lambda s, *more: [*(F.col(c).alias(f"{s}_{c}") for c in ("node", "n", "place", "label")), *more]
    others = salted_join(prefixes.select("shingle", *named("p")), mixed.select("shingle", "main"), "shingle", mixed, ["p_node"], 20_000).where("p_label <> main")
    met = salted_join(prefixes.select("shingle", *named("m")), others, "shingle", mixed, ["m_node"], 20_000)
    least = f"{percent} * (p_n + m_n)"
    met = met.where(f"p_label <> m_label AND (m_label = main OR p_node < m_node) AND {100 + percent} * (p_n - p_place) >= {least} AND {100 + percent} * (m_n - m_place) >= {least}")
    return met.select(F.least("p_node", "m_node").alias("a"), F.greatest("p_node", "m_node").alias("b")).distinct()


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, sketch_a, sketch_b) that reach the threshold by their sketches, less six standard errors."""
    rows, bands = band_plan(percent)
    least = percent / 100 - 6 * math.sqrt(percent / 100 * (1 - percent / 100) / (rows * bands))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= least))

    return pairs.mapInArrow(compare, "a binary, b binary")


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, set_a, set_b) with 100 * intersection >= percent * union."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)
            linked = []
            for x, y in sets:
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return pairs.mapInArrow(confirm, "a binary, b binary")


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """links (a, b) -> (node, label): the smallest node that each linked node reaches.

    Every step takes the smallest label among the neighbours and then the label of that label, so long chains halve.
    labels, from an earlier call on fewer links, saves steps.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    nodes = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label"))
    if labels is not None:
        nodes = nodes.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
    state = written = materialize(nodes, "labels")
    while True:
        near = edges.join(state, edges["b"] == state["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        best = state.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        up = state.select(F.col("node").alias("_n"), F.col("label").alias("_up"))
        jumped = best.join(up, F.col("label") == F.col("_n"), "left").select("node", "old", F.least("label", F.coalesce("_up", "label")).alias("label"))
        after = materialize(jumped, "labels")
        discard(written)
        state, written = after.select("node", "label"), after
        if after.where("label <> old").isEmpty():
            discard(edges)
            return state


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: int = 0, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, the columns keep, n_shingles, component_id, kept, n_copies): documents linked by near-equal shingle sets, directly or by way of others.

    Two documents are linked if their sets of distinct shingles of so many words have 100 * intersection >=
    percent * union. A document with fewer words has its whole sequence as its only shingle; one without words, or
    with null text, has none and is linked with nothing. component_id is the smallest doc_id of the component, kept
    tells whether that is the row's own; n_copies counts rows with the very same set. Rows without doc_id get no
    component and are kept. Repeated rows of one doc_id with unlike texts are judged text by text. An empty table
    gives an empty one; other columns are left out. key seeds the hashes of words.

    Equal sets become one node first. A bucket is a band's value with two nodes or more. In each bucket the node that
    shares most buckets is compared with all others, which joins most of a group of near copies at the cost of one
    comparison for each node. Buckets that still hold nodes of several components are open; of their nodes, all pairs
    of unlike components that can be links by their rarest shingles are compared (_prefixes), which leaves out none.
    Two nodes that share no bucket, and have no way over others, stay apart: at the threshold with odds of 1 to a
    million, more alike ones with less (band_plan); a sketch rules out a link with odds of 1 to a billion (_likely).
    """
    own = docs.select("doc_id", "text")
    signed = materialize(signatures(docs, words, percent, key, keep), "signatures")
    named = signed.where("node IS NOT NULL AND doc_id IS NOT NULL")
    copies = materialize(named.groupBy("node").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n"), F.count("*").alias("n_copies")), "nodes")
    firsts = named.join(copies.select("node", "first"), "node").where("doc_id = first").select("node", "doc_id", "n_shingles", "bands", "sketch").dropDuplicates(["node"])
    nodes = materialize(firsts, "node-signatures")
    banded = nodes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    shared = materialize(banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = materialize(banded.join(shared, "band"), "bucket-members")
    weight = materialize(members.groupBy("node").agg(F.sum("size").alias("weight")), "weights")
    leaders = members.join(weight, "node").groupBy("band").agg(F.max(F.struct("weight", "node", "n")).alias("lead")).select(F.col("band").alias("_band"), F.col("lead.node").alias("leader"), F.col("lead.n").alias("lead_n"))
    leaders = materialize(leaders, "leaders")
    sought = weight.select("node").join(copies.select("node", "first"), "node")
    texts = own.join(sought, own["doc_id"] == sought["first"]).select("node", "text")
    sets = materialize(_full_sets(texts, words, key).dropDuplicates(["node"]), "shingle-sets")
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("sketch").alias(f"sketch_{s}"))
    full = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"set_{s}"))

    def linked(pairs: DataFrame) -> DataFrame:
        likely = materialize(_likely(pairs.join(side("a"), "a").join(side("b"), "b"), percent), "likely-pairs")
        found = materialize(_confirmed(likely.join(full("a"), "a").join(full("b"), "b"), percent), "links")
        discard(pairs, likely)
        return found

    met = members.join(leaders, F.col("band") == F.col("_band")).where(f"node <> leader AND {percent} * greatest(n, lead_n) <= 100 * least(n, lead_n)")
    pairs = met.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    links = linked(materialize(pairs, "pairs"))
    discard(shared, weight, leaders)
    labels = None if links.isEmpty() else components(links)
    labelled = members.select("band", "node", F.col("node").alias("label"))
    if labels is not None:
        labelled = materialize(members.select("band", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled-members")
    mixed = materialize(labelled.groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("greatest")).where("least <> greatest").select("band"), "open-buckets")
    opened = labelled.join(mixed, "band").select("node", "label").distinct()
    prefixes = _prefixes(sets, opened, percent)
    further = linked(materialize(_prefix_pairs(prefixes, percent), "pairs"))
    discard(members, labelled, mixed, prefixes, nodes, sets)
    if not further.isEmpty():
        labels = components(links.unionByName(further), labels)
    discard(links, further)
    known = copies.select("node", "first", "n_copies")
    if labels is not None:
        known = known.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        least = known.groupBy("label").agg(F.min("first").alias("component_id"))
        known = known.join(least, "label")
    else:
        known = known.withColumn("component_id", F.col("first"))
    told = signed.select("doc_id", *(keep or []), "n_shingles", "node").join(known.select(F.col("node").alias("_node"), "component_id", "n_copies"), F.col("node") == F.col("_node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return told.select("doc_id", *(keep or []), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
