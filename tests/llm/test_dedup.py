import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runlens.llm import lines, minhash
from runlens.llm.shingles import shingle_sets as shingles_of

from .conftest import COLUMNS


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute_components(docs, width, percent):
    """doc_id -> (set size, smallest linked doc_id), for unique doc_ids."""
    sets = {d: shingles(t, width) for d, t in docs}
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def families(seed, n=40, words=60):
    """Families of near copies of one another, some near the threshold and some in chains."""
    rng = random.Random(seed)
    out, word = [], lambda: rng.choice("abcdefghij") + str(rng.randrange(500))
    for _ in range(n):
        text = [word() for _ in range(words)]
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            copy = list(text)
            for _ in range(rng.randrange(6)):
                i = rng.randrange(len(copy))
                rng.choice([lambda: copy.__setitem__(i, word()), lambda: copy.pop(i), lambda: copy.insert(i, word())])()
            out.append(" ".join(copy))
            if rng.random() < 0.3:
                text = copy
    rng.shuffle(out)
    return list(enumerate(out))


def test_components_match_brute_force(spark):
    for seed, width, percent in ((1, 3, 85), (2, 5, 80)):
        docs = families(seed)
        got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width, percent).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(docs, width, percent)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_a_group_around_no_center_keeps_all_links(spark):
    """Many deletions of a few words each: buckets with hundreds of nodes, most pairs of them below the threshold."""
    rng = random.Random(5)
    text = [f"w{i}" for i in range(70)]
    docs = []
    for i in range(250):
        gone = set(rng.sample(range(70), rng.randrange(1, 7)))
        docs.append((i, " ".join(w for j, w in enumerate(text) if j not in gone)))
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(docs, 3, 85)


def test_prefix_join_alone_finds_every_link(spark):
    docs = families(7, n=25)
    sets = [(d, shingles(t, 3)) for d, t in docs]
    number = {s: i for i, s in enumerate(sorted(set().union(*(s for _, s in sets))))}
    name = lambda d: d.to_bytes(4, "big")
    packed = [(name(d), b"".join(number[x].to_bytes(8, "little") for x in sorted(s))) for d, s in sets]
    opened = spark.createDataFrame([(name(d), name(d)) for d, _ in docs], "node binary, label binary")
    prefixes = minhash._prefixes(spark.createDataFrame(packed, "node binary, shingles binary"), opened, 85)
    pairs = {(bytes(r["a"]), bytes(r["b"])) for r in minhash._prefix_pairs(prefixes, 85).collect()}
    links = {(name(a), name(b)) for a, x in sets for b, y in sets if a < b and 100 * len(x & y) >= 85 * len(x | y)}
    assert links and links <= pairs and len(pairs) < 10 * len(links)


def test_near_duplicates_of_awkward_rows(awkward, empty):
    got = minhash.near_duplicates(awkward, 3, 85).collect()
    assert len(got) == awkward.count() and minhash.near_duplicates(empty).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[0]["n_shingles"] == by[1]["n_shingles"] == by[2]["n_shingles"] == 0 and all(by[i]["kept"] for i in (0, 1, 2))
    assert by[3]["n_shingles"] == by[4]["n_shingles"] == 1 and by[6]["component_id"] == by[7]["component_id"] == 5
    assert by[None]["component_id"] is None and by[None]["kept"] and by[5]["n_copies"] == 3


@pytest.mark.parametrize("order", list(itertools.permutations(range(4)))[::5])
def test_unlike_texts_of_one_doc_id(spark, order):
    rng = random.Random(4)
    a, b = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(2))
    rows = [(1, a), (1, b), (2, a + " and more"), (3, b + " and more")]
    got = minhash.near_duplicates(spark.createDataFrame([rows[i] for i in order], "doc_id long, text string"), 3, 85).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_words_that_differ_have_unlike_hashes():
    bits = [0]
    while len(bits) < 2048:
        bits += [1 - x for x in bits]
    for n in (8, 64, 255, 256, 1024, 2048):
        a, b = bytes(97 + x for x in bits[:n]), bytes(98 - x for x in bits[:n])
        x, y, z = shingles_of([a, b, a], 3)
        assert (x == z).all() and (x != y).all() and len(x) == 1
        assert shingles_of([a], 3, key=1)[0] != x


def test_pairs_at_the_threshold_meet_in_some_band():
    """Also small sets, whose minimum and maximum under a permutation aren't independent."""
    rng = np.random.default_rng(3)
    for percent, low in ((80, 5), (85, 7), (80, 10), (85, 20)):
        rows, bands = minhash.band_plan(percent)
        keys, odd = minhash.permutations(-(-rows * bands // 2))
        missed = 0
        for _ in range(1500):
            union = rng.integers(0, 1 << 63, low, dtype=np.uint64)
            x, y = (minhash.signature(s, keys, odd)[: rows * bands].reshape(bands, rows) for s in (union, union[: -(-low * percent // 100)]))
            missed += not (x == y).all(axis=1).any()
        assert missed == 0


def brute_lines(docs, least=20, most=3):
    strip, lower = "\x20\x09\x0a\x0b\x0c\x0d", lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    key = lambda line: lower(line.strip(strip))
    where = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                where.setdefault(key(line), set()).add(d)
    out = {}
    for d, t in docs:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not (len(w := where.get(key(x), ())) >= most and max(w) != d)]
        out[d] = (len(all_lines), len(all_lines) - len(kept), "\n".join(kept))
    return out


def test_lines_match_brute_force(spark, awkward, empty):
    rng = random.Random(2)
    pool = [f"shared line number {i} with enough letters é{i}" for i in range(12)] + ["short", "", "  Shared LINE number 3 with enough letters é3\t"]
    docs = [(i, "\n".join(rng.choices([*pool, f"own {i} {rng.random()} of this document"], k=rng.randrange(1, 9)))) for i in range(120)]
    docs += [(1000, None), (1001, ""), (1002, "\n".join(pool * 400))]
    got = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in got} == brute_lines(docs)
    unlike = lines.dedup_lines(awkward)
    assert unlike.count() == awkward.count() and unlike.columns == [*awkward.columns, "n_lines", "n_dropped"]
    assert {r["doc_id"]: r["n_dropped"] for r in unlike.collect() if r["doc_id"] in (8, 9, 10)} == {8: 1, 9: 1, 10: 0}
    assert lines.dedup_lines(empty).count() == 0 and COLUMNS


def test_workers_get_large_texts_by_their_bytes(spark):
    """Near-dedup's workers and executors hold a few MB of texts at once, however many rows have them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key, None)
    rows = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 400).alias("text"))
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    try:
        spark.conf.unset(key)
        minhash.signatures(rows, 5, 80)
        assert 1 << 20 < max(r["n"] for r in rows.mapInArrow(sizes, "n long").collect()) < 5 << 20
        spark.conf.set(key, "1m")
        minhash.signatures(rows, 5, 80)
        assert max(r["n"] for r in rows.mapInArrow(sizes, "n long").collect()) < 2 << 20
    finally:
        spark.conf.unset(key) if own is None else spark.conf.set(key, own)
