"""Phrases, spelling variants and shards against plain loops."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import phrases, queries, sharding, spelling
from runlens.llm.common import materialize

from .conftest import COLUMNS, DATA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op13_phrase_mining"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/sf0.001/documents.parquet'")
    got = queries.queries()[name](spark, f"{DATA}/sf0.001")
    columns = ", ".join(got.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, con.execute(f"SELECT {columns} FROM ({queries.oracle_sql()[name]})").fetchall()))


# phrases


def brute_phrases(docs, least, top, percent):
    counts, totals = {k: Counter() for k in (1, 2, 3)}, Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang or "und"] += len(words)
            for k in counts:
                counts[k].update((lang or "und", *words[i : i + k]) for i in range(len(words) - k + 1))
    told, inside = [], Counter()
    for (lang, *p), m in counts[3].items():
        for q in (p[:2], p[1:]):
            inside[lang, *q] = max(inside[lang, *q], m if m >= least else 0)
    for k in (2, 3):
        for (lang, *p), a in counts[k].items():
            if a < least:
                continue
            if k == 2 and inside[lang, *p] and 100 * inside[lang, *p] >= percent * a:
                continue
            cuts = [(10**6 * a * a // (counts[c][(lang, *p[:c])] * counts[k - c][(lang, *p[c:])]), c) for c in range(1, k)]
            score, c = min(cuts)
            told.append((lang, -score, -a, " ".join(p).encode(), counts[c][(lang, *p[:c])], counts[k - c][(lang, *p[c:])]))
    out = []
    for lang, group in itertools.groupby(sorted(told), key=lambda t: t[0]):
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -score) for i, (_, score, a, p, left, right) in enumerate(itertools.islice(group, top), 1)]
    return out


@pytest.mark.parametrize(("seed", "least", "top", "percent"), [(1, 3, 10_000, 50), (2, 2, 7, 80), (3, 4, 10_000, 1)])
def test_phrases_match_plain_counting(spark, seed, least, top, percent):
    rng = random.Random(seed)
    words = ["a", "B", "c", "été", "Été", "x\x00", "😀", "d"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b"]) for _ in range(rng.randrange(40)))
    docs = [(rng.choice(["en", "de", None]), rng.choice([text(), text(), None, ""])) for _ in range(60)]
    got = phrases.mine_phrases(spark.createDataFrame(docs, "lang string, text string").repartition(3), least, top, percent)
    assert sorted(map(tuple, got.collect())) == sorted(brute_phrases(docs, least, top, percent))


def test_phrases_of_awkward_rows(spark, awkward, empty):
    docs = [(r["lang"], r["text"]) for r in awkward.collect()]
    assert sorted(map(tuple, phrases.mine_phrases(awkward, 2, 50).collect())) == sorted(brute_phrases(docs, 2, 50, 50))
    assert phrases.mine_phrases(empty).count() == 0


def test_words_with_one_hash_are_told_apart(spark, monkeypatch):
    plain = phrases.word_hashes
    bad = lambda whole, begins, ends, key: plain(whole, begins, ends, key) if key else plain(whole, begins, begins, 0)
    monkeypatch.setattr(phrases, "word_hashes", bad)
    words, hashes, lengths, places = phrases.block_lists([b"a b a"])
    assert set(words) == {b"a", b"b"} and len(set(hashes.tolist())) == 1 and lengths[0] == 3 and not lengths[1:].any() and sorted(places.tolist()) == [0, 1, 2]


def test_scores_are_exact_past_64_bits(spark):
    a, left, right = 3 * 10**11 + 7, 9 * 10**11 + 1, 3 * 10**11 + 8
    got = spark.range(1).select(phrases._score(F.lit(a), F.lit(left), F.lit(right))).first()[0]
    assert got == 10**6 * a * a // (left * right)


def test_lists_extend_to_the_same_counts():
    words, hashes, lengths, places = phrases.block_lists([b"a b c a b c. a b", b"b c"])
    every = lambda *h: np.ones(len(h[0]), bool)
    name = dict(zip(hashes.tolist(), words, strict=False))
    *pair, n = phrases.extended(hashes, lengths, places, every, None)
    assert {(name[x], name[y]): c for x, y, c in zip(*(p.tolist() for p in pair), n.tolist(), strict=True)} == {(b"a", b"b"): 3, (b"b", b"c"): 3, (b"c", b"a"): 1}
    *three, n = phrases.extended(hashes, lengths, places, every, every)
    assert {tuple(name[x] for x in t): c for *t, c in zip(*(p.tolist() for p in three), n.tolist(), strict=True)} == {(b"a", b"b", b"c"): 2, (b"b", b"c", b"a"): 1, (b"c", b"a", b"b"): 1}


# spelling variants


def brute_words(docs, least_chars=5, least=3, typo=97):
    found = Counter()
    for name, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if typo and h % typo == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= least_chars and n >= least}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs, **how):
    words, form, told = brute_words(docs, **how), {}, {}
    for w, n in words.items():
        around = [v for v in words if near(w, v)]
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
        told[w] = (n, len(around))
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, *told[w], words.get(form[w])))
    return sorted(out)


@pytest.mark.parametrize(("seed", "letters", "typo"), [(1, "ab", 7), (2, "aé", 0), (3, "abcdß", 3), (4, "a", 0)])
def test_variants_match_edit_distance(spark, seed, letters, typo):
    rng = random.Random(seed)
    docs = []
    for i in range(200):
        docs.append((i if i % 9 else None, " ".join(("x".join if rng.random() < 0.1 else "".join)(rng.choices(letters, k=min(12, 3 + int(rng.expovariate(0.3))))) for _ in range(30)).replace("a", rng.choice("aA"))))
    docs += [(1, None), (2, ""), (3, "... 12 —"), docs[5]]
    got = spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), typo=typo)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == brute_variants(docs, typo=typo)


def test_variants_of_awkward_rows(spark, awkward, empty):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = sorted(map(tuple, spelling.spelling_variants(awkward).collect()))
    assert [r[0] for r in got] == sorted(brute_words(docs)) and spelling.spelling_variants(empty).count() == 0


def test_keys_are_those_of_the_deletions_themselves():
    words = ["banana", "annas", "hello", "z" * 3000, "été" * 5, "aaaaa"]
    row, kind, place, key = spelling.deletion_keys(words)
    of = lambda w: spelling.deletion_keys([w])[3][0]
    for w, k, p, h in zip(row, kind, place, key, strict=True):
        if kind is not None and k != spelling.REPLACED and len(words[w]) < 100:
            assert h == of(words[w] if k == spelling.WHOLE else words[w][:p] + words[w][p + 1 :])
    assert Counter(kind.tolist())[spelling.REPLACED] == sum(map(len, words)) and (kind[row == 3] == spelling.DELETED).sum() == 1


def test_words_whose_keys_are_alike_are_compared_as_strings(spark, monkeypatch):
    """All keys of a kind alike: groups and joins then rest on the strings alone."""
    docs = [(i, w) for i, w in enumerate(["abcde"] * 9 + ["abcdx"] * 4 + ["abcd"] * 20 + ["abcdef"] * 3 + ["vwxyz"] * 3)]
    plain = spelling.shared_keys

    def alike(words):
        return plain(words).limit(0).union(words.select("id", "word").mapInArrow(_all_alike, "key long, kind byte, place int, id long"))

    monkeypatch.setattr(spelling, "shared_keys", alike)
    got = spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"), typo=0)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == brute_variants(docs, typo=0)


def _all_alike(batches):
    import pyarrow as pa

    for batch in batches:
        row, kind, place, _ = spelling.deletion_keys(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(row), np.int64)), pa.array(kind), pa.array(place), pa.array(batch.column(0).to_numpy()[row])], ["key", "kind", "place", "id"])


# shards


@pytest.mark.parametrize(("files", "shards"), [(1, 8), (7, 8), (16, 3), (5, 1)])
def test_shards_are_exact_and_whole(spark, tmp_path, files, shards):
    rows = spark.range(1000).where("id % 7 > 0").select((F.col("id") % 400).alias("doc_id"), F.lit("s").alias("slot"), F.lit(None).cast("string").alias("text"))
    rows.repartition(files).write.parquet(f"{tmp_path}/in")
    got = sharding.shard_files(spark, f"{tmp_path}/in", shards, seed=3, rows_per_part=50)
    assert got.columns == ["doc_id", "text", "shard", "slot"]
    out = [(r["shard"], r["slot"], r["doc_id"]) for r in got.collect()]
    sizes = Counter(k for k, _, _ in out)
    assert len(sizes) == shards and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(s for k, s, _ in out if k == shard) == list(range(n)) for shard, n in sizes.items())
    assert Counter(d for _, _, d in out) == Counter(r["doc_id"] for r in rows.collect())
    assert out == [(r["shard"], r["slot"], r["doc_id"]) for r in sharding.shard_files(spark, f"{tmp_path}/in", shards, seed=3, rows_per_part=50).collect()]
    assert out != [(r["shard"], r["slot"], r["doc_id"]) for r in sharding.shard_files(spark, f"{tmp_path}/in", shards, seed=4, rows_per_part=50).collect()]


def test_shards_of_awkward_rows(spark, awkward, empty, tmp_path):
    got = sharding.shard_rows(awkward)
    assert got.columns == [*COLUMNS.replace(" long", "").replace(" string", "").split(", "), "shard", "slot"]
    assert sorted(map(repr, (r[:-2] for r in map(tuple, got.collect())))) == sorted(map(repr, map(tuple, awkward.collect())))
    assert sharding.shard_rows(empty).count() == 0
    sharding.write_shards(got, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("shard").count().count() == 8
    few = materialize(spark.range(9).repartition(9), "few")
    assert sorted(r["shard"] for r in sharding.shard_files(spark, few._written, 12, most_files=2).collect()) == list(range(9))


def test_permutations_are_all_alike_likely(spark):
    n = 24_000
    place = lambda i, size: sharding.permuted(F.lit(i).cast("long"), F.lit(size).cast("long"), F.xxhash64("id"))
    seen = spark.range(n).groupBy(F.array(*[place(i, 4) for i in range(4)]).alias("p")).count().collect()
    assert len(seen) == 24 and sum((r["count"] - n / 24) ** 2 / (n / 24) for r in seen) < 60  # chi square, 23 degrees
    ids = spark.range(1009).select(sharding.permuted(F.col("id"), F.lit(1009).cast("long"), F.lit(5).cast("long")).alias("p"))
    assert sorted(r["p"] for r in ids.collect()) == list(range(1009))


@pytest.mark.parametrize(("drawn", "marked", "all_"), [(10, 7, 20), (1, 1, 3), (50, 30, 60), (3, 0, 9), (5, 9, 9)])
def test_draws_follow_the_hypergeometric_law(spark, drawn, marked, all_):
    n, long = 20_000, lambda x: F.lit(x).cast("long")
    u = (F.shiftrightunsigned(F.xxhash64("id"), 11) + 0.5) / float(1 << 53)
    got = {r["x"]: r["count"] for r in spark.range(n).groupBy(sharding.hypergeometric(long(drawn), long(marked), long(all_), u).alias("x")).count().collect()}
    for x in range(min(drawn, marked) + 1):
        p = math.comb(marked, x) * math.comb(all_ - marked, drawn - x) / math.comb(all_, drawn) if drawn - x <= all_ - marked else 0
        assert abs(got.get(x, 0) - n * p) <= 5 * math.sqrt(n * p) + 1


def test_the_matrix_adds_up(spark):
    rows = [(f"f{i}", 1 + i * i % 50_000) for i in range(37)]
    total = sum(n for _, n in rows)
    sizes = [total // 5 + (k < total % 5) for k in range(5)]
    got = sharding.communication_matrix(spark.createDataFrame(rows, "file string, n long"), len(rows), sizes, seed=1).orderBy("place").collect()
    assert [(r["file"], r["n"]) for r in got] == sorted(rows) and all(sum(r["sent"]) == r["n"] and min(r["sent"]) >= 0 for r in got)
    assert [sum(r["sent"][k] for r in got) for k in range(5)] == sizes
    assert all(r["base"] == [sum(q["sent"][k] for q in got[:i]) for k in range(5)] for i, r in enumerate(got))
