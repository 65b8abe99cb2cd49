"""Phrase mining with vertical lists: for each word the sorted places where it stands, extended to phrases by merging with the places of the next word.

Documents are gathered into blocks of one language; a block is one row with its distinct words and their lists of
places. A phrase's list in a block is its first part's list merged with the list of its last word, one place on; the lists' lengths, summed over blocks,
are exact frequencies. Lists never leave their block: only (phrase, length) is shuffled, after sums on the map side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import discard, materialize, prepare, utf8
from runlens.llm.shingles import mix, word_hashes

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: 0 in words, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\v\f\r")] = 2
#: Bytes of text in a block, but for a longer text, which is a block of its own.
BLOCK = 1_000_000
#: Bits of the filter that tells workers which words or pairs can be part of longer phrases: 16 MB, whatever the corpus holds.
FILTER_BITS = 1 << 27
_BLOCK = "lang string, words array<binary>, hashes binary, lengths binary, places binary"


def block_lists(texts: list[bytes], key: int = 0) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(words, hashes, lengths, places): the distinct words of all texts, their hashes, and their lists of places, one after the other.

    Words of a piece have neighbouring places; between pieces one place is left out, so no phrase spans them. A word whose
    hash another word has too comes last, with an empty list, so that the two are seen.
    """
    whole = b"\n".join(texts).translate(_LOWER) + b"\n"
    kind = _KIND[np.frombuffer(whole, np.uint8)]
    edge = np.flatnonzero(np.diff(kind > 0, prepend=True))
    begins, ends = edge[::2], edge[1::2]
    breaks = np.cumsum(kind == 2)
    parted = np.zeros(len(begins), np.int64)
    if len(begins):
        parted[1:] = np.diff(breaks[begins]) > 0
    places = (np.arange(len(begins)) + np.cumsum(parted)).astype(np.int32)
    hashes = word_hashes(whole, begins, ends, key)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    first = np.flatnonzero(np.diff(ordered, prepend=~ordered[:1]) != 0) if len(ordered) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(first, len(ordered))).astype(np.int32)
    other = word_hashes(whole, begins, ends, key + (1 << 40))[order]
    met = np.flatnonzero((ordered[1:] == ordered[:-1]) & (other[1:] != other[:-1])) + 1  # unlike words with one hash
    words = [whole[a:b] for i in (order[first], order[met]) for a, b in zip(begins[i].tolist(), ends[i].tolist(), strict=True)]
    return words, np.append(ordered[first], ordered[met]), np.append(lengths, np.zeros(len(met), np.int32)), places[order]


def _blocks(docs: DataFrame, key: int) -> DataFrame:
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.binary())), ("hashes", pa.binary()), ("lengths", pa.binary()), ("places", pa.binary())])
        waiting: dict[str, tuple[list[bytes], int]] = {}

        def row(lang: str, texts: list[bytes]) -> pa.RecordBatch:
            words, *arrays = block_lists(texts, key)
            return pa.RecordBatch.from_pydict({"lang": [lang], "words": [words]} | {n: [a.tobytes()] for n, a in zip(("hashes", "lengths", "places"), arrays, strict=True)}, schema=schema)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                texts, size = waiting.get(lang, ([], 0))
                texts.append(text)
                waiting[lang] = (texts, size + len(text))
                if size + len(text) >= BLOCK:
                    yield row(lang, waiting.pop(lang)[0])
                elif sum(n for _, n in waiting.values()) >= 16 * BLOCK:
                    largest = max(waiting, key=lambda k: waiting[k][1])
                    yield row(largest, waiting.pop(largest)[0])
        for lang, (texts, _) in waiting.items():
            yield row(lang, texts)

    return docs.where("text IS NOT NULL AND text <> ''").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(lists, _BLOCK)


def word_lists(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (lang, text) -> (blocks, counts), two written tables: the vertical lists, and (lang, hash, word, n) of every word.

    Should two words have one hash, which 64 bits make rare at any size, all is done again with another key.
    """
    prepare(docs.sparkSession)
    key = 0
    while True:
        blocks = materialize(_blocks(docs, key), "phrase-lists", **{"compression": "zstd", "parquet.block.size": str(16 << 20)})  # a row has about a MB

        def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lang, words, hashes, n in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(words.values), pa.string()), pa.array(np.frombuffer(hashes.as_py(), np.int64)), words.values, pa.array(np.frombuffer(n.as_py(), np.int32).astype(np.int64))], ["lang", "hash", "word", "n"])

        each = blocks.select("lang", "words", "hashes", "lengths").mapInArrow(lengths, "lang string, hash long, word binary, n long")
        counts = materialize(each.groupBy("lang", "hash", "word").agg(F.sum("n").alias("n")), "phrase-words")
        if counts.groupBy("lang", "hash").agg(F.count("*").alias("words")).where("words > 1").isEmpty():
            return blocks, counts
        discard(blocks, counts)
        key += 1


def _filter(keys: DataFrame) -> np.ndarray:
    """A bit for each key (a column of longs) modulo FILTER_BITS, as bytes: what has no bit is no key, what has one may be."""
    name = keys.columns[0]
    bits = keys.select(F.expr(f"cast(shiftright(pmod({name}, {FILTER_BITS}L), 6) AS int)").alias("at"), F.expr(f"shiftleft(1L, cast(pmod({name}, 64L) AS int))").alias("bit"))
    words = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def _may(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(FILTER_BITS - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The filter's key of a pair of words."""
    return mix(first * np.uint64(3) + second)


def extended(hashes: np.ndarray, lengths: np.ndarray, places: np.ndarray, words_may: Callable[[np.ndarray], np.ndarray], pairs_may: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> tuple[np.ndarray, ...]:
    """(hashes of the words..., list length) of a block's pairs of words that may be frequent; with pairs_may of its triples of frequent pairs.

    The lists of the frequent words, one after the other, are merged with the lists of what may follow: owner has for
    each place the word whose list holds it, so a list's successors are found at its places plus one.
    """
    kept = words_may(hashes)
    word = np.repeat(np.where(kept, np.arange(len(hashes)), -1), lengths)
    owner = np.full((int(places.max()) if len(places) else 0) + 3, -1, np.int64)
    owner[places] = word
    at = places[word >= 0].astype(np.int64)
    at = at[owner[at + 1] >= 0]
    columns = [owner[at], owner[at + 1]]
    if pairs_may is not None:
        pair = pairs_may(hashes[columns[0]], hashes[columns[1]])
        begins = np.zeros(len(owner), bool)
        begins[at[pair]] = True
        at = at[pair & begins[at + 1]]
        columns = [owner[at], owner[at + 1], owner[at + 2]]
    n = max(1, len(hashes))
    code = columns[0] * n + columns[1]
    if len(columns) == 3:
        code = np.unique(code, return_inverse=True)[1] * n + columns[2]
    _, first, length = np.unique(code, return_index=True, return_counts=True)
    return *[hashes[c[first]] for c in columns], length


def phrase_lengths(blocks: DataFrame, least: int, words: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(lang, h1, h2[, h3], n), a written table: pairs of frequent words, or triples of frequent pairs, that stand at least so often.

    words (lang, hash) and pairs (lang, h1, h2) are the frequent ones. Workers know them by filters of fixed size: a pair or triple that
    slips through is counted like the others, and none that is frequent is lost.
    """
    context = blocks.sparkSession.sparkContext
    known = context.broadcast(_filter(words.select("hash")))
    known_pairs = None if pairs is None else context.broadcast(_pair_filter(pairs))
    names = ["h1", "h2"] if pairs is None else ["h1", "h2", "h3"]

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_may = lambda h: _may(known.value, h)
        pairs_may = None if known_pairs is None else lambda a, b: _may(known_pairs.value, pair_key(a, b))
        for batch in batches:
            for lang, *arrays in zip(*batch.columns, strict=True):
                hashes, lengths, places = (np.frombuffer(a.as_py(), t) for a, t in zip(arrays, (np.uint64, np.int32, np.int32), strict=True))
                *columns, n = extended(hashes, lengths, places, words_may, pairs_may)
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(n), pa.string()), *[pa.array(c.view(np.int64)) for c in columns], pa.array(n.astype(np.int64))], ["lang", *names, "n"])

    found = blocks.select("lang", "hashes", "lengths", "places").mapInArrow(extend, f"lang string, {', '.join(f'{n} long' for n in names)}, n long")
    out = materialize(found.groupBy("lang", *names).agg(F.sum("n").alias("n")).where(F.col("n") >= least), f"phrases-of-{len(names)}")
    for sent in (known, known_pairs):
        if sent is not None:
            sent.destroy()
    return out


def _pair_filter(pairs: DataFrame) -> np.ndarray:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(pair_key(a, b).view(np.int64))], ["key"])

    return _filter(pairs.select("h1", "h2").mapInArrow(keys, "key long"))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact while a * a * 1000000 has 38 digits at most."""
    a, left, right = (c.cast("decimal(19,0)") for c in (a, left, right))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), left * right).cast("long")


def mine_phrases(docs: DataFrame, least: int = 10, top: int = 2000, percent: int = 50) -> DataFrame:
    """docs (lang, text) -> (lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 or 3 words.

    A-Z count as a-z; texts are split at . , ; : ! ? and line ends into pieces, those at blanks into words. n counts the
    language's words, a the phrase, l and r the parts of the cut with the lowest score floor(10^6 a a / (l r)) (ties: the
    first cut). Phrases found fewer than `least` times are left out, and those inside a longer one of at least
    that many that has percent of their count or more. Order: score, then a, both falling, then the phrase's UTF-8 bytes. Null lang: und. Null
    or empty text: nothing. Rows that repeat count each time. No rows give no rows. Other columns are not looked at. A text
    is taken as a whole, about 40 bytes of memory for each of its bytes.
    """
    blocks, counts = word_lists(docs)
    frequent = counts.where(F.col("n") >= least)
    pairs = phrase_lengths(blocks, least, frequent)
    triples = phrase_lengths(blocks, least, frequent, pairs)
    discard(blocks)
    word = lambda k: frequent.select("lang", F.col("hash").alias(f"h{k}"), F.col("word").alias(f"w{k}"), F.col("n").alias(f"n{k}"))
    two = materialize(pairs.join(word(1), ["lang", "h1"]).join(word(2), ["lang", "h2"]), "phrase-two")
    head = two.select("lang", "h1", "h2", "w1", "w2", "n1", F.col("n").alias("n12"))
    tail = two.select("lang", F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("w2").alias("w3"), F.col("n2").alias("n3"), F.col("n").alias("n23"))
    three = materialize(triples.join(head, ["lang", "h1", "h2"]).join(tail, ["lang", "h2", "h3"]), "phrase-three")
    parts = three.select("lang", F.explode(F.array(F.struct("h1", "h2"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2")))).alias("p"), "n")
    longest = parts.groupBy("lang", "p.h1", "p.h2").agg(F.max("n").alias("_longer"))
    kept = two.join(longest, ["lang", "h1", "h2"], "left").where(100 * F.coalesce("_longer", F.lit(0)) < percent * F.col("n"))
    text = lambda *c: F.concat_ws(" ", *[F.col(x).cast("string") for x in c])
    short = kept.select("lang", text("w1", "w2").alias("phrase"), F.col("n").alias("a"), F.col("n1").alias("l"), F.col("n2").alias("r"), _score(F.col("n"), F.col("n1"), F.col("n2")).alias("score"))
    first, second = _score(F.col("n"), F.col("n1"), F.col("n23")), _score(F.col("n"), F.col("n12"), F.col("n3"))
    cut = three.withColumn("_1", first).withColumn("_2", second)
    early = F.col("_1") <= F.col("_2")
    long = cut.select("lang", text("w1", "w2", "w3").alias("phrase"), F.col("n").alias("a"), F.when(early, F.col("n1")).otherwise(F.col("n12")).alias("l"), F.when(early, F.col("n23")).otherwise(F.col("n3")).alias("r"), F.least("_1", "_2").alias("score"))
    all_ = materialize(short.union(long), "phrase-scores")
    total = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase").cast("binary")]
    groups = max(1, int((all_.count() / top) ** 0.5))  # the best of each group first, so that a language is never one task
    best = all_.withColumn("_g", F.pmod(F.xxhash64("phrase"), F.lit(groups)))
    best = best.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_g").orderBy(*order))).where(F.col("_r") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    out = materialize(best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
    discard(counts, pairs, triples, two, three, all_)
    return out
