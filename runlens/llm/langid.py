"""Language ID: character models by interpolated Kneser-Ney smoothing, one for each language, learned by counting in Spark."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm.common import discard, materialize, prepare
from runlens.llm.shingles import mix

ORDER = 4
_START, _OTHER = 1, 32


@functools.cache
def _folded() -> np.ndarray:
    """For each character of the basic plane the letter in lower case, or a blank for what is no letter."""
    return np.array([(ord(c.lower()[0]) if c.isalpha() else _OTHER) for c in map(chr, range(1 << 16))], np.uint16)


def _units(point: int) -> tuple[int, int]:
    """The two symbols of a letter beyond the basic plane (its UTF-16 units, in lower case), blanks for what is no letter."""
    if not chr(point).isalpha():
        return _OTHER, _OTHER
    low = ord(chr(point).lower()[0])
    return tuple(np.frombuffer(chr(low if low > 0xFFFF else point).encode("utf-16-le"), "<u2").tolist())


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as symbols, each after three start marks, and where each begins. Runs of what is no letter are one blank."""
    mark = "\x01" * (ORDER - 1)
    parts = [(mark + t.replace("\x01", " ")).encode("utf-16-le", "replace") for t in texts]
    codes = np.frombuffer(b"".join(parts), "<u2")
    folded = _folded()[codes]
    folded[codes == _START] = _START
    high = np.flatnonzero((codes >= 0xD800) & (codes < 0xDC00))
    if len(high):
        points = 0x10000 + ((codes[high].astype(np.int64) - 0xD800) << 10) + (codes[high + 1].astype(np.int64) - 0xDC00)
        kinds, which = np.unique(points, return_inverse=True)
        units = np.array([_units(int(p)) for p in kinds], np.uint16)
        folded[high], folded[high + 1] = units[which, 0], units[which, 1]
    begins = np.cumsum([0, *(len(p) // 2 for p in parts)])
    stays = np.ones(len(folded), bool)
    stays[1:] = (folded[1:] != _OTHER) | (folded[:-1] != _OTHER)
    kept = folded[stays]
    return kept, begins - np.concatenate(([0], np.cumsum(~stays)))[begins]


def grams(codes: np.ndarray, begin: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol from begin on but start marks: its place, and it with the three before it, 16 bits each."""
    places = np.flatnonzero(codes[begin:] != _START) + begin
    packed = codes[places].astype(np.uint64)
    for j in range(1, ORDER):
        packed |= codes[places - j].astype(np.uint64) << np.uint64(16 * j)
    return places, packed


def _windows(codes: np.ndarray, size: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """grams of all codes, so many at a time: a text of any length needs little more than its symbols."""
    for low in range(0, len(codes), size):
        begin = max(0, low - ORDER + 1)
        places, packed = grams(codes[begin : low + size], low - begin)
        yield places + begin, packed


def count_grams(labelled: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """(lang, held, gram, n) over all of labelled (lang, held, text): every four-symbol sequence and how often it occurs."""
    prepare(labelled.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[tuple[str, bool], list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(key: tuple[str, bool]) -> None:
            keys, n = (np.concatenate(x) for x in zip(*counted[key], strict=True))
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            counted[key] = [(keys[first], np.add.reduceat(n[order], first))]

        for batch in batches:
            by: dict[tuple[str, bool], list[str]] = {}
            for lang, held, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                by.setdefault((lang, held), []).append(text)
            for key, texts in by.items():
                begin = size = 0
                for end, text in enumerate(texts, 1):
                    size += len(text)
                    if size >= chunk or end == len(texts):
                        for _, packed in _windows(symbols(texts[begin:end])[0]):
                            if len(packed):
                                counted.setdefault(key, []).append(np.unique(packed, return_counts=True))
                            if len(counted.get(key, ())) >= 16:
                                merged(key)
                        begin, size = end, 0
        for key in counted:
            merged(key)
            keys, n = counted[key][0]
            for i in range(0, len(keys), 100_000):
                part = keys[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(part)), pa.array([key[1]] * len(part)), pa.array(part.view(np.int64)), pa.array(n[i : i + 100_000], pa.int64())], ["lang", "held", "gram", "n"])

    partial = labelled.select("lang", "held", "text").mapInArrow(count, "lang string, held boolean, gram long, n long")
    return partial.groupBy("lang", "held", "gram").agg(F.sum("n").alias("n"))


class Sorted:
    """Hashes in order, found by their top bits and a short walk."""

    def __init__(self, keys: np.ndarray) -> None:
        hashes = mix(keys)
        self.order = np.argsort(hashes)
        self.hashes = np.append(hashes[self.order], np.uint64(0))
        bits = min(22, max(4, (4 * len(keys)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.hashes[:-1] >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places in the order given at first, -1 where missing."""
        hashes = mix(keys)
        top = (hashes >> self.shift).astype(np.int32)
        at, end = self.starts[top], self.starts[top + 1]
        found = (self.hashes[at] == hashes) & (at < end)
        out = np.where(found, at, -1)
        rest = np.flatnonzero(~found & (at + 1 < end))
        while len(rest):
            at[rest] += 1
            hit = self.hashes[at[rest]] == hashes[rest]
            out[rest[hit]] = at[rest[hit]]
            rest = rest[~hit & (at[rest] + 1 < end[rest])]
        return np.where(out >= 0, self.order[out], -1) if len(self.order) else out


#: A prime by which the two symbols before a sequence's last are mixed, so that its remainders deal them over parts.
DEAL = 1_000_003


def dealt(parts: int) -> Column:
    """The part of a sequence in column gram by the two symbols before its last."""
    return F.shiftright("gram", 16).bitwiseAND(0xFFFFFFFF) % DEAL % parts


class Model:
    """Interpolated Kneser-Ney: log2 probabilities of all sequences that some language has, for every language at once.

    rows: (order, language number, sequence, count), the count being occurrences at the highest order and distinct
    symbols before the sequence at the lower ones. Of the sequences of three symbols and more, a model can have those
    alone whose two symbols before the last are of `part` (see dealt): with all shorter ones, the discounts (by order and language) and
    the number of symbols of all languages, these have everything that their probabilities depend on.
    """

    def __init__(self, width: int, order: np.ndarray, lang: np.ndarray, gram: np.ndarray, n: np.ndarray, discounts: np.ndarray, symbols: int, part: int = 0, parts: int = 1) -> None:
        self.width, self.part, self.parts = width, part, parts
        self.logs, self.found, self.contexts, self.weights = [], [], [], []
        for k in range(1, ORDER + 1):
            here = order == k
            keys, which = np.unique(gram[here], return_inverse=True)
            counts = np.zeros((len(keys), width))
            np.add.at(counts, (which, lang[here]), n[here])
            discount = discounts[k - 1]
            contexts, of = np.unique(keys >> np.uint64(16), return_inverse=True)
            total, kinds = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
            np.add.at(total, of, counts)
            np.add.at(kinds, of, counts > 0)
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            lower = np.full((len(keys), width), 1 / symbols) if k == 1 else np.exp2(self._log(k - 1, keys & np.uint64((1 << 16 * (k - 1)) - 1)))
            p = np.maximum(counts - discount, 0) / np.maximum(total, 1)[of] + weight[of] * lower
            self.found.append(Sorted(keys))
            self.logs.append(np.log2(p).astype(np.float32))
            self.contexts.append(Sorted(contexts))
            self.weights.append(np.log2(weight).astype(np.float32))
        self.unknown = -math.log2(symbols)

    def _log(self, k: int, sequences: np.ndarray) -> np.ndarray:
        if k == 0:
            return np.full((len(sequences), self.width), self.unknown, np.float32)
        at = self.found[k - 1].find(sequences)
        out = self.logs[k - 1][at] if len(self.logs[k - 1]) else np.empty((len(sequences), self.width), np.float32)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            rest = sequences[missing]
            out[missing] = self._log(k - 1, rest & np.uint64((1 << 16 * (k - 1)) - 1)) if k > 1 else self.unknown
            context = self.contexts[k - 1].find(rest >> np.uint64(16))
            known = context >= 0
            out[missing[known]] += self.weights[k - 1][context[known]]
        return out

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits by text and language of the symbols in this part, number of all symbols, whether there is a letter."""
        codes, begins = symbols(texts)
        bits, n, letters = np.zeros((len(texts), self.width)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for places, packed in _windows(codes, 1 << 17):
            of = np.searchsorted(begins, places, "right") - 1
            n += np.bincount(of, minlength=len(texts))
            letters += np.bincount(of, codes[places] != _OTHER, len(texts)).astype(np.int64)
            if self.parts > 1:
                mine = (packed >> np.uint64(16) & np.uint64(0xFFFFFFFF)) % np.uint64(DEAL) % np.uint64(self.parts) == self.part
                packed, of = packed[mine], of[mine]
            if len(of):
                first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                bits[of[first]] -= np.add.reduceat(self._log(ORDER, packed), first, axis=0, dtype=np.float64)
        return bits, n, letters > 0


class Learned:
    """What is known of the languages: true counts (k, lang, gram, n) of all sequences in a table, and small numbers about them.

    The table grows with the corpus, so its models are made and sent out in pieces of at most about `cells` sequences times
    languages: the driver has one at a time, and so has a Python worker. A piece has as many whole languages as fit, in the order of
    their names; a language that alone has more sequences is dealt over several pieces by the two symbols before a sequence's last, which
    all sequences have that a symbol's probability can depend on. So a piece holds no more than its share and what no corpus makes grow
    beyond its letters: a language's single symbols, its pairs of symbols, and what follows its most frequent pair.
    """

    def __init__(self, tables: DataFrame, cells: int) -> None:
        self.tables, self._sent = tables, {}
        told = tables.groupBy("k", "lang").agg(F.count("*").alias("rows"), F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect()
        self.langs = sorted({r["lang"] for r in told})
        number = {x: i for i, x in enumerate(self.langs)}
        self.symbols = tables.where("k = 1").select("gram").distinct().count() + 1
        self.discounts = np.full((ORDER, len(self.langs)), 0.5)
        size = [0] * len(self.langs)
        for r in told:
            size[number[r["lang"]]] += r["rows"]
            if r["ones"]:
                self.discounts[r["k"] - 1, number[r["lang"]]] = min(0.95, max(0.05, r["ones"] / (r["ones"] + 2 * r["twos"])))
        #: (first language, language after the last, part, parts) of each piece.
        self.pieces: list[tuple[int, int, int, int]] = []
        first = 0
        while first < len(size):
            end = first + 1
            while end < len(size) and sum(size[first : end + 1]) * (end + 1 - first) <= cells:
                end += 1
            parts = max(1, -(-size[first] // cells)) if end == first + 1 else 1
            self.pieces += [(first, end, part, parts) for part in range(parts)]
            first = end
        #: By language: what cross-entropies are usual in it (see usual).
        self.limits = np.tile([np.inf, 0.0, 0.0, 0.0, 0.0, np.inf], (len(self.langs), 1))

    def sent(self, piece: int) -> Broadcast:
        if piece not in self._sent:
            first, end, part, parts = self.pieces[piece]
            own = self.tables if end - first == len(self.langs) else self.tables.where(F.col("lang").isin(self.langs[first:end]))
            own = own if parts == 1 else own.where((F.col("k") <= 2) | (dealt(parts) == part))
            got = own.select("k", "lang", "gram", "n").toArrow()
            lang = pc.index_in(got["lang"], value_set=pa.array(self.langs[first:end], got["lang"].type)).to_numpy()
            model = Model(end - first, got["k"].to_numpy(), lang, got["gram"].to_numpy().astype(np.int64).view(np.uint64), got["n"].to_numpy(), self.discounts[:, first:end], self.symbols, part, parts)
            self._sent[piece] = self.tables.sparkSession.sparkContext.broadcast(model)
        return self._sent[piece]

    def forget(self) -> None:
        """Takes the models back from the workers."""
        for shared in self._sent.values():
            shared.unpersist()

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy in bits a symbol by text and language, number of symbols, whether there is a letter."""
        bits = np.zeros((len(texts), len(self.langs)))
        for piece, (first, end, _, _) in enumerate(self.pieces):
            own, n, letters = self.sent(piece).value.sums(texts)
            bits[:, first:end] += own
        return bits / np.maximum(n, 1)[:, None], n, letters


def _slices(batch: pa.RecordBatch, column: int, size: int = 300_000) -> Iterator[tuple[int, list[str]]]:
    """The texts of a column in lists of about that many characters, and where each begins."""
    texts, begin, held = [t or "" for t in batch.column(column).to_pylist()], 0, 0
    for end, text in enumerate(texts, 1):
        held += len(text)
        if held >= size or end == len(texts):
            yield begin, texts[begin:end]
            begin, held = end, 0


def _entropies(docs: DataFrame, learned: Learned, keep: list[str]) -> DataFrame:
    """The columns keep, and lang_pred, score, cross_entropy, n_symbols, rejected of docs."""
    prepare(docs.sparkSession)
    langs, limits = learned.langs, learned.limits
    names_out = [*keep, "lang_pred", "score", "cross_entropy", "n_symbols", "rejected"]
    told = T.StructType().add("lang_pred", "string").add("score", "double").add("cross_entropy", "double").add("n_symbols", "long").add("rejected", "boolean")
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in keep), *told])

    def judged(bits: np.ndarray, n: np.ndarray, letters: np.ndarray) -> list[pa.Array]:
        bits = bits / np.maximum(n, 1)[:, None]
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(best)), best]
        odds = np.exp2(-(bits - least[:, None]) * np.minimum(n, 20)[:, None]).sum(axis=1)
        names = [langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
        return [pa.array(names, pa.string()), pa.array(np.where(letters, 1 / odds, 0.0)), pa.array(np.where(letters, least, 0.0)), pa.array(n, pa.int64()), pa.array(~letters | (least > usual(limits[best], n)))]

    # a text that is kept isn't sent twice
    own = "text" in keep and docs.schema["text"].dataType == T.StringType()
    at = keep.index("text") if own else len(keep)
    sent = keep if own else [*keep, F.col("text").cast("string").alias("_text")]
    pieces = learned.pieces
    if len(pieces) == 1:
        shared = learned.sent(0)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin, texts in _slices(batch, at):
                    yield pa.RecordBatch.from_arrays([*(c.slice(begin, len(texts)) for c in batch.columns[: len(keep)]), *judged(*shared.value.sums(texts))], names_out)

        return docs.select(*sent).mapInArrow(judge, schema)

    numbered = materialize(docs.select(*sent, F.monotonically_increasing_id().alias("_row")), "numbered-texts")
    text = "text" if own else "_text"

    def adder(piece: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        shared, width = learned.sent(piece), pieces[piece][1] - pieces[piece][0]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin, texts in _slices(batch, 1):
                    bits, n, letters = shared.value.sums(texts)
                    sums = pa.FixedSizeListArray.from_arrays(pa.array(bits.ravel()), width).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), pa.array([piece] * len(texts), pa.int32()), sums, pa.array(n, pa.int64()), pa.array(letters)], ["_row", "_piece", "_bits", "_n", "_letters"])

        return add

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits = np.zeros((batch.num_rows, len(langs)))
                for row, own in zip(bits, batch.column(batch.num_columns - 3).to_pylist(), strict=True):
                    for of in own:
                        row[pieces[of["_piece"]][0] : pieces[of["_piece"]][1]] += of["_bits"]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *judged(bits, batch.column(batch.num_columns - 2).to_numpy(), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))], names_out)

    # Each piece's sums are written before the next one is sent, so a worker never needs two of them.
    each = [materialize(numbered.select("_row", text).mapInArrow(adder(piece), "_row long, _piece int, _bits array<double>, _n long, _letters boolean"), "piece-sums") for piece in range(len(pieces))]
    every = functools.reduce(DataFrame.unionByName, each)
    added = every.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_piece", "_bits"))).alias("_pieces"), F.first("_n").alias("_n"), F.first("_letters").alias("_letters"))
    return numbered.join(added, "_row").select(*keep, "_pieces", "_n", "_letters").mapInArrow(whole, schema)


#: The share of a language's own texts that its limit may reject, and the quantiles of held-back texts between which the
#: fall-off of their distances is measured that is taken to go on beyond them.
MISS, QUANTILES = 1e-9, (0.5, 0.99, 0.999)


def usual(limits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The largest usual cross-entropy of texts of n symbols, by rows of (m, c, a, b, z, e).

    The mean is m + c / n, the variance a + b / n, and z standard deviations from it are usual. A text that is no better
    predicted than single symbols by their frequencies (e bits each, and four standard deviations of the part that shrinks with n) never is.
    """
    m, c, a, b, z, e = limits.T
    n = np.maximum(n, 1)
    return np.minimum(m + c / n + z * np.sqrt(a + b / n), np.maximum(m, e) + c / n + 4 * np.sqrt(b / n))


def _measured(known: DataFrame) -> list[Row]:
    """(lang, rows, m, c, a, b, q) of known (lang, h, u = 1 / n), not empty, see usual: lines fitted over u, to h and to its squared distance from the first.

    q are the QUANTILES of the distances in standard deviations. What is fitted, a row for each language, goes back to the rows as a
    small table that is sent out, so that no join has an empty side.
    """
    zero = lambda x: F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0))
    few = lambda t: F.broadcast(known.sparkSession.createDataFrame(t.collect(), t.schema))
    line = few(known.groupBy("lang").agg(F.count("*").alias("rows"), F.avg("h").alias("_h"), F.avg("u").alias("_u"), zero(F.regr_slope("h", "u")).alias("c")).withColumn("m", F.col("_h") - F.col("c") * F.col("_u")).drop("_h", "_u"))
    near = known.join(line, "lang").withColumn("d", F.col("h") - F.col("m") - F.col("c") * F.col("u"))
    spread = few(near.groupBy("lang").agg(F.avg(F.col("d") ** 2).alias("_v"), F.avg("u").alias("_u"), zero(F.regr_slope(F.col("d") ** 2, F.col("u"))).alias("b")).withColumn("a", F.greatest(F.col("_v") - F.col("b") * F.col("_u"), F.lit(1e-3))).drop("_v", "_u"))
    far = near.join(spread, "lang").withColumn("z", F.ceil(F.col("d") / F.sqrt(F.col("a") + F.col("b") * F.col("u")) * 64) / 64)
    steps = far.groupBy("lang", "rows", "m", "c", "a", "b", "z").agg(F.count("*").alias("n"))
    return steps.groupBy("lang", "rows", "m", "c", "a", "b").agg(F.percentile("z", F.array(*map(F.lit, QUANTILES)), F.col("n")).alias("q")).collect()


def _reach(q: list[float]) -> float:
    """The standard deviations that all but MISS of a language's texts keep to, by the QUANTILES of held-back ones.

    Beyond the last two of these, a tail falls off by e in equal distances, which are taken as the larger of what the body (first to second) and
    the rim (second to third) show; tails of texts, lighter than that or as light, have less beyond.
    """
    far = [hi + (hi - lo) / math.log((1 - p) / (1 - r)) * math.log((1 - r) / MISS) for lo, hi, p, r in zip(q, q[1:], QUANTILES, QUANTILES[1:])]
    return max(far)


def _entropy_of_symbols(counts: DataFrame) -> dict[str, float]:
    """Bits a symbol of each language in counts (lang, gram, n) by the frequencies of single symbols."""
    single = counts.groupBy("lang", F.col("gram").bitwiseAND(0xFFFF).alias("s")).agg(F.sum("n").cast("double").alias("n"))
    told = single.groupBy("lang").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log2("n")).alias("logs"))
    return {r["lang"]: math.log2(r["all"]) - r["logs"] / r["all"] for r in told.collect()}


def _calibrate(fitted: Learned, held_back: DataFrame, entropies: dict[str, float], least_rows: int = 30) -> np.ndarray | None:
    """What is usual in each language of entropies (see usual), from texts (lang, text) that the model was not counted from; None if there are none.

    Only rows predicted as labelled count. A language with fewer than least_rows of them takes what is usual over the rows of all
    languages, or where none is right, over all rows with a letter. One with too few to show the last of the QUANTILES isn't held to a
    shorter tail than all languages together have; where these can't show the last but one either, no distance is unusual, and only
    texts that are no better predicted than by single symbols are. What is gathered is a row for each language.
    """
    known = _entropies(held_back, fitted, ["lang"]).where("n_symbols > 0 AND lang_pred <> 'und'")
    known = materialize(known.select("lang", (F.col("lang_pred") == F.col("lang")).alias("right"), F.col("cross_entropy").alias("h"), (1 / F.col("n_symbols")).alias("u")), "calibration")
    if known.isEmpty():
        return None
    right = known.where("right")
    some = right if not right.isEmpty() else known
    every = _measured(some.withColumn("lang", F.substring("lang", 1, 0)))[0]
    far = _reach(every["q"]) if every["rows"] * (1 - QUANTILES[1]) >= 1 else math.inf
    limits = lambda r: [r["m"], r["c"], r["a"], r["b"], _reach(r["q"]) if r["rows"] * (1 - QUANTILES[-1]) >= 1 else max(far, _reach(r["q"]))]
    own = {r["lang"]: limits(r) for r in _measured(some) if r["rows"] >= least_rows} if some is right else {}
    pooled = limits(every)
    discard(known)
    return np.array([[*own.get(x, pooled), e] for x, e in sorted(entropies.items())])


def learn(labelled: DataFrame, cells: int = 1 << 23, folds: int = 10) -> Learned | None:
    """What is known of the languages in labelled (lang, text), or None if no row has both a lang and a symbol.

    All rows are counted, in Spark, and every sequence keeps its own count; models are made in pieces of about `cells`
    sequences times languages (see Learned). The limits of rejection come from one in `folds` texts (by a hash of the text, so
    that copies stay together), scored by a model of the others; the model that is returned has all.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held", F.pmod(F.xxhash64("text"), F.lit(folds)) == 0)
    counts = materialize(count_grams(rows), "gram-counts")

    def tables(highest: DataFrame) -> DataFrame:
        lower, table = [], highest
        for k in range(ORDER - 1, 0, -1):
            table = table.groupBy("lang", F.col("gram").bitwiseAND((1 << 16 * k) - 1).alias("gram")).agg(F.count("*").alias("n"))
            lower.append(table.withColumn("k", F.lit(k)))
        lower = materialize(functools.reduce(DataFrame.unionByName, lower), "lower-counts")
        return highest.withColumn("k", F.lit(ORDER)).unionByName(lower)

    fitted = Learned(tables(counts.where("NOT held").drop("held")), cells)
    every = materialize(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "all-counts")
    learned = Learned(tables(every), cells)
    if not learned.langs:
        return None
    limits = _calibrate(fitted, rows.where("held"), _entropy_of_symbols(every)) if fitted.langs else None
    if limits is not None:
        learned.limits = limits
    fitted.forget()
    return learned


def identify(docs: DataFrame, model: Learned | None, keep: list[str] | None = None) -> DataFrame:
    """docs' columns keep (doc_id) with lang_pred, score, cross_entropy, n_symbols, rejected.

    lang_pred is the language whose model gives the text the lowest cross-entropy a symbol (ties: the first by name),
    score its share of the odds (0 to 1). A text that is null or has no letter is `und`, score 0, and rejected; so is
    one whose cross-entropy is not usual for a text of its length in that language, by held-back texts (see usual).
    Without a model all are `und`, score 0, and only texts without a letter are rejected. Repeated rows give a row
    each; an empty table gives an empty one.
    """
    keep = keep or ["doc_id"]
    if model is None:
        letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cross_entropy"), F.lit(0).cast("long").alias("n_symbols"), (~letter).alias("rejected"))
    return _entropies(docs, model, keep)
