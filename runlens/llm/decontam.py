"""Benchmark decontamination: documents that hold a benchmark item, up to an edit budget."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import prepare
from runlens.llm.langid import Sorted

Q = 8
_BLANK = 32
#: Characters that are normalized, and symbols whose q-grams are looked up, at a time: a text of any length needs little more than its symbols.
_STEP = 1 << 20


@functools.cache
def _folded() -> np.ndarray:
    return np.array([(ord(c.lower()[0]) if c.isalnum() else _BLANK) for c in map(chr, range(1 << 16))], np.uint32)


def normalized(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one array of symbols: letters and digits in lower case, one blank for anything between them and after each text.

    Also where each text begins in it, and each symbol's place in its own text.
    """
    whole = "".join(t + "\n" for t in texts)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    symbols, places, last = [], [], _BLANK
    for low in range(0, len(whole), _STEP):
        codes = np.frombuffer(whole[low : low + _STEP].encode("utf-32-le", "replace"), np.uint32)
        folded = np.where(codes < 1 << 16, _folded()[np.minimum(codes, 0xFFFF)], codes)
        own = begins[(begins >= low) & (begins < low + len(folded))] - low
        ends = begins[1:][(begins[1:] > low) & (begins[1:] <= low + len(folded))] - 1 - low
        before = np.concatenate(([last], folded[:-1]))
        before[own] = _BLANK
        stays = (folded != _BLANK) | (before != _BLANK)
        stays[ends] = True
        kept = np.flatnonzero(stays)
        symbols.append(folded[kept].astype(np.uint32))
        places.append((kept + low).astype(np.uint32 if len(whole) < 1 << 32 else np.int64))
        last = folded[-1]
    flat, at = (np.concatenate(x) if x else np.zeros(0, np.uint32) for x in (symbols, places))
    cuts = np.searchsorted(at, begins)
    return flat, cuts, at


def qgrams(symbols: np.ndarray, width: int = Q) -> np.ndarray:
    """Hashes of all runs of width symbols, each built from two runs of at most half of it."""
    h, have = symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1
    while have < width:
        step = min(have, width - have)
        h = (h[:-step] ^ (h[:-step] >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) + h[step:] if len(h) > step else h[:0]
        have += step
    return h


def edit_budget(size: int, rate: float) -> int:
    """Edits that an item of so many symbols may have: rate * size, or fewer if those could spoil all of its q-grams."""
    return max(0, min(int(size * rate), (size - Q) // Q))


class _Class:
    """Items of similar size, by q-gram.

    k edits spoil at most k * Q of an item's m - Q + 1 q-grams, so a region within budget shares the rest (needed). They
    lie within m + k symbols of the text, on diagonals that differ by at most k.
    """

    def __init__(self, numbers: list[int], symbols: list[np.ndarray], hashes: list[np.ndarray], keys: np.ndarray, rate: float) -> None:
        self.numbers = np.array(numbers, np.int32)
        sizes = np.array([len(symbols[i]) for i in numbers])
        budgets = np.array([edit_budget(n, rate) for n in sizes])
        self.needed, self.budgets = sizes - Q + 1 - budgets * Q, budgets
        flat = np.searchsorted(keys, np.concatenate([hashes[i] for i in numbers]))
        order = np.argsort(flat, kind="stable")
        self.first = np.searchsorted(flat[order], np.arange(len(keys) + 1)).astype(np.int32)
        self.item = np.repeat(np.arange(len(numbers), dtype=np.int32), [len(hashes[i]) for i in numbers])[order]
        self.place = np.concatenate([np.arange(len(hashes[i]), dtype=np.int32) for i in numbers])[order]
        self.there = self.first[1:] > self.first[:-1]
        #: A region within budget is at most `reach` symbols long, and some stretch of `window` of them has `dense` shared q-grams or more.
        extent = sizes + budgets
        self.reach, self.window = int(extent.max()), int(extent.min())
        self.dense = max(1, int(np.ceil(self.needed / np.ceil(extent / self.window)).min()))
        self.width = int(budgets.max()) + 1
        self.largest = int(sizes.max())

    def shared(self, at: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the symbols, item, place in item) of the shared q-grams (at, key found) that can be part of a region within budget.

        Left out are only those further than `reach` from every stretch that is dense enough: a region has such a
        stretch and is no longer than that, so all its q-grams stay, wherever in it they are.
        """
        mine = self.there[found]
        at, found = at[mine], found[mine]
        if len(at) < self.dense:
            return at[:0], at[:0], at[:0]
        last = at[self.dense - 1 :]
        runs = np.flatnonzero(last - at[: len(last)] < self.window)
        low, high = np.searchsorted(at, at[runs] - self.reach), np.searchsorted(at, last[runs] + self.reach, "right")
        near = np.cumsum(np.bincount(low, minlength=len(at) + 1) - np.bincount(high, minlength=len(at) + 1))[:-1] > 0
        at, found = at[near], found[near]
        many = self.first[found + 1] - self.first[found]
        ends = np.cumsum(many)
        flat = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - many, many) + np.repeat(self.first[found], many)
        return np.repeat(at, many), self.item[flat], self.place[flat]

    def regions(self, at: np.ndarray, found: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item's number, least and greatest diagonal) of the bands that share enough q-grams of an item.

        Bands are twice as wide as the largest budget and begin every width, so the diagonals of any region within budget
        lie in one of them. Of a band with enough q-grams those diagonals stay that have enough within the item's own budget.
        """
        at, item, place = self.shared(at, found)
        if not len(at):
            return
        text = np.searchsorted(cuts, at, side="right") - 1
        diagonal = at - place - cuts[text] + self.largest
        wide = 2 * self.width
        for shift in (0, self.width):
            band = (diagonal + shift) // wide
            key = (text * len(self.numbers) + item) * (int(band.max()) + 1) + band
            order = np.argsort(key, kind="stable")
            begins = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
            counts = np.diff(np.append(begins, len(key)))
            for k in np.flatnonzero(counts >= self.needed[item[order[begins]]]):
                mine = order[begins[k] : begins[k] + counts[k]]
                own = int(item[mine[0]])
                needed, along = int(self.needed[own]), np.sort(diagonal[mine])
                enough = np.flatnonzero(along[needed - 1 :] - along[: len(along) - needed + 1] <= self.budgets[own])
                if len(enough):
                    yield int(text[mine[0]]), int(self.numbers[own]), int(along[enough[0]]) - self.largest, int(along[enough[-1] + needed - 1]) - self.largest


class Items:
    """Benchmark items by q-gram, with an edit budget; those of fewer than two q-grams' symbols, which the lemma leaves none, for exact places."""

    def __init__(self, ids: list, texts: list[str], rate: float) -> None:
        symbols, cuts, _ = normalized(texts)
        self.ids, self.rate = ids, rate
        self.symbols = [s[: len(s) - sum(1 for x in s[-2:] if x == _BLANK)] for s in (symbols[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))]
        least = 2 * Q
        long = [i for i, s in enumerate(self.symbols) if len(s) >= least]
        hashes = {i: qgrams(self.symbols[i]) for i in long}
        keys = np.unique(np.concatenate([hashes[i] for i in long])) if long else np.zeros(0, np.uint64)
        self.keys, self.seen = Sorted(keys), np.zeros(1 << 20, bool)
        self.seen[self._slot(keys)] = True
        by: dict[int, list[int]] = {}
        for i in long:
            by.setdefault((len(self.symbols[i]) // least).bit_length(), []).append(i)
        self.classes = [_Class(numbers, self.symbols, hashes, keys, rate) for _, numbers in sorted(by.items())]
        #: Shorter items with a blank at both ends, by the hash of all of it or of its first Q symbols.
        self.anchors: dict[int, tuple[Sorted, list[list[tuple[int, np.ndarray]]]]] = {}
        short: dict[int, dict[int, list[tuple[int, np.ndarray]]]] = {}
        for i, s in enumerate(self.symbols):
            if 0 < len(s) < least:
                padded = np.concatenate(([_BLANK], s, [_BLANK])).astype(np.uint32)
                width = min(Q, len(padded))
                short.setdefault(width, {}).setdefault(int(qgrams(padded[:width], width)[0]), []).append((i, padded))
        for width, held in short.items():
            self.anchors[width] = (Sorted(np.array(list(held), np.uint64)), list(held.values()))

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int32)

    def _known(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of q-grams that some item has, and which of the keys they are."""
        places, keys = [], []
        for low in range(0, max(1, len(symbols) - Q + 1), _STEP):
            hashes = qgrams(symbols[low : low + _STEP + Q - 1])
            maybe = np.flatnonzero(self.seen[self._slot(hashes)])
            found = self.keys.find(hashes[maybe])
            places.append(maybe[found >= 0] + low)
            keys.append(found[found >= 0])
        return np.concatenate(places), np.concatenate(keys)

    def _ends(self, symbols: np.ndarray, region: np.ndarray, budget: int, anywhere: bool) -> np.ndarray | None:
        """For each end in region, from `budget` symbols before its begin on, the least edits that turn a part before it into symbols, or None if all are over budget.

        The part begins anywhere, or at the region's begin. Rows are the item's symbols, columns the diagonals; the
        region is filled up with signs that equal nothing, one for each symbol that may be missing at its ends.
        """
        width = len(region) - len(symbols) + 1 + 2 * budget
        if width < 1:
            return None
        padded = np.concatenate((np.zeros(budget, region.dtype), region, np.zeros(budget, region.dtype)))
        steps = np.arange(width)
        cost = np.zeros(width, np.int64) if anywhere else np.abs(steps - budget)
        for i, c in enumerate(symbols):
            next_cost = cost + (padded[i : i + width] != c)
            np.minimum(next_cost[:-1], cost[1:] + 1, out=next_cost[:-1])
            cost = np.minimum.accumulate(next_cost - steps) + steps
            if cost.min() > budget:
                return None
        return cost

    def align(self, item: int, region: np.ndarray) -> tuple[int, int, int] | None:
        """(edits, start, end in region) of the item's place with the fewest edits, the first of these to end and of the latest start; None if over budget."""
        symbols = self.symbols[item]
        budget = edit_budget(len(symbols), self.rate)
        cost = self._ends(symbols, region, budget, True)
        if cost is None:
            return None
        end = min(max(0, int(cost.argmin()) + len(symbols) - budget), len(region))
        back = self._ends(symbols[::-1], region[:end][::-1], budget, False)
        edits = int(cost.min())
        start = end if back is None else end - min(max(0, int(np.flatnonzero(back <= edits)[0]) + len(symbols) - budget), end)
        return edits, start, end

    def _exact(self, symbols: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, place in symbols) of short items between blanks or the text's ends, the first place in each text."""
        padded = np.concatenate(([_BLANK], symbols)).astype(np.uint32)
        for width, (keys, held) in self.anchors.items():
            for low in range(0, max(1, len(padded) - width + 1), _STEP):
                found = keys.find(qgrams(padded[low : low + _STEP + width - 1], width))
                at = np.flatnonzero(found >= 0)
                for k in np.unique(found[at]):
                    for item, want in held[k]:
                        places = at[found[at] == k] + low
                        places = places[places + len(want) <= len(padded)]
                        for j, c in enumerate(want):
                            places = places[padded[places + j] == c]
                        text = np.searchsorted(cuts, places, side="right") - 1
                        for t, first in zip(*np.unique(text, return_index=True), strict=True):
                            yield int(t), item, int(places[first])

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits), the best place for each text and item; places count the text's own characters."""
        symbols, cuts, own = normalized(texts)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        if self.anchors:
            for t, i, at in self._exact(symbols, cuts):
                if (t, i) not in best or at < best[t, i][1]:
                    best[t, i] = (0, at, at + len(self.symbols[i]))
        tried: set[tuple[int, int, int, int]] = set()
        if self.classes:
            at, found = self._known(symbols)
            for group in self.classes:
                for t, i, least, greatest in group.regions(at, found, cuts):
                    item = self.symbols[i]
                    budget = edit_budget(len(item), self.rate)
                    start, end = max(int(cuts[t]), int(cuts[t]) + least - budget), min(int(cuts[t + 1]), int(cuts[t]) + greatest + len(item) + budget)
                    region = symbols[start:end]
                    if (t, i, start, end) in tried:
                        continue
                    tried.add((t, i, start, end))
                    own_bytes, item_bytes = region.astype("<u4").tobytes(), item.astype("<u4").tobytes()
                    exact = own_bytes.find(item_bytes)
                    while exact > 0 and exact % 4:
                        exact = own_bytes.find(item_bytes, exact + 1)
                    got = (0, exact // 4, exact // 4 + len(item)) if exact >= 0 else self.align(i, region)
                    if got:
                        told = (got[0], start + got[1], start + got[2])
                        if (t, i) not in best or (told[0], told[2], -told[1]) < (best[t, i][0], best[t, i][2], -best[t, i][1]):
                            best[t, i] = told
        for (t, i), (edits, start, end) in sorted(best.items()):
            yield t, i, int(own[start]) - int(begins[t]), min(int(own[end - 1]) + 1 - int(begins[t]), len(texts[t])), edits


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_chars: int = 2_000_000, blocks_at_once: int = 4) -> DataFrame:
    """(doc_id, item_id, start, end, edits): where documents hold items of benchmark (item_id, text), one row for each two.

    Letters and digits in lower case count, all else parts words, the text's end too: a text's last symbol is a blank. A place counts if it turns into the whole item by
    at most edit_budget edits of single symbols: rate * symbols, or less where no q-gram would be left for the lemma.
    start and end are those of the place with the fewest edits, in the text's characters; of several the one that ends
    first. Items of fewer than 16 symbols count where they stand exactly, between blanks or the text's ends: an edit can
    leave them without a q-gram. Null texts and items without a letter or digit match nothing. The items are matched in
    blocks of about block_chars characters, whose indexes (some 40 bytes a character) are broadcast; a scan of the documents meets
    blocks_at_once of them, so what a worker holds has a bound. Repeated rows give their rows again, items of one
    item_id are matched each; no documents or items give no row; other columns are left out.
    """
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.where("text IS NOT NULL").select("item_id", "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, start long, end long, edits long"
    item_type = benchmark.select("item_id").limit(0).toArrow().schema.field(0).type
    out = spark.createDataFrame([], schema)
    for first in range(0, blocks, blocks_at_once):
        held = []
        for block in range(first, min(blocks, first + blocks_at_once)):
            part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
            index = Items([r[0] for r in part], [r[1] for r in part], rate)
            if index.classes or index.anchors:
                held.append(spark.sparkContext.broadcast(index))
        if not held:
            continue

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, begin, size = [t or "" for t in batch.column(1).to_pylist()], 0, 0
                for end, text in enumerate(texts, 1):
                    size += len(text)
                    if size < 300_000 and end < len(texts):
                        continue
                    for shared in held:
                        found = list(shared.value.matches(texts[begin:end]))
                        if found:
                            t, i, start, stop, edits = zip(*found, strict=True)
                            rows = pa.array([begin + x for x in t], pa.int64())
                            ids = pa.array([shared.value.ids[x] for x in i], item_type)
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), ids, *(pa.array(x, pa.int64()) for x in (start, stop, edits))], ["doc_id", "item_id", "start", "end", "edits"])
                    begin, size = end, 0

        found = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(scan, schema)
        out = found if blocks <= blocks_at_once else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that hold a benchmark item (see contaminated); rows without doc_id stay, other columns pass through."""
    bad = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti")
