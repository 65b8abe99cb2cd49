"""Re-running the searches of reports: commands read as searches, a literal index of their patterns, coverage rows, and one verdict a report."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import commands
from runlens.operators import citations, evidence
from runlens.shared import materialize, prepare

_QUOTED = re.compile(r"\\[^A-Za-z0-9]")


def search_of(command: Column) -> Column:
    """(pattern, dir, without, mode) of a line such as `grep -rn "a b" src | grep -v c`; null where it is no search.

    -F takes the pattern as it stands, -i and -w as usual, -l, or -c by file, counts files, and a following grep -v names what lines may not match.
    """
    flag = lambda c, letter: F.exists(c["words"], lambda w: w.rlike(f"^-[a-zA-Z]*{letter}"))
    operands = lambda c: F.filter(F.slice(c["words"], 2, F.greatest(F.size(c["words"]) - 1, F.lit(0))), lambda w: ~w.startswith("-"))

    def pattern(c: Column) -> Column:
        own = F.get(operands(c), F.lit(0))
        literal = F.when(flag(c, "F"), F.concat(F.lit("\\Q"), own, F.lit("\\E"))).otherwise(own)
        whole = F.when(flag(c, "w"), F.concat(F.lit("\\b(?:"), literal, F.lit(")\\b"))).otherwise(literal)
        return F.when(flag(c, "i"), F.concat(F.lit("(?i)"), whole)).otherwise(whole)

    def told(found: Column) -> Column:
        first = F.get(found, F.lit(0))
        rest = F.filter(F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), lambda c: c["name"].isin("grep", "egrep", "rg") & flag(c, "v"))
        is_search = first["name"].isin("grep", "egrep", "rg") & (F.size(operands(first)) > 0) & ~flag(first, "v")
        place = F.regexp_replace(F.coalesce(F.get(operands(first), F.lit(1)), F.lit(".")), "/+$", "")
        return F.when(is_search, F.struct(pattern(first).alias("pattern"), place.alias("dir"), pattern(F.get(rest, F.lit(0))).alias("without"), F.when(flag(first, "l"), "files").otherwise("lines").alias("mode")))

    return commands.let(commands.words(command), told)


def required(pattern: str) -> str:
    """The longest text that every match of a pattern holds, as far as plain reading tells; empty where none is sure."""
    if pattern.startswith("\\Q") and pattern.find("\\E") == len(pattern) - 2:
        return pattern[2:-2]
    if re.search(r"\(\?[a-zA-Z-]*[ix]|\\Q|(?<!\\)\|", pattern):
        return ""
    runs, own, depth, i = [], "", 0, 0
    while i < len(pattern):
        c, plain = pattern[i], ""
        if c == "\\":
            quoted = _QUOTED.match(pattern, i)
            plain, i = (pattern[i + 1], i + 2) if quoted else ("", len(pattern) if pattern[i + 1 : i + 2] in "xupPcNk0123456789" else i + 2)
        elif c == "[":
            end = re.compile(r"\[\^?\]?(?:\\.|\[[^\]]*\]|[^\]\\])*\]").match(pattern, i)
            i = end.end() if end else len(pattern)
        else:
            depth += (c == "(") - (c == ")")
            plain, i = ("" if c in "().^$*+?{" else c), i + 1
            if c == "{":
                i = pattern.find("}", i) + 1 or len(pattern)
        after = pattern[i : i + 1]
        if plain and not depth and after not in ("*", "?", "{"):
            own += plain
            if after != "+":
                continue
        runs.append(own)
        own = ""
    return max([*runs, own], key=len)


#: What parts the tokens of a line; bits of a line's number in a block, lines and bytes of a block.
_BLANK, _BITS, _LINES, _BYTES = " ", 15, 1 << 15, 8 << 20
#: Texts in tables at most; places of lines, and lines of pairs, looked at together.
_SHORT, _PLACES, _MET = 1000, 1 << 20, 2_000_000
#: What a pattern may not hold if it is to stand for itself.
_SPECIAL = r"[\\\[\](){}.*+?^$|]"


def _plain(pattern: Column) -> Column:
    """The text that a pattern stands for if it is nothing but that text, else null."""
    inner = F.substring(pattern, F.lit(3), F.length(pattern) - 4)
    quoted = pattern.startswith("\\Q") & pattern.endswith("\\E") & (F.length(pattern) > 4) & ~inner.contains("\\E")
    return F.when(quoted, inner).when((pattern != "") & ~pattern.rlike(_SPECIAL), pattern)


def _hash(*columns: str) -> Column:
    """A hash that tells nulls of one column from those of another."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def _joined(texts: pa.Array) -> str:
    return pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], texts), _BLANK)[0].as_py()


class _Folder:
    """How many lines and files of a folder hold each plain text asked for, by blocks of its lines.

    asked has (word, without, word_id, pair_id, by_file). Texts of one to three characters are found by tables. Of others, each distinct token of a block (what blanks
    part) is looked through once: a text without a blank is in a line if it is in one of its tokens; texts with one are looked for in the lines. A pair costs a block what
    the rarer of its two texts does, or a bit for each line.
    """

    def __init__(self, asked: list[tuple]) -> None:
        words = dict.fromkeys(text for word, without, *_ in asked for text in (word, without) if text is not None)
        self.short, short = [], []
        for n in (1, 2, 3):  # most that a line holds are of so few characters; a block has a row of bits for each
            own = [w for w in words if len(w) == n and _BLANK not in w]
            table = self._table(own, n, len(short)) if own and len(short) + len(own) <= _SHORT else None
            if table:
                self.short.append(table)
                short += own
        words = {w: i for i, w in enumerate([*short, *(words.keys() - set(short))])}
        self.n_short, at = len(short), words.__getitem__
        pairs: dict[tuple[int, int], int] = {}
        ids, by_file, pair_ids, pair_by_file = {}, set(), [], set()
        for word, without, word_id, pair_id, of_files in asked:
            own = at(word)
            ids[own] = word_id
            if of_files:
                by_file.add(own)
            if without is not None:
                pair = pairs.setdefault((own, at(without)), len(pair_ids))
                if pair == len(pair_ids):
                    pair_ids.append(pair_id)
                if of_files:
                    pair_by_file.add(pair)
        self.n = len(words)
        self.ids = [ids.get(i) for i in range(self.n)] + pair_ids
        self.word, self.other = np.array(list(pairs), np.int64).reshape(-1, 2).T
        self.by_file, self.pair_by_file = np.zeros(self.n, bool), np.array(sorted(pair_by_file), np.int64)
        self.by_file[list(by_file)] = True
        self.n_lines, self.n_files, self.n_unlike = np.zeros(len(self.ids), np.int64), np.zeros(self.n, np.int64), np.zeros(len(pairs), np.int64)
        long = {w: i for w, i in words.items() if i >= self.n_short}
        self.plain, self.spaced = (self._automaton({w: i for w, i in long.items() if (_BLANK in w) == spaced}) for spaced in (False, True))
        self.last: dict[str, tuple[int, np.ndarray]] = {}

    @staticmethod
    def _automaton(words: dict[str, int]) -> ahocorasick.Automaton | None:
        if not words:
            return None
        automaton = ahocorasick.Automaton()
        for word, i in words.items():
            automaton.add_word(word, i)
        automaton.make_automaton()
        return automaton

    @staticmethod
    def _table(words: list[str], n: int, first: int) -> tuple[int, np.ndarray, np.ndarray] | None:
        """words of n characters, numbered from first, as (n, character -> its number, numbers of n characters -> word or -1); None where their characters are too many for a table."""
        chars = sorted({c for w in words for c in w})
        if (len(chars) + 1) ** n > 1 << 22:
            return None
        number = np.zeros(0x110000, np.int32)
        number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        table = np.full([len(chars) + 1] * n, -1, np.int32)
        for i, w in enumerate(words, first):
            table[tuple(number[ord(c)] for c in w)] = i
        return n, number, table.ravel()

    def _short_held(self, texts: pa.Array, kind: type) -> np.ndarray:
        """_held of the texts in tables, by all places of the lines."""
        n = len(texts)
        held = np.zeros((self.n_short, n), bool)
        bits, size = held.ravel(), pc.utf8_length(texts).to_numpy().astype(np.int64) + 1
        cuts = np.unique([0, *np.searchsorted(np.cumsum(size), np.arange(_PLACES, size.sum(), _PLACES)), n])
        for i, j in pairwise(cuts.tolist()):
            letters = np.frombuffer(_joined(texts.slice(i, j - i)).encode("utf-32-le", "surrogatepass"), np.uint32)
            line = np.repeat(np.arange(i, j), size[i:j])
            for chars, number, table in self.short:
                own, of = number[letters], round(len(table) ** (1 / chars))
                at = own[: len(own) - chars + 1].copy()
                for k in range(1, chars):
                    at *= of
                    at += own[k : len(own) - chars + 1 + k]
                text = table[at]
                found = np.flatnonzero(text >= 0)
                bits[text[found] * np.int64(n) + line[found]] = True
        text, line = held.nonzero()
        return (text << _BITS | line).astype(kind)

    def _plain_held(self, texts: pa.Array, kind: type) -> np.ndarray:
        """_held of texts without a blank, with repeats."""
        split = pc.split_pattern(texts, _BLANK)
        coded = split.flatten().dictionary_encode()
        token, tokens = coded.indices.to_numpy(), coded.dictionary
        lines = np.repeat(np.arange(len(texts), dtype=kind), pc.list_value_length(split).to_numpy())
        # All distinct tokens are looked through as one string; where a match ends tells its token.
        place, text = np.fromiter(chain.from_iterable(self.plain.iter(_joined(tokens))), np.int64).reshape(-1, 2).T
        ends = np.cumsum(pc.utf8_length(tokens).to_numpy().astype(np.int64) + 1)
        size = np.bincount(np.searchsorted(ends, place, "right"), minlength=len(tokens))
        begin, size = (np.cumsum(size) - size)[token], size[token]
        at = np.repeat((begin - (np.cumsum(size) - size)).astype(np.int32), size)
        at += np.arange(len(at), dtype=np.int32)
        own = (text << _BITS).astype(kind)[at]
        own |= np.repeat(lines, size)
        return own

    def _held(self, texts: pa.Array) -> np.ndarray:
        """text << _BITS | line, in order and once each."""
        kind = np.uint32 if self.n <= 1 << 32 - _BITS else np.int64
        found = [np.empty(0, kind)]
        if self.plain:
            found.append(self._plain_held(texts, kind))
        if self.spaced:
            found.append(np.array([i << _BITS | line for line, text in enumerate(texts.to_pylist()) for _, i in self.spaced.iter(text)], kind))
        keys = np.concatenate(found)
        keys.sort()
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
        return np.concatenate([self._short_held(texts, kind), keys]) if self.short else keys

    def _files(self, counts: np.ndarray, kind: str, parts: Iterable[tuple[np.ndarray, np.ndarray]], last: int) -> None:
        """Counts the distinct files of each what of parts (what, file), both in order, of which no two have the same what; a file that goes on in the next block counts once."""
        before, counted = self.last.get(kind, (-1, np.empty(0, np.int64)))
        open_ = [counted] if before == last else []
        for what, file in parts:
            new = np.ones(len(what), bool)
            new[1:] = (what[1:] != what[:-1]) | (file[1:] != file[:-1])
            what, file = what[new], file[new]
            np.add.at(counts, what[~((file == before) & np.isin(what, counted))], 1)
            open_.append(what[file == last])
        self.last[kind] = last, np.unique(np.concatenate(open_)) if open_ else counted[:0]

    def count(self, texts: pa.Array, files: np.ndarray) -> None:
        """Counts a block of at most _LINES lines, of which files has the numbers of their files, in order."""
        n = len(texts)
        keys = self._held(texts)
        text, line = (keys >> _BITS).astype(np.int32), (keys & (1 << _BITS) - 1).astype(np.int32)
        often = np.bincount(text, minlength=self.n)
        begin = np.cumsum(often) - often
        self.n_lines[: self.n] += often
        if self.by_file.any():
            mine = self.by_file[text]
            self._files(self.n_files, "words", [(text[mine], files[line[mine]])], files[-1])
        if not len(self.word):
            return
        lesser = often[self.word] <= often[self.other]
        few, many = np.where(lesser, self.word, self.other), np.where(lesser, self.other, self.word)
        dense = often >= max(n // 32, 16)
        both = np.flatnonzero(dense[few])
        # Bits of the lines of each text that many lines hold; other texts have their lines in keys.
        row = np.cumsum(dense) - 1
        lined = np.zeros((max(int(dense.sum()), 1), -(-n // 64) * 64), bool)
        mine = dense[text]
        lined[row[text[mine]], line[mine]] = True
        bits = np.packbits(lined, axis=1, bitorder="little")
        del lined
        longs = bits.view(np.uint64)
        for i in range(0, len(both), 2048):
            some = both[i : i + 2048]
            self.n_lines[self.n + some] += np.bitwise_count(longs[row[few[some]]] & longs[row[many[some]]]).sum(1, dtype=np.int64)

        def met(pairs: np.ndarray, one: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """(pair, line, whether it holds the other text too) of all lines that hold one text of a pair, some pairs at once."""
            pairs = pairs[often[one[pairs]] > 0]
            size = often[one[pairs]]
            cut = np.searchsorted(np.cumsum(size), np.arange(_MET, size.sum() + _MET, _MET))
            for some, own in zip(np.split(pairs, cut), np.split(size, cut), strict=True):
                pair = np.repeat(some, own)
                at = line[np.arange(len(pair)) + np.repeat(begin[one[some]] - (np.cumsum(own) - own), own)]
                second = other[pair]
                hit = np.empty(len(pair), bool)
                by_bit = dense[second]
                hit[by_bit] = bits[row[second[by_bit]], at[by_bit] >> 3] >> (at[by_bit] & 7) & 1
                wanted = (second[~by_bit] << _BITS | at[~by_bit]).astype(keys.dtype)
                place = np.searchsorted(keys, wanted)
                hit[~by_bit] = keys[np.minimum(place, len(keys) - 1)] == wanted
                yield pair, at, hit

        for pair, _, hit in met(np.flatnonzero(~dense[few] & (often[few] > 0)), few, many):
            self.n_lines[self.n :] += np.bincount(pair[hit], minlength=len(self.word))
        if len(self.pair_by_file):
            self._files(self.n_unlike, "pairs", ((pair[~hit], files[at[~hit]]) for pair, at, hit in met(self.pair_by_file, self.word, self.other)), files[-1])

    def told(self) -> pa.RecordBatch:
        n_files = np.concatenate([self.n_files, np.where(np.isin(np.arange(len(self.word)), self.pair_by_file), self.n_files[self.word] - self.n_unlike, 0)])
        found = [i for i in np.flatnonzero(self.n_lines).tolist() if self.ids[i] is not None]
        return pa.RecordBatch.from_arrays([pa.array([self.ids[i] for i in found], pa.int64()), pa.array(self.n_lines[found]), pa.array(n_files[found])], ["id", "n_lines", "n_files"])


def _count_texts(asked: list[tuple], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n_lines, n_files) of batches (dir, path, text) in which a folder's and a file's lines stand together; asked has (dir, word, without, word_id, pair_id, by_file), without and pair_id null in searches for the word alone.

    A word's id counts the lines and files that hold it, a pair's id the lines that hold both and the files in which every line that holds the word
    holds both. Files are counted only where by_file says so. What a line costs follows from the words in it, however many searches name them.
    """
    index: dict[str, list[tuple]] = {}
    for folder, *own in asked:
        index.setdefault(folder, []).append(tuple(own))
    now, last, number, counts, texts, files, size = index, None, 0, None, [], [], 0  # no folder is index

    def flush() -> None:
        nonlocal texts, files, size
        if counts and texts:
            counts.count(pa.concat_arrays(texts), np.concatenate(files))
        texts, files, size = [], [], 0

    for batch in batches:
        folders, paths, lines = batch.columns
        begins = np.ones(len(batch), bool)
        begins[1:] = [a != b for a, b in pairwise(folders.to_pylist())] if len(folders.unique()) > 1 else False
        starts = np.flatnonzero(begins).tolist()
        for start, end in zip(starts, [*starts[1:], len(batch)], strict=True):
            folder = folders[start].as_py()
            if folder != now:
                flush()
                if counts:
                    yield counts.told()
                now, last, counts = folder, None, _Folder(index.pop(folder)) if folder in index else None
            if counts is None:
                continue
            for i in range(start, end, _LINES):
                path, text = (x.slice(i, min(_LINES, end - i)) for x in (paths, lines))
                if sum(map(len, texts)) + len(text) > _LINES or size > _BYTES:
                    flush()
                new = np.zeros(len(path), np.int64)
                new[0] = path[0].as_py() != last
                new[1:] = pc.fill_null(pc.not_equal(path[1:], path[:-1]), True).to_numpy(zero_copy_only=False)
                own = number + np.cumsum(new)
                number, last = int(own[-1]), path[-1].as_py()
                texts.append(pc.fill_null(text, ""))
                files.append(own)
                size += text.nbytes
    flush()
    if counts:
        yield counts.told()


def _counted_texts(searches: DataFrame, text_lines: DataFrame, folders: DataFrame, per_block: int, per_task: int = 100_000) -> DataFrame:
    """(search, n_lines, n_files) of searches (search, dir, word, without, by_file) for lines that hold a word and, where that isn't null, not another; folders (dir, n) has the lines of each.

    Searches and lines are exchanged once, by folder: a folder with more than per_task lines, and more lines than searches, is dealt by files over as many tasks as it needs, each of which
    gets its searches; one with more than per_block searches is dealt by words too, and its lines are read for each block. A table of such folders is
    broadcast. A task gets a folder's searches before its lines, so nothing is gathered on the driver.
    """
    prepare(searches.sparkSession)
    dealt = folders.join(searches.groupBy("dir").agg(F.count("*").alias("_asked")), "dir")
    large = dealt.select("dir", F.ceil(F.col("_asked") / per_block).alias("_blocks"), F.ceil(F.col("n") / F.greatest(F.lit(per_task), F.least("_asked", F.lit(per_block)))).alias("_salts"))
    large = F.broadcast(materialize(large.where("_blocks > 1 OR _salts > 1"), "folders"))
    placed = searches.select("search", "dir", "word", "without", "by_file", _hash("dir", "word").alias("word_id"), F.when(F.col("without").isNotNull(), _hash("dir", "word", "without")).alias("pair_id"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1)) - 1))
    one = lambda key, n: F.pmod(F.xxhash64(key), F.coalesce(n, F.lit(1)))
    group = F.xxhash64("dir", "_block", "_salt").alias("_group")
    asked = placed.join(large, "dir", "left").withColumn("_block", one("word", "_blocks")).withColumn("_salt", every(F.col("_salts")))
    asked = asked.select(group, F.lit(False).alias("_line"), F.lit(None).cast("string").alias("path"), F.col("word").alias("text"), "without", "word_id", "pair_id", "by_file")
    lines = text_lines.where("dir IS NOT NULL AND text IS NOT NULL").select("dir", F.col("path").cast("string").alias("path"), "text").join(large, "dir", "left")
    lines = lines.withColumn("_salt", one("path", "_salts")).withColumn("_block", every(F.col("_blocks"))).select(group, F.lit(True).alias("_line"), "path", "text")
    both = asked.unionByName(lines, allowMissingColumns=True).repartition("_group").sortWithinPartitions("_group", "_line", "path")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((key, r.slice(i, n)) for r in batches for key, i, n in _runs(r))
        for _, own in groupby(parts, lambda x: x[0][0]):
            asked = []
            for (_, is_line), some in groupby(own, lambda x: x[0]):
                if is_line and asked:
                    yield from _count_texts(asked, (pa.RecordBatch.from_arrays([pa.nulls(len(r), pa.string()), r["path"], r["text"]], ["dir", "path", "text"]) for _, r in some))
                elif not is_line:
                    asked = [(None, *row) for _, r in some for row in zip(*(r[c].to_pylist() for c in ("text", "without", "word_id", "pair_id", "by_file")), strict=True)]

    told = both.mapInArrow(count, "id long, n_lines long, n_files long")
    counts = materialize(told.groupBy("id").agg(F.sum("n_lines").alias("n_lines"), F.sum("n_files").alias("n_files")), "found")
    of = lambda c: counts.select(F.col("id").alias(c), F.col("n_lines").alias(f"{c}_lines"), F.col("n_files").alias(f"{c}_files"))
    both = placed.select("search", "word_id", "pair_id").join(of("word_id"), "word_id", "left").join(of("pair_id"), "pair_id", "left")
    less = lambda what: (F.coalesce(f"word_id_{what}", F.lit(0)) - F.coalesce(f"pair_id_{what}", F.lit(0))).alias(f"n_{what}")
    return both.select("search", less("lines"), less("files"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, bool], int, int]]:
    """((group, whether they are lines), begin, number) of rows that stand together."""
    group, is_line = (batch[c].to_numpy(zero_copy_only=False) for c in ("_group", "_line"))
    starts = [0, *(np.flatnonzero((group[1:] != group[:-1]) | (is_line[1:] != is_line[:-1])) + 1).tolist()] if len(batch) else []
    for start, end in zip(starts, [*starts[1:], len(batch)], strict=True):
        yield (int(group[start]), bool(is_line[start])), start, end - start


def searched(claims: DataFrame, text_lines: DataFrame, per_block: int = 20_000, texts_per_block: int = 500_000) -> DataFrame:
    """evidence.searched's rows, but a line meets only the claims whose pattern's required text it holds.

    Searches for plain texts (without another plain text, if any) are counted in one pass over the lines, see _counted_texts. Others are
    collected in blocks of per_block, whose automata are broadcast; each block is one scan of the lines, and what a line
    may match is then decided by Spark's own patterns. Those whose pattern requires no text meet all lines of their folder.
    """
    on = ["dir", "pattern", "without", "also"]
    asked = claims.withColumn("_search", F.when(F.col("pattern").isNotNull(), _hash(*on)))
    by_file = F.bool_or(F.coalesce(F.col("mode") == "files", F.lit(False))).alias("by_file")
    word, without = _plain(F.col("pattern")), _plain(F.col("without"))
    distinct = asked.where("pattern IS NOT NULL").groupBy(F.col("_search").alias("search"), *on).agg(by_file).withColumns({"word": word, "_no": without})
    plain = F.col("dir").isNotNull() & F.col("also").isNull() & F.col("word").isNotNull() & (F.col("without").isNull() | F.col("_no").isNotNull())
    distinct = materialize(distinct.withColumn("_plain", plain), "searches")
    folders = materialize(text_lines.groupBy("dir").agg(F.count("*").alias("n")), "folders")
    counted = _counted_texts(distinct.where("_plain").select("search", "dir", "word", F.col("_no").alias("without"), "by_file"), text_lines, folders, texts_per_block)
    others = distinct.where("NOT _plain").select("search", *on)
    if not others.isEmpty():
        counted = counted.unionByName(_counted_patterns(others, text_lines, per_block))
    counted = counted.withColumnRenamed("search", "_search")
    there = folders.select(F.col("dir").alias("_there"))
    told = asked.join(counted, "_search", "left").join(there, F.col("dir") == F.col("_there"), "left")
    number = F.when(F.col("mode") == "files", F.col("n_files")).otherwise(F.col("n_lines"))
    told = told.withColumn("actual", F.when(F.col("_there").isNotNull(), F.coalesce(number, F.lit(0))))
    status = F.when(F.col("pattern").isNull(), "uncited").when(F.col("_there").isNull(), "failed").when(F.col("claimed").isNull(), "unverified").when(F.col("actual") == F.col("claimed"), "reproduced").otherwise("mismatch")
    return told.withColumn("status", status).withColumn("is_failing", F.col("status").isin("mismatch", "uncited", "failed")).drop("n_lines", "n_files", "_search", "_there")


def _counted_patterns(distinct: DataFrame, text_lines: DataFrame, per_block: int) -> DataFrame:
    """(search, n_lines, n_files) of searches (search, dir, pattern, without, also)."""
    spark = distinct.sparkSession
    prepare(spark)
    n = distinct.count()
    blocks = max(1, -(-n // per_block))
    kinds = "dir string, path string, search long, pattern string, without string, is_also boolean, text string"
    met = spark.createDataFrame([], kinds)
    for block in range(blocks):
        own = distinct.where(F.pmod("search", F.lit(blocks)) == block).collect()
        needles: dict[str, list[tuple]] = {}
        every: dict[str, list[tuple]] = {}
        for r in own:
            for pattern, without, also in ((r["pattern"], r["without"], False), *([(r["also"], None, True)] if r["also"] is not None else [])):
                word, told = required(pattern), (r["search"], pattern, without, also)
                (needles.setdefault(word, []) if word else every.setdefault(r["dir"], [])).append((r["dir"], *told) if word else told)
        sent = spark.sparkContext.broadcast((needles, every))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            needles, every = sent.value
            automaton = ahocorasick.Automaton()
            for word in needles:
                automaton.add_word(word, word)
            automaton.make_automaton()
            for batch in batches:
                at, rows = [], []
                for i, (folder, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    held = {word for _, word in automaton.iter(text)} if needles and text else ()
                    mine = [*every.get(folder, ()), *(x[1:] for word in held for x in needles[word] if x[0] == folder)]
                    at += [i] * len(mine)
                    rows += mine
                search, pattern, without, also = zip(*rows, strict=True) if rows else [[]] * 4
                index = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(search, pa.int64()), pa.array(pattern, pa.string()), pa.array(without, pa.string()), pa.array(also, pa.bool_()), batch.column(2).take(index)], ["dir", "path", "search", "pattern", "without", "is_also", "text"])

        found = text_lines.where("text IS NOT NULL").select("dir", F.col("path").cast("string"), "text").mapInArrow(find, kinds)
        met = found if blocks == 1 else met.unionByName(found)
    hit = F.regexp_like("text", F.col("pattern")) & ~F.coalesce(F.regexp_like("text", F.col("without")), F.lit(False))
    per_file = met.where(hit).groupBy("search", "path").agg(F.count_if(~F.col("is_also")).alias("n"), F.bool_or("is_also").alias("has_also"))
    needs = distinct.where("also IS NOT NULL").select("search", F.lit(True).alias("_needs"))
    good = per_file.join(needs, "search", "left").where("_needs IS NULL OR has_also")
    return good.groupBy("search").agg(F.sum("n").alias("n_lines"), F.count_if(F.col("n") > 0).alias("n_files"))


def coverage_rows(docs: DataFrame, key: str = "path") -> DataFrame:
    """(key, item, command, claimed, seen, total, unverified) of the tables (#, item, search -> count, seen of total, result) in the section Coverage."""
    rows = evidence.line_cells(citations.sections(docs, key).where("section = 'coverage'"), key)
    cell = lambda i: F.coalesce(F.try_element_at("cells", F.lit(i)), F.lit(""))
    cited = citations.citation(F.concat(F.lit("enumerated "), cell(3)))
    part = lambda i: F.regexp_extract(cell(4), r"(\d+) of (\d+)", i).try_cast("long")
    told = rows.select(key, cell(1).try_cast("int").alias("item"), cited.alias("c"), part(1).alias("seen"), part(2).alias("total"), cell(5).rlike(r"(?i)\bunverified\b").alias("unverified"))
    return told.where("item IS NOT NULL").select(key, "item", "c.command", "c.claimed", "seen", "total", "unverified")


def report_verdicts(reports: DataFrame, text_lines: DataFrame, expected: DataFrame, key: str = "path") -> DataFrame:
    """reports (key, text), text_lines (dir, path, line, text), expected (item) -> (key, claims, failing, partly, coverage, exit): a report's verdict from its text.

    Searches cited by cleared items and by coverage rows are run again (see searched). partly counts coverage rows that looked at fewer
    than all places that they found, or at fewer than there are; coverage is complete, incomplete or missing against the expected items, whose rows say
    unverified or cite a search. exit is 1 if a claim fails, a row is partly inspected, or the coverage isn't complete.
    """
    # Reports are small, and reading them takes long: they go to as many tasks as there are shuffle partitions, once and before they are taken apart.
    dealt = reports.select(key, "text").repartition(int(reports.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    items = citations.cleared(dealt, key).select(key, citations.citation(F.col("item")).alias("c"))
    rows = coverage_rows(dealt, key)
    cited = items.select(key, F.lit(None).cast("int").alias("item"), "c.command", "c.claimed", F.lit(None).cast("long").alias("seen"), F.lit(None).cast("long").alias("total"), (~F.col("c.kind").isin("unverified", "place")).alias("is_claim"))
    cited = cited.unionByName(rows.select(key, "item", "command", "claimed", "seen", "total", (~F.col("unverified")).alias("is_claim"))).withColumn("s", search_of(F.col("command")))
    # Written, as reading a command takes long and all that follows needs it.
    cited = materialize(cited.select(key, "item", "seen", "total", "claimed", "is_claim", "s.pattern", "s.dir", "s.without", "s.mode", F.lit(None).cast("string").alias("also")), "cited")
    claims, rows = cited.where("is_claim").drop("is_claim"), cited.where("item IS NOT NULL")
    done = searched(claims, text_lines)
    partly = F.col("item").isNotNull() & ((F.col("seen") < F.col("total")) | (F.col("total") < F.col("actual")))
    counted = done.groupBy(key).agg(F.count("*").alias("claims"), F.count_if("is_failing").alias("failing"), F.count_if(F.coalesce(partly, F.lit(False))).alias("partly"))
    covered = rows.select(key, "item").distinct().join(expected.select("item").distinct(), "item", "left_semi").groupBy(key).agg(F.count("*").alias("_covered"))
    wanted = expected.select("item").distinct().agg(F.count("*").alias("_wanted"))
    told = reports.select(key).distinct().join(counted, key, "left").join(covered, key, "left").crossJoin(F.broadcast(wanted)).fillna(0, ["claims", "failing", "partly", "_covered"])
    coverage = F.when(F.col("_wanted") == 0, "no-checklist").when(F.col("_covered") == 0, "missing").when(F.col("_covered") < F.col("_wanted"), "incomplete").otherwise("complete")
    told = told.withColumn("coverage", coverage)
    bad = (F.col("failing") > 0) | (F.col("partly") > 0) | F.col("coverage").isin("missing", "incomplete")
    return told.select(key, "claims", "failing", "partly", "coverage", F.when(bad, 1).otherwise(0).alias("exit"))
