"""Token ids: exact encoding with remembered words, and a word-aligned binary table of them."""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import materialize, prepare

_WHITE = r"[\pZ\x09-\x0D\x1C-\x1F\x{85}\x{180E}]"
#: No text, or a space or line end next to other white space or at either end.
_TOUCHING = rf"\A[ \n]|\A\z|[ \n]\z|[ \n]{_WHITE}|{_WHITE}[ \n]"
_MARKS = ".,;:!?#$%&*|"
#: How byte-level models write a byte: visible ones as themselves, the others counted from U+0100.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_BYTES = {b: b if b in _SHOWN else 256 + [x for x in range(256) if x not in _SHOWN].index(b) for b in range(256)}


class _Words(dict):
    """Words and their ids; looks new words up, and remembers the short ones until there are too many."""

    def __init__(self, look, limit: int) -> None:
        self.look, self.limit = look, limit

    def __missing__(self, word: str) -> bytes:
        ids = self.look(word)
        if len(word) <= 11:
            if len(self) >= self.limit:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Texts to ids (bytes of little-endian unsigned 32-bit integers), as the tokenizers library's encode gives them for the whole text with add_special_tokens=False.

    Two families of tokenizers are known by their parts. Byte-level ones that keep spaces part a text where a character
    that isn't white space meets a space or line end, so a text in which these stand alone is the sequence of its
    words, each with what stands before it. Those that drop white space part it at every space. Other texts, texts that
    hold an added token's string, and all texts of any other tokenizer are encoded whole. A word's ids are looked up among
    remembered ones: up to `limit` words of at most 11 characters, as longer ones rarely recur. A new word of letters
    and closing marks goes straight to the library's model, anything else through the whole of the tokenizer. Byte-level
    texts that are given together are parted by Arrow, and each of their distinct words is looked up once, without its
    closing marks.
    """

    def __init__(self, path: str, limit: int = 800_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.kind = "" if any(t.normalized for t in added) else _family(json.loads(self.tokenizer.to_str()))
        self.spaced = self.kind == "spaced"
        self.added = [t.content for t in added]
        self.firsts = _Words(lambda word: self._encode([word])[0], limit)
        self.words = _Words(self._word, limit)
        self.marks = {"": b""}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """Ids of a word after a space, or of a line end and a word."""
        first = self.spaced and word[:1] == "\n"
        body = word[1:] if first else word
        letters = body.rstrip(_MARKS)
        if not letters.isalpha() or max(letters) >= "\u0250":
            return self._encode([word if first or not self.spaced else " " + word])[0]
        marks = self._marks(body[len(letters) :])
        shown = letters if letters.isascii() else letters.encode().decode("latin-1").translate(_BYTES)
        before = self._marks("\n") if first else b""
        if self.spaced and not first:
            shown = "\u0120" + shown
        return before + b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)]) + marks

    def _marks(self, marks: str) -> bytes:
        if marks not in self.marks:
            self.marks[marks] = self._encode([marks])[0]
        return self.marks[marks]

    def _closed(self, word: str) -> bytes:
        """Ids of a word after a space: its letters are remembered once, whatever marks close it."""
        letters = word.rstrip(_MARKS)
        if not letters.isalpha() or max(letters) >= "\u0250":
            return self.words[word]
        return self.words[letters] + self._marks(word[len(letters) :])

    def _one(self, text: str) -> bytes:
        if not self.kind or any(t in text for t in self.added):
            return self._encode([text])[0]
        low = text.lower()
        if any(t in low for t in self.added) or not text.isascii() and ("\u03a3" in text or "\u0130" in text or not unicodedata.is_normalized("NFC", low)):
            return self._encode([text])[0]
        return b"".join(map(self.words.__getitem__, low.replace("\n", " ").split(" ")))

    def _by_words(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of texts in which spaces and line ends stand alone."""
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        begins, coded = parts.offsets.to_numpy()[:-1], parts.values.dictionary_encode()
        at, words = np.array(coded.indices, np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        later, firsts = np.zeros(len(words), bool), [words[i] for i in at[begins].tolist()]
        later[np.delete(at, begins)] = True
        ids = [(self._closed(w) if w[-1] in _MARKS else self.words[w]) if x else b"" for w, x in zip(words, later.tolist(), strict=True)] + [self.firsts[w] for w in firsts]
        at[begins] = np.arange(len(words), len(ids))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        lengths, starts = sizes[at], (np.cumsum(sizes) - sizes)[at]
        before = np.append(0, np.cumsum(lengths))
        where = np.repeat(starts - before[:-1], lengths)
        where += np.arange(len(where))
        got = np.frombuffer(b"".join(ids), "<u4")[where]
        cuts = before[np.append(begins, len(at))].tolist()
        return (got[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.spaced:
            return list(map(self._one, texts))
        column = pa.array(texts, pa.large_string())
        whole = pc.match_substring_regex(column, _TOUCHING)
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(column, token))
        plain = column.filter(pc.invert(whole))
        others = self._by_words(plain) if len(plain) else iter(())
        return [self._encode([text])[0] if x else next(others) for text, x in zip(texts, whole.to_pylist(), strict=True)]


#: The parts by which the two families of tokenizers are known.
_SPACED = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
_DROPPED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


def _family(parts: dict) -> str:
    """spaced, dropped, or nothing for a tokenizer whose texts can only be encoded whole."""
    model = parts["model"]
    if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback") or parts.get("truncation") or parts.get("padding"):
        return ""
    own = {k: parts[k] for k in _SPACED}
    return "spaced" if own == _SPACED else "dropped" if own == _DROPPED else ""


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each tokenizer in a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def groups(texts: list[str], chars: int = 2_000_000) -> Iterator[slice]:
    """Slices of about so many characters, or one text."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


#: Ids in a 64-bit word and bits of each, by the selector in its top four bits. The last is the escape for ids of over 30 bits.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


def _windows(fits: np.ndarray, count: int) -> np.ndarray:
    """Where this and the next count - 1 all fit."""
    size = 1
    while size < count:
        step = min(size, count - size)
        fits = fits[:-step] & fits[step:]
        size += step
    return fits


def pack(ids: np.ndarray) -> np.ndarray:
    """Ids below 2^60 as 64-bit words: each word takes as many of the next ids as fit."""
    n = len(ids)
    selector = np.full(n, len(COUNTS) - 1, np.int8)
    for s in range(len(COUNTS) - 2, -1, -1):
        count, bits = int(COUNTS[s]), int(BITS[s])
        if count > n:
            break
        fits = _windows(ids < (1 << bits), count)
        if not fits.any():  # then more and smaller ids don't fit either
            break
        selector[: len(fits)][fits] = s
    steps, at, i = COUNTS[selector].astype(np.uint8).tobytes(), [], 0
    while i < n:
        at.append(i)
        i += steps[i]
    at = np.array(at, np.int64)
    chosen = selector[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        where = np.flatnonzero(chosen == s)
        begin, made = at[where], words[where]
        for j in range(int(COUNTS[s]) if BITS[s] else 0):
            made |= ids[begin + j].astype(np.uint64) << np.uint64(j * int(BITS[s]))
        words[where] = made
    return words


def unpack(words: np.ndarray) -> np.ndarray:
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[chosen]
    ends = np.cumsum(counts)
    ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(chosen):
        where = np.flatnonzero(chosen == s)
        begin, made = ends[where] - counts[where], words[where]
        for j in range(int(COUNTS[s]) if BITS[s] else 0):
            ids[begin + j] = (made >> np.uint64(j * int(BITS[s]))) & np.uint64((1 << int(BITS[s])) - 1)
    return ids


_BLOCK = "part int, block int, base long, n_ids long, doc_ids array<{kind}>, offsets array<long>, words binary"


def write_token_blocks(docs: DataFrame, tokenizer: str, end_id: int = 0, block_ids: int = 1 << 18) -> DataFrame:
    """Encodes docs in ascending doc_id order and writes the ids, in blocks of about block_ids, as a table in the shared folder.

    A row is a block: part and block give its place, base the ids before it in its part, doc_ids its documents,
    offsets where each of them begins among the block's n_ids, words the packed ids (little-endian). A block decodes
    without any other. Null text counts as empty; each document ends with end_id. Null doc_ids come first; rows of
    one doc_id are ordered by text. An empty table gives no block.
    """
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, part, block, base = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4").tobytes()
        held, doc_ids, size, doc_type = [], [], 0, None

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for x in held])
            words = pack(np.frombuffer(b"".join(held), "<u4"))
            columns = [[part], [block], [base], [int(lengths.sum())], [doc_ids], [(np.cumsum(lengths) - lengths).tolist()], [words.astype("<u8").tobytes()]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(doc_type), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "block", "base", "n_ids", "doc_ids", "offsets", "words"])

        for batch in batches:
            ids, texts, doc_type = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(0).type
            for cut in groups(texts, 4_000_000):
                for doc_id, coded in zip(ids[cut], to_ids(texts[cut]), strict=True):
                    held.append(coded + end)
                    doc_ids.append(doc_id)
                    size += len(coded) // 4 + 1
                    if size >= block_ids:
                        yield flush()
                        block, base, held, doc_ids, size = block + 1, base + size, [], [], 0
        if held:
            yield flush()

    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(encode, _BLOCK.format(kind=kind)), "token-blocks", compression="zstd")


def read_token_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document's ids decoded from its block, and the ids of all documents before it.

    Where a part begins is a running sum over one row for each part, a number that follows the cluster, not the rows.
    """
    prepare(blocks.sparkSession)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = unpack(np.frombuffer(batch.column("words")[i].as_buffer(), "<u8")).astype("<u4")
                begin, offsets = batch.column("begin")[i].as_py(), batch.column("offsets")[i].values.to_numpy()
                sizes = np.diff(np.append(offsets, len(ids)))
                parts = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.append(offsets, len(ids)).astype("<i4") * np.int32(4)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, pa.array(begin + offsets, pa.int64()), pa.array(sizes, pa.int64()), parts], ["doc_id", "start", "n_tokens", "ids"])

    rows = blocks.join(F.broadcast(begins), "part").select("doc_ids", "offsets", "words", (F.col("begin") + F.col("base")).alias("begin"))
    return rows.mapInArrow(decode, f"doc_id {kind}, start long, n_tokens long, ids binary")
