"""Packing: documents as token sequences of one length, by harmonic classes of piece lengths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import prepare
from runlens.llm.tokens import encoder, groups

#: (document's id and number of ids, start, ids)
Piece = tuple[tuple, int, bytes]


class Harmonic:
    """Class k holds pieces of capacity/(k+1) < length <= capacity/k, and a bin of class k takes exactly k of them, so it wastes less than 1/(k+1).

    A document of up to capacity/2 ids is one piece, unless it fills another bin up. Of a longer one, whole
    sequences are cut off, and what is left over capacity/2, which would have a bin of class 1 alone, waits as filler:
    the room that k pieces leave in a bin goes to ids cut off it, and what then has a lower class is a piece of that. Without filler
    the largest waiting piece is cut for the room, so a bin wastes nothing while anything waits. At most `fillers`
    documents wait as filler; beyond that the first is cut in half a capacity and a rest. Bins are filled with no regard to other
    workers; a worker holds fewer than k pieces of each class.
    """

    def __init__(self, capacity: int = 2048, fillers: int = 256) -> None:
        if capacity & (capacity - 1) or capacity < 2:
            raise ValueError("capacity must be a power of two, and at least 2")
        self.capacity, self.fillers = capacity, fillers
        self.waiting: dict[int, list[Piece]] = {}

    def add(self, doc: tuple, ids: bytes) -> Iterator[list[Piece]]:
        """The bins that this document's pieces fill."""
        whole = 4 * self.capacity
        for start in range(0, len(ids) - whole + 1, whole):
            yield [(doc, start // 4, ids[start : start + whole])]
        start = len(ids) // whole * whole
        todo = [(doc, start // 4, ids[start:])] if start < len(ids) else []
        while todo:
            piece = todo.pop()
            k = whole // len(piece[2])
            held = self.waiting.setdefault(k, [])
            held.append(piece)
            if k == 1 and len(held) > self.fillers:
                doc, start, ids = held.pop(0)
                todo += [(doc, start, ids[: whole // 2]), (doc, start + self.capacity // 2, ids[whole // 2 :])]
            elif k > 1 and len(held) == k:
                full = self.waiting.pop(k)
                rest = self._fill(full)
                yield full
                todo += rest

    def _fill(self, full: list[Piece]) -> list[Piece]:
        """Takes ids for the room left in a bin from the largest pieces that wait; what is left of the last of them."""
        room = 4 * self.capacity - sum(len(p[2]) for p in full)
        while room and self.waiting:
            k = min(self.waiting)
            doc, start, ids = self.waiting[k].pop()
            if not self.waiting[k]:
                del self.waiting[k]
            full.append((doc, start, ids[:room]))
            if len(ids) > room:
                return [(doc, start + room // 4, ids[room:])]
            room -= len(ids)
        return []

    def rest(self) -> Iterator[list[Piece]]:
        """What still waits, one class after another, cut where a bin is full; the last ids go to bins of powers of two."""
        left = sum(len(p[2]) // 4 for held in self.waiting.values() for p in held)
        room, size, full = 0, 0, []
        for _, held in sorted(self.waiting.items()):
            for doc, start, ids in held:
                while ids:
                    if not room:
                        room = size = min(self.capacity, 1 << (left.bit_length() - 1))
                    taken = ids[: 4 * room]
                    full.append((doc, start, taken))
                    n = len(taken) // 4
                    start, ids, room, left = start + n, ids[4 * n :], room - n, left - n
                    if not room:
                        yield full
                        full = []
        self.waiting = {}


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, fillers: int = 256) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Each document's ids and end_id lie in its pieces once each; a sequence's pieces follow one another from offset 0,
    and it holds at most capacity ids. Sequences are meant to be padded to capacity unless they hold a power of two.
    Null text counts as empty: its piece is the end_id. Repeated rows are packed each; an empty table gives no piece;
    other columns are left out. Each input partition is packed by itself: sequence_id is its number and a count.
    """
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, harmonic, sequence = encoder(tokenizer), Harmonic(capacity, fillers), TaskContext.get().partitionId() << 40
        end = end_id.to_bytes(4, "little")
        doc_type, out = None, []

        def put(full: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for (doc_id, tokens), start, ids in full:
                out.append((doc_id, start, len(ids) // 4, ids, tokens, sequence, offset))
                offset += len(ids) // 4
            sequence += 1

        def flush() -> pa.RecordBatch:
            types = [doc_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            out.clear()
            return made

        for batch in batches:
            doc_ids, texts, doc_type = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(0).type
            for cut in groups(texts):
                for doc_id, coded in zip(doc_ids[cut], to_ids(texts[cut]), strict=True):
                    ids = coded + end
                    for full in harmonic.add((doc_id, len(ids) // 4), ids):
                        put(full)
                if out:
                    yield flush()
        for full in harmonic.rest():
            put(full)
        if out:
            yield flush()

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(pack, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
