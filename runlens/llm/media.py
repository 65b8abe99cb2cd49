"""Media columns: payloads as 8-bit audio, cut into content-defined chunks that are stored once each."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import materialize, prepare, salted_join, utf8
from runlens.llm.shingles import mix

UNIT, FILL = 576, 255
RATE = 8000
#: A random 32-bit value for each byte, fixed by its seed.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
#: Chunk digests whose first bits another chunk has too are looked up in the chunk table; the filter has this many bits, whatever the corpus holds.
_FILTER_BITS = 1 << 24


def payload_of(text: bytes) -> bytes:
    """The text with bytes 255 up to a positive multiple of 576."""
    return text + bytes([FILL]) * (-len(text) % UNIT if text else UNIT)


def wav(payload: bytes) -> bytes:
    """An 8-bit mono PCM file: each byte is a sample."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def samples_of(media: bytes) -> bytes:
    """The samples of a file that wav made; anything else is an error."""
    riff, size, kind, fmt, n, form, channels, _, _, block, bits, data, length = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (riff, kind, fmt, n, form, channels, block, bits, data) != (b"RIFF", b"WAVE", b"fmt ", 16, 1, 1, 1, 8, b"data") or size != len(media) - 8 or length != len(media) - 44:
        raise ValueError("not an 8-bit mono PCM file of this store")
    return media[44:]


def cut_points(files: list[bytes], least: int = 1024, mask_bits: int = 12, most: int = 16384) -> list[list[int]]:
    """Ends of each file's chunks: where the gear hash of the last 32 bytes has mask_bits zero bits, at least `least` and at most `most` bytes apart.

    The hash of 32 bytes is built from those of 16, 8, 4, 2 and 1 bytes, for all files in one pass; no cut comes
    within a file's first 32 bytes, so a file's cuts depend on nothing else.
    """
    whole = np.frombuffer(b"".join(files), np.uint8)
    h = GEAR[whole]
    for step in (1, 2, 4, 8, 16):
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint32(step)
        h = longer
    marks = np.flatnonzero(h >> np.uint32(32 - mask_bits) == 0) + 1
    out, begin = [], 0
    for f in files:
        end, at, ends = begin + len(f), begin, []
        own = marks[np.searchsorted(marks, begin) : np.searchsorted(marks, end)].tolist()
        for m in own:
            while m - at > most:
                at += most
                ends.append(at - begin)
            if m - at >= least:
                at = m
                ends.append(at - begin)
        while end - at > most:
            at += most
            ends.append(at - begin)
        if at < end or not ends:
            ends.append(end - begin)
        out.append(ends)
        begin = end
    return out


def _chunked(files: list[bytes]) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    """(number, chunks, digests) of each file, about 2 MB at a time."""
    begin = size = 0
    for end, f in enumerate(files, 1):
        size += len(f)
        if size < 2_000_000 and end < len(files):
            continue
        for i, ends in enumerate(cut_points(files[begin:end]), begin):
            chunks = [files[i][a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield i, chunks, [hashlib.blake2b(c, digest_size=16).digest() for c in chunks]
        begin, size = end, 0


def _slices(batch: pa.RecordBatch, sizes: list[int | None], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes by the rows' sizes, so that a worker holds no more at a time than that and a row."""
    begin = size = 0
    for end, n in enumerate(sizes, 1):
        size += n or 0
        if size >= most or end == len(sizes):
            yield batch.slice(begin, end - begin)
            begin, size = end, 0


def _slot(digest: bytes) -> int:
    return int.from_bytes(digest[:4], "little") % _FILTER_BITS


def store_media(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> (files, chunks), two tables in the shared folder.

    files has doc_id, n_bytes of the text, digests (the file's ordered chunk list), and own: the zlib-packed chunks
    that no other place can hold, null where the chunk is in chunks (digest, data), once however often it occurs.
    Whether a digest may occur twice is read from a filter of fixed size over the digests that do occur twice; a
    chunk that it takes for one of them lands in chunks like those, so the filter only ever saves shuffling.
    """
    spark = docs.sparkSession
    prepare(spark)
    own = docs.select("doc_id", F.col("text").cast("string"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in _slices(b, pc.binary_length(b.column(0)).to_pylist())):
            found = [d for _, _, digests in _chunked([wav(payload_of(t)) for t in utf8(batch.column(0))]) for d in digests]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([_slot(d) for d in found], pa.int32())], ["digest", "slot"])

    every = own.select("text").mapInArrow(digest, "digest binary, slot int")
    twice = every.groupBy("digest", "slot").agg(F.count("*").alias("n")).where("n > 1").select((F.col("slot") / 64).cast("int").alias("word"), F.lit(1).cast("long").alias("one"), (F.col("slot") % 64).alias("bit"))
    words = twice.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits")).toArrow()
    table = np.zeros(_FILTER_BITS // 64, np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.int64).view(np.uint64)
    repeats = spark.sparkContext.broadcast(np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = repeats.value
        names = ["doc_id", "n_bytes", "digests", "own", "digest", "data"]
        kinds = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.binary(), pa.binary()]
        sent: set[bytes] = set()
        for batch in (s for b in batches for s in _slices(b, pc.binary_length(b.column(1)).to_pylist())):
            texts, put = utf8(batch.column(1)), {}
            if len(sent) > 100_000:
                sent.clear()
            sizes, lists, kept = [], [], []
            for i, chunks, digests in _chunked([wav(payload_of(t)) for t in texts]):
                sizes.append(len(texts[i]))
                lists.append(digests)
                kept.append([None if shared[_slot(d)] else zlib.compress(c, 6) for c, d in zip(chunks, digests, strict=True)])
                put.update((d, c) for c, d in zip(chunks, digests, strict=True) if shared[_slot(d)] and d not in sent)
                sent.update(put)
            n, m = len(texts), len(put)
            files = [pa.array(x, k) for x, k in zip((sizes, lists, kept, [None] * n, [None] * n), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *files], names)
            if m:
                data = [[None] * m, [None] * m, [None] * m, list(put), [zlib.compress(c, 6) for c in put.values()]]
                yield pa.RecordBatch.from_arrays([pa.nulls(m, batch.column(0).type), *(pa.array(x, k) for x, k in zip(data, kinds, strict=True))], names)

    laid = materialize(own.mapInArrow(lay, f"doc_id {kind}, n_bytes long, digests array<binary>, own array<binary>, digest binary, data binary"), "media", compression="uncompressed")
    files = laid.where("digest IS NULL").select("doc_id", "n_bytes", "digests", "own")
    chunks = laid.where("digest IS NOT NULL").groupBy("digest").agg(F.first("data").alias("data"))
    return files, materialize(chunks, "media-chunks", compression="uncompressed")


_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _described(files: list[bytes]) -> list[pa.Array]:
    """The columns of _FEATURES."""
    rows = []
    for file in files:
        payload = samples_of(file)
        x = np.frombuffer(payload, np.uint8)
        n, high = len(x), x >= 128
        counts = np.bincount(x, minlength=256).astype(np.int64)
        values = np.arange(256) - 128
        mean, power = int(counts @ values) / n, int(counts @ values**2) / n
        rows.append((n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), f"mean={mean:.4f};rms={power**0.5:.4f};zcr={int((high[1:] != high[:-1]).sum()) / max(1, n - 1):.4f}"))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 6, kinds, strict=True)]


def read_media(files: DataFrame, chunks: DataFrame, describe: bool = False) -> DataFrame:
    """(doc_id, n_bytes, media): each file put together from its chunk list, every chunk checked against its digest.

    Files that have all their chunks need no shuffle; the others' missing ones come by a join on the digest, in which
    chunks of very many places are dealt over several tasks. Rows of one doc_id with the same chunks are told apart no
    further: each gets its file. With describe, in place of media what features adds to it, computed where the file is put together.
    """
    prepare(files.sparkSession)
    kind = files.schema["doc_id"].dataType.simpleString()
    told = _FEATURES if describe else "media binary"
    names = ["doc_id", "n_bytes", *(c.split()[0] for c in told.split(", "))]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in _slices(b, b.column(1).to_pylist())):
            made = []
            for digests, own, fetched in zip(*(batch.column(c).to_pylist() for c in ("digests", "own", "fetched")), strict=True):
                got = {f["place"]: f["data"] for f in fetched or ()}
                parts = [zlib.decompress(got[i] if o is None else o) for i, o in enumerate(own)]
                if any(hashlib.blake2b(p, digest_size=16).digest() != d for p, d in zip(parts, digests, strict=True)):
                    raise ValueError("a chunk differs from its digest")
                made.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(_described(made) if describe else [pa.array(made, pa.binary())])], names)

    whole = files.where(~F.exists("own", lambda c: c.isNull())).withColumn("fetched", F.expr("cast(null AS array<struct<place:int,data:binary>>)"))
    parted = files.where(F.exists("own", lambda c: c.isNull())).withColumn("row", F.struct("doc_id", "n_bytes", F.xxhash64("digests"), F.xxhash64(F.reverse("digests"))))
    places = parted.select("row", F.posexplode(F.arrays_zip("digests", "own")).alias("place", "c")).where("c.own IS NULL").select("row", "place", F.col("c.digests").alias("digest")).distinct()
    places = materialize(places, "media-places")
    counts = materialize(places.groupBy("digest").agg(F.count("*").alias("n")), "media-counts")
    fetched = salted_join(places, chunks, "digest", counts, ["row", "place"], per=5_000).groupBy("row").agg(F.collect_list(F.struct("place", "data")).alias("fetched"))
    joined = parted.join(fetched, parted["row"].eqNullSafe(fetched["row"])).select("doc_id", "n_bytes", "digests", "own", "fetched")
    return whole.unionByName(joined).select("doc_id", "n_bytes", "digests", "own", "fetched").mapInArrow(build, f"doc_id {kind}, n_bytes long, {told}")


def features(media: DataFrame) -> DataFrame:
    """In place of media: size and sha256 of the payload (the samples), the crc32 of its last 32, size and sha256 of the file, and feature: mean, root mean square and share of sign changes of the samples.

    Samples stand for values from -128 to 127 around the middle 128.
    """
    prepare(media.sparkSession)
    kind = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", *(c.split()[0] for c in _FEATURES.split(", "))]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in _slices(b, b.column(1).to_pylist())):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_described(batch.column(2).to_pylist())], names)

    return media.mapInArrow(tell, f"doc_id {kind}, n_bytes long, {_FEATURES}")


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every text as media, reads it back and describes it: one row for each row of docs (doc_id, text).

    Null text counts as empty: a payload of 576 fill bytes. Equal texts give equal rows but for doc_id; repeated rows
    give a row each; an empty table gives an empty one; other columns are left out.
    """
    files, chunks = store_media(docs)
    return read_media(files, chunks, describe=True)
