"""Line dedup: lines that recur in several documents stay in one of them only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import materialize, prepare, salted_join, utf8

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLANK = b" \t\n\x0b\x0c\r"


def line_keys(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """One row (doc_id, version, pos, key) for each line whose key has min_chars code points; version tells apart texts of one doc_id.

    A line's key is the line without blanks at its ends and with A-Z in lower case, here as a 128-bit hash.
    """
    prepare(docs.sparkSession)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, found = [], [], []
            for i, text in enumerate(utf8(batch.column(2))):
                for pos, line in enumerate(text.translate(_LOWER).split(b"\n")):
                    key = line.strip(_BLANK)
                    if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                        row.append(i)
                        at.append(pos)
                        found.append(xxhash.xxh3_128_digest(key))
            ids = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(ids), batch.column(1).take(ids), pa.array(at, pa.int32()), pa.array(found, pa.binary())], ["doc_id", "version", "pos", "key"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("version"), "text").mapInArrow(keys, f"doc_id {kind}, version long, pos int, key binary")


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, version, dropped): positions of the lines whose key is in min_docs documents or more and in a larger doc_id too.

    Distinct documents are counted by (key, doc_id) first, so a line that all documents share never meets in one
    task. The join back to lines deals such a key over salts for the same reason.
    """
    lines = materialize(line_keys(docs, min_chars), "line-keys")
    counted = lines.groupBy("key", "doc_id").agg(F.count("*").alias("c")).groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper"), F.sum("c").alias("n"))
    common = materialize(counted.where(F.col("docs") >= min_docs).select("key", "keeper", "n"), "common-lines")
    found = salted_join(lines, common.select("key", "keeper"), "key", common, ["doc_id", "pos"]).where("doc_id <> keeper")
    return found.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("dropped"))


def _kept(text: Column, dropped: Column) -> Column:
    lines = F.split(text, "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    return F.when(dropped.isNull(), text).otherwise(F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with text cut down to the lines that stay, and n_lines (before), n_dropped.

    Keys (see line_keys) of at least min_chars code points that at least min_docs documents hold lose all their lines
    but for those in the largest doc_id with the key. Null text: one empty line, and text becomes empty. Rows without
    doc_id count for nothing and stay as they are. Repeated rows of a doc_id are one document: all of them keep or lose
    the line alike. An empty table gives an empty one. Other columns pass through; n_lines and n_dropped are replaced.
    """
    drops = dropped_lines(docs, min_chars, min_docs).select(F.col("doc_id").alias("_drop_id"), F.col("version").alias("_drop_version"), F.col("dropped").alias("_dropped"))
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    joined = docs.join(drops, (docs["doc_id"] == drops["_drop_id"]) & (F.xxhash64(docs["text"]) == drops["_drop_version"]), "left")
    text = F.coalesce(docs["text"], F.lit(""))
    out = {c: docs[c] for c in rest} | {"text": _kept(text, F.col("_dropped")), "n_lines": F.size(F.split(text, "\n", -1)).cast("long"), "n_dropped": F.coalesce(F.size("_dropped"), F.lit(0)).cast("long")}
    order = [*(c for c in docs.columns if c in out and c not in ("n_lines", "n_dropped")), "n_lines", "n_dropped"]
    return joined.select(*[out[c].alias(c) for c in order])
