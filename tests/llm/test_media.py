import hashlib
import zlib

from pyspark.sql import functions as F

from runlens.llm import media


def test_media_is_read_back_whole(awkward, empty):
    files, chunks = media.store_media(awkward)
    assert chunks.count() == chunks.select("digest").distinct().count() > 0
    told = media.media_columns(awkward).collect()
    apart = media.features(media.read_media(files, chunks)).collect()
    assert sorted(map(str, told)) == sorted(map(str, apart)) and len(told) == awkward.count()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in awkward.collect()}
    for r in told:
        text = texts[r["doc_id"]]
        payload = text + b"\xff" * (-len(text) % 576 if text else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        values = [b - 128 for b in payload]
        mean, rms = sum(values) / len(values), (sum(v * v for v in values) / len(values)) ** 0.5
        turns = sum((x >= 0) != (y >= 0) for x, y in zip(values, values[1:], strict=False)) / max(1, len(values) - 1)
        assert r["feature"] == f"mean={mean:.4f};rms={rms:.4f};zcr={turns:.4f}"
        assert (r["media_bytes"], r["media_sha256"]) == (len(payload) + 44, hashlib.sha256(media.wav(payload)).hexdigest())
    assert media.media_columns(empty).count() == 0


def test_a_chunk_of_very_many_places(spark):
    """Boilerplate texts have one chunk, whose places are dealt over several joins."""
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.repeat(F.lit("boilerplate "), 200)).otherwise(F.col("id").cast("string")).alias("text"))
    files, chunks = media.store_media(docs)
    assert chunks.count() < 12_000
    told = media.read_media(files, chunks, describe=True)
    assert told.count() == 12_000 and told.where("doc_id % 3 > 0").select("payload_sha256").distinct().count() == 1 and told.select("doc_id").distinct().count() == 12_000


def test_cuts_depend_on_the_file_alone():
    a, b = bytes(range(256)) * 200, b"other" * 9000
    assert media.cut_points([a, b, a])[0] == media.cut_points([a])[0] == media.cut_points([b, a])[1]
    for f, ends in zip((a, b), media.cut_points([a, b]), strict=True):
        assert ends[-1] == len(f) and all(x < y <= x + 16384 for x, y in zip([0, *ends], ends, strict=False))
