"""Spelling variants: words that differ by one inserted, deleted or replaced letter, found by integer keys of their deletions.

The key of a word without its i-th letter is put together from the polynomial hashes of what stands before and behind it, so
that all keys of many words are a few array operations. Keys are dealt by their highest bits, sorted in each part, and what shares a key
is compared as strings. Words that differ in one place share that deletion: each learns the best of all others from
the first two of the group, so no pairs are made.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import discard, materialize, prepare, utf8
from runlens.llm.shingles import mix

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Modulo 2^64; odd, so that it has an inverse.
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
#: Words that a task counts before it sends them on.
MOST_WORDS = 200_000
WHOLE, DELETED, REPLACED = 0, 1, 2


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, kind, place, key): each word's own key, one for each deletion that gives another word, and one for each place whose letter may be another.

    With S the running sum of letter * BASE^index over all words, a word's prefix and suffix are differences of S; divided by
    BASE^begin, and once more behind the deleted letter, they add up to the hash of the word without it.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    begins = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(words)), sizes)
    sums = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(mix(letters + np.uint64(1)) * _powers(BASE, len(letters)), dtype=np.uint64, out=sums[1:])
    back = _powers(INVERSE, len(letters) + 1)[begins]
    begin, end = begins[row], (begins + sizes)[row]
    at = np.arange(len(letters))
    salt = lambda n: n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = mix((sums[begins + sizes] - sums[begins]) * back + salt(sizes))
    less = (sums[at] - sums[begin] + (sums[end] - sums[at + 1]) * np.uint64(INVERSE)) * back[row] + salt(sizes[row] - 1)
    place = at - begin
    first = (place == 0) | (letters != np.roll(letters, 1))  # a run's letters give one and the same deletion
    replaced = mix(mix(less) + salt(place + 1))
    rows = np.concatenate([np.arange(len(words)), row[first], row])
    kinds = np.repeat(np.array([WHOLE, DELETED, REPLACED], np.int8), [len(words), int(first.sum()), len(row)])
    places = np.concatenate([np.zeros(len(words), np.int64), place[first], place])
    return rows, kinds, places.astype(np.int32), np.concatenate([whole, mix(less[first]), replaced])


def count_words(docs: DataFrame, least_chars: int = 5, least: int = 3, typo: int = 97) -> DataFrame:
    """docs (doc_id, text) -> (id, word, n), a written table: words of at least so many code points that stand at least so often.

    Words are the longest runs of A-Z, a-z and U+00C0 to U+00FF, A-Z as a-z. With h the crc32 of `<doc_id>:<run>`, a run
    loses its code point h % length if typo divides h, before it is counted; typo=0 leaves all as they are.
    """
    prepare(docs.sparkSession)
    run = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % least_chars)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                begin = zlib.crc32(name.encode() + b":")
                for word, n in Counter(run.findall(text.translate(_LOWER))).items():
                    h = zlib.crc32(word, begin) if typo else 1
                    if typo and h % typo == 0:
                        whole = word.decode()
                        i = h % len(whole)
                        found[(whole[:i] + whole[i + 1 :]).encode()] += n
                    else:
                        found[word] += n
                if len(found) > MOST_WORDS:
                    yield told()
                    found.clear()
        yield told()

    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    each = docs.where("text IS NOT NULL").select(name, "text").mapInArrow(counts, "word binary, n long")
    counted = each.groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n")).where((F.col("n") >= least) & (F.char_length("word") >= least_chars))
    return materialize(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words")


def shared_keys(words: DataFrame, keys_per_part: int = 1_000_000) -> DataFrame:
    """words (id, word) -> (key, kind, place, id) of the keys that may tell neighbours: a deletion that is a word, or two words that differ in one place.

    Radix-partitioned: the highest bits of a key are its partition's number, and each partition is sorted by itself. A
    key's rows are no more than letters can stand in a word's places, whatever the corpus holds.
    """
    prepare(words.sparkSession)
    letters = words.agg(F.coalesce(F.sum(2 * F.char_length("word") + 1), F.lit(0))).first()[0]
    bits = min(20, max(0, (letters // keys_per_part).bit_length()))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(np.cumsum([0, *map(len, texts)]) // 500_000)) + 1
            for part in np.split(np.arange(len(texts)), cuts):
                if len(part):
                    row, kind, place, key = deletion_keys([texts[i] for i in part])
                    radix = (key >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(key), np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(radix), pa.array(key.view(np.int64)), pa.array(kind), pa.array(place), pa.array(ids[part][row])], ["radix", "key", "kind", "place", "id"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        key, kind, place, ids = (table.column(c).to_numpy() for c in ("key", "kind", "place", "id"))
        order = np.lexsort((kind, key))
        key, kind = key[order], kind[order]
        starts = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
        of = lambda k: np.bincount(run, kind == k, len(starts))
        deleted, replaced = (of(WHOLE) > 0) & (of(DELETED) > 0), of(REPLACED) > 1
        kept = np.where(kind == REPLACED, replaced[run], deleted[run])
        yield pa.RecordBatch.from_arrays([pa.array(key[kept]), pa.array(kind[kept]), pa.array(place[order][kept]), pa.array(ids[order][kept])], ["key", "kind", "place", "id"])

    made = words.select("id", "word").mapInArrow(keys, "radix int, key long, kind byte, place int, id long")
    return made.repartitionById(1 << bits, F.col("radix")).select("key", "kind", "place", "id").mapInArrow(shared, "key long, kind byte, place int, id long")


def neighbours(words: DataFrame) -> DataFrame:
    """words (id, word, n), a written table -> (word, n_near, best): how many words are one edit away, and the most frequent of them, as (its -n, its word)."""
    rows = shared_keys(words).join(words, "id")
    rest = F.concat(F.substring("word", F.lit(1), F.col("place")), F.substring("word", F.col("place") + 2, F.char_length("word")))
    rows = materialize(rows.select("key", F.when(F.col("kind") == WHOLE, F.col("word")).otherwise(rest).alias("rest"), "kind", "place", "word", "n"), "spelling-groups")
    self = F.struct((-F.col("n")).alias("n"), F.col("word").alias("word"))

    # Strings decide: groups are of one key and one rest, so that words whose keys happen to be alike stay apart.
    group = Window.partitionBy("key", "rest", "place")
    ordered = group.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one, two = F.first(self).over(ordered), F.nth_value(self, 2).over(ordered)
    replaced = rows.where(F.col("kind") == REPLACED).select("word", (F.count("*").over(group) - 1).alias("n_near"), F.when(one["word"] == F.col("word"), two).otherwise(one).alias("best")).where("n_near > 0")

    short = rows.where(F.col("kind") == WHOLE).select(F.col("key").alias("_key"), F.col("word").alias("_word"), F.struct((-F.col("n")).alias("n"), F.col("word").alias("word")).alias("_short"))
    met = rows.where(F.col("kind") == DELETED).join(short, (F.col("key") == F.col("_key")) & (F.col("rest") == F.col("_word")))
    longer = met.groupBy(F.col("_word").alias("word")).agg(F.count("*").alias("n_near"), F.min(self).alias("best"))
    told = replaced.union(longer).union(met.select("word", F.lit(1).cast("long"), "_short"))
    return told.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def spelling_variants(docs: DataFrame, least_chars: int = 5, least: int = 3, typo: int = 97, times: int = 2) -> DataFrame:
    """docs (doc_id, text) -> (word, form, root, n, n_near, form_n): a row for each word of count_words.

    n_near counts the words one inserted, deleted or replaced code point away; form is the one with the largest n (ties: the
    smallest in code-point order) if that is `times` the word's n or more, form_n its n; root is where the forms of forms end, the word itself if it
    has none. Null and empty texts have no words, null doc_id counts as the empty string; rows that repeat count each time, other columns
    are not looked at, no rows give no rows. A text is taken as a whole, about six bytes of memory for each of its bytes.
    """
    words = count_words(docs, least_chars, least, typo)
    near = neighbours(words)
    has = F.col("best.n") * -1 >= times * F.col("n")
    told = words.join(near, "word", "left").select("word", F.when(has, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, -F.col("best.n")).alias("form_n"))
    told = materialize(told, "spelling-forms")
    roots = _roots(told.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    out = materialize(told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "spelling-variants")
    discard(words, told, roots)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) with each root's own root put in its place until none has one: a step doubles the length of the chains it follows.

    A form stands at least twice as often as its word, so chains have no circle and are no longer than the binary digits of a count.
    """
    now = materialize(forms, "spelling-roots")
    while True:
        upper = now.select(F.col("word").alias("_at"), F.col("root").alias("_up"))
        after = materialize(now.select("word", "root").join(upper, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")), "spelling-roots")
        discard(now)
        now = after
        if now.where("moved").isEmpty():
            return now
