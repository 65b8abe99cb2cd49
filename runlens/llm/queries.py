"""The registered queries of this folder: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import chat, decontam, langid, licenses, lines, media, minhash, packing, phrases, secrets, sharding, spelling, tokens
from runlens.llm.common import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = langid.learn(docs.where(~held_out).select("doc_id", "lang", "text"))
    return langid.identify(docs.select("doc_id", "text"), model).withColumn("held_out", held_out)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


_OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  WHERE 100 * least(p.n, q.n) >= 85 * greatest(p.n, q.n)
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), copies AS (SELECT doc_id, list_sort(list(s)) AS k FROM sets GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) OVER (PARTITION BY k) AS c FROM copies)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept, coalesce(any_value(c), 1) AS n_copies
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN sizes USING (doc_id) LEFT JOIN counted USING (doc_id) GROUP BY d.doc_id
"""


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = tokens.write_token_blocks(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.read_token_blocks(blocks).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = chat.parse_formatted(materialize(chat.format_chats(chat.as_reply_trees(rows)), "formatted-chats"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) AS told,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length('<|turn|><|text|><|end|>') + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS chars
  FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM whole
"""


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan_secrets(docs, secrets.learn(docs))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_OP8_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM split
), common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, pos, line, coalesce(doc_id <> keeper, false) AS dropped FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


#: The crc32 goes over the UTF-8 bytes of the id, which are digits, and of letters up to U+00FF.
_OP11_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents
), each AS (SELECT doc_id, w, count(*) AS c FROM runs WHERE length(w) >= 5 GROUP BY doc_id, w),
hashed AS (
  SELECT w, c, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 + (unicode(x) >> 6))::BIGINT, (128 + (unicode(x) & 63))::BIGINT] END))),
    lambda h, b: xor(h >> 8, t[1 + (xor(h, b) & 255)])), 4294967295) AS h FROM each, crc
), told AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM told WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cuts AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT DISTINCT x.word AS word, y.word AS other, y.n AS m FROM cuts x JOIN cuts y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word AND length(x.word) = length(y.word)
  UNION SELECT x.word, y.word, y.n FROM cuts x JOIN words y ON x.rest = y.word
  UNION SELECT y.word, x.word, x.n FROM cuts x JOIN words y ON x.rest = y.word
), near AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS best, max(m) AS m FROM pairs GROUP BY word),
forms AS (SELECT word, CASE WHEN m >= 2 * n THEN best END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words LEFT JOIN near USING (word)),
chain AS (
  SELECT word, word AS root, 0 AS k FROM forms
  UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
), roots AS (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_files(spark, f"{sf_dir}/documents.parquet", shards=8)
    content = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return placed.select("doc_id", (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(_table(spark, sf_dir, "documents"))


#: Words carry their language, so that all joins are on words alone.
_OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (SELECT list_transform(list_filter(string_split_regex(piece, '[ \x09]+'), lambda x: x <> ''), lambda x: lang || chr(9) || x) AS w FROM pieces),
u AS (SELECT w, count(*)::HUGEINT AS c FROM (SELECT unnest(w) AS w FROM split) GROUP BY w),
b AS (SELECT x, y, count(*)::HUGEINT AS c FROM (SELECT unnest(w[:-2]) AS x, unnest(w[2:]) AS y FROM split WHERE len(w) > 1) GROUP BY x, y HAVING count(*) >= 10),
t AS (SELECT x, y, z, count(*)::HUGEINT AS c FROM (SELECT unnest(w[:-3]) AS x, unnest(w[2:-2]) AS y, unnest(w[3:]) AS z FROM split WHERE len(w) > 2) GROUP BY x, y, z HAVING count(*) >= 10),
total AS (SELECT split_part(w, chr(9), 1) AS lang, sum(c) AS n FROM u GROUP BY 1),
cuts AS (
  SELECT x, y, NULL AS z, b.c AS a, 1 AS cut, u1.c AS l, u2.c AS r FROM b JOIN u u1 ON u1.w = x JOIN u u2 ON u2.w = y
  UNION ALL SELECT t.x, t.y, t.z, t.c, 1, u.c, b.c FROM t JOIN u ON u.w = t.x JOIN b ON b.x = t.y AND b.y = t.z
  UNION ALL SELECT t.x, t.y, t.z, t.c, 2, b.c, u.c FROM t JOIN u ON u.w = t.z JOIN b ON b.x = t.x AND b.y = t.y
), scored AS (SELECT *, (1000000 * a * a) // (l * r) AS score FROM cuts),
candidates AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY x, y, z ORDER BY score, cut) = 1),
longer AS (SELECT x, y, max(c) AS m FROM (SELECT x, y, c FROM t UNION ALL SELECT y, z, c FROM t) GROUP BY x, y),
kept AS (
  SELECT split_part(c.x, chr(9), 1) AS lang, concat_ws(' ', split_part(c.x, chr(9), 2), split_part(c.y, chr(9), 2), split_part(c.z, chr(9), 2)) AS phrase, a, l, r, score
  FROM candidates c LEFT JOIN longer g ON g.x = c.x AND g.y = c.y WHERE c.z IS NOT NULL OR m IS NULL OR 100 * m < 50 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_minhash_near_dedup, op3_token_output, op4_decontamination, op5_chat_formatting, op6_media_columns, op7_secret_scan, op8_line_dedup, op9_packing, op10_license_scan, op11_spelling_variants, op12_sharding, op13_phrase_mining)}


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_near_dedup": _OP2_SQL, "op5_chat_formatting": _OP5_SQL, "op8_line_dedup": _OP8_SQL, "op11_spelling_variants": _OP11_SQL, "op13_phrase_mining": _OP13_SQL}
