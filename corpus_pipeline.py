"""Documents to training sequences: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
docs has doc_id, text, lang and n_chars at least; stages but the last return its columns, whatever they are called, and
pass on those that they have no part in. All stages take nulls in any column, empty and very long texts, repeated rows
and empty tables, which give empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import decontam, langid, lines, minhash, packing
from runlens.llm.common import discard, materialize, settled


def _numbered(docs: DataFrame, *own: str) -> DataFrame:
    """docs with its columns but for those that an operator reads named by their numbers, so that none can clash with a column of the operator's."""
    return docs.select(*[docs[c].alias(c if c in own else f"_{i}") for i, c in enumerate(docs.columns)])


def _named(told: DataFrame, docs: DataFrame, *own: str, **changed: F.Column) -> DataFrame:
    """The columns of docs back from _numbered, with some changed."""
    return told.select(*[changed.get(c, F.col(c if c in own else f"_{i}")).alias(c) for i, c in enumerate(docs.columns)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects, and sets lang to the language found.

    Rejected are null texts, texts without a letter, and those that no language's model takes for its own. Ties between
    languages go to the first by name; repeated rows are judged alike. Without any labelled text, lang stays as it is and
    only texts without a letter go. n_chars and rows without doc_id stay as they are.
    """
    model = langid.learn(docs.select("lang", "text"))
    rows = _numbered(docs, "text")
    judged = langid.identify(rows, model, rows.columns).where("NOT rejected")
    return _named(judged, docs, "text") if model is None else _named(judged, docs, "text", lang=F.col("lang_pred"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that other documents keep; n_chars follows the text.

    Null text becomes empty, and a document all of whose lines go stays with an empty text. Of documents that share a
    line the largest doc_id keeps it; rows without doc_id neither count nor change; repeated rows are one document.
    """
    cut = lines.dedup_lines(_numbered(docs, "doc_id", "text"))
    return _named(cut, docs, "doc_id", "text", n_chars=F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, 0.8): that of the smallest doc_id.

    Null texts and those without a word are like nothing and stay; rows without doc_id stay. Texts of one doc_id are
    judged each. Of repeated rows with one doc_id and text the first by lang, source and n_chars stays, nulls first.
    """
    rows = _numbered(docs, "doc_id", "text").withColumn("version", F.xxhash64("text"))
    told = minhash.near_duplicates(rows, keep=["version"]).where("n_shingles > 0 AND doc_id IS NOT NULL")
    told = told.groupBy(F.col("doc_id").alias("told_id"), F.col("version").alias("told_version")).agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n"))
    told = materialize(told.where("NOT kept OR n > 1"), "near-copies")
    left = rows.join(told, (F.col("doc_id") == F.col("told_id")) & (F.col("version") == F.col("told_version")), "left").where("kept IS NULL OR kept")
    numbered = _numbered(docs, "doc_id", "text").columns
    order = F.struct(*[F.col(f"_{docs.columns.index(c)}") for c in ("lang", "source", "n_chars") if c in docs.columns], F.to_json(F.struct(*numbered)))
    once = left.where("n > 1").groupBy("doc_id", "version").agg(F.min_by(F.struct(*numbered), order).alias("row")).select("row.*")
    return _named(left.where("n IS NULL OR n = 1").select(*numbered).unionByName(once), docs, "doc_id", "text")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, exactly or within its edit budget.

    All rows of a doc_id go if one of them holds an item; null and empty texts hold none; rows without doc_id stay.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, with their ids, in sequences of at most 2048 tokens; null text counts as empty, repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]
#: No SQL: language ID, decontamination and packing can't be expressed in it; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep. A stage's table is deleted when the next one's is written, so only the last stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(spark, f"stage-{name}", lambda: stage(spark, docs, sf_dir))  # noqa: B023
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
