"""The corpus pipeline: five stages over documents, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import decontam, jaccard, langid, packing, queries, store, substring


def _apart(docs: DataFrame, *taken: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns whose names a stage needs for itself renamed, and the columns that give the old names back."""
    names, used = {}, {c.lower() for c in docs.columns} | {t.lower() for t in taken}
    for c in docs.columns:
        names[c] = c
        if c.lower() in {t.lower() for t in taken}:
            names[c] = next(f"{c}_{i}" for i in range(len(used) + 1) if f"{c}_{i}".lower() not in used)
            used.add(names[c].lower())
    return docs.withColumnsRenamed(names), [F.col(new).alias(old) for old, new in names.items()]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null or empty text, or text without a letter."""
    own, back = _apart(docs, "lang_pred", "score", "ambiguous", "__text")
    known = langid.predict(own, langid.fit(docs.where(~langid.held_out(F.col("doc_id")))))
    return known.where(F.col("lang_pred") != langid.UNKNOWN).select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: that with the smallest doc_id (of repeated rows, one).

    Documents are told apart by doc_id and text, so different texts stay apart under one doc_id or none.
    """
    first = jaccard.class_firsts(docs).select(F.col("first_id").alias("__first"), F.col("key").alias("__first_key"))
    own, back = _apart(docs, "__key", "__first", "__first_key")
    keyed = own.withColumn("__key", jaccard.text_key(F.col("text")))
    same = (F.col("__key") == F.col("__first_key")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("__first"))
    return keyed.join(first, same, "left_semi").dropDuplicates(["doc_id", "__key"]).select(*back)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated 13-word windows out of texts; documents of which no word is left go.

    What is left of a text keeps its bytes, line breaks and spaces included; a document that loses nothing stays as it was.
    """
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    own, _ = _apart(docs, "payload")
    carried = own.withColumn("payload", F.to_json(F.struct(*[F.col(o).alias(c) for c, o in zip(docs.columns, own.columns) if c in names]))) if names else own
    done = substring.remove_repeats(carried, "payload" if names else None)
    left = done.where((F.col("n_removed") == 0) | (F.col("kept") != ""))
    fields = {c: F.from_json("payload", docs.select(*names).schema).getField(c) for c in names}
    fields |= {"doc_id": F.col("doc_id"), "text": F.col("rest")}
    if "n_chars" in names:
        fields["n_chars"] = F.when(F.col("n_removed") > 0, F.length("rest")).otherwise(fields["n_chars"])
    return left.select(*[fields[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item; whether one does depends on its text alone, so texts decide, not doc_ids."""
    own, back = _apart(docs, "__key", "__leak")
    keyed = own.withColumn("__key", jaccard.text_key(F.col("text")))
    found = decontam.find_leaks(keyed, queries.table(spark, sf_dir, "benchmark"), key="__key")
    leaks = found.select(F.col("key").alias("__leak")).distinct()
    return keyed.join(leaks, F.col("__key") == F.col("__leak"), "left_anti").select(*back)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048: a row a piece of a document."""
    pieces = packing.pack(docs, queries.tokenizer("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, each on what its predecessor wrote."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store.written(stage(spark, docs, sf_dir), name)
    return docs
