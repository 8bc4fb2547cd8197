"""The corpus pipeline: language, repeated lines, near duplicates, benchmark passages, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from winnow.llm import decontaminate, language, lines, sentencepiece, simhash
from winnow.sources.scratch import cut_lineage, scratch_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; the models learn from the labelled ones among them.

    Every row is judged by its whole text; null texts and those without a letter go. Without labelled rows all go. Repeated
    rows and rows without doc_id or lang are judged like any other; an empty table stays empty.
    """
    found = language.identify(docs, language.learn(docs), docs.columns, prefix="__lang_")
    return found.where("__lang_accepted").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has; those with nothing left of what they held go.

    Earlier is the smaller doc_id, then the smaller line number; of repeated rows the lines of all stay that are first. Null
    and empty texts and documents without doc_id stay as they are, however long a line is; an empty table stays empty.
    """
    found = lines.dedup_lines(docs.withColumnRenamed("line_counts", "__line_counts"))
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    gone = blank & (F.col("line_counts.kept") < F.col("line_counts.lines"))
    kinds = dict(docs.dtypes)
    own = {"n_chars": F.length("text").cast(kinds.get("n_chars", "long")), "line_counts": F.col("__line_counts") if "line_counts" in kinds else None}
    columns = [own[c].alias(c) if c in own else F.col(f"`{c}`") for c in docs.columns]
    return found.where(~gone).select(*columns)


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Documents but for those whose doc_id and text (by ``text_key``) are dropped; others with the same doc_id stay."""
    rows = dropped.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    same = (docs["doc_id"].cast("long") == rows["__id"]) & (F.xxhash64(docs["text"]) == rows["__key"])
    return docs.join(rows, same, "left_anti")


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id, of several texts with it the first by hash.

    Each row is judged by its doc_id and its text, so where documents share a doc_id, a text whose group has no other
    stays. Exact repeats of a row that stays all stay, and so do documents without doc_id. Null and empty texts are
    alike; texts of any length are taken whole; an empty table stays empty.
    """
    found = cut_lineage(simhash.simhash_groups(docs).where("doc_id IS NOT NULL"), "groups")
    first = found.where("kept").groupBy("group").agg(F.min("text_key").alias("first"))
    return _without(docs, found.join(first, "group").where("NOT kept OR text_key <> first"))


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Each row is judged by its doc_id and its whole text; documents without doc_id by their text alone. Null and empty
    texts hold none; repeated rows go or stay together; an empty table, or an empty benchmark, changes nothing.
    """
    items = spark.read.parquet(f"{str(sf_dir).rstrip('/')}/benchmark.parquet")
    found = cut_lineage(decontaminate.contamination(docs, items, keyed=True).where("contaminated").select("doc_id", "text_key"), "passages")
    left = _without(docs, found)
    unnamed = found.where("doc_id IS NULL").select(F.col("text_key").alias("__key")).distinct()
    same = docs["doc_id"].isNull() & (F.xxhash64(docs["text"]) == unnamed["__key"])
    return left.join(unnamed, same, "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, exact, ids`` of each document, whatever its length.

    Null and empty texts have no tokens; repeated rows and rows without doc_id each get a row; an empty table gives none.
    """
    return sentencepiece.round_trip(docs, keep=["lang", "source"])


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_documents),
    ("benchmark decontamination", decontaminate_documents),
    ("SentencePiece encoding and decoding", encode),
]

#: Language models and tokens have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each one's result is written and read again."""
    docs = spark.read.parquet(f"{str(sf_dir).rstrip('/')}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch_dir(spark, f"pipeline-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
