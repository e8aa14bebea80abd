"""Five stages over documents: quality, line dedup, SimHash dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written as Parquet
and read back before the next one starts, so a lost executor costs one stage's tasks at most. Null texts, languages,
sources and ids are defined by the operators; an empty table goes through as one; columns of any other name come along
up to the last stage. Equal rows are rows of their own until the near-copies stage, which keeps one id of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.line_dedup import line_dedup
from quillon.llm.mixing import mixed_documents
from quillon.llm.near_copies import near_copy_groups
from quillon.llm.packing import pack_documents
from quillon.llm.quality import quality_scores
from quillon.llm.shared import WORD, stored
from quillon.llm.tokens import vocabulary


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in columns])


def _aside(docs: DataFrame, names: list[str]) -> DataFrame:
    """Columns of docs whose names an operator gives to its own results, under other names; _back undoes it."""
    return docs.withColumnsRenamed({c: f"aside {c}" for c in docs.columns if c in names})


def _back(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*[F.col(f"`aside {c}`" if f"aside {c}" in docs.columns else f"`{c}`").alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_scores(_aside(docs, ["perplexity", "threshold", "kept"]), labels)
    return _back(scored.where("kept"), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that earlier lines match; one that loses its last word that way goes."""
    kept = line_dedup(_aside(docs, ["n_lines", "n_removed"]))
    bare = (F.col("n_removed") > 0) & ~F.col("text").rlike(WORD)
    return _measured(_back(kept.where(~F.coalesce(bare, F.lit(False))), docs.columns), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group whose five-word shingles have a similarity of 0.8 or more; rows with a null id stay."""
    gone = near_copy_groups(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a document, or the words taken of it, once for each round that takes it."""
    return _measured(mixed_documents(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix in sequences of 4096 tokens."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [("quality", quality), ("line dedup", lines), ("near copies", near_copies), ("mixing", mixing), ("packing", packing)]

#: Perplexities, fingerprints and token ids have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
