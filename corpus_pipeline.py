"""The corpus pipeline: toxicity, language, near duplicates, mixing, tokens; each stage reads what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import language, mixing, neardup, pieces, toxicity
from panelloom.llm.common import free_names, table
from panelloom.session import scratch_table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; all, if the labels teach nothing. The classifier learns from all labelled documents outside the hold-out."""
    model = toxicity.fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    if not model.learnt:
        return docs
    (score,) = free_names(docs, "__toxic")
    return toxicity.score_toxicity(docs, model, into=score).where(F.col(score) < 0.5).select(docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter and those whose best two languages are next to equal go. All stay if no document has a language to learn."""
    model = language.fit_languages(docs)
    if not model.contents:
        return docs
    named = docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns})
    kept = language.predict_language(named, model, text="own_text").where("not rejected")
    return kept.select([F.col(f"own_{c}").alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by shingles of five words: that with the smallest id; rows without id stay."""
    kept = neardup.near_duplicates(docs, size=5).where("kept and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["__id"], "left_semi").unionByName(docs.where("doc_id is null"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    mixed = mixing.mix_sources(docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns if c not in ("doc_id", "text", "source")}))
    copies = mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copies.select([F.col(c if c in ("doc_id", "text", "source") else f"own_{c}").alias(c) for c in docs.columns])


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and ids of every document, with their number."""
    return pieces.encode(docs).withColumn("n_tokens", F.size("ids"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: The first two stages are learnt and the last runs a tokenizer: SQL can't express them, so tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
