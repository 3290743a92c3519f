"""A corpus from documents to packed sequences, stage by stage.

Null and empty texts have no quality words: the classifier scores them, the rules reject them (too few words), so none
reaches near-dedup in a run; given to that stage alone they stay, linked with nothing. Texts of any length are taken whole
in every stage. Of near copies the row with the smallest doc_id stays, of those the first; rows with one doc_id and
different texts, and rows without a doc_id, are rows of their own; of fully repeated rows one stays. An empty table passes
every stage as an empty table. Other columns stay as they are, whatever their names; ``n_chars`` follows a changed text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armlift.llm import line_rules, near_dedup, packing, quality_model
from armlift.llm.shared import broadcast_if_small, same_row, save, without


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality."""
    scores = quality_model.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(docs, scores.withColumn("kept", F.col("predicted") == 1))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted, without their frequent lines; n_chars follows the text."""
    out = line_rules.clean(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, with the smallest doc_id and of those the first; all other rows stay."""
    found = save(near_dedup.near_groups(docs), "near")
    # rows kept by doc_id alone: a group has several where its smallest doc_id is repeated, or all are null
    named = found.where("kept AND root IS NOT NULL")
    again = save(named.groupBy(F.col("root").alias("root_")).agg(
        F.count("*").alias("rows"), F.min_by("text_hash", "row").alias("stays")).where("rows > 1"), "again")
    several = named.join(broadcast_if_small(again, 500_000), F.col("root") == F.col("root_"))
    kept = without(docs, found.select("doc_id", "text_hash", "kept").union(several.where("text_hash <> stays").select(
        "doc_id", "text_hash", F.lit(False))))
    copies = save(several.where("text_hash = stays").groupBy(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")).agg(
        F.count("*").alias("rows")).where("rows > 1").drop("rows"), "copies")
    if copies.isEmpty():
        return kept
    keys = broadcast_if_small(copies, 1_000_000)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # rows of one doc_id and text may differ in other columns: the choice does not hang on the order of tasks
    one = kept.join(keys, same_row(kept, copies), "left_semi").groupBy("doc_id", "text").agg(
        F.min_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("rest_")).select(
        "doc_id", "text", "rest_.*") if rest else kept.join(keys, same_row(kept, copies), "left_semi").distinct()
    return kept.join(keys, same_row(kept, copies), "left_anti").unionByName(one)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality-classifier", classify),
    ("quality-rules", apply_rules),
    ("near-dedup", drop_near_copies),
    ("packing", pack_sequences),
]

# Tokens come from a tokenizer library and scores from a trained model: SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again as the next stage's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
