"""A training-data pipeline over ``documents``: every stage takes (spark, docs, sf_dir), is written as Parquet and reread.

quality: drops documents that the classifier rejects. near_duplicates: keeps the smallest id of every group (five words,
similarity 0.8). decontaminate: drops documents that hold a
passage of a benchmark item (13 words), or of which a twentieth or more is benchmark text. pii: replaces personal data by its kind.
mix: one row per copy that the mix draws, with its shard.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import decontam, dedup, mixing, pii, quality
from loomspan.llm.common import materialise, shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document scored by neighbours among the labelled ones; those that the classifier rejects go."""
    return quality.filter_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what is linked to a smaller id. Of rows that repeat an id, one stays for each group that has the id as its smallest, and
    one if their texts have no words; rows without an id are no duplicates and stay."""
    found = dedup.near_duplicates(docs, shingle=5, percent=80, keys=True).where(F.col("doc_id").isNotNull())
    found = found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"), F.collect_set(F.when(F.col("kept"), F.struct("node", "label"))).alias("sets"))
    found = materialise(found.where("rows > 1 or not kept").select("doc_id", F.when(F.col("rows") > 1, F.col("sets")).alias("sets")))
    once = docs.join(found.select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    # rows of an id that repeats: the set of each tells whether it is kept and in which group. The rows travel as one column, whatever the names of theirs
    sets = found.where("sets is not null").select(F.col("doc_id").alias("__id"), F.explode("sets").alias("__set")).select("__id", F.col("__set.node").alias("__key"), F.col("__set.label").alias("__label"))
    repeated = docs.join(found.where("sets is not null").select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("__of"), F.col("text").alias("__text"), F.struct(*docs.columns).alias("__row"))
    repeated = dedup.with_node(repeated, "__text", 5)
    repeated = repeated.join(sets, (F.col("__of") == F.col("__id")) & F.col("__node").eqNullSafe(F.col("__key")))
    one = repeated.groupBy("__of", "__label").agg(F.min_by("__row", F.struct(F.coalesce("__text", F.lit("")), F.xxhash64("__row"))).alias("__row"))
    return once.unionByName(one.select("__row.*"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a whole window of benchmark words, however long they are; null and empty texts stay, an empty benchmark drops nothing."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in brackets, and n_chars follows; null texts stay null, all other columns are unchanged."""
    return pii.redact(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix draws; documents without words are not drawn, and of an empty table nothing is."""
    return mixing.mix(docs)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicates_stage), ("decontaminate", decontaminate_stage), ("pii", pii_stage), ("mix", mix_stage)]

#: SQL cannot express the neighbour vote, the sketches or the tagger; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return docs
