"""A corpus pipeline of five stages, each an operator of ``recollect.llm`` applied to what the stage before kept.

Documents that a stage rejects go; the last stage lays out what is left in training sequences.
A stage takes (session, documents, folder of the tables) and returns a DataFrame, which
``run`` writes as Parquet in the shared folder and reads again. Each begins by giving back the driver's memory that those before it left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import decontaminate, language_id, packing, shared, simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the model knows with a score of a half at least; null texts and those without letters go."""
    shared.give_back(spark)
    docs = docs.select(*COLUMNS)
    model = language_id.fit(docs.where(~shared.is_held_out(F.col("doc_id"))))
    found = language_id.identify_languages(docs, model)
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("lang_score") >= 0.5)).select(*COLUMNS)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a toxicity score under 0.3."""
    shared.give_back(spark)
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(toxicity.labelled(docs, shared.table(spark, sf_dir, "labels")))
    return toxicity.score_toxicity(docs, model).where("tox_score < 0.3").select(*COLUMNS)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates, once; of different texts of that id the first by hash. Documents without an id stay."""
    shared.give_back(spark)
    docs = docs.select(*COLUMNS)
    found = simhash.similar_documents(docs).where("doc_id IS NOT NULL")
    kept = found.groupBy("component").agg(F.min(F.struct("doc_id", "t")).alias("first")).select("first.*")
    without = docs.where("doc_id IS NULL")
    marked = docs.withColumn("t", F.xxhash64("text"))
    return marked.join(kept, ["doc_id", "t"], "left_semi").dropDuplicates(["doc_id", "t"]).select(*COLUMNS).unionByName(without)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that share no window with the benchmark."""
    shared.give_back(spark)
    docs = docs.select(*COLUMNS)
    found = decontaminate.contamination(docs, shared.table(spark, sf_dir, "benchmark"))
    bad = shared.settled(found.where("n_hit > 0").select(F.col("doc_id").alias("bad_id"), F.col("sig").alias("bad_sig")).distinct())
    marked = docs.withColumn("sig", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.col("sig") == F.col("bad_sig"))
    return marked.join(bad, same, "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4,096 tokens; of rows with equal texts one comes in a sequence. Null and empty texts have no piece."""
    shared.give_back(spark)
    return packing.pack_documents(packing.measured(docs.select(*COLUMNS)).drop("text"), "n_tokens")


STAGES = [("language_id", identified), ("toxicity", civil), ("near_duplicates", unique), ("decontamination", unseen), ("packing", packed)]

#: Learned models and best-fit packing have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns; what the stages wrote besides is deleted as soon as the next one is stored."""
    docs, before = shared.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder = shared.own_folder(spark, f"pipeline-{name}")
        with shared.cleared(spark):
            stage(spark, docs, sf_dir).write.parquet(folder)
        if before:
            shared.delete(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return docs
