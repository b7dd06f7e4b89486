"""Coercion of free types to canonical ones, and resolution of mentions to entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.scoring import cosine
from . import vectors


def nearest_canonical(raw: DataFrame, canonicals: DataFrame) -> DataFrame:
    """``(raw, best, sim)``: each distinct value's nearest canonical by cosine, ties by name.

    The canonicals are a vocabulary, whose size is checked before it is broadcast.
    """
    if canonicals.count() > 10_000:
        raise ValueError("canonicals must be a small vocabulary")
    pairs = raw.select("raw", "embedding").dropDuplicates(["raw"]).join(F.broadcast(canonicals.select("canonical", F.col("embedding").alias("c"))))
    scored = pairs.select("raw", "canonical", cosine(F.col("embedding"), F.col("c")).alias("sim"))
    # The greatest similarity, then the first name.
    top = Window.partitionBy("raw").orderBy(F.desc("sim"), "canonical")
    return scored.withColumn("n", F.row_number().over(top)).where("n = 1").select("raw", F.col("canonical").alias("best"), "sim")


def coerce_relation_types(raw: DataFrame, canonicals: DataFrame, threshold: float = 0.55, margin: float = 0.05) -> DataFrame:
    """``(raw, type, sim)`` for distinct ``raw(raw, embedding)``.

    Blank is RELATED_TO at 0; a synonym is its canonical at 1. A canonical type gives way to
    another that is nearer by ``margin``; a novel type becomes the nearest canonical at
    ``threshold`` or more, else it stays.
    """
    shaped = F.replace(F.upper(V.stripped(F.col("raw"))), F.lit(" "), F.lit("_"))
    known = V.normalize_relation_type(F.col("raw"))
    best = nearest_canonical(raw, canonicals)
    own = raw.select("raw", "embedding").dropDuplicates(["raw"]).join(F.broadcast(canonicals.select("canonical", F.col("embedding").alias("c"))), known == F.col("canonical"))
    own = own.select("raw", cosine(F.col("embedding"), F.col("c")).alias("own"))
    rows = raw.select("raw").distinct().join(best, "raw", "left").join(own, "raw", "left").withColumns({"shaped": shaped, "known": known})
    blank = F.col("shaped").isNull() | (F.col("shaped") == "")
    listed = F.col("shaped").isin(*V.RELATION_TYPES)
    synonym = ~listed & (F.col("known") != F.col("shaped"))
    override = F.col("sim") >= F.coalesce("own", F.lit(-1.0)) + margin
    kind = (
        F.when(blank, "RELATED_TO").when(synonym, F.col("known")).when(listed, F.when(override, F.col("best")).otherwise(F.col("known")))
        .when(F.col("sim") >= threshold, F.col("best")).otherwise(F.col("shaped"))
    )
    value = F.when(blank, 0.0).when(synonym, 1.0).when(listed, F.when(override, F.col("sim")).otherwise(1.0)).otherwise(F.coalesce("sim", F.lit(0.0)))
    return rows.select("raw", kind.alias("type"), value.alias("sim"))


def coerce_entity_types(raw: DataFrame, canonicals: DataFrame, threshold: float = 0.55) -> DataFrame:
    """``(raw, type, sim)``: listed types and synonyms at 1, else the nearest canonical at ``threshold`` or more, else the raw one at 0; blank is Concept at 0."""
    known = V.normalize_entity_type(F.col("raw"))
    blank = F.col("raw").isNull() | (V.stripped(F.col("raw")) == "")
    novel = raw.where(known.isNull())
    best = nearest_canonical(novel, canonicals)
    rows = raw.select("raw").distinct().join(best, "raw", "left")
    near = F.col("sim") >= threshold
    kind = F.when(known.isNotNull(), known).when(near, F.col("best")).otherwise(F.col("raw"))
    value = F.when(blank, 0.0).when(known.isNotNull(), 1.0).when(near, F.col("sim")).otherwise(0.0)
    return rows.select("raw", kind.alias("type"), value.alias("sim"))


def resolve_entities(mentions: DataFrame, entities: DataFrame, threshold: float = 0.85, unknown_threshold: float = 0.9) -> DataFrame:
    """``(mention_id, entity_id, sim, is_new)`` of ``mentions(mention_id, type, embedding)`` against the stored ``entities(entity_id, type, embedding)``.

    A mention resolves to the nearest entity of its type at ``threshold`` or more; one of type
    Unknown to the nearest of any type at ``unknown_threshold``. Mentions of a batch are
    resolved against what was stored before it, never against each other.
    """
    named = mentions.withColumnRenamed("mention_id", "query_id")
    typed = vectors.top_k(named.where("type <> 'Unknown'"), entities, 1, "entity_id", same_type=True).where(F.col("sim") >= threshold)
    free = vectors.top_k(named.where("type = 'Unknown'"), entities, 1, "entity_id").where(F.col("sim") >= unknown_threshold)
    met = typed.unionByName(free).select(F.col("query_id").alias("mention_id"), "entity_id", "sim")
    return mentions.select("mention_id").join(met, "mention_id", "left").withColumn("is_new", F.col("entity_id").isNull())


def group_mentions(mentions: DataFrame) -> DataFrame:
    """One row for each document, name (in any case) and canonical type: the first mention by position, and how many there are."""
    key = F.lower(V.stripped(F.col("name")))
    kind = F.coalesce(V.normalize_entity_type(F.col("raw_type")), F.col("raw_type"))
    first = F.min_by(F.struct("name", "confidence"), "position").alias("m")
    grouped = mentions.groupBy("doc_id", key.alias("key"), kind.alias("type")).agg(first, F.count(F.lit(1)).alias("mentions"))
    return grouped.select("doc_id", "key", "type", "m.name", "m.confidence", "mentions")
