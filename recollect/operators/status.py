"""Counts, top lists and recency over the memory's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table, 0 for an empty one."""
    parts = [df.select(F.lit(name).alias("name")) for name, df in tables.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.agg(*[F.count(F.when(F.col("name") == n, 1)).alias(n) for n in tables])


def relation_counts(relations: DataFrame) -> DataFrame:
    """Live and superseded relations and those that an agent wrote, in one row."""
    agent = F.col("created_by") == "agent" if "created_by" in relations.columns else F.lit(False)
    return relations.agg(
        F.count(F.when(F.col("valid_until").isNull(), 1)).alias("live"),
        F.count(F.when(F.col("valid_until").isNotNull(), 1)).alias("superseded"),
        F.count(F.when(agent & F.col("valid_until").isNull(), 1)).alias("by_agent"),
    )


def recent_conversations(conversations: DataFrame, turns: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` conversations active last, with their turns; those without turns are left out."""
    active = turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), F.max("ts").alias("last_turn"))
    return conversations.join(active, "session_id").orderBy(F.desc("last_turn"), "session_id").limit(k)


def recent_writes(relations: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` relations written last, live or not."""
    return relations.orderBy(F.desc("valid_from"), "edge_id").limit(k)


def summary(documents: DataFrame, entities: DataFrame, relations: DataFrame, conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """One row: how many entities, documents, live and superseded relations, conversations and turns there are, the five entities with the
    most accesses on live relations, the five relations that agents wrote last, live or not, and the three conversations active last."""
    first = lambda rows, name, *columns: rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", *columns))), lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias(name))
    # A handful of rows each, numbered in their order.
    ranked = lambda rows, *order: rows.withColumn("__n", F.row_number().over(Window.orderBy(*order)))
    sizes = counts({"entities": entities, "documents": documents, "conversations": conversations, "turns": turns})
    both = relation_counts(relations).select(F.col("live").alias("live_relations"), F.col("superseded").alias("superseded_relations"))
    top = first(ranked(top_entities(entities, relations, 5), F.desc("total"), "name", "type"), "top_entities", "name", "type", "total")
    written = recent_writes(relations.where("created_by = 'agent'"), 5)
    agents = first(ranked(written, F.desc("valid_from"), "edge_id"), "recent_agent_writes", "edge_id", "subject_id", "type", "object_id", "valid_from")
    active = ranked(recent_conversations(conversations, turns, 3), F.desc("last_turn"), "session_id")
    talks = first(active, "recent_conversations", "session_id", "title", "turns", "last_turn")
    # Each side is one row.
    return sizes.join(both).join(top).join(agents).join(talks)


def lookup(entities: DataFrame, name: str, limit: int = 5) -> DataFrame:
    """Up to ``limit`` entities of a name in any case."""
    return entities.where(F.lower("name") == name.lower()).orderBy("name", "type").limit(limit)


top_entities = graph.incidence_counts
