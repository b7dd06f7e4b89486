"""Documents, chunks, conversations, turns and mentions as keyed folds over append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def merge_documents(docs: DataFrame, stored: DataFrame | None = None, order: str = "doc_id") -> DataFrame:
    """First arrival of each content, without contents already stored; ``content_hash`` is added."""
    hashed = docs.withColumn("content_hash", T.content_hash(F.col("text")))
    first = hashed.withColumn("__n", F.row_number().over(Window.partitionBy("content_hash").orderBy(order))).where("__n = 1").drop("__n")
    return first if stored is None else first.join(stored.select("content_hash"), "content_hash", "left_anti")


def merge_conversations(turns: DataFrame) -> DataFrame:
    """``(session_id, title, agent_id, started_at, last_active_at)`` of ``turns(session_id, ts[, title, agent_id])``: the first title, else one made up."""
    has = set(turns.columns)
    title = F.min_by("title", F.when(F.col("title").isNotNull(), F.col("ts"))) if "title" in has else F.lit(None).cast("string")
    agent = F.min_by("agent_id", F.when(F.col("agent_id").isNotNull(), F.col("ts"))) if "agent_id" in has else F.lit(None).cast("string")
    found = turns.groupBy("session_id").agg(title.alias("t"), agent.alias("agent_id"), F.min("ts").alias("started_at"), F.max("ts").alias("last_active_at"))
    made = T.conversation_title(F.col("agent_id"), F.col("started_at"), F.col("session_id"))
    return found.select("session_id", F.coalesce("t", made).alias("title"), "agent_id", "started_at", "last_active_at")


def merge_turns(turns: DataFrame) -> DataFrame:
    """The first row of each turn by time, with its key; rows whose ids hold a colon are refused by ``quarantine``."""
    first = Window.partitionBy("session_id", "turn_id").orderBy("ts")
    ok = turns.where(T.valid_segment(F.col("session_id")) & T.valid_segment(F.col("turn_id")))
    return ok.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n").withColumn("turn_key", T.turn_key(F.col("session_id"), F.col("turn_id")))


def quarantine(turns: DataFrame) -> DataFrame:
    return turns.where(~(T.valid_segment(F.col("session_id")) & T.valid_segment(F.col("turn_id"))))


def next_turns(turns: DataFrame, first: int = 0) -> DataFrame:
    """``(session_id, from_turn, to_turn)`` where the turn numbered one less exists."""
    before = F.lag("turn_number").over(Window.partitionBy("session_id").orderBy("turn_number"))
    linked = turns.select("session_id", "turn_number").distinct().withColumn("p", before)
    return linked.where((F.col("p") == F.col("turn_number") - 1) & (F.col("turn_number") > first)).select("session_id", F.col("p").alias("from_turn"), F.col("turn_number").alias("to_turn"))


def merge_mentions(mentions: DataFrame) -> DataFrame:
    """``(entity_id, turn_key, confidence, created_at)`` with the greatest confidence and the first time."""
    return mentions.groupBy("entity_id", "turn_key").agg(F.max("confidence").alias("confidence"), F.min("created_at").alias("created_at"))


def merge_entities(assertions: DataFrame) -> DataFrame:
    """Entities by name and type: the first assertion's attributes, one access for each assertion after the first."""
    others = [c for c in assertions.columns if c not in ("name", "type", "seq", "ts")]
    first = [F.min_by(c, "seq").alias(c) for c in others]
    found = assertions.groupBy("name", "type").agg(*first, (F.count(F.lit(1)) - 1).alias("access_count"), F.min("ts").alias("created_at"), F.max("ts").alias("__last"))
    last = F.when(F.col("access_count") > 0, F.col("__last")).alias("last_accessed")
    return found.select(T.entity_id(F.col("name"), F.col("type")).alias("entity_id"), *[c for c in found.columns if c != "__last"], last)


def add_aliases(entities: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities with aliases, alias stubs and same-as edges from ``resolved(alias, canonical_id, sim)``.

    A name that only differs in case from the entity's, or is listed already, adds nothing.
    """
    names = entities.select(F.col("entity_id").alias("canonical_id"), F.col("name").alias("canonical_name"), "type", "aliases")
    known = F.coalesce(F.array_contains("aliases", F.col("alias")), F.lit(False))
    new = resolved.join(names, "canonical_id").where((F.lower("alias") != F.lower("canonical_name")) & ~known)
    per = new.groupBy("canonical_id", "type", "alias").agg(F.max("sim").alias("sim"))
    lists = per.groupBy(F.col("canonical_id").alias("entity_id")).agg(F.sort_array(F.collect_set("alias")).alias("__new"))
    empty = F.array().cast("array<string>")
    updated = entities.join(lists, "entity_id", "left").withColumn("aliases", F.concat(F.coalesce("aliases", empty), F.coalesce("__new", empty))).drop("__new")
    alias_id = T.entity_id(F.col("alias"), F.col("type"))
    stubs = per.groupBy("alias", "type").agg(F.count(F.lit(1)).alias("n")).select(alias_id.alias("entity_id"), F.col("alias").alias("name"), "type", F.lit(False).alias("canonical"))
    same_as = per.select(alias_id.alias("alias_id"), "canonical_id", F.col("sim").alias("confidence"), F.lit("vector_similarity").alias("method"))
    return updated, stubs, same_as


def touched(base: DataFrame, touches: DataFrame, key: str) -> DataFrame:
    """Access counters of ``base(key, access_count, last_accessed)`` with the log ``touches(key, ts)`` added."""
    new = touches.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.max("ts").alias("__t"))
    grown = base.join(new, key, "left")
    return grown.withColumns({"access_count": F.coalesce("access_count", F.lit(0)) + F.coalesce("__n", F.lit(0)), "last_accessed": F.greatest("last_accessed", "__t")}).drop("__n", "__t")


def entities_of_documents(chunks: DataFrame, extracted: DataFrame, entities: DataFrame) -> DataFrame:
    """``(entity_id, chunk_id)``: the canonical entities of the chunks' documents, each pair once."""
    known = extracted.join(entities.where("canonical").select("entity_id").distinct(), "entity_id", "left_semi").select("entity_id", "doc_id").distinct()
    return chunks.select("chunk_id", "doc_id").distinct().join(known, "doc_id").select("entity_id", "chunk_id").distinct()


def entities_in_session(turns: DataFrame, mentions: DataFrame, session: DataFrame | None = None, since=None) -> DataFrame:
    """Distinct entities mentioned in turns, of the given sessions or since a time."""
    chosen = turns if session is None else turns.join(session, "session_id", "left_semi")
    chosen = chosen if since is None else chosen.where(F.col("ts") >= since)
    return chosen.select("turn_key").join(mentions, "turn_key").select("entity_id").distinct()


def chunks_in_session(turns: DataFrame, ingested: DataFrame, chunks: DataFrame, session: DataFrame | None = None, since=None) -> DataFrame:
    """Distinct chunks of documents that came in by turns, of the given sessions or since a time."""
    chosen = turns if session is None else turns.join(session, "session_id", "left_semi")
    chosen = chosen if since is None else chosen.where(F.col("ts") >= since)
    docs = chosen.select("turn_key").join(ingested, "turn_key").select("doc_id").distinct()
    return chunks.join(docs, "doc_id", "left_semi").select("chunk_id").distinct()


def conversation_detail(turns: DataFrame, mentions: DataFrame, limit: int = 10) -> DataFrame:
    """The oldest ``limit`` turns of each conversation in order, each with its entities by name; turns without any have an empty list."""
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "turn_key"))
    oldest = turns.withColumn("position", rank).where(F.col("position") <= limit)
    listed = oldest.join(mentions.select("turn_key", "name"), "turn_key", "left").groupBy("session_id", "position", "turn_key", "role")
    return listed.agg(F.sort_array(F.collect_set("name")).alias("entities"))
