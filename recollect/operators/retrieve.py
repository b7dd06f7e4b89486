"""Hybrid retrieval: vector seeds, propagation, bounded expansion, scoring and scoping for a batch of queries.

Queries meet documents and not each of their entities: what an entity leads to is found once for all queries, and
bounds tell which of it can be among any query's best. Scoping by session or time never changes which seeds are found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scoring import Weights, clamped, reinforcement, score
from ..functions.text import edge_label, entity_header
from . import graph, vectors
from .facts import QUALIFIERS

#: So many seeds are sent to every task.
FEW = 20_000


@dataclass
class Memory:
    """The tables that a search reads.

    ``entities(entity_id, name, type, canonical, access_count, last_accessed, embedding)``,
    ``chunks(chunk_id, doc_id, embedding)``, ``extracted(entity_id, doc_id)`` and
    ``relations(edge_id, subject_id, object_id, type, subtype, confidence, access_count, last_accessed, valid_until)``.
    """

    entities: DataFrame
    chunks: DataFrame
    extracted: DataFrame
    relations: DataFrame


def dead_of(relations: DataFrame) -> DataFrame:
    """``(entity_id)``: entities that have relations, but no live one."""
    live = F.col("valid_until").isNull().cast("int").alias("live")
    ends = relations.select(F.explode(F.array("subject_id", "object_id")).alias("entity_id"), live)
    return ends.groupBy("entity_id").agg(F.max("live").alias("live")).where("live = 0").select("entity_id")


def hydrate(seeds: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Canonical seeds that have no relation at all or a live one at least; ``seeds`` has an ``entity_id``."""
    return seeds.join(dead_of(relations), "entity_id", "left_anti").join(entities.where("canonical").select("entity_id"), "entity_id", "left_semi")


def documents_of(chunk_hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(query_id, doc_id, sim)``: documents with the best similarity among their hit chunks; a few for each query."""
    return chunks.select("chunk_id", "doc_id").join(F.broadcast(chunk_hits), "chunk_id").groupBy("query_id", "doc_id").agg(F.max("sim").alias("sim"))


def propagate(chunk_hits: DataFrame, chunks: DataFrame, extracted: DataFrame) -> DataFrame:
    """``(query_id, entity_id, sim)``: entities inherit the similarity of each of their documents, and come once for each."""
    return graph.dealt(extracted.select("doc_id", "entity_id"), "entity_id").join(F.broadcast(documents_of(chunk_hits, chunks)), "doc_id").select("query_id", "entity_id", "sim")


def seeds_of(memory: Memory, queries: DataFrame, seed_k: int) -> tuple[DataFrame, DataFrame]:
    """Seed similarities ``(query_id, entity_id, sim)`` and chunk hits ``(query_id, chunk_id, sim, rank)``."""
    direct = vectors.top_k(queries, memory.entities, seed_k, "entity_id")
    hits = vectors.top_k(queries, memory.chunks, seed_k, "chunk_id")
    # An entity that queries meet themselves is like a document of its own. Rows are dealt by entity before they meet queries, and need not move again.
    of_doc = ["doc_id", F.lit(None).cast("string").alias("own")]
    of_self = [F.lit(None).cast(memory.extracted.schema["doc_id"].dataType).alias("doc_id"), F.col("entity_id").cast("string").alias("own")]
    asked = documents_of(hits, memory.chunks).where("doc_id IS NOT NULL").select("query_id", *of_doc, "sim").unionByName(direct.select("query_id", *of_self, "sim")).alias("a")
    places = memory.extracted.where("doc_id IS NOT NULL").select("entity_id", *of_doc).unionByName(memory.entities.select("entity_id", *of_self))
    same = F.col("p.doc_id").eqNullSafe(F.col("a.doc_id")) & F.col("p.own").eqNullSafe(F.col("a.own"))
    met = graph.dealt(places, "entity_id").alias("p").join(F.broadcast(asked), same)
    return met.groupBy("query_id", "entity_id").agg(F.max("sim").alias("sim")), hits


def chunks_of(memory: Memory, queries: DataFrame, chunk_limit: int = 3, seed_k: int = 5, allowed_chunks: DataFrame | None = None, hits: DataFrame | None = None) -> DataFrame:
    """The chunks ``(query_id, chunk_id, sim, rank)`` of a search, ``hits`` if they are known already."""
    hits = vectors.top_k(queries, memory.chunks, seed_k, "chunk_id") if hits is None else hits
    if allowed_chunks is None:
        return hits.where(F.col("rank") <= chunk_limit)
    hits = hits.join(allowed_chunks, ["query_id", "chunk_id"], "left_semi")
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= chunk_limit)


def search(
    memory: Memory,
    queries: DataFrame,
    now: Column,
    hops: int = 2,
    limit: int = 10,
    chunk_limit: int = 3,
    seed_k: int = 5,
    weights: Weights = Weights(),
    allowed_entities: DataFrame | None = None,
    allowed_chunks: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Ranked entities and chunks for ``queries(query_id, embedding)``.

    ``allowed_entities(query_id, entity_id)`` and ``allowed_chunks(query_id, chunk_id)`` scope
    the result; with an empty one nothing is allowed. Allowed entities without a ``query_id`` hold for every query. Entities come with ``query_id,
    entity_id, sim, distance, edge_confidence, boost, score, path, rank``; ties are broken by
    distance and id. Chunks come with ``query_id, chunk_id, sim, rank``.
    """
    if not 1 <= hops <= graph.MOST_HOPS:
        raise ValueError(f"hops must be from 1 to {graph.MOST_HOPS}")
    spark, taken = queries.sparkSession, vectors.asked(queries)
    near = [vectors.top_k(queries, rows, seed_k, c, taken=taken, carry=also).withColumn("met", F.lit(c)) for rows, c, also in ((memory.entities, "entity_id", ()), (memory.chunks, "chunk_id", ("doc_id",)))]
    near = near[0].unionByName(near[1], allowMissingColumns=True)
    shape = near.schema
    live = memory.relations.where("valid_until IS NULL")
    qualifiers = [(F.col(c) if c in live.columns else F.lit(None)).cast("string").alias(c) for c in QUALIFIERS]
    step = F.struct(F.col("edge_id").cast("string").alias("edge_id"), "type", "subtype", "confidence", "access_count", F.col("last_accessed").cast("string").alias("last_accessed"), *qualifiers)
    boost_of = lambda x: reinforcement(x["access_count"], x["last_accessed"].cast("timestamp"), now, weights)
    state = memory.entities.where("canonical").select("entity_id", reinforcement(F.col("access_count"), F.col("last_accessed"), now, weights).alias("own"))

    # No path has more than the best boost of edges and entities and the best confidence.
    edge = F.struct("access_count", "last_accessed")
    tops = live.select(boost_of(edge).alias("boost"), clamped(F.col("confidence")).alias("c")).unionByName(state.select(F.col("own").alias("boost")), allowMissingColumns=True)
    tops = tops.agg(F.least(F.max("boost"), F.lit(weights.cap)), F.max("c"))

    # What needs nothing of each other is found at the same time. What queries met, a few rows for each, stays with their vectors in the driver.
    def of_data() -> tuple[DataFrame, DataFrame]:
        living = graph.held(state.join(dead_of(memory.relations), "entity_id", "left_anti"))
        return living, graph.held(memory.extracted.where("doc_id IS NOT NULL").select("doc_id", "entity_id").distinct().join(living, "entity_id"))

    near, (top, sure), (living, in_docs) = graph.at_once(spark, near.toArrow, tops.first, of_data)
    top = 1 + weights.gamma * (top or 0.0)

    def local(rows: pa.Table, *more: T.StructField) -> DataFrame:
        known = {f.name: f for f in (*shape, *more)}
        return spark.createDataFrame(rows, T.StructType([known[c] for c in rows.column_names]))

    direct_rows = near.filter(pc.equal(near["met"], "entity_id")).select(["query_id", "entity_id", "sim"])
    hit_rows = near.filter(pc.equal(near["met"], "chunk_id")).select(["query_id", "chunk_id", "doc_id", "sim", "rank"])
    doc_rows = hit_rows.filter(pc.and_(pc.is_valid(hit_rows["chunk_id"]), pc.is_valid(hit_rows["doc_id"])))
    doc_rows = doc_rows.group_by(["query_id", "doc_id"]).aggregate([("sim", "max")]).select(["query_id", "doc_id", "sim_max"]).rename_columns(["query_id", "doc_id", "sim"])
    direct, hits, docs = local(direct_rows), local(hit_rows.drop_columns("doc_id")), local(doc_rows)
    each = lambda rows, c: local(pa.table({c: pc.unique(rows[c])}))

    # Seeds, once for all queries: the entities of documents, and those that queries meet themselves.
    members = in_docs.join(F.broadcast(each(doc_rows, "doc_id")), "doc_id", "left_semi").select("doc_id", "entity_id", "own")
    alive = living.join(F.broadcast(each(direct_rows, "entity_id")), "entity_id", "left_semi").select("entity_id", "own")

    def scored(rows: DataFrame) -> DataFrame:
        return rows.withColumn("score", score(F.col("sim"), F.col("distance"), F.col("edge_confidence"), F.col("boost"), weights))

    # Seeds as results. Those of one document are alike to a query, so its first ones by boost and id are enough, unless a scope chooses others for each query.
    firsts = members
    if allowed_entities is not None and "query_id" not in allowed_entities.columns:
        firsts = firsts.join(allowed_entities, "entity_id", "left_semi")
    if allowed_entities is None or "query_id" not in allowed_entities.columns:
        firsts = firsts.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("own"), "entity_id"))).where(F.col("n") <= limit)
    else:
        firsts = graph.dealt(firsts, "entity_id")
    started = firsts.select("doc_id", "entity_id", "own").join(F.broadcast(docs), "doc_id").select("query_id", "entity_id", "sim", "own").unionByName(direct.join(alive, "entity_id").select("query_id", "entity_id", "sim", "own"))
    if allowed_entities is not None:
        started = started.join(allowed_entities, [c for c in ("query_id", "entity_id") if c in allowed_entities.columns], "left_semi")
    started = scored(started.select("query_id", "entity_id", "sim", F.lit(0).alias("distance"), F.lit(0.0).alias("edge_confidence"), F.least("own", F.lit(weights.cap)).alias("boost")))
    # Each query's first seeds in the order of results; those after them stay behind, whatever paths add. Dealt by query once.
    whole = F.struct("sim", "distance", "edge_confidence", "boost", "score")
    started = started.repartition("query_id").groupBy("query_id", "entity_id").agg(F.max_by(whole, F.struct("score", "sim")).alias("b")).select("query_id", "entity_id", "b.*")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_id")
    start = started.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    start_rows, start_kinds = start.toArrow(), start.schema
    start = spark.createDataFrame(start_rows, start_kinds)

    # What a query's result must reach: the score of its last seed, if it has enough of them. A path from a seed has the score s * B + A * B for a similarity s and a factor B
    # from 1 to ``most``. The greatest s * B - least of a seed's queries is convex in B, so a line through its ends bounds it.
    last_rows = start_rows.filter(pc.equal(start_rows["n"], limit)).select(["query_id", "score"]).rename_columns(["query_id", "least"])
    last = local(last_rows, T.StructField("least", T.DoubleType()))
    reach = lambda rows: rows.join(F.broadcast(last), "query_id", "left").na.fill({"least": float("-inf")})
    most = 1 + weights.gamma * weights.cap
    bounded = weights.gamma >= 0 and weights.cap >= 0

    kinds = [T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("far", T.IntegerType())]

    def ends_of(rows: pa.Table, by: str) -> DataFrame:
        """``(<by>, low, high, far)``: those of ``rows(query_id, <by>, sim)`` from which a path may reach what is asked, at the distance ``far`` at most, whatever its edges and its end."""
        met = rows.join(last_rows, "query_id")
        least = met["least"].fill_null(float("-inf")).to_numpy()
        close = weights.alpha * np.clip(met["sim"].fill_null(0.0).to_numpy(), 0.0, 1.0)
        met = pa.table({by: met[by], "low": close - least, "high": close * most - least}).group_by(by).aggregate([("low", "max"), ("high", "max")])
        low, high = met["low_max"].to_numpy(), met["high_max"].to_numpy()
        far = np.zeros(len(met), dtype=np.int32)
        with np.errstate(invalid="ignore"):
            bound = low + (high - low) * (top - 1) / (most - 1) if most > 1 else np.maximum(low, high)
            for d in range(1, hops + 1):
                at = weights.beta / (1 + d) + max(weights.delta, 0.0) * (sure or 0.0)
                far[(not bounded) | np.isnan(bound) | (np.maximum(at + low, at * top + bound) >= -1e-9)] = d
        return local(pa.table({by: met[by], "low": low, "high": high, "far": far}).filter(pa.array(far > 0)), *kinds)

    # Only of these documents and direct hits may paths be among the results.
    of_docs, of_direct = ends_of(doc_rows, "doc_id"), ends_of(direct_rows, "entity_id")
    both = members.join(F.broadcast(of_docs), "doc_id").drop("own").unionByName(alive.select("entity_id").distinct().join(F.broadcast(of_direct), "entity_id"), allowMissingColumns=True).withColumnRenamed("entity_id", "seed")
    by_seed = Window.partitionBy("seed")
    together = {c: F.max(c).over(by_seed) for c in ("low", "high", "far")} | {"n": F.row_number().over(by_seed.orderBy("doc_id"))}
    sources = graph.held(both.withColumn("itself", F.col("doc_id").isNull()).withColumns(together))
    seeds = sources.where("n = 1").select("seed", "low", "high", "far")
    farther, many = seeds.agg(F.max("far"), F.count(F.lit(1))).first()
    farther = farther or 1

    def reaches(distance, confidence: Column, boost: Column) -> Column:
        factor = 1 + F.lit(weights.gamma) * boost
        bound = F.col("low") + (F.col("high") - F.col("low")) * (factor - 1) / (most - 1) if most > 1 else F.greatest("low", "high")
        return F.isnan(bound) | ((F.lit(weights.beta) / (1 + distance) + F.lit(weights.delta) * clamped(confidence)) * factor + bound >= -1e-9)

    def total(path: Column) -> Column:
        return F.aggregate(path, F.lit(0.0), lambda s, x: s + x["confidence"])

    def edge_boost(path: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(path, boost_of)), F.lit(0.0))

    def worth(frontier: DataFrame, steps: DataFrame) -> DataFrame:
        ahead = frontier.join(seeds, "seed").select("seed", F.col("node").alias("src"), total(F.col("path")).alias("c"), edge_boost(F.col("path")).alias("b"), "low", "high")
        on = steps.select("src", F.col("dst").alias("entity_id"), F.col("step.confidence").alias("c2"), boost_of(F.col("step")).alias("b2")).join(living, "entity_id")
        boost = F.least(F.greatest("b", "b2", "own"), F.lit(weights.cap))
        return ahead.join(on, "src").where(reaches(farther, (F.col("c") + F.col("c2")) / farther, boost)).select("seed", F.col("entity_id").alias("node")).distinct()

    paths = graph.shortest_paths(seeds.select("seed"), live, farther, step, worth=worth if bounded else None, goes=lambda h: seeds.where(F.col("far") >= h).select("seed"), few=many <= FEW)
    path = F.col("path")
    # What a live relation reaches is alive.
    reached = paths.withColumnRenamed("target", "entity_id").join(living, "entity_id").join(F.broadcast(seeds) if many <= FEW else seeds, "seed")
    reached = reached.select("seed", "entity_id", "distance", "path", (total(path) / F.col("distance")).alias("edge_confidence"), F.least(F.greatest(edge_boost(path), F.col("own")), F.lit(weights.cap)).alias("boost"), "low", "high")
    reached = (reached.where(reaches(F.col("distance"), F.col("edge_confidence"), F.col("boost"))) if bounded else reached).drop("low", "high")
    # Sources of seeds before their queries; a direct hit is like a document of its own.
    from_source = sources.select("doc_id", "seed", F.when(F.col("itself"), F.col("seed")).alias("self")).join(reached, "seed").drop("seed").alias("s")
    asked = docs.withColumn("self", F.lit(None).cast(shape["entity_id"].dataType)).unionByName(direct.where("entity_id IS NOT NULL").withColumnRenamed("entity_id", "self"), allowMissingColumns=True).alias("a")
    same = F.col("s.doc_id").eqNullSafe(F.col("a.doc_id")) & F.col("s.self").eqNullSafe(F.col("a.self"))
    met = from_source.join(F.broadcast(asked), same).select("query_id", "sim", "entity_id", "distance", "path", "edge_confidence", "boost")
    spread = reach(scored(met)).where(F.col("score") >= F.col("least") - 1e-9).drop("least")
    none = F.from_json(F.lit("[]"), paths.schema["path"].dataType)
    best = start.drop("n").withColumn("path", none).unionByName(spread).repartition("query_id").groupBy("query_id", "entity_id").agg(
        F.max_by(F.struct("sim", "distance", "edge_confidence", "boost", "score", "path"), F.struct("score", -F.col("distance"), "sim")).alias("b")
    ).select("query_id", "entity_id", "b.*")
    if allowed_entities is not None:
        best = best.join(allowed_entities, [c for c in ("query_id", "entity_id") if c in allowed_entities.columns], "left_semi")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "distance", "entity_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked, chunks_of(memory, queries, chunk_limit, seed_k, allowed_chunks, hits)


def labels_of(path: Column) -> Column:
    """The labels of a path's edges, with their subtypes and qualifiers."""
    return F.transform(path, lambda x: edge_label(x["type"], x["subtype"], x["quantity_kind"], x["quantity_value"], x["quantity_unit"], x["time_scope"]))


def as_documents(found: DataFrame, chunks: DataFrame, entities: DataFrame, passages: DataFrame) -> DataFrame:
    """``(query_id, kind, position, id, content, score)``: the entities of a search as headers, then its chunks' texts.

    ``entities(entity_id, name, type)`` and ``passages(chunk_id, text)`` give what to show; positions count on from entities to chunks.
    """
    named = found.join(entities.select("entity_id", "name", "type"), "entity_id")
    first = named.select("query_id", F.lit("entity").alias("kind"), F.col("rank").alias("position"), F.col("entity_id").alias("id"), entity_header(F.col("name"), F.col("type"), F.col("distance"), labels_of(F.col("path"))).alias("content"), "score")
    many = found.groupBy("query_id").agg(F.max("rank").alias("many"))
    then = passages.select("chunk_id", "text").join(F.broadcast(chunks), "chunk_id").join(many, "query_id", "left")
    place = (F.coalesce("many", F.lit(0)) + F.col("rank")).alias("position")
    return first.unionByName(then.select("query_id", F.lit("chunk").alias("kind"), place, F.col("chunk_id").alias("id"), F.col("text").alias("content"), F.col("sim").alias("score")))


def touches_of(entities: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Log rows ``(entity_id, ts)`` and ``(edge_id, ts)`` that reinforce what a search returned."""
    nodes = entities.select("entity_id", at.alias("ts")).distinct()
    edges = entities.select(F.explode("path").alias("p")).select("p.edge_id", at.alias("ts")).distinct()
    return nodes, edges


def touched(entities: DataFrame, at: Column) -> DataFrame:
    """The same as one log ``(kind, id, ts)``, from one pass over what a search returned."""
    one = lambda kind, of: F.struct(F.lit(kind).alias("kind"), of.cast("string").alias("id"))
    ids = F.concat(F.array(one("entity", F.col("entity_id"))), F.transform("path", lambda p: one("edge", p["edge_id"])))
    return entities.select(F.explode(ids).alias("t")).select("t.kind", "t.id").distinct().withColumn("ts", at)


def vector_only(memory: Memory, queries: DataFrame, k: int = 5, limit: int | None = None) -> DataFrame:
    """``(query_id, entity_id, sim, rank)``: direct hits, then entities of hit chunks' documents with a similarity of 0; with ``limit`` the first ones of each query.

    A document's entities count the same to a query, so its first ``limit + k`` by id are enough for ``limit`` besides the direct hits.
    """
    direct = graph.held(vectors.top_k(queries, memory.entities, k, "entity_id").select("query_id", "entity_id", "sim"))
    hits = vectors.top_k(queries, memory.chunks, k, "chunk_id")
    extracted = memory.extracted
    if limit is not None:
        by_id = Window.partitionBy("doc_id").orderBy("entity_id")
        extracted = extracted.select("doc_id", "entity_id").distinct().withColumn("__n", F.row_number().over(by_id)).where(F.col("__n") <= limit + k).drop("__n")
    # Dealt by query first, which also serves the ranking.
    through = propagate(hits, memory.chunks, extracted).select("query_id", "entity_id").repartition("query_id").distinct().withColumn("sim", F.lit(0.0))
    both = direct.repartition("query_id").unionByName(through.join(F.broadcast(direct), ["query_id", "entity_id"], "left_anti"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "entity_id")))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def graph_only(questions: DataFrame, entities: DataFrame, relations: DataFrame, hops: int = 3, k: int = 5, most_words: int = 5_000) -> DataFrame:
    """``(query_id, target, distance)`` around the first ``k`` entities by name whose name holds the last word of the question.

    Names are matched with ``most_words`` distinct words at once; more words are taken in that many rounds.
    """
    last = F.lower(F.regexp_extract("question", r"(\w+)\W*$", 1))
    asked = questions.select("query_id", last.alias("word")).where("word <> ''")
    names = entities.where("canonical").select("entity_id", "name")
    words = asked.select("word").distinct()
    rounds = max(1, -(-words.count() // most_words))
    first = Window.partitionBy("word").orderBy("name", "entity_id")
    met = None
    for r in range(rounds):
        part = words if rounds == 1 else words.where(F.pmod(F.xxhash64("word"), F.lit(rounds)) == r)
        held = names.join(F.broadcast(part), F.lower("name").contains(F.col("word")))
        firsts = held.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k)
        met = firsts if met is None else met.unionByName(firsts)
    seeds = asked.join(met.select("word", "entity_id"), "word")
    found = graph.reachable(seeds.select(F.struct("query_id", "entity_id").alias("s")).select(F.col("s.entity_id").alias("seed")).distinct(), relations.where("valid_until IS NULL"), hops)
    return seeds.select("query_id", F.col("entity_id").alias("seed")).join(found, "seed").groupBy("query_id", "target").agg(F.min("distance").alias("distance"))


def allow_entities(scope: DataFrame, turns: DataFrame, mentions: DataFrame) -> DataFrame:
    """``(query_id, entity_id)`` within each query's session and look-back; ``scope(query_id, session_id, since)``, null where not asked."""
    met = turns.join(mentions.select("turn_key", "entity_id"), "turn_key")
    by_session = scope.where("session_id IS NOT NULL").join(met, "session_id").select("query_id", "entity_id").distinct()
    # Each entity's last mention decides, so a query's range meets an entity once and not each of its mentions.
    last = met.groupBy("entity_id").agg(F.max("ts").alias("ts"))
    by_time = last.join(scope.where("since IS NOT NULL").select("query_id", "since").distinct(), F.col("ts") >= F.col("since")).select("query_id", "entity_id").distinct()
    asked_session, asked_time = scope.where("session_id IS NOT NULL").select("query_id"), scope.where("since IS NOT NULL").select("query_id")
    both = by_session.join(by_time, ["query_id", "entity_id"], "left_semi")
    only_session = by_session.join(asked_time, "query_id", "left_anti")
    only_time = by_time.join(asked_session, "query_id", "left_anti")
    return both.unionByName(only_session).unionByName(only_time)


__all__ = ["Memory", "allow_entities", "as_documents", "chunks_of", "documents_of", "graph_only", "hydrate", "labels_of", "propagate", "search", "seeds_of", "touched", "touches_of", "vector_only"]
