"""Queries over the graph: traversal, retrieval, status and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import evals, facts, graph, provenance, retrieve, status, vectors
from ..plans import adhoc
from . import model as M


def _regions(spark, sf_dir):
    return M.table(spark, sf_dir, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("seed"))


def bfs_shortest(spark, sf_dir):
    return graph.reachable(_regions(spark, sf_dir), M.star_edges(spark, sf_dir), 5)


def bfs_paths(spark, sf_dir):
    """Shortest paths with their edges, the smallest sequence of edge ids of each pair."""
    found = graph.shortest_paths(_regions(spark, sf_dir), M.star_edges(spark, sf_dir), 2, F.struct("edge_id"))
    return found.select("seed", "target", "distance", F.array_join(F.transform("path", lambda x: x["edge_id"]), ">").alias("path"))


def all_paths_neighbors(spark, sf_dir):
    names = M.star_entities(spark, sf_dir)
    found = graph.neighbours(_regions(spark, sf_dir), M.star_edges(spark, sf_dir), names, 2, 25)
    return found.select("seed", "target", "name", "distance", F.array_join("edge_ids", ">").alias("path"))


def reinforcement_score(spark, sf_dir):
    e = M.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return e.select("user_id", "event_type", "n", F.round(scoring.reinforcement(F.col("n"), F.col("last"), F.expr(M.NOW)), 6).alias("boost"))


def score_candidate(spark, sf_dir):
    e = M.table(spark, sf_dir, "events")
    boost = scoring.reinforcement(F.col("event_id") % 9, F.col("ts"), F.expr(M.NOW))
    value = scoring.score(F.col("value") / 80, F.col("event_id") % 4, F.col("user_id") % 10 / 10, boost)
    return e.select("event_id", F.round(value, 6).alias("score"))


def seed_propagation(spark, sf_dir):
    seeds, _ = retrieve.seeds_of(M.vector_memory(spark, sf_dir), M.vector_queries(spark, sf_dir), 5)
    return seeds.withColumn("sim", F.round("sim", 6))


def seed_hydration(spark, sf_dir):
    memory = M.vector_memory(spark, sf_dir)
    every = memory.entities.select("entity_id")
    return retrieve.hydrate(every, memory.entities, memory.relations)


def hybrid_retrieve(spark, sf_dir):
    memory = M.vector_memory(spark, sf_dir)
    found, _ = retrieve.search(memory, M.vector_queries(spark, sf_dir), F.expr(M.NOW), hops=2, limit=10)
    path = F.array_join(F.transform("path", lambda x: x["edge_id"]), ">")
    rounded = [F.round(c, 6).alias(c) for c in ("sim", "edge_confidence", "boost", "score")]
    return found.select("query_id", "entity_id", "distance", *rounded, path.alias("path"), "rank")


def retrieved_chunks(spark, sf_dir):
    chunks = retrieve.chunks_of(M.vector_memory(spark, sf_dir), M.vector_queries(spark, sf_dir), chunk_limit=3)
    return chunks.select("query_id", "chunk_id", F.round("sim", 6).alias("sim"), "rank")


def _search(spark, sf_dir):
    """The entities of a search with names, and its chunks with what they say, as one row for each query."""
    memory = M.vector_memory(spark, sf_dir)
    found, chunks = retrieve.search(memory, M.vector_queries(spark, sf_dir), F.expr(M.NOW))
    named = found.join(memory.entities.select("entity_id", "name", "type"), "entity_id")
    entity = F.struct("rank", "name", "type", F.round("score", 6).alias("score"), F.transform("path", lambda x: x["type"]).alias("path_edge_types"), retrieve.labels_of(F.col("path")).alias("labels"))
    chunk = F.struct("rank", "text", "title", "doc_id", F.round("sim", 6).alias("score"))
    said = M.passages(spark, sf_dir, memory).join(F.broadcast(chunks), ["chunk_id"]).groupBy("query_id").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))
    return named.groupBy("query_id").agg(F.array_sort(F.collect_list(entity)).alias("entities")).join(said, "query_id", "left")


def search_json(spark, sf_dir):
    """The hybrid result, entities and chunks, as one JSON text for each query."""
    item = F.transform("entities", lambda e: F.struct(e["name"].alias("name"), e["type"].alias("type"), e["score"].alias("score"), e["path_edge_types"].alias("path_edge_types")))
    part = F.transform("chunks", lambda c: F.struct(c["text"].alias("text"), c["title"].alias("source_doc"), c["doc_id"].alias("doc_id"), c["score"].alias("score")))
    whole = F.struct(item.alias("results"), F.size("entities").alias("touched_entity_count"), F.coalesce(part, F.from_json(F.lit("[]"), "array<struct<text: string, source_doc: string, doc_id: bigint, score: double>>")).alias("chunks"))
    return _search(spark, sf_dir).select("query_id", F.to_json(whole).alias("result"))


def search_text(spark, sf_dir):
    """The hybrid result as a block of text for each query."""
    return _search(spark, sf_dir).select("query_id", text.search_block(F.col("entities"), F.col("chunks")).alias("result"))


def retriever_rows(spark, sf_dir):
    """The entities and then the chunks of each query as documents."""
    memory = M.vector_memory(spark, sf_dir)
    found, chunks = retrieve.search(memory, M.vector_queries(spark, sf_dir), F.expr(M.NOW))
    return retrieve.as_documents(graph.held(found), chunks, memory.entities, M.passages(spark, sf_dir)).withColumn("score", F.round("score", 6))


def scoped_retrieve(spark, sf_dir):
    """Hybrid results whose entity has an odd number, filtered after the search and before the cut."""
    memory = M.vector_memory(spark, sf_dir)
    queries = M.vector_queries(spark, sf_dir)
    odd = memory.entities.where("substr(entity_id, -1) IN ('1', '3', '5', '7', '9')").select("entity_id")
    found, _ = retrieve.search(memory, queries, F.expr(M.NOW), hops=2, limit=10, allowed_entities=odd)
    return found.select("query_id", "entity_id", F.round("score", 6).alias("score"), "rank")


def vector_only_retrieve(spark, sf_dir):
    found = retrieve.vector_only(M.vector_memory(spark, sf_dir), M.vector_queries(spark, sf_dir))
    return found.withColumn("sim", F.round("sim", 6))


def graph_only_retrieve(spark, sf_dir):
    """Questions that end in a region's name."""
    asked = M.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("query_id"), F.concat(F.lit("Who is in "), "r_name", F.lit("?")).alias("question"))
    edges = M.star_edges(spark, sf_dir).withColumn("valid_until", F.lit(None).cast("timestamp"))
    return retrieve.graph_only(asked, M.star_entities(spark, sf_dir), edges, 3)


def reinforce_log(spark, sf_dir):
    """What a search touches: entities and edges on their paths."""
    memory = M.vector_memory(spark, sf_dir)
    found, _ = retrieve.search(memory, M.vector_queries(spark, sf_dir), F.expr(M.NOW))
    return retrieve.touched(found, F.expr(M.NOW))


def status_counts(spark, sf_dir):
    names = ("documents", "conversations", "customer", "supplier", "part")
    return status.counts({n: M.table(spark, sf_dir, n) for n in names})


def status_relations(spark, sf_dir):
    edges = facts.subject_keyed(M.order_assertions(spark, sf_dir)).withColumn("created_by", F.when(F.col("subject") % 3 == 0, "agent").otherwise("ingest"))
    return status.relation_counts(edges)


def status_top_entities(spark, sf_dir):
    edges = M.star_edges(spark, sf_dir).withColumns({"valid_until": F.lit(None).cast("timestamp"), "access_count": F.length("object_id").cast("long")})
    return status.top_entities(M.star_entities(spark, sf_dir), edges, 5)


def status_recent_writes(spark, sf_dir):
    edges = facts.subject_keyed(M.order_assertions(spark, sf_dir)).withColumn("edge_id", F.concat_ws("-", "subject", "version"))
    return status.recent_writes(edges, 5).select("edge_id", "object", "valid_from")


def status_recent_conversations(spark, sf_dir):
    turns = M.turns(spark, sf_dir)
    found = status.recent_conversations(provenance.merge_conversations(turns), turns, 3)
    return found.select("session_id", "title", "turns", "last_turn")


def entity_lookup_ci(spark, sf_dir):
    return status.lookup(M.star_entities(spark, sf_dir), "aSIa").select("entity_id", "name", "type")


def path_render(spark, sf_dir):
    """Paths of retrieval results as labels, with headers."""
    memory = M.vector_memory(spark, sf_dir)
    found, _ = retrieve.search(memory, M.vector_queries(spark, sf_dir), F.expr(M.NOW))
    labels = retrieve.labels_of(F.col("path"))
    named = found.join(memory.entities.select("entity_id", "name", "type"), "entity_id")
    return named.select("query_id", "rank", text.entity_header(F.col("name"), F.col("type"), F.col("distance"), labels).alias("header"))


def transcripts(spark, sf_dir):
    """Conversations as text, a line for each turn."""
    t = M.turns(spark, sf_dir)
    lines = t.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn_id", text.transcript_line(F.col("role"), F.col("text")).alias("line")))).alias("l"))
    return lines.select("session_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("transcript"))


def _results(spark, sf_dir):
    found = retrieve.vector_only(M.vector_memory(spark, sf_dir), M.vector_queries(spark, sf_dir), limit=10)
    return found.select(F.col("query_id").alias("question_id"), "rank", F.col("entity_id").alias("name"))


def _wanted(spark, sf_dir):
    return M.vector_queries(spark, sf_dir).select(F.col("query_id").alias("question_id"), F.concat(F.lit("e0000000"), F.col("type")).alias("wanted"))


def eval_pk_mrr(spark, sf_dir):
    """Hit rate and reciprocal rank of vector search, a hit being an entity whose number starts with the query's label."""
    first = evals.first_hits(_results(spark, sf_dir), _wanted(spark, sf_dir))
    return evals.hit_rate_and_mrr(first).select("questions", F.round("hit_rate", 6).alias("hit_rate"), F.round("mrr", 6).alias("mrr"))


def eval_by_hops(spark, sf_dir):
    """The same by bands of questions, as by the hops that they need; a question's band is its number's remainder."""
    first = evals.first_hits(_results(spark, sf_dir), _wanted(spark, sf_dir)).withColumn("hops", F.col("question_id") / 50 % 3 + 1)
    return evals.hit_rate_and_mrr(first, "hops").select(F.col("hops").cast("int").alias("hops"), "questions", F.round("hit_rate", 6).alias("hit_rate"), F.round("mrr", 6).alias("mrr"))


def chunk_baseline(spark, sf_dir):
    """Search of chunks alone, ten for each query: the share of them with the query's label, and the first one's rank."""
    memory, asked = M.vector_memory(spark, sf_dir), M.vector_queries(spark, sf_dir)
    found = graph.held(vectors.top_k(asked, memory.chunks, 10, "chunk_id").select(F.col("query_id").alias("question_id"), "rank", F.col("chunk_id").alias("item")))
    labels = M.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("K"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("item"), F.col("label").cast("string").alias("type"))
    # Of the items of a query's label those that it found.
    relevant = labels.join(F.broadcast(found), "item").join(asked.select(F.col("query_id").alias("question_id"), "type"), ["question_id", "type"]).select("question_id", "item")
    first = found.join(relevant, ["question_id", "item"], "left_semi").groupBy("question_id").agg(F.min("rank").alias("first_rank"))
    return evals.precision_at(found, relevant, 10).join(first, "question_id", "left")


def eval_prf1(spark, sf_dir):
    """Customers' live priority against the one they asked for most often."""
    live = facts.current(facts.subject_keyed(M.order_assertions(spark, sf_dir))).select("subject", "object")
    often = M.order_assertions(spark, sf_dir).groupBy("subject", "object").count()
    truth = often.groupBy("subject").agg(F.max_by("object", F.struct("count", "object")).alias("object"))
    return evals.match_scores(live, truth, ["subject", "object"]).select("tp", "found", "truth", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def eval_precision_at(spark, sf_dir):
    results = graph.held(_results(spark, sf_dir).withColumnRenamed("name", "item"))
    q = M.vector_queries(spark, sf_dir).select(F.col("query_id").alias("question_id"), F.col("type").alias("label"))
    items = M.vector_memory(spark, sf_dir).entities.select(F.col("entity_id").alias("item"), F.col("type").alias("label"))
    relevant = items.join(F.broadcast(results), "item").join(q, ["question_id", "label"]).select("question_id", "item")
    return evals.precision_at(results, relevant, 5)


def status_summary(spark, sf_dir):
    """All that a status tells, in one row; relations are the star schema's, those of suppliers written by agents and every third of customers' superseded."""
    at = F.expr("timestampadd(MINUTE, length(edge_id) * 7 % 60, TIMESTAMP_NTZ '2024-01-01 00:00:00')")
    number = F.substring("subject_id", 2, 20).cast("long")
    edges = M.star_edges(spark, sf_dir).withColumns({
        "created_by": F.when(F.col("subject_id").startswith("S"), "agent").otherwise("ingest"), "valid_from": at,
        "valid_until": F.when(F.col("subject_id").startswith("C") & (number % 3 == 0), at), "access_count": F.length("object_id").cast("long"),
    })
    turns = M.turns(spark, sf_dir)
    found = status.summary(M.table(spark, sf_dir, "documents"), M.star_entities(spark, sf_dir), edges, provenance.merge_conversations(turns), turns)
    listed = lambda c, *fields: F.array_join(F.transform(c, lambda x: F.concat_ws("/", *[x[f].cast("string") for f in fields])), ";").alias(c)
    return found.select(
        "entities", "documents", "live_relations", "superseded_relations", "conversations", "turns",
        listed("top_entities", "name", "type", "total"), listed("recent_agent_writes", "subject_id", "type", "object_id"), listed("recent_conversations", "session_id", "turns"),
    )


def graph_query(spark, sf_dir):
    """A guarded ad-hoc statement over the tables."""
    tables = {f"memory_{n}": M.table(spark, sf_dir, n) for n in ("supplier", "nation", "region")}
    statement = """WITH located AS (SELECT r_name, n_name, s_name FROM memory_supplier JOIN memory_nation ON s_nationkey = n_nationkey JOIN memory_region ON n_regionkey = r_regionkey)
        SELECT r_name, count(*) AS suppliers, count(DISTINCT n_name) AS nations FROM located WHERE length(s_name) > :least GROUP BY r_name"""
    return adhoc.run(spark, statement, tables, {"least": 1})


QUERIES = {
    f.__name__: f
    for f in (
        bfs_shortest, bfs_paths, all_paths_neighbors, reinforcement_score, score_candidate, seed_propagation, seed_hydration, hybrid_retrieve, retrieved_chunks, search_json, scoped_retrieve,
        vector_only_retrieve, graph_only_retrieve, reinforce_log, status_counts, status_relations, status_top_entities, status_recent_writes, status_recent_conversations, entity_lookup_ci,
        search_text, retriever_rows, path_render, transcripts, eval_pk_mrr, eval_by_hops, chunk_baseline, status_summary, eval_prf1, eval_precision_at, graph_query,
    )
}

_REACH = f"""WITH RECURSIVE {M.STAR},
walk AS (SELECT 'R' || r_regionkey AS seed, 'R' || r_regionkey AS node, 0 AS d FROM region
         UNION SELECT seed, dst, d + 1 FROM walk JOIN both_ways ON src = node WHERE d < {{hops}}),
reach AS (SELECT seed, node AS target, min(d) AS distance FROM walk GROUP BY ALL HAVING min(d) > 0)"""


def _boost(n: str, last: str) -> str:
    return f"CASE WHEN {n} <= 0 OR {last} IS NULL THEN 0.0 ELSE least(ln(1 + {n}) * exp(-ln(2) / 604800 * greatest((epoch_us(TIMESTAMP '2024-02-01') - epoch_us({last})) / 1e6, 0)), 2.0) END"


_SEARCH = M.MEMORY + f""",
live AS (SELECT edge_id, s AS src, o AS dst, confidence, n, la FROM rel WHERE NOT dead AND s <> o UNION ALL SELECT edge_id, o, s, confidence, n, la FROM rel WHERE NOT dead AND s <> o),
p1 AS (SELECT query_id, entity_id AS seed, sim, dst AS target, edge_id AS path, confidence AS conf, {_boost('n', 'la')} AS eb FROM alive JOIN live ON src = entity_id
       QUALIFY row_number() OVER (PARTITION BY query_id, entity_id, dst ORDER BY edge_id) = 1),
p2 AS (SELECT query_id, seed, sim, l.dst AS target, path || '>' || l.edge_id AS path, (conf + confidence) / 2 AS conf, greatest(eb, {_boost('n', 'la')}) AS eb
       FROM p1 JOIN live l ON l.src = p1.target WHERE l.dst <> seed AND (query_id, seed, l.dst) NOT IN (SELECT (query_id, seed, target) FROM p1)
       QUALIFY row_number() OVER (PARTITION BY query_id, seed, l.dst ORDER BY path, l.edge_id) = 1),
cand AS (SELECT query_id, entity_id AS target, sim, 0 AS distance, 0.0 AS conf, 0.0 AS eb, '' AS path FROM alive
         UNION ALL SELECT query_id, target, sim, 1, conf, eb, path FROM p1 UNION ALL SELECT query_id, target, sim, 2, conf, eb, path FROM p2),
boosted AS (SELECT cand.*, least(greatest(eb, {_boost('access_count', 'last_accessed')}), 2.0) AS boost FROM cand JOIN ent ON ent.entity_id = target),
scored AS (SELECT *, (least(greatest(sim, 0), 1) + 0.8 / (1 + distance) + 0.3 * least(greatest(conf, 0), 1)) * (1 + 0.2 * boost) AS score FROM boosted),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, target ORDER BY score DESC, distance, sim DESC) = 1),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, distance, target) AS INTEGER) AS rank FROM best)"""
_VECTOR_ONLY = M.MEMORY + """,
vo AS (SELECT query_id, entity_id, sim FROM direct UNION ALL SELECT query_id, entity_id, 0.0 FROM through WHERE (query_id, entity_id) NOT IN (SELECT (query_id, entity_id) FROM direct)),
vr AS (SELECT query_id, entity_id, sim, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, entity_id) AS INTEGER) AS rank FROM vo)"""
_ISLANDS = f"""WITH {M.ORDERS},
b AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> object THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY ts, k) AS version FROM a),
i AS (SELECT subject, CAST(version AS BIGINT) AS version, any_value(object) AS object, min(ts) AS valid_from FROM b GROUP BY subject, version),
edges AS (SELECT *, lead(valid_from) OVER (PARTITION BY subject ORDER BY version) AS valid_until, row_number() OVER (PARTITION BY subject ORDER BY version DESC) = 1 AS live FROM i)
"""
#: Ranked entities as they are shown, and the chunks that come with them.
_SHOWN = """steps AS (SELECT query_id, target, unnest(string_split(path, '>')) AS edge_id, generate_subscripts(string_split(path, '>'), 1) AS i FROM ranked WHERE rank <= 10 AND path <> ''),
        vias AS (SELECT query_id, target, string_agg(text, ' → ' ORDER BY i) AS via, string_agg('"' || regexp_extract(text, '^T[0-9]+') || '"', ',' ORDER BY i) AS types FROM steps JOIN lab USING (edge_id) GROUP BY ALL),
        shown AS (SELECT r.query_id, r.rank, r.target, r.score, 'v' || e.vec_id AS name, CAST(label AS VARCHAR) AS label, via, types,
                  'v' || e.vec_id || ' (' || label || ') ' || CASE WHEN r.distance = 0 THEN '[seed]' ELSE '[' || r.distance || ' hops via ' || via || ']' END AS header
                  FROM ranked r LEFT JOIN vias USING (query_id, target) JOIN e ON e.vec_id = CAST(substr(r.target, 2) AS BIGINT) WHERE rank <= 10),
        said AS (SELECT query_id, 'K' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS chunk_id, vec_id % 100 AS doc_id, 'passage K' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS text, round(sim, 6) AS score,
                 CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS INTEGER) AS rank FROM direct QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 3)"""
ORACLES = {
    "bfs_shortest": _REACH.format(hops=5) + " SELECT * FROM reach",
    "bfs_paths": _REACH.format(hops=2) + """, one AS (SELECT 'R' || r_regionkey AS seed, dst AS target, min(edge_id) AS path FROM region JOIN both_ways ON src = 'R' || r_regionkey GROUP BY ALL),
        two AS (SELECT seed, dst AS target, arg_min(path || '>' || edge_id, (path, edge_id)) AS path FROM one JOIN both_ways ON src = target GROUP BY seed, dst)
        SELECT seed, target, distance, CASE distance WHEN 1 THEN one.path ELSE two.path END AS path FROM reach LEFT JOIN one USING (seed, target) LEFT JOIN two USING (seed, target)""",
    "all_paths_neighbors": f"""WITH {M.STAR}, {M.STAR_ENTITIES}, one AS (SELECT 'R' || r_regionkey AS seed, dst AS target, 1 AS distance, [edge_id] AS path FROM region JOIN both_ways ON src = 'R' || r_regionkey),
        two AS (SELECT seed, dst AS target, 2 AS distance, list_append(path, edge_id) AS path FROM one JOIN both_ways ON src = target WHERE NOT list_contains(path, edge_id))
        SELECT seed, target, name, distance, array_to_string(path, '>') AS path FROM (SELECT * FROM one UNION ALL SELECT * FROM two) JOIN ents ON entity_id = target WHERE target <> seed
        QUALIFY row_number() OVER (PARTITION BY seed ORDER BY distance, name, path) <= 25""",
    "reinforcement_score": f"SELECT user_id, event_type, count(*) AS n, round({_boost('count(*)', 'max(ts)')}, 6) AS boost FROM events GROUP BY user_id, event_type",
    "score_candidate": f"SELECT event_id, round((least(greatest(value / 80, 0), 1) + 0.8 / (1 + event_id % 4) + 0.3 * least(greatest(user_id % 10 / 10, 0), 1)) * (1 + 0.2 * {_boost('event_id % 9', 'ts')}), 6) AS score FROM events",
    "seed_propagation": f"WITH {M.MEMORY} SELECT query_id, entity_id, round(sim, 6) AS sim FROM seeds",
    "seed_hydration": f"WITH {M.MEMORY} SELECT entity_id FROM ent WHERE entity_id NOT IN (SELECT entity_id FROM ends GROUP BY 1 HAVING bool_and(dead))",
    "hybrid_retrieve": f"WITH {_SEARCH} SELECT query_id, target AS entity_id, distance, round(sim, 6) AS sim, round(CAST(conf AS DOUBLE), 6) AS edge_confidence, round(boost, 6) AS boost, round(score, 6) AS score, path, rank FROM ranked WHERE rank <= 10",
    "retrieved_chunks": f"WITH {M.MEMORY} SELECT query_id, 'K' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS chunk_id, round(sim, 6) AS sim, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS INTEGER) AS rank FROM direct QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 3",
    "scoped_retrieve": f"WITH {_SEARCH} SELECT query_id, target AS entity_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, distance, target) AS INTEGER) AS rank FROM best WHERE right(target, 1) IN ('1', '3', '5', '7', '9') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, distance, target) <= 10",
    "vector_only_retrieve": f"WITH {_VECTOR_ONLY} SELECT query_id, entity_id, round(sim, 6) AS sim, rank FROM vr",
    "graph_only_retrieve": _REACH.format(hops=3) + f""", {M.STAR_ENTITIES},
        met AS (SELECT r_regionkey AS query_id, entity_id AS seed FROM region JOIN ents ON contains(lower(name), lower(regexp_extract(r_name, '(\\w+)\\W*$', 1))) QUALIFY row_number() OVER (PARTITION BY r_regionkey ORDER BY name, entity_id) <= 5),
        w AS (SELECT query_id, seed, seed AS node, 0 AS d FROM met), w1 AS (SELECT DISTINCT query_id, seed, dst AS node, 1 AS d FROM w JOIN both_ways ON src = node),
        w2 AS (SELECT DISTINCT query_id, seed, dst AS node, 2 AS d FROM w1 JOIN both_ways ON src = node),
        w3 AS (SELECT DISTINCT query_id, seed, dst AS node, 3 AS d FROM w2 JOIN both_ways ON src = node),
        per AS (SELECT query_id, seed, node, min(d) AS d FROM (SELECT * FROM w UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3) GROUP BY ALL HAVING min(d) > 0)
        SELECT query_id, node AS target, min(d) AS distance FROM per GROUP BY query_id, node""",
    "reinforce_log": f"""WITH {_SEARCH} SELECT DISTINCT 'entity' AS kind, target AS id, TIMESTAMP '2024-02-01' AS ts FROM ranked WHERE rank <= 10
        UNION SELECT 'edge', unnest(string_split(path, '>')), TIMESTAMP '2024-02-01' FROM ranked WHERE rank <= 10 AND path <> ''""",
    "status_counts": "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM conversations) AS conversations, (SELECT count(*) FROM customer) AS customer, (SELECT count(*) FROM supplier) AS supplier, (SELECT count(*) FROM part) AS part",
    "status_relations": _ISLANDS + "SELECT count(*) FILTER (live) AS live, count(*) FILTER (NOT live) AS superseded, count(*) FILTER (live AND subject % 3 = 0) AS by_agent FROM edges",
    "status_top_entities": f"""WITH {M.STAR}, {M.STAR_ENTITIES}, n AS (SELECT s AS id, length(o) AS n FROM star UNION ALL SELECT o, length(o) FROM star)
        SELECT name, type, CAST(sum(n) AS BIGINT) AS total FROM n JOIN ents ON entity_id = id GROUP BY name, type ORDER BY total DESC, name, type LIMIT 5""",
    "status_recent_writes": _ISLANDS + "SELECT subject || '-' || version AS edge_id, object, valid_from FROM edges ORDER BY valid_from DESC, edge_id LIMIT 5",
    "status_recent_conversations": f"""WITH {M.TURNS} SELECT session_id, 'agent:' || strftime(min(ts), '%Y%m%dT%H%M%SZ') || ':' || substr(sha256(CAST(session_id AS VARCHAR)), 1, 8) AS title, count(*) AS turns, max(ts) AS last_turn
        FROM turns GROUP BY session_id ORDER BY last_turn DESC, session_id LIMIT 3""",
    "entity_lookup_ci": f"WITH {M.STAR_ENTITIES} SELECT * FROM ents WHERE lower(name) = 'asia' ORDER BY name, type LIMIT 5",
    "path_render": f"""WITH {_SEARCH}, {_SHOWN} SELECT query_id, rank, header FROM shown""",
    "retriever_rows": f"""WITH {_SEARCH}, {_SHOWN} SELECT query_id, 'entity' AS kind, rank AS position, target AS id, header AS content, round(score, 6) AS score FROM shown
        UNION ALL SELECT query_id, 'chunk', (SELECT max(rank) FROM shown WHERE shown.query_id = said.query_id) + rank, chunk_id, text, score FROM said""",
    "search_json": f"""WITH {_SEARCH}, {_SHOWN},
        a AS (SELECT query_id, count(*) AS n, string_agg('{{"name":"' || name || '","type":"' || label || '","score":' || round(score, 6) || ',"path_edge_types":[' || coalesce(types, '') || ']}}', ',' ORDER BY rank) AS j FROM shown GROUP BY query_id),
        b AS (SELECT query_id, string_agg('{{"text":"' || text || '","source_doc":"doc ' || doc_id || '","doc_id":' || doc_id || ',"score":' || score || '}}', ',' ORDER BY rank) AS j FROM said GROUP BY query_id)
        SELECT query_id, '{{"results":[' || a.j || '],"touched_entity_count":' || n || ',"chunks":[' || coalesce(b.j, '') || ']}}' AS result FROM a LEFT JOIN b USING (query_id)""",
    "search_text": f"""WITH {_SEARCH}, {_SHOWN},
        a AS (SELECT query_id, string_agg('- ' || name || ' (' || label || ')' || CASE WHEN via IS NULL THEN '' ELSE ' [via ' || via || ']' END, chr(10) ORDER BY rank) AS j FROM shown GROUP BY query_id),
        b AS (SELECT query_id, string_agg('[doc ' || doc_id || ']' || chr(10) || text, chr(10) ORDER BY rank) AS j FROM said GROUP BY query_id)
        SELECT query_id, '## Entities' || chr(10) || a.j || coalesce(chr(10) || chr(10) || '## Source Passages' || chr(10) || b.j, '') AS result FROM a LEFT JOIN b USING (query_id)""",
    "transcripts": "SELECT conv_id AS session_id, string_agg('[' || upper(role) || '] ' || text, chr(10) || chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id",
    "eval_pk_mrr": f"""WITH {_VECTOR_ONLY}, f AS (SELECT query_id, (SELECT min(rank) FROM vr WHERE vr.query_id = q.query_id AND rank <= 10 AND contains(lower(entity_id), 'e0000000' || qlabel)) AS r FROM q)
        SELECT count(*) AS questions, round(avg(CASE WHEN r IS NULL THEN 0.0 ELSE 1.0 END), 6) AS hit_rate, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM f""",
    "eval_by_hops": f"""WITH {_VECTOR_ONLY}, f AS (SELECT CAST(query_id / 50 AS BIGINT) % 3 + 1 AS hops, (SELECT min(rank) FROM vr WHERE vr.query_id = q.query_id AND rank <= 10 AND contains(lower(entity_id), 'e0000000' || qlabel)) AS r FROM q)
        SELECT CAST(hops AS INTEGER) AS hops, count(*) AS questions, round(avg(CASE WHEN r IS NULL THEN 0.0 ELSE 1.0 END), 6) AS hit_rate, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM f GROUP BY hops""",
    "chunk_baseline": f"""WITH {M.VECTORS}, t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS INTEGER) AS rank FROM sims QUALIFY rank <= 10)
        SELECT query_id AS question_id, count(*) FILTER (label = qlabel) / 10 AS precision, min(rank) FILTER (label = qlabel) AS first_rank FROM t GROUP BY query_id""",
    "status_summary": f"""WITH {M.STAR}, {M.STAR_ENTITIES}, {M.TURNS},
        edge AS (SELECT *, type || '-' || s || '-' || o AS edge_id, s LIKE 'C%' AND CAST(substr(s, 2) AS BIGINT) % 3 = 0 AS dead, s LIKE 'S%' AS agent FROM star),
        n AS (SELECT s AS id, length(o) AS n FROM edge WHERE NOT dead UNION ALL SELECT o, length(o) FROM edge WHERE NOT dead),
        top AS (SELECT name, type, CAST(sum(n) AS BIGINT) AS total FROM n JOIN ents ON entity_id = id GROUP BY name, type ORDER BY total DESC, name, type LIMIT 5),
        recent AS (SELECT *, length(edge_id) * 7 % 60 AS written FROM edge WHERE agent ORDER BY written DESC, edge_id LIMIT 5),
        talks AS (SELECT session_id, count(*) AS n, max(ts) AS last FROM turns GROUP BY session_id ORDER BY last DESC, session_id LIMIT 3)
        SELECT (SELECT count(*) FROM ents) AS entities, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM edge WHERE NOT dead) AS live_relations, (SELECT count(*) FROM edge WHERE dead) AS superseded_relations,
               (SELECT count(DISTINCT session_id) FROM turns) AS conversations, (SELECT count(*) FROM turns) AS turns,
               (SELECT string_agg(name || '/' || type || '/' || total, ';' ORDER BY total DESC, name, type) FROM top) AS top_entities,
               (SELECT string_agg(s || '/' || type || '/' || o, ';' ORDER BY written DESC, edge_id) FROM recent) AS recent_agent_writes,
               (SELECT string_agg(session_id || '/' || n, ';' ORDER BY last DESC, session_id) FROM talks) AS recent_conversations""",
    "eval_prf1": _ISLANDS + """, truth AS (SELECT subject, arg_max(object, (n, object)) AS object FROM (SELECT o_custkey AS subject, o_orderpriority AS object, count(*) AS n FROM orders GROUP BY ALL) GROUP BY subject),
        found AS (SELECT subject, object FROM edges WHERE live), c AS (SELECT (SELECT count(*) FROM found JOIN truth USING (subject, object)) AS tp, (SELECT count(*) FROM found) AS found, (SELECT count(*) FROM truth) AS truth)
        SELECT tp, found, truth, round(tp / found, 6) AS precision, round(tp / truth, 6) AS recall, round(2 * (tp / found) * (tp / truth) / (tp / found + tp / truth), 6) AS f1 FROM c""",
    "eval_precision_at": f"WITH {_VECTOR_ONLY} SELECT vr.query_id AS question_id, count(*) FILTER (e.label = q.qlabel) / 5 AS precision FROM vr JOIN q USING (query_id) JOIN e ON e.vec_id = CAST(substr(vr.entity_id, 2) AS BIGINT) WHERE rank <= 5 GROUP BY vr.query_id",
    "graph_query": "SELECT r_name, count(*) AS suppliers, count(DISTINCT n_name) AS nations FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE length(s_name) > 1 GROUP BY r_name",
}
