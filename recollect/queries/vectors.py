"""Queries over vectors: search, coercion and resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import coerce, provenance, vectors
from . import model as M


def _items(spark, sf_dir):
    return M.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", F.col("label").cast("string").alias("type"))


def vector_topk(spark, sf_dir):
    found = vectors.top_k(M.vector_queries(spark, sf_dir), _items(spark, sf_dir), 5)
    return found.withColumn("sim", F.round("sim", 6))


def vector_topk_typed(spark, sf_dir):
    found = vectors.top_k(M.vector_queries(spark, sf_dir), _items(spark, sf_dir), 5, same_type=True)
    return found.withColumn("sim", F.round("sim", 6))


def _centroids(spark, sf_dir):
    rows = M.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    listed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("l"))
    return listed.select(F.col("label").cast("string").alias("canonical"), F.transform("l", lambda x: x["m"]).alias("embedding"))


def coerce_by_centroid(spark, sf_dir):
    """Every vector's nearest label centroid, as types are coerced by descriptors; below 0.3 the raw one stays."""
    raw = M.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("raw-"), F.col("vec_id").cast("string")).alias("raw"), "embedding")
    found = coerce.coerce_entity_types(raw, _centroids(spark, sf_dir), 0.3)
    return found.select("raw", "type", F.round("sim", 5).alias("sim"))


#: Raw relation types of every kind: blank, synonyms, canonical ones and novel ones, in any case and spacing.
RAW_TYPES = ("", "  ", "works at", "EMPLOYED_BY", "uses", "RUNS ON", "HAS_TITLE", "created", "LIVES_IN", "located in", "sponsored", "HAS_RIVAL", "rides with", "MENTORED", "FAMILY_OF", "approved")


def coerce_relation_type(spark, sf_dir):
    """Raw types stand for the first vectors and canonical ones for those from the hundredth on; nearness is asked for as low as such vectors come."""
    listed = spark.createDataFrame(list(enumerate(RAW_TYPES)), "vec_id long, raw string")
    known = spark.createDataFrame([(100 + n, c) for n, c in enumerate(V.RELATION_TYPES)], "vec_id long, canonical string")
    rows = M.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = coerce.coerce_relation_types(listed.join(rows, "vec_id").select("raw", "embedding"), known.join(rows, "vec_id").select("canonical", "embedding"), 0.2, 0.25)
    return found.select("raw", "type", F.round("sim", 6).alias("sim"))


def _mentions(spark, sf_dir, kind=None):
    q = M.vector_queries(spark, sf_dir).withColumnRenamed("query_id", "mention_id")
    return q.withColumn("type", F.lit(kind)) if kind else q


def _stored(spark, sf_dir):
    """The rows that aren't mentions, which stand for what was stored before the mentions came; so a mention never resolves to another mention."""
    return M.table(spark, sf_dir, "embeddings").where("vec_id % 50 <> 0").select(F.col("vec_id").alias("entity_id"), F.col("label").cast("string").alias("type"), "embedding")


def resolve_threshold(spark, sf_dir):
    found = coerce.resolve_entities(_mentions(spark, sf_dir), _stored(spark, sf_dir), 0.3, 0.35)
    return found.withColumn("sim", F.round("sim", 6))


def resolve_unknown_type(spark, sf_dir):
    found = coerce.resolve_entities(_mentions(spark, sf_dir, "Unknown"), _stored(spark, sf_dir), 0.3, 0.33)
    return found.withColumn("sim", F.round("sim", 6))


def alias_stubs(spark, sf_dir):
    """Aliases that resolution finds: lists on the entities, stubs and same-as edges, as rows of one table."""
    stored = _stored(spark, sf_dir).withColumns({"entity_id": F.concat(F.lit("e"), F.col("entity_id").cast("string")), "name": F.concat(F.lit("name "), F.col("entity_id").cast("string")), "aliases": F.array().cast("array<string>")})
    found = coerce.resolve_entities(_mentions(spark, sf_dir), stored, 0.3, 0.35).where("NOT is_new")
    resolved = found.select(F.concat(F.lit("alias "), F.col("mention_id").cast("string")).alias("alias"), F.col("entity_id").alias("canonical_id"), "sim")
    entities, stubs, same_as = provenance.add_aliases(stored, resolved)
    a = entities.where("size(aliases) > 0").select(F.lit("entity").alias("kind"), F.col("entity_id").alias("a"), F.array_join("aliases", ",").alias("b"))
    b = stubs.select(F.lit("stub").alias("kind"), F.col("entity_id").alias("a"), F.col("name").alias("b"))
    c = same_as.select(F.lit("same_as").alias("kind"), F.col("alias_id").alias("a"), F.col("canonical_id").alias("b"))
    return a.unionByName(b).unionByName(c)


def entity_merge(spark, sf_dir):
    """Entities by name and type from a log of assertions: the first attributes, a count of those that follow."""
    e = M.table(spark, sf_dir, "events")
    log = e.select(F.col("user_id").cast("string").alias("name"), F.col("event_type").alias("type"), F.struct("ts", "event_id").alias("seq"), "ts", F.round("value", 4).alias("confidence"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("source_doc"))
    return provenance.merge_entities(log)


def touch_counters(spark, sf_dir):
    base = M.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_nationkey").cast("long").alias("access_count"), F.lit(None).cast("timestamp_ntz").alias("last_accessed"))
    log = M.table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), "ts")
    return provenance.touched(base, log, "entity_id")


QUERIES = {
    f.__name__: f
    for f in (vector_topk, vector_topk_typed, coerce_by_centroid, resolve_threshold, resolve_unknown_type, coerce_relation_type, alias_stubs, entity_merge, touch_counters)
}

_RESOLVED = f"""WITH {M.VECTORS}, best AS (SELECT query_id, vec_id, sim FROM sims WHERE vec_id % 50 <> 0 {{typed}} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) = 1)"""
_ID = "sha256({a} || chr(0) || {b})"
_RAW = ", ".join(f"({n}, '{r}')" for n, r in enumerate(RAW_TYPES))
_CANONICAL = ", ".join(f"({100 + n}, '{c}')" for n, c in enumerate(V.RELATION_TYPES))
_SYNONYM = ", ".join(f"('{s}', '{c}')" for c, every in V.RELATION_SYNONYMS.items() for s in every)
ORACLES = {
    "coerce_relation_type": f"""WITH raws(vec_id, raw) AS (VALUES {_RAW}), known(vec_id, canonical) AS (VALUES {_CANONICAL}), synonym(s, c) AS (VALUES {_SYNONYM}),
        r AS (SELECT raw, replace(upper(trim(raw)), ' ', '_') AS shaped, embedding::DOUBLE[] AS v FROM raws JOIN embeddings USING (vec_id)),
        k AS (SELECT canonical, embedding::DOUBLE[] AS v FROM known JOIN embeddings USING (vec_id)),
        sims AS (SELECT raw, canonical, list_cosine_similarity(r.v, k.v) AS sim FROM r, k),
        best AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY raw ORDER BY sim DESC, canonical) = 1),
        own AS (SELECT s.raw, s.sim AS own FROM sims s JOIN r USING (raw) WHERE s.canonical = r.shaped)
        SELECT raw, CASE WHEN shaped = '' THEN 'RELATED_TO' WHEN c IS NOT NULL THEN c WHEN own IS NOT NULL THEN CASE WHEN sim >= own + 0.25 THEN canonical ELSE shaped END WHEN sim >= 0.2 THEN canonical ELSE shaped END AS type,
               round(CASE WHEN shaped = '' THEN 0.0 WHEN c IS NOT NULL THEN 1.0 WHEN own IS NOT NULL THEN CASE WHEN sim >= own + 0.25 THEN sim ELSE 1.0 END ELSE sim END, 6) AS sim
        FROM r JOIN best USING (raw) LEFT JOIN own USING (raw) LEFT JOIN synonym ON shaped = s""",
    "vector_topk": f"WITH {M.VECTORS} SELECT query_id, vec_id AS item_id, round(sim, 6) AS sim, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS INTEGER) AS rank FROM sims QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 5",
    "vector_topk_typed": f"WITH {M.VECTORS} SELECT query_id, vec_id AS item_id, round(sim, 6) AS sim, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS INTEGER) AS rank FROM sims WHERE label = qlabel QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 5",
    "coerce_by_centroid": f"""WITH {M.VECTORS}, x AS (SELECT label, unnest(range(1, 65)) AS i, unnest(v) AS x FROM e), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL),
        c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label),
        b AS (SELECT vec_id, CAST(c.label AS VARCHAR) AS type, list_cosine_similarity(v, c) AS sim FROM e, c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, CAST(c.label AS VARCHAR)) = 1)
        SELECT 'raw-' || vec_id AS raw, CASE WHEN sim >= 0.3 THEN type ELSE 'raw-' || vec_id END AS type, CASE WHEN sim >= 0.3 THEN round(sim, 5) ELSE 0.0 END AS sim FROM b""",
    "resolve_threshold": _RESOLVED.format(typed="AND label = qlabel") + " SELECT q.query_id AS mention_id, vec_id AS entity_id, round(sim, 6) AS sim, vec_id IS NULL AS is_new FROM q LEFT JOIN best ON q.query_id = best.query_id AND sim >= 0.3",
    "resolve_unknown_type": _RESOLVED.format(typed="") + " SELECT q.query_id AS mention_id, vec_id AS entity_id, round(sim, 6) AS sim, vec_id IS NULL AS is_new FROM q LEFT JOIN best ON q.query_id = best.query_id AND sim >= 0.33",
    "alias_stubs": f"""WITH {M.VECTORS}, best AS (SELECT query_id, 'e' || vec_id AS id, CAST(label AS VARCHAR) AS type, sim FROM sims WHERE vec_id % 50 <> 0 AND label = qlabel
            QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, 'e' || vec_id) = 1), r AS (SELECT id, type, 'alias ' || query_id AS alias FROM best WHERE sim >= 0.3)
        SELECT 'entity' AS kind, id AS a, string_agg(alias, ',' ORDER BY alias) AS b FROM r GROUP BY id UNION ALL SELECT DISTINCT 'stub', {_ID.format(a='alias', b='type')}, alias FROM r
        UNION ALL SELECT 'same_as', {_ID.format(a='alias', b='type')}, id FROM r""",
    "entity_merge": f"""SELECT {_ID.format(a='CAST(user_id AS VARCHAR)', b='event_type')} AS entity_id, CAST(user_id AS VARCHAR) AS name, event_type AS type, arg_min(round(value, 4), (ts, event_id)) AS confidence,
        'e' || arg_min(event_id, (ts, event_id)) AS source_doc, count(*) - 1 AS access_count, min(ts) AS created_at, CASE WHEN count(*) > 1 THEN max(ts) END AS last_accessed FROM events GROUP BY user_id, event_type""",
    "touch_counters": """SELECT c_custkey AS entity_id, c_nationkey + coalesce(n, 0) AS access_count, t AS last_accessed
        FROM customer LEFT JOIN (SELECT user_id, count(*) AS n, max(ts) AS t FROM events GROUP BY user_id) ON user_id = c_custkey""",
}
