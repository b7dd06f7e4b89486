"""Queries over versioned facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts
from . import model as M


def _edge_columns(edges, *more):
    return edges.select("subject", "object", *more, "access_count", "valid_from", "valid_until")


def _source_docs(edges):
    return edges.withColumn("n_docs", F.size("source_docs").cast("long")).withColumn("first_doc", F.get("source_docs", F.lit(0)))


def relation_additive(spark, sf_dir):
    l = M.table(spark, sf_dir, "lineitem")  # noqa: E741
    rows = l.select(
        F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("seq"), F.col("l_shipdate").alias("ts"), F.col("l_suppkey").alias("subject"), F.lit("USES").alias("type"),
        F.col("l_partkey").alias("object"), F.col("l_discount").alias("confidence"), F.concat(F.lit("o"), "l_orderkey").alias("source_doc"), F.col("l_returnflag").alias("subtype"),
    )
    return _source_docs(facts.additive(rows)).select("subject", "object", "access_count", "valid_from", "last_accessed", "confidence", "subtype", "n_docs", "first_doc")


def relation_subject_keyed(spark, sf_dir):
    edges = _source_docs(facts.subject_keyed(M.order_assertions(spark, sf_dir)))
    return _edge_columns(edges, "version", "last_accessed", "confidence", "n_docs", "first_doc")


def relation_object_keyed(spark, sf_dir):
    return _edge_columns(facts.object_keyed(M.event_assertions(spark, sf_dir)), "version", "subtype")


def relation_subtype_keyed(spark, sf_dir):
    return _edge_columns(facts.subtype_keyed_single(M.brand_assertions(spark, sf_dir)), "version", "subtype")


def relation_subtype_fold(spark, sf_dir):
    """The general fold; events of a user as preferences by band, where an object comes under several subtypes."""
    rows = M.event_assertions(spark, sf_dir).withColumns({"type": F.lit("HAS_PREFERENCE")})
    return facts.subtype_keyed(rows).select("subject", "object", "subtype", "version", "valid_from", "valid_until", "access_count", "last_accessed")


def _agents(rows):
    """Every third order is an agent's, in a session by the day and a turn by the order."""
    agent = F.col("seq.o_orderkey") % 3 == 0
    return rows.withColumns({
        "created_by": F.when(agent, "agent").otherwise("ingest"), "session_id": F.when(agent, F.date_format("ts", "yyyyMMdd")),
        "turn_id": F.when(agent, F.concat(F.lit("t"), F.col("seq.o_orderkey").cast("string"))), "time_scope": F.when(F.col("seq.o_orderkey") % 4 == 0, F.date_format("ts", "yyyy")),
    })


def relation_provenance(spark, sf_dir):
    """Who made each edge, its sources with agents' marks, its qualifier, and how it is tied to the edges before and after."""
    edges = facts.subject_keyed(_agents(M.order_assertions(spark, sf_dir)))
    return edges.select("subject", "version", "edge_id", "created_by", "session_id", "turn_id", "time_scope", F.array_join("source_docs", ",").alias("sources"), "supersedes_edge_id", "superseded_by_doc")


def ingest_outcomes(spark, sf_dir):
    """Counts of what each document's assertions did; a document is a day's orders."""
    rows = M.order_assertions(spark, sf_dir).withColumn("source_doc", F.date_format("ts", "yyyy-MM-dd"))
    found = facts.outcome_of(rows, facts.subject_keyed(rows)).groupBy("source_doc").pivot("outcome", ["created", "reinforced", "superseded"]).count()
    return found.na.fill(0)


def superseded_of_type(spark, sf_dir):
    """How many edges of one type are superseded."""
    edges = facts.subject_keyed(M.order_assertions(spark, sf_dir))
    return facts.superseded(edges).where("type = 'BELONGS_TO'").agg(F.count(F.lit(1)).alias("n"))


def relation_outcomes(spark, sf_dir):
    return facts.outcomes(M.order_assertions(spark, sf_dir)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def current_facts(spark, sf_dir):
    return facts.current(facts.subject_keyed(M.order_assertions(spark, sf_dir))).select("subject", "object", "valid_from", "access_count")


def superseded_facts(spark, sf_dir):
    return facts.superseded(facts.subject_keyed(M.order_assertions(spark, sf_dir))).select("subject", "object", "valid_from", "valid_until")


def facts_as_of(spark, sf_dir):
    edges = facts.subject_keyed(M.order_assertions(spark, sf_dir))
    return facts.as_of(edges, F.expr("TIMESTAMP_NTZ '1996-06-01 00:00:00'")).select("subject", "object", "valid_from")


def latest_fact_label(spark, sf_dir):
    """Each subject's latest edge with a label that tells whether it is live."""
    edges = facts.subject_keyed(M.order_assertions(spark, sf_dir))
    last = edges.groupBy("subject").agg(F.max_by(F.struct("object", "valid_until"), "version").alias("e"))
    return last.select("subject", "e.object", F.when(F.col("e.valid_until").isNull(), "live").otherwise("superseded").alias("state"))


QUERIES = {
    f.__name__: f
    for f in (
        relation_additive, relation_subject_keyed, relation_object_keyed, relation_subtype_keyed, relation_subtype_fold, relation_outcomes, current_facts, superseded_facts, facts_as_of,
        latest_fact_label, relation_provenance, ingest_outcomes, superseded_of_type,
    )
}

_ISLANDS = f"""WITH {M.ORDERS},
b AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> object THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY ts, k) AS version FROM a),
i AS (SELECT subject, version, any_value(object) AS object, min(ts) AS valid_from, count(*) AS access_count, max(ts) AS last_accessed, max(confidence) AS confidence,
      count(DISTINCT k) AS n_docs, 'o' || arg_min(k, (ts, k)) AS first_doc FROM b GROUP BY subject, version),
edges AS (SELECT *, lead(valid_from) OVER (PARTITION BY subject ORDER BY version) AS valid_until FROM i)
"""
ORACLES = {
    "relation_additive": """SELECT l_suppkey AS subject, l_partkey AS object, count(*) AS access_count, min(l_shipdate) AS valid_from, max(l_shipdate) AS last_accessed, max(l_discount) AS confidence,
        arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber)) AS subtype, count(DISTINCT l_orderkey) AS n_docs, 'o' || arg_min(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS first_doc
        FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "relation_subject_keyed": _ISLANDS + "SELECT subject, object, CAST(version AS INTEGER) AS version, last_accessed, confidence, n_docs, first_doc, access_count, valid_from, valid_until FROM edges",
    "relation_object_keyed": f"""WITH {M.EVENTS},
        b AS (SELECT *, last_value(subtype IGNORE NULLS) OVER (PARTITION BY subject, object ORDER BY ts, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known,
              row_number() OVER (PARTITION BY subject, object ORDER BY ts, k) AS n FROM a),
        c AS (SELECT *, sum(CASE WHEN n = 1 OR (subtype IS NOT NULL AND known IS NOT NULL AND known <> subtype) THEN 1 ELSE 0 END) OVER (PARTITION BY subject, object ORDER BY ts, k) AS version FROM b),
        i AS (SELECT subject, object, version, max(subtype) AS subtype, min(ts) AS valid_from, count(*) AS access_count FROM c GROUP BY subject, object, version)
        SELECT subject, object, CAST(version AS INTEGER) AS version, subtype, access_count, valid_from, lead(valid_from) OVER (PARTITION BY subject, object ORDER BY version) AS valid_until FROM i""",
    "relation_subtype_keyed": f"""WITH {M.BRANDS},
        b AS (SELECT *, lag(object) OVER (PARTITION BY subject, subtype ORDER BY ts, k, j) AS p FROM a),
        c AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> object THEN 1 ELSE 0 END) OVER (PARTITION BY subject, subtype ORDER BY ts, k, j) AS version FROM b),
        i AS (SELECT subject, subtype, version, any_value(object) AS object, min(ts) AS valid_from, count(*) AS access_count FROM c GROUP BY subject, subtype, version)
        SELECT subject, object, CAST(version AS INTEGER) AS version, subtype, access_count, valid_from, lead(valid_from) OVER (PARTITION BY subject, subtype ORDER BY version) AS valid_until FROM i""",
    # The fold step by step: live edges as a list, one assertion a round.
    "relation_subtype_fold": f"""WITH RECURSIVE {M.EVENTS},
        n AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ts, k) AS i FROM a),
        f AS (
          SELECT subject, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(object VARCHAR, subtype VARCHAR, version INTEGER, valid_from TIMESTAMP, access_count BIGINT, last_accessed TIMESTAMP)[]) AS live,
                 CAST(NULL AS STRUCT(object VARCHAR, subtype VARCHAR, version INTEGER, valid_from TIMESTAMP, access_count BIGINT, last_accessed TIMESTAMP)) AS closed, CAST(NULL AS TIMESTAMP) AS closed_at, 0 AS versions
          FROM (SELECT DISTINCT subject FROM a)
          UNION ALL
          SELECT f.subject, n.i,
                 CASE WHEN len(list_filter(live, lambda e: e.object = n.object)) > 0
                      THEN list_transform(live, lambda e: CASE WHEN e.object = n.object THEN struct_pack(object := e.object, subtype := coalesce(n.subtype, e.subtype), version := e.version, valid_from := e.valid_from,
                                                              access_count := e.access_count + 1, last_accessed := n.ts) ELSE e END)
                      ELSE list_append(list_filter(live, lambda e: e.version IS DISTINCT FROM list_filter(live, lambda x: coalesce(x.subtype = n.subtype, false))[1].version),
                                       struct_pack(object := n.object, subtype := n.subtype, version := versions + 1, valid_from := n.ts, access_count := CAST(1 AS BIGINT), last_accessed := n.ts)) END,
                 CASE WHEN len(list_filter(live, lambda e: e.object = n.object)) = 0 THEN list_filter(live, lambda x: coalesce(x.subtype = n.subtype, false))[1] END, n.ts,
                 CASE WHEN len(list_filter(live, lambda e: e.object = n.object)) = 0 THEN versions + 1 ELSE versions END
          FROM f JOIN n ON n.subject = f.subject AND n.i = f.i + 1),
        ends AS (SELECT subject, unnest(live) AS e, CAST(NULL AS TIMESTAMP) AS valid_until FROM f QUALIFY row_number() OVER (PARTITION BY subject ORDER BY i DESC) = 1
                 UNION ALL SELECT subject, closed, closed_at FROM f WHERE closed IS NOT NULL)
        SELECT subject, e.object AS object, e.subtype AS subtype, e.version AS version, e.valid_from AS valid_from, valid_until, e.access_count AS access_count, e.last_accessed AS last_accessed FROM ends""",
    "relation_provenance": f"""WITH {M.ORDERS},
        b AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> object THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY ts, k) AS version FROM a),
        s AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'o' || k || ',agent:' || strftime(ts, '%Y%m%d') || ':t' || k ELSE 'o' || k END AS source, CASE WHEN k % 4 = 0 THEN strftime(ts, '%Y') END AS scope FROM b),
        i AS (SELECT subject, CAST(version AS INTEGER) AS version, any_value(object) AS object, arg_min(CASE WHEN k % 3 = 0 THEN 'agent' ELSE 'ingest' END, (ts, k)) AS created_by,
              min((ts, k)) AS first, string_agg(source, ',' ORDER BY ts, k) AS sources, arg_max(scope, (ts, k)) FILTER (WHERE scope IS NOT NULL) AS time_scope FROM s GROUP BY subject, version),
        d AS (SELECT i.*, sha256(concat_ws('|', i.subject, 'BELONGS_TO', i.object, i.version)) AS edge_id, s.k, s.ts FROM i JOIN s ON s.subject = i.subject AND (s.ts, s.k) = i.first)
        SELECT subject, version, edge_id, created_by, CASE WHEN k % 3 = 0 THEN strftime(ts, '%Y%m%d') END AS session_id, CASE WHEN k % 3 = 0 THEN 't' || k END AS turn_id, time_scope, sources,
               lag(edge_id) OVER w AS supersedes_edge_id, 'o' || lead(k) OVER w AS superseded_by_doc FROM d WINDOW w AS (PARTITION BY subject ORDER BY version)""",
    "ingest_outcomes": f"""WITH {M.ORDERS}
        SELECT strftime(ts, '%Y-%m-%d') AS source_doc, count(*) FILTER (WHERE p IS NULL) AS created, count(*) FILTER (WHERE p = object) AS reinforced, count(*) FILTER (WHERE p <> object) AS superseded FROM a GROUP BY 1""",
    "superseded_of_type": _ISLANDS + "SELECT count(*) AS n FROM edges WHERE valid_until IS NOT NULL",
    "relation_outcomes": f"WITH {M.ORDERS} SELECT CASE WHEN p IS NULL THEN 'created' WHEN p <> object THEN 'superseded' ELSE 'reinforced' END AS outcome, count(*) AS n FROM a GROUP BY 1",
    "current_facts": _ISLANDS + "SELECT subject, object, valid_from, access_count FROM edges WHERE valid_until IS NULL",
    "superseded_facts": _ISLANDS + "SELECT subject, object, valid_from, valid_until FROM edges WHERE valid_until IS NOT NULL",
    "facts_as_of": _ISLANDS + "SELECT subject, object, valid_from FROM edges WHERE valid_from <= TIMESTAMP '1996-06-01' AND (valid_until IS NULL OR valid_until > TIMESTAMP '1996-06-01')",
    "latest_fact_label": _ISLANDS + "SELECT subject, arg_max(object, version) AS object, 'live' AS state FROM edges GROUP BY subject",
}
