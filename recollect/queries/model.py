"""The memory's tables as views of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "TIMESTAMP_NTZ '2024-02-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns a minute apart, conversations an hour."""
    at = F.expr("timestampadd(MINUTE, CAST(conv_id * 60 + turn AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00')")
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_id"), F.col("turn").alias("turn_number"), "role", "text", at.alias("ts"), F.concat_ws(":", "conv_id", "turn").alias("turn_key"))


TURNS = """turns AS (
  SELECT conv_id AS session_id, turn AS turn_id, turn AS turn_number, role, text,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id * 60 + turn AS BIGINT)) AS ts, conv_id || ':' || turn AS turn_key
  FROM conversations)"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of five plain letters or more of a turn stands for an entity that it mentions."""
    name = F.lower(F.regexp_extract("text", "[A-Za-z]{5,}", 0))
    rows = turns(spark, sf_dir).select("session_id", "turn_key", name.alias("entity_id"), (F.length("text") % 100 / 100).alias("confidence"), F.col("ts").alias("created_at"))
    return rows.where("entity_id <> ''").withColumn("name", F.col("entity_id"))


MENTIONS = """mentions AS (
  SELECT session_id, turn_key, lower(regexp_extract(text, '[A-Za-z]{5,}')) AS entity_id, (length(text) % 100) / 100.0 AS confidence, ts AS created_at
  FROM turns WHERE regexp_extract(text, '[A-Za-z]{5,}') <> '')"""


def long_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of four turns or more."""
    return turns(spark, sf_dir).groupBy("session_id").count().where("count >= 4").select("session_id")


SESSIONS = "sessions AS (SELECT session_id FROM turns GROUP BY session_id HAVING count(*) >= 4)"


def turn_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's text as a document that is stored once; ``doc_id`` is the first turn that brought it."""
    from ..operators.provenance import merge_documents

    return merge_documents(turns(spark, sf_dir).withColumn("doc_id", F.col("turn_key")), order="ts").withColumn("chunk_id", F.concat_ws(":", "doc_id", F.lit(0), F.sha2("text", 256)))


TURN_DOCS = """turn_docs AS (
  SELECT turn_key AS doc_id, turn_key, session_id, ts, turn_key || ':0:' || sha256(text) AS chunk_id
  FROM turns QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY ts) = 1)"""


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star schema as relations: where suppliers and customers are, nations' regions, and the parts that suppliers deliver."""
    def edge(df, s, prefix_s, o, prefix_o, kind):
        subject, obj = F.concat(F.lit(prefix_s), F.col(s).cast("string")), F.concat(F.lit(prefix_o), F.col(o).cast("string"))
        return df.select(F.concat_ws("-", F.lit(kind), subject, obj).alias("edge_id"), subject.alias("subject_id"), obj.alias("object_id"), F.lit(kind).alias("type")).distinct()

    return (
        edge(table(spark, sf_dir, "supplier"), "s_suppkey", "S", "s_nationkey", "N", "LOCATED_IN")
        .unionByName(edge(table(spark, sf_dir, "customer"), "c_custkey", "C", "c_nationkey", "N", "LIVES_IN"))
        .unionByName(edge(table(spark, sf_dir, "nation"), "n_nationkey", "N", "n_regionkey", "R", "BELONGS_TO"))
        .unionByName(edge(table(spark, sf_dir, "lineitem"), "l_suppkey", "S", "l_partkey", "P", "USES"))
    )


STAR = """star AS (
  SELECT 'LOCATED_IN' AS type, 'S' || s_suppkey AS s, 'N' || s_nationkey AS o FROM supplier UNION
  SELECT 'LIVES_IN', 'C' || c_custkey, 'N' || c_nationkey FROM customer UNION
  SELECT 'BELONGS_TO', 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION
  SELECT DISTINCT 'USES', 'S' || l_suppkey, 'P' || l_partkey FROM lineitem),
both_ways AS (SELECT type || '-' || s || '-' || o AS edge_id, s AS src, o AS dst FROM star UNION ALL SELECT type || '-' || s || '-' || o, o, s FROM star)"""


def star_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    def named(name, key, prefix, label, kind):
        return table(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("entity_id"), F.col(label).alias("name"), F.lit(kind).alias("type"), F.lit(True).alias("canonical"))

    return (
        named("supplier", "s_suppkey", "S", "s_name", "Organization").unionByName(named("customer", "c_custkey", "C", "c_name", "Person"))
        .unionByName(named("nation", "n_nationkey", "N", "n_name", "Location")).unionByName(named("region", "r_regionkey", "R", "r_name", "Location"))
        .unionByName(named("part", "p_partkey", "P", "p_name", "Technology"))
    )


STAR_ENTITIES = """ents AS (
  SELECT 'S' || s_suppkey AS entity_id, s_name AS name, 'Organization' AS type FROM supplier UNION ALL
  SELECT 'C' || c_custkey, c_name, 'Person' FROM customer UNION ALL
  SELECT 'N' || n_nationkey, n_name, 'Location' FROM nation UNION ALL
  SELECT 'R' || r_regionkey, r_name, 'Location' FROM region UNION ALL
  SELECT 'P' || p_partkey, p_name, 'Technology' FROM part)"""


def order_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' order priorities as a subject-keyed stream of assertions."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.struct("o_orderdate", "o_orderkey").alias("seq"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("subject"), F.lit("BELONGS_TO").alias("type"),
        F.col("o_orderpriority").alias("object"), F.round(F.col("o_totalprice") % 100 / 100, 4).alias("confidence"), F.concat(F.lit("o"), "o_orderkey").alias("source_doc"),
    )


ORDERS = """a AS (
  SELECT o_orderdate AS ts, o_orderkey AS k, o_custkey AS subject, o_orderpriority AS object, round(o_totalprice % 100 / 100, 4) AS confidence,
         lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p
  FROM orders)"""


def event_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as an object-keyed stream; the subtype is a band of the value, which may be null."""
    band = F.when(F.col("value") < 20, None).when(F.col("value") < 60, "low").otherwise("high")
    e = table(spark, sf_dir, "events")
    return e.select(F.struct("ts", "event_id").alias("seq"), "ts", F.col("user_id").alias("subject"), F.lit("HAS_TITLE").alias("type"), F.col("event_type").alias("object"), band.alias("subtype"))


EVENTS = """a AS (
  SELECT ts, event_id AS k, user_id AS subject, event_type AS object, CASE WHEN value < 20 THEN NULL WHEN value < 60 THEN 'low' ELSE 'high' END AS subtype
  FROM events)"""


def brand_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' parts by brand; a part has one brand, so windows suffice for the subtype-keyed class."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))  # noqa: E741
    return l.select(
        F.struct("o_orderdate", "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey").alias("seq"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("subject"),
        F.lit("HAS_PREFERENCE").alias("type"), F.col("l_partkey").alias("object"), F.col("p_brand").alias("subtype"),
    )


BRANDS = """a AS (
  SELECT o_orderdate AS ts, l_orderkey AS k, (l_linenumber, l_shipdate, l_partkey) AS j, o_custkey AS subject, l_partkey AS object, p_brand AS subtype
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def vector_memory(spark: SparkSession, sf_dir: str):
    """Embeddings as entities, some of them stubs, and chunks of a hundred documents, with a ring of relations, some of them superseded or qualified."""
    from ..operators.retrieve import Memory

    v = table(spark, sf_dir, "embeddings")
    at = F.expr("timestampadd(HOUR, CAST(vec_id % 700 AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00')")
    key = lambda c: F.concat(F.lit("E"), F.lpad(c.cast("string"), 9, "0"))
    vec = F.col("vec_id")
    entities = v.select(
        key(vec).alias("entity_id"), F.concat(F.lit("v"), vec.cast("string")).alias("name"), F.col("label").cast("string").alias("type"), (vec % 13 != 0).alias("canonical"),
        (vec % 7).alias("access_count"), F.when(vec % 7 > 0, at).alias("last_accessed"), "embedding",
    )
    chunks = v.select(F.concat(F.lit("K"), F.lpad(vec.cast("string"), 9, "0")).alias("chunk_id"), (vec % 100).alias("doc_id"), "embedding")
    extracted = v.select(key(vec).alias("entity_id"), (vec * 3 % 100).alias("doc_id"))
    relations = v.select(
        F.concat(F.lit("R"), F.lpad(vec.cast("string"), 9, "0")).alias("edge_id"), key(vec).alias("subject_id"), key((vec * 7 + 3) % 500).alias("object_id"),
        F.concat(F.lit("T"), F.col("label").cast("string")).alias("type"), F.when(vec % 4 == 0, F.concat(F.lit("s"), (vec % 3).cast("string"))).alias("subtype"), (0.5 + vec % 50 / 100).alias("confidence"),
        F.when(vec % 6 == 0, (vec % 10).cast("string")).alias("quantity_value"), F.when(vec % 12 == 0, "h").alias("quantity_unit"),
        F.when((vec % 6 == 0) & (vec % 18 != 0), "hours").alias("quantity_kind"), F.when(vec % 5 == 0, "weekly").alias("time_scope"),
        (vec % 5).alias("access_count"), F.when(vec % 5 > 0, at).alias("last_accessed"), F.when(vec % 11 == 0, at).alias("valid_until"),
    )
    return Memory(entities, chunks, extracted, relations)


def passages(spark: SparkSession, sf_dir: str, memory=None) -> DataFrame:
    """What each chunk of the vector memory says, and its document's title; ``memory`` if it is at hand."""
    return (memory or vector_memory(spark, sf_dir)).chunks.select("chunk_id", "doc_id", F.concat(F.lit("passage "), F.col("chunk_id")).alias("text"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 50."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").cast("string").alias("type"))


VECTORS = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
q AS (SELECT vec_id AS query_id, v AS qv, label AS qlabel FROM e WHERE vec_id % 50 = 0),
sims AS (SELECT query_id, vec_id, label, qlabel, list_cosine_similarity(v, qv) AS sim FROM q, e)"""

MEMORY = VECTORS + """,
ent AS (SELECT vec_id AS id, 'E' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS entity_id, vec_id % 7 AS access_count,
        CASE WHEN vec_id % 7 > 0 THEN TIMESTAMP '2024-01-01' + to_hours(vec_id % 700) END AS last_accessed FROM e WHERE vec_id % 13 <> 0),
rel AS (SELECT 'R' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS edge_id, 'E' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS s,
        'E' || lpad(CAST((vec_id * 7 + 3) % 500 AS VARCHAR), 9, '0') AS o, 0.5 + (vec_id % 50) / 100.0 AS confidence, vec_id % 5 AS n,
        CASE WHEN vec_id % 5 > 0 THEN TIMESTAMP '2024-01-01' + to_hours(vec_id % 700) END AS la, vec_id % 11 = 0 AS dead FROM e),
lab AS (SELECT 'R' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS edge_id, 'T' || label || CASE WHEN vec_id % 4 = 0 THEN '[s' || vec_id % 3 || ']' ELSE '' END ||
        CASE WHEN vec_id % 6 = 0 OR vec_id % 5 = 0 THEN ' {' || concat_ws(', ', CASE WHEN vec_id % 6 = 0 THEN CASE WHEN vec_id % 18 = 0 THEN 'quantity' ELSE 'hours' END || '=' || vec_id % 10 || CASE WHEN vec_id % 12 = 0 THEN ' h' ELSE '' END END,
        CASE WHEN vec_id % 5 = 0 THEN 'scope=weekly' END) || '}' ELSE '' END AS text FROM e),
direct AS (SELECT query_id, 'E' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS entity_id, vec_id, sim FROM sims
           QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 5),
docs AS (SELECT query_id, vec_id % 100 AS doc_id, max(sim) AS sim FROM direct GROUP BY ALL),
through AS (SELECT query_id, 'E' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS entity_id, max(sim) AS sim FROM docs JOIN e ON vec_id * 3 % 100 = doc_id GROUP BY ALL),
seeds AS (SELECT query_id, entity_id, max(sim) AS sim FROM (SELECT query_id, entity_id, sim FROM direct UNION ALL SELECT * FROM through) GROUP BY ALL),
ends AS (SELECT s AS entity_id, dead FROM rel UNION ALL SELECT o, dead FROM rel),
alive AS (SELECT * FROM seeds WHERE entity_id NOT IN (SELECT entity_id FROM ends GROUP BY 1 HAVING bool_and(dead)) AND entity_id IN (SELECT entity_id FROM ent))"""
