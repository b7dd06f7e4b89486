"""Queries over documents, conversations and their provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import chunking, coerce, provenance
from . import model as M


def doc_dedupe_by_hash(spark, sf_dir):
    return provenance.merge_documents(M.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "content_hash")


def word_window_chunks(spark, sf_dir):
    docs = M.table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = docs.select("doc_id", F.posexplode(chunking.word_windows(F.col("text"), 100, 20)).alias("chunk_index", "chunk"))
    return cut.select("doc_id", "chunk_index", F.octet_length("chunk").alias("n_bytes"), T.chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("chunk")).alias("chunk_id"))


CHUNKS = r"""w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, i AS chunk_index, array_to_string(w[i * 80 + 1:i * 80 + 100], ' ') AS chunk
      FROM (SELECT doc_id, w, unnest(range(0, CAST(greatest(ceil((len(w) - 20) / 80.0), 1) AS BIGINT))) AS i FROM w WHERE len(w) > 0))"""


def recursive_chunks(spark, sf_dir):
    """Chunks of at most 200 tokens of a public tokenizer."""
    import public_tokenizers

    length = chunking.TokenLength(public_tokenizers.path("word_bpe_49k.json"))
    cut = chunking.chunk_documents(M.table(spark, sf_dir, "documents").select("doc_id", "text"), 200, 25, length)
    return cut.select("doc_id", "chunk_index", "position", "chunk_id", F.length("text").alias("n_chars"))


def turn_fingerprints(spark, sf_dir):
    ids = [F.col(c) for c in ("session_id", "turn_id", "role")]
    return M.turns(spark, sf_dir).select("session_id", "turn_id", T.turn_fingerprint(*ids, F.col("text")).alias("fingerprint"), T.turn_title(*ids).alias("title"))


def turn_eligibility(spark, sf_dir):
    ids = [F.col(c) for c in ("session_id", "turn_id", "role", "text")]
    return M.turns(spark, sf_dir).select("session_id", "turn_id", T.eligible(*ids).alias("eligible"))


def conversation_summary(spark, sf_dir):
    return provenance.merge_conversations(M.turns(spark, sf_dir)).select("session_id", "title", "started_at", "last_active_at")


def conversation_history(spark, sf_dir):
    found = provenance.conversation_detail(M.turns(spark, sf_dir), M.mentions(spark, sf_dir), 10)
    return found.select("session_id", F.col("position").cast("long").alias("position"), "turn_key", "role", F.array_join("entities", ",").alias("entities"))


def turn_next_edges(spark, sf_dir):
    return provenance.next_turns(M.turns(spark, sf_dir))


def mention_max_confidence(spark, sf_dir):
    rows = M.mentions(spark, sf_dir).select("entity_id", F.col("session_id").cast("string").alias("turn_key"), "confidence", "created_at")
    return provenance.merge_mentions(rows).withColumnsRenamed({"turn_key": "session"})


def entities_in_conversation(spark, sf_dir):
    return provenance.entities_in_session(M.turns(spark, sf_dir), M.mentions(spark, sf_dir).select("turn_key", "entity_id"), M.long_sessions(spark, sf_dir))


SINCE = "TIMESTAMP '2024-01-02 12:00:00'"


def entities_since(spark, sf_dir):
    return provenance.entities_in_session(M.turns(spark, sf_dir), M.mentions(spark, sf_dir).select("turn_key", "entity_id"), since=F.expr(SINCE.replace("TIMESTAMP", "TIMESTAMP_NTZ")))


def _chunks(spark, sf_dir, **scope):
    docs = M.turn_documents(spark, sf_dir)
    return provenance.chunks_in_session(M.turns(spark, sf_dir), docs.select("doc_id", "turn_key"), docs.select("doc_id", "chunk_id"), **scope)


def chunks_in_conversation(spark, sf_dir):
    return _chunks(spark, sf_dir, session=M.long_sessions(spark, sf_dir))


def chunks_since(spark, sf_dir):
    return _chunks(spark, sf_dir, since=F.expr(SINCE.replace("TIMESTAMP", "TIMESTAMP_NTZ")))


def allowlist_intersection(spark, sf_dir):
    return entities_in_conversation(spark, sf_dir).join(entities_since(spark, sf_dir), "entity_id", "left_semi")


def entities_from_chunks(spark, sf_dir):
    docs = M.table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = docs.select("doc_id", F.posexplode(chunking.word_windows(F.col("text"), 100, 20)).alias("chunk_index", "chunk"))
    chunks = cut.select("doc_id", T.chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("chunk")).alias("chunk_id"))
    named = docs.select("doc_id", F.lower(F.regexp_extract("text", "[A-Za-z]{6,}", 0)).alias("entity_id")).where("entity_id <> ''")
    entities = named.select("entity_id").distinct().withColumn("canonical", F.lit(True))
    found = provenance.entities_of_documents(chunks, named, entities)
    return found.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.min("chunk_id").alias("first_chunk"))


RAW_RELATIONS = ["works at", " Employed by ", "manages", "prefers", "knows", "", "part of", "LEADS", "based in", "Talked About", "depends on", "spouse of", "mentors"]
RAW_TYPES = ["CEO", "company", "Library", "city", "", "Person", "methodology", "to-do", "gadget", " Date ", "datetime", "SPEC"]


def _picked(spark, sf_dir, values):
    items = F.array(*[F.lit(v) for v in values])
    return M.table(spark, sf_dir, "events").select("event_id", F.get(items, (F.col("event_id") % len(values)).cast("int")).alias("raw"))


def normalize_relation_type(spark, sf_dir):
    rows = _picked(spark, sf_dir, RAW_RELATIONS).withColumn("canonical", V.normalize_relation_type(F.col("raw")))
    return rows.groupBy("raw", "canonical", V.slot_class(F.col("canonical")).alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def normalize_entity_type(spark, sf_dir):
    rows = _picked(spark, sf_dir, RAW_TYPES).withColumn("canonical", V.normalize_entity_type(F.col("raw")))
    return rows.groupBy("raw", "canonical").agg(F.count(F.lit(1)).alias("n"))


def normalize_subtype(spark, sf_dir):
    rows = M.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" -"), "p_type", F.lit("/ "), "p_brand", F.lit("#!")).alias("raw"))
    return rows.select("p_partkey", V.normalize_subtype(F.col("raw")).alias("subtype"))


def subtype_fallback(spark, sf_dir):
    rows = _picked(spark, sf_dir, RAW_RELATIONS).withColumns({"canonical": V.normalize_relation_type(F.col("raw")), "given": F.when(F.col("event_id") % 3 == 0, "Some Kind")})
    found = rows.withColumn("subtype", V.subtype_or_raw(F.col("given"), F.col("raw"), F.col("canonical")))
    return found.groupBy("raw", "given", "subtype").agg(F.count(F.lit(1)).alias("n"))


def group_mentions(spark, sf_dir):
    e = M.table(spark, sf_dir, "events")
    kinds = F.array(*[F.lit(x) for x in RAW_TYPES])
    mentions = e.select(
        (F.col("user_id") % 50).alias("doc_id"), F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("name"),
        F.get(kinds, (F.col("event_id") % 2).cast("int")).alias("raw_type"), F.round("value", 4).alias("confidence"), F.col("event_id").alias("position"),
    )
    return coerce.group_mentions(mentions)


def _listed(pairs: dict[str, str]) -> str:
    return "(VALUES " + ", ".join(f"('{s}', '{c}')" for s, c in pairs.items()) + ") AS syn(s, c)"


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_REL = {s: c for c, all_ in V.RELATION_SYNONYMS.items() for s in all_}
_ENT = {s: c for c, all_ in V.ENTITY_SYNONYMS.items() for s in all_} | {c.lower(): c for c in V.ENTITY_TYPES}
_SHAPED = r"replace(upper(regexp_replace(raw, '^\s+|\s+$', '', 'g')), ' ', '_')"
_SUB = "nullif(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_'), '')"
_RAW = "raws AS (SELECT event_id, {l}[event_id % {n} + 1] AS raw FROM events)"
_RAW_REL = _RAW.format(l=_sql_list(RAW_RELATIONS), n=len(RAW_RELATIONS))
_CANON = f"canon AS (SELECT event_id, raw, {_SHAPED} AS shaped, CASE WHEN {_SHAPED} = '' THEN 'RELATED_TO' ELSE coalesce(c, {_SHAPED}) END AS canonical FROM raws LEFT JOIN {_listed(_REL)} ON s = {_SHAPED})"
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_ROLE = r"coalesce(nullif(lower(regexp_replace(coalesce(role, ''), '^\s+|\s+$', '', 'g')), ''), 'unknown')"
_TEXT = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"

QUERIES = {
    f.__name__: f
    for f in (
        doc_dedupe_by_hash, word_window_chunks, recursive_chunks, turn_fingerprints, turn_eligibility, conversation_summary, conversation_history, turn_next_edges,
        mention_max_confidence, entities_in_conversation, entities_since, chunks_in_conversation, chunks_since, allowlist_intersection, entities_from_chunks,
        normalize_relation_type, normalize_entity_type, normalize_subtype, subtype_fallback, group_mentions,
    )
}

_IN_SESSION = "SELECT DISTINCT entity_id FROM turns JOIN sessions USING (session_id) JOIN mentions USING (turn_key)"
_SINCE = f"SELECT DISTINCT entity_id FROM turns JOIN mentions USING (turn_key) WHERE ts >= {SINCE}"
ORACLES = {
    "doc_dedupe_by_hash": "SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents GROUP BY sha256(text)",
    "word_window_chunks": f"WITH {CHUNKS} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(strlen(chunk) AS INTEGER) AS n_bytes, doc_id || ':' || chunk_index || ':' || sha256(chunk) AS chunk_id FROM c",
    "turn_fingerprints": f"SELECT conv_id AS session_id, turn AS turn_id, sha256(concat_ws('|', conv_id, turn, {_ROLE}, {_TEXT})) AS fingerprint, concat_ws(':', 'conversation', conv_id, turn, {_ROLE}) AS title FROM conversations",
    "turn_eligibility": f"SELECT conv_id AS session_id, turn AS turn_id, coalesce({_TEXT} <> '', false) AND {_ROLE} NOT IN ('tool', 'function') AS eligible FROM conversations",
    "conversation_summary": f"""WITH {M.TURNS} SELECT session_id, 'agent:' || strftime(min(ts), '%Y%m%dT%H%M%SZ') || ':' || substr(sha256(CAST(session_id AS VARCHAR)), 1, 8) AS title,
        min(ts) AS started_at, max(ts) AS last_active_at FROM turns GROUP BY session_id""",
    "conversation_history": f"""WITH {M.TURNS}, {M.MENTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, turn_key) AS position FROM turns)
        SELECT r.session_id, position, turn_key, role, coalesce(string_agg(DISTINCT entity_id, ',' ORDER BY entity_id), '') AS entities
        FROM r LEFT JOIN mentions USING (turn_key) WHERE position <= 10 GROUP BY ALL""",
    "turn_next_edges": "SELECT DISTINCT b.conv_id AS session_id, a.turn AS from_turn, b.turn AS to_turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.turn > 0",
    "mention_max_confidence": f"WITH {M.TURNS}, {M.MENTIONS} SELECT entity_id, CAST(session_id AS VARCHAR) AS session, max(CAST(confidence AS DOUBLE)) AS confidence, min(created_at) AS created_at FROM mentions GROUP BY entity_id, session_id",
    "entities_in_conversation": f"WITH {M.TURNS}, {M.MENTIONS}, {M.SESSIONS} {_IN_SESSION}",
    "entities_since": f"WITH {M.TURNS}, {M.MENTIONS} {_SINCE}",
    "chunks_in_conversation": f"WITH {M.TURNS}, {M.SESSIONS}, {M.TURN_DOCS} SELECT DISTINCT chunk_id FROM turn_docs JOIN sessions USING (session_id)",
    "chunks_since": f"WITH {M.TURNS}, {M.TURN_DOCS} SELECT DISTINCT chunk_id FROM turn_docs WHERE ts >= {SINCE}",
    "allowlist_intersection": f"WITH {M.TURNS}, {M.MENTIONS}, {M.SESSIONS} {_IN_SESSION} INTERSECT {_SINCE}",
    "entities_from_chunks": f"""WITH {CHUNKS}, n AS (SELECT doc_id, lower(regexp_extract(text, '[A-Za-z]{{6,}}')) AS entity_id FROM documents WHERE regexp_extract(text, '[A-Za-z]{{6,}}') <> '')
        SELECT entity_id, count(DISTINCT k) AS n_chunks, min(k) AS first_chunk FROM (SELECT entity_id, doc_id || ':' || chunk_index || ':' || sha256(chunk) AS k FROM c JOIN n USING (doc_id)) GROUP BY entity_id""",
    "normalize_relation_type": f"""WITH {_RAW_REL}, {_CANON} SELECT raw, canonical, CASE WHEN canonical IN {_IN(V.SUBJECT_KEYED)} THEN 'subject' WHEN canonical IN {_IN(V.OBJECT_KEYED)} THEN 'object'
        WHEN canonical IN {_IN(V.SUBTYPE_KEYED)} THEN 'subtype' ELSE 'additive' END AS slot, count(*) AS n FROM canon GROUP BY ALL""",
    "normalize_entity_type": f"""WITH {_RAW.format(l=_sql_list(RAW_TYPES), n=len(RAW_TYPES))} SELECT raw, CASE WHEN trim(raw) = '' THEN 'Concept' ELSE c END AS canonical, count(*) AS n
        FROM raws LEFT JOIN {_listed(_ENT)} ON s = lower(trim(raw)) GROUP BY ALL""",
    "normalize_subtype": f"SELECT p_partkey, {_SUB.format(x=chr(39) + ' -' + chr(39) + ' || p_type || ' + chr(39) + '/ ' + chr(39) + ' || p_brand || ' + chr(39) + '#!' + chr(39))} AS subtype FROM part",
    "subtype_fallback": f"""WITH {_RAW_REL}, {_CANON}, g AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'Some Kind' END AS given FROM canon)
        SELECT raw, given, coalesce({_SUB.format(x='given')}, CASE WHEN shaped <> canonical THEN {_SUB.format(x='shaped')} END) AS subtype, count(*) AS n FROM g GROUP BY ALL""",
    "group_mentions": f"""WITH m AS (SELECT user_id % 50 AS doc_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS name,
            CASE event_id % 2 WHEN 0 THEN 'Person' ELSE 'Organization' END AS type, round(value, 4) AS confidence, event_id FROM events)
        SELECT doc_id, lower(name) AS key, type, arg_min(name, event_id) AS name, arg_min(confidence, event_id) AS confidence, count(*) AS mentions FROM m GROUP BY doc_id, lower(name), type""",
}
