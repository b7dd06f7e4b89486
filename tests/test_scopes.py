from recollect.operators.retrieve import Memory, graph_only
from recollect.queries import graph as G


def test_a_scope_of_many_entities_still_holds(spark, monkeypatch):
    """Over 100,000 entities with odd numbers, and only two that the search can find."""
    near = spark.createDataFrame([("E1", [1.0, 0.0]), ("E2", [1.0, 0.1])], "entity_id string, embedding array<float>")
    far = spark.range(200_100).selectExpr("concat('F', lpad(id, 9, '0')) AS entity_id", "CAST(array(-1, 0) AS array<float>) AS embedding")
    more = "entity_id AS name", "'T' AS type", "true AS canonical", "0L AS access_count", "CAST(NULL AS timestamp) AS last_accessed", "embedding"
    entities = near.unionByName(far).selectExpr("entity_id", *more)
    chunks = spark.createDataFrame([], "chunk_id string, doc_id long, embedding array<float>")
    extracted = spark.createDataFrame([], "entity_id string, doc_id long")
    relations = spark.createDataFrame([], "edge_id string, subject_id string, object_id string, type string, subtype string, confidence double, access_count long, last_accessed timestamp, valid_until timestamp")
    monkeypatch.setattr(G.M, "vector_memory", lambda *_: Memory(entities, chunks, extracted, relations))
    monkeypatch.setattr(G.M, "vector_queries", lambda *_: spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>"))
    found = [r.entity_id for r in G.scoped_retrieve(spark, "").orderBy("rank").collect()]
    assert found[0] == "E1" and all(int(x[-1]) % 2 for x in found)


def test_many_questions_match_names_as_few_do(spark):
    """Over 5,000 distinct words, and names that hold a word without being it."""
    entities = spark.createDataFrame([("a", "Acme Works", True), ("b", "Big Corp", True), ("c", "other", True)], "entity_id string, name string, canonical boolean")
    relations = spark.createDataFrame([("e", "a", "c", None), ("f", "b", "c", None)], "edge_id string, subject_id string, object_id string, valid_until timestamp")
    asked = spark.range(5_001).selectExpr("id AS query_id", "concat('Who is at w', id, 'x?') AS question")
    few = spark.createDataFrame([(-1, "Who is at Acme?"), (-2, "Who is at acme?"), (-3, "Where is Corp?")], "query_id long, question string")
    want = {tuple(r) for r in graph_only(few, entities, relations, 1).collect()}
    assert {q for q, _, _ in want} == {-1, -2, -3}
    assert {tuple(r) for r in graph_only(asked.unionByName(few), entities, relations, 1).collect()} == want
    assert {tuple(r) for r in graph_only(few, entities, relations, 1, most_words=1).collect()} == want
