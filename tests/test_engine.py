from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recollect.engine import Engine
from recollect.operators import chunking
from recollect.streaming import facts as stream_facts

PATTERNS = {"works at": r"(\w+) works at (\w+)", "uses": r"(\w+) uses (\w+)"}


def extract(docs):
    found = chunking.extract_by_patterns(docs, PATTERNS)
    related = found.select("doc_id", F.col("seq").alias("n"), "subject", "object", F.col("type").alias("raw_type"), F.lit(None).cast("string").alias("subtype"), F.lit(0.8).alias("confidence"))
    ends = found.select("doc_id", (F.col("seq") * 2).alias("position"), F.col("subject").alias("name"), F.lit("person").alias("raw_type"), F.lit(0.9).alias("confidence")).unionByName(
        found.select("doc_id", (F.col("seq") * 2 + 1).alias("position"), F.col("object").alias("name"), F.lit("company").alias("raw_type"), F.lit(0.9).alias("confidence"))
    )
    return ends, related


def at(day):
    return F.lit(datetime(2024, 1, day))


def docs(spark, *rows):
    return spark.createDataFrame([(t, f"title {i}", "text", "s", f"{i}") for i, t in enumerate(rows)], "text string, title string, source_type string, session_id string, turn_id string")


def live(engine, kind="WORKS_FOR"):
    names = {r.entity_id: r.name for r in engine.table("entities").collect()}
    return {(names[r.subject_id], names[r.object_id]) for r in engine.relations().where((F.col("type") == kind) & F.col("valid_until").isNull()).collect()}


def test_a_memory_from_end_to_end(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "memory"), extract)
    counts = engine.ingest(docs(spark, "Ada works at Acme.", "Ada uses Spark.", "Ada works at Acme."), at(1)).collect()
    assert sorted((r.chunks, r.entities_created, r.entities_reinforced, r.relations_created, r.relations_superseded) for r in counts) == [(1, 2, 0, 1, 0)] * 2
    assert engine.table("entities").count() == 3
    assert engine.ingest(docs(spark, "Ada works at Acme."), at(2)).count() == 0
    (r,) = engine.ingest(docs(spark, "Ada works at Initech."), at(3)).collect()
    assert (r.entities_created, r.entities_reinforced, r.relations_created, r.relations_superseded) == (1, 1, 0, 1)
    names = {r.entity_id: r.name for r in engine.table("entities").collect()}
    edges = {(names[r.subject_id], r.type, names[r.object_id], r.valid_until is None) for r in engine.relations().collect()}
    assert edges == {("Ada", "WORKS_FOR", "Acme", False), ("Ada", "WORKS_FOR", "Initech", True), ("Ada", "USES", "Spark", True)}
    queries = spark.createDataFrame([(1, "Ada (Person)")], "query_id long, question string")
    found, chunks = engine.retrieve(queries, at(4))
    assert {names[r.entity_id] for r in found.collect()} >= {"Ada", "Spark", "Initech"} and chunks.count() == 3
    assert {r.access_count for r in engine.entities().where("name = 'Ada'").collect()} == {1}
    none = spark.createDataFrame([(1, "nowhere", None)], "query_id long, session_id string, since timestamp")
    found, chunks = engine.retrieve(queries, at(4), reinforce=False, scope=none)
    assert found.count() == chunks.count() == 0
    kinds = [r.kind for r in engine.documents_for(queries, at(4), reinforce=False).orderBy("position").collect()]
    assert kinds == ["entity"] * (len(kinds) - 3) + ["chunk"] * 3 and len(kinds) > 4
    assert engine.conversation("s").where("size(entities) > 0").count() >= 1
    assert {r.name for r in engine.neighbours("ada", 1).collect()} == {"Spark", "Initech"}
    assert engine.entity(engine.table("entities").where("name = 'Spark'").first().entity_id).first().name == "Spark"
    assert engine.query("SELECT count(*) AS n FROM relations WHERE type = :t", t="USES").first().n == 1
    # The turn t0 is met by two documents, and turns are stored once.
    assert engine.table("turns").count() == 2 and {r.rows for r in engine.table("metrics").where("stage = 'chunks'").collect()} == {2, 0, 1}
    with pytest.raises(ValueError):
        engine.wipe()
    engine.store.compact()
    assert engine.relations().count() == 3 and engine.table("documents").count() == 3


def test_status(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "memory"), extract)
    empty = engine.status().first()
    assert (empty.entities, empty.live_relations, empty.top_entities) == (0, 0, [])
    engine.ingest(docs(spark, "Ada works at Acme.", "Bob works at Acme."), at(1))
    engine.ingest(docs(spark, "Ada works at Initech."), at(2))
    engine.assert_relations(agent(spark, (1, "Ada", "Person", "Hooli", "Company", "works at", "chat", "s2", "9", 0.7, None)), at(3))
    row = engine.status().first()
    assert (row.documents, row.entities, row.live_relations, row.superseded_relations, row.conversations, row.turns) == (3, 5, 2, 2, 2, 3)
    assert [(r.type, r.valid_from.day) for r in row.recent_agent_writes] == [("WORKS_FOR", 3)]
    assert [r.session_id for r in row.recent_conversations] == ["s2", "s"] and len(row.top_entities) == 4


def agent(spark, *rows):
    return spark.createDataFrame(list(rows), "n int, subject string, subject_type string, object string, object_type string, rel_type string, source string, session_id string, turn_id string, confidence double, subtype string")


def test_agents_relations(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "memory"), extract)
    engine.ingest(docs(spark, "Ada works at Acme."), at(1))
    rows = agent(
        spark, (1, "Ada", "Person", "Hooli", "Company", "works at", "chat", "s", "9", 0.7, None), (2, "Ada", "Person", "X", "Company", "uses", "chat", None, "9", 0.7, None),
        (3, "Ada", "Person", "Hooli", "Company", "employed by", "chat", "s", "9", 0.9, None), (4, "Ada", "Person", "Y", "Company", "uses", "chat", "a:b", "9", 0.7, None),
    )
    assert {(r.n, r.outcome) for r in engine.assert_relations(rows, at(5)).collect()} == {(1, "superseded"), (2, "rejected"), (3, "reinforced"), (4, "rejected")}
    assert live(engine) == {("Ada", "Hooli")}
    new = engine.relations().where("created_by = 'agent'").first()
    old = engine.relations().where("created_by = 'ingest'").first()
    assert new.source_docs == ["chat", "agent:s:9"] and new.confidence == 0.9 and new.supersedes_edge_id == old.edge_id
    assert (old.superseded_by_doc, old.valid_until.day, old.source_docs) == ("chat", 5, [engine.table("documents").first().doc_id])
    # The endpoints are mentioned in the agent's turn.
    key = engine.table("turns").where("turn_id = '9'").first().turn_key
    assert engine.mentions().where(F.col("turn_key") == key).count() == 2


def test_agents_entities(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "memory"), extract)
    engine.ingest(docs(spark, "Ada works at Acme."), at(1))
    rows = spark.createDataFrame([(1, "Ada", "person", "chat", 0.8, "s", "1"), (2, "Zed", "engineer", "chat", 0.8, "s", "1"), (3, "Nobody", "person", "chat", 0.8, None, "1")], "n int, name string, type string, source string, confidence double, session_id string, turn_id string")
    found = {r.n: r for r in engine.add_entities(rows, at(2)).collect()}
    assert found[1].resolved_to_existing and found[1].canonical_name == "Ada" and not found[2].resolved_to_existing and found[3].entity_id is None
    (zed,) = engine.entities().where("name = 'Zed'").collect()
    assert (zed.type, zed.subtype, zed.created_by, zed.session_id, zed.turn_id, zed.source_doc) == ("Person", "engineer", "agent", "s", "1", "chat")
    assert engine.entities().where("name = 'Nobody'").count() == 0 and engine.mentions().where("turn_key LIKE '%1'").count() == 2


@pytest.mark.parametrize("order", [("Acme", "Initech"), ("Initech", "Acme")])
def test_documents_of_a_batch_count_in_the_order_of_their_arrival(spark, tmp_path, order):
    engine = Engine(spark, str(tmp_path / "memory"), extract)
    rows = docs(spark, *(f"Ada works at {x}." for x in order))
    outcomes = engine.ingest(rows, at(1)).agg(F.sum("relations_created"), F.sum("relations_superseded")).first()
    assert live(engine) == {("Ada", order[1])} and tuple(outcomes) == (1, 1)
    engine.ingest(docs(spark, "Bob works at Acme.", "Bob works at Initech.").withColumn("arrival", F.when(F.col("turn_id") == "0", 7).otherwise(3)), at(2))
    assert ("Bob", "Acme") in live(engine)


def test_a_failed_batch_leaves_nothing_and_can_be_tried_again(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "memory"), extract)
    engine.ingest(docs(spark, "Ada uses Spark."), at(1))
    whole = type(engine.store.begin()).commit
    monkeypatch.setattr("recollect.sources.files.Batch.commit", lambda self, base=False: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        engine.ingest(docs(spark, "Ada works at Acme."), at(2))
    assert engine.table("chunks").count() == engine.table("assertions").count() == 1
    monkeypatch.setattr("recollect.sources.files.Batch.commit", whole)
    engine.ingest(docs(spark, "Ada works at Acme."), at(2))
    assert engine.table("chunks").count() == engine.table("assertions").count() == 2
    assert {r.access_count for r in engine.relations().collect()} == {1}


def test_other_names_become_aliases(spark, tmp_path):
    def said(docs):
        found = docs.select("doc_id", F.lit(0).alias("position"), F.regexp_replace("text", " is here", "").alias("name"), F.lit("company").alias("raw_type"), F.lit(0.9).alias("confidence"))
        none = docs.select("doc_id", F.lit(0).alias("n"), F.lit("a").alias("subject"), F.lit("b").alias("object"), F.lit("uses").alias("raw_type"), F.lit(None).cast("string").alias("subtype"), F.lit(0.5).alias("confidence"))
        return found, none.where("doc_id IS NOT NULL")

    engine = Engine(spark, str(tmp_path / "memory"), said)
    engine.ingest(docs(spark, "Acme International Trading Company is here"), at(1))
    (r,) = engine.ingest(docs(spark, "Acme International Trading Companys is here"), at(2)).collect()
    assert (r.entities_reinforced, r.relations_rejected) == (1, 1)
    by_name = {r.name: r for r in engine.entities().collect()}
    assert by_name["Acme International Trading Company"].aliases == ["Acme International Trading Companys"] and by_name["Acme International Trading Company"].canonical
    stub = by_name["Acme International Trading Companys"]
    (same,) = engine.table("same_as").collect()
    assert not stub.canonical and same.alias_id == stub.entity_id and same.canonical_id == by_name["Acme International Trading Company"].entity_id
    engine.ingest(docs(spark, "Acme International Trading Companys is here "), at(3))
    assert engine.entities().count() == 2 and engine.table("same_as").count() == 1
    assert {r.reason for r in engine.table("rejected").collect()} == {"unknown endpoint"}


def test_seeding_from_a_folder_with_a_profile(spark, tmp_path):
    (tmp_path / "corpus").mkdir()
    for n, text in enumerate(["Ada works at Acme.", "Ada works at Initech.", "Bob uses Spark."]):
        (tmp_path / "corpus" / f"0{n}-doc.md").write_text(text)
    engine = Engine.of_profile(spark, str(tmp_path / "memory"))
    with pytest.raises(ValueError, match="confirmed"):
        engine.seed(str(tmp_path / "corpus"), at(1), "demo")
    for _ in range(2):
        counts = engine.seed(str(tmp_path / "corpus"), at(1), "demo", confirm=True)
        assert counts.agg(F.sum("relations_created"), F.sum("relations_superseded")).first() == (2, 1)
    assert live(engine) == {("Ada", "Initech")} and engine.table("turns").count() == 3
    with pytest.raises(ValueError, match="no files"):
        engine.seed(str(tmp_path / "corpus"), at(1), "demo", pattern="*.txt", confirm=True)
    with pytest.raises(ValueError, match="there are plain"):
        Engine.of_profile(spark, str(tmp_path / "other"), "none")


def test_remembered_turns_are_explicit(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "memory"), extract)
    engine.ingest(docs(spark, "Ada works at Acme."), at(1))
    engine.remember(docs(spark, "Ada works at Acme.", "Ada uses Spark."), at(2))
    assert {(r.session_id, r.turn_id) for r in engine.explicit_turns().collect()} == {("s", "0"), ("s", "1")}


def test_fold_of_a_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "seq long, ts timestamp, subject string, type string, object string, subtype string, confidence double"
    rows = [(0, datetime(2024, 1, 1), "s", "P", "a", "x", 0.5), (1, datetime(2024, 1, 2), "s", "P", "b", "x", 0.5), (2, datetime(2024, 1, 3), "s", "P", "b", None, 0.5)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    query = (
        stream_facts.fold_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        .writeStream.format("memory").queryName("folded").outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    assert [(r.outcome, r.closed) for r in spark.table("folded").orderBy("seq").collect()] == [("created", None), ("superseded", "a"), ("reinforced", None)]
