from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recollect.operators import chunking, coerce, evals, graph, provenance, retrieve, vectors

NOW = datetime(2024, 2, 1)
EDGES = "edge_id string, subject_id string, object_id string, type string, subtype string, confidence double, access_count long, last_accessed timestamp, valid_until timestamp"
ENTITIES = "entity_id string, name string, type string, canonical boolean, access_count long, last_accessed timestamp, embedding array<float>"


def edges(spark, *rows):
    return spark.createDataFrame([(i, s, o, "T", None, float(c), 0, None, NOW if dead else None) for i, s, o, c, dead in rows], EDGES)


@pytest.fixture(scope="module")
def memory(spark):
    ent = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [-1.0, 0.0]), ("d", [0.0, -1.0]), ("z", [0.9, 0.1])]
    entities = spark.createDataFrame([(i, f"name {i}", "Person", i != "z", 0, None, v) for i, v in ent], ENTITIES)
    chunks = spark.createDataFrame([("k1", 1, [0.0, 1.0]), ("k2", 2, [1.0, 0.0])], "chunk_id string, doc_id long, embedding array<float>")
    extracted = spark.createDataFrame([("b", 1), ("d", 2), ("z", 2)], "entity_id string, doc_id long")
    relations = edges(spark, ("e1", "a", "b", 0.8, False), ("e2", "b", "c", 0.4, False), ("e3", "a", "c", 1.0, True), ("e4", "d", "d", 0.9, True))
    return retrieve.Memory(entities, chunks, extracted, relations)


def test_search_expands_over_live_edges_and_canonical_targets(spark, memory):
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    found, chunks = retrieve.search(memory, queries, F.lit(NOW), hops=2, seed_k=1)
    rows = {r.entity_id: r for r in found.collect()}
    # z is no canonical entity, d has nothing but a superseded edge, and a superseded edge is no way to c.
    assert set(rows) == {"a", "b", "c"}
    assert (rows["a"].distance, rows["b"].distance, rows["c"].distance) == (0, 1, 2)
    assert rows["c"].edge_confidence == pytest.approx(0.6) and [p.edge_id for p in rows["c"].path] == ["e1", "e2"]
    assert rows["a"].score == pytest.approx(1.8) and rows["b"].score == pytest.approx(1 + 0.4 + 0.24)
    assert [r.chunk_id for r in chunks.collect()] == ["k2"]


def test_an_empty_scope_allows_nothing(spark, memory):
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    nothing = spark.createDataFrame([], "query_id long, entity_id string")
    found, _ = retrieve.search(memory, queries, F.lit(NOW), allowed_entities=nothing)
    assert found.count() == 0


def test_scope_by_session_and_time(spark):
    turns = spark.createDataFrame([("s", "s:1", datetime(2024, 1, 1)), ("s", "s:2", datetime(2024, 1, 9)), ("r", "r:1", datetime(2024, 1, 9))], "session_id string, turn_key string, ts timestamp")
    mentions = spark.createDataFrame([("a", "s:1"), ("b", "s:2"), ("c", "r:1")], "entity_id string, turn_key string")
    scope = spark.createDataFrame([(1, "s", None), (2, None, datetime(2024, 1, 5)), (3, "s", datetime(2024, 1, 5)), (4, "x", None)], "query_id long, session_id string, since timestamp")
    found = {(r.query_id, r.entity_id) for r in retrieve.allow_entities(scope, turns, mentions).collect()}
    assert found == {(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "b")}


def test_shortest_paths_choose_the_smallest_edges(spark):
    e = edges(spark, ("e2", "a", "b", 1, False), ("e1", "a", "c", 1, False), ("e3", "b", "d", 1, False), ("e4", "c", "d", 1, False), ("e9", "d", "a", 1, False))
    seeds = spark.createDataFrame([("a",), ("q",)], "seed string")
    found = {r.target: (r.distance, [p.edge_id for p in r.path]) for r in graph.shortest_paths(seeds, e, 3, F.struct("edge_id")).collect()}
    assert found == {"b": (1, ["e2"]), "c": (1, ["e1"]), "d": (1, ["e9"])}
    assert {(r.target, r.distance) for r in graph.reachable(seeds, e, 1).collect()} == {("b", 1), ("c", 1), ("d", 1)}
    with pytest.raises(ValueError):
        graph.shortest_paths(seeds, e, 6)


def test_all_paths_use_no_edge_twice(spark):
    e = edges(spark, ("e1", "a", "b", 1, False), ("e2", "b", "a", 1, False), ("e3", "b", "c", 1, False))
    found = {tuple(r.edge_ids) for r in graph.all_paths(spark.createDataFrame([("a",)], "seed string"), e, 9).collect()}
    assert found == {("e1",), ("e2",), ("e1", "e3"), ("e2", "e3")}


def test_top_k_in_rounds_equals_one_round(spark):
    items = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "item_id long, embedding array<float>")
    queries = spark.createDataFrame([(i, [float(i), 2.0, 1.0]) for i in range(9)], "query_id long, embedding array<float>")
    whole = sorted(map(tuple, vectors.top_k(queries, items, 3).collect()))
    assert whole == sorted(map(tuple, vectors.top_k(queries, items, 3, most_queries=2).collect())) and len(whole) == 27


def test_upsert_and_dimension(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, x string, at int")
    assert sorted((r.id, r.x) for r in vectors.upsert(old, spark.createDataFrame([(1, "c", 2)], "id int, x string, at int"), "id", "at").collect()) == [(1, "c"), (2, "b")]
    with pytest.raises(Exception, match="vector of 1"):
        vectors.check_dimension(spark.createDataFrame([([1.0],)], "embedding array<float>"), 2).collect()


def test_coercion(spark):
    canon = spark.createDataFrame([("USES", [1.0, 0.0]), ("LEADS", [0.0, 1.0])], "canonical string, embedding array<float>")
    raw = spark.createDataFrame([("utilises", [0.9, 0.1]), ("leads", [0.7, 0.7]), ("uses", [0.0, 1.0]), ("built on", [0.0, 1.0]), ("odd", [-1.0, -1.0]), ("", [1.0, 0.0])], "raw string, embedding array<float>")
    found = {r.raw: r.type for r in coerce.coerce_relation_types(raw, canon).collect()}
    # A canonical type gives way to a clearly nearer one, a synonym never does.
    assert found == {"utilises": "USES", "leads": "LEADS", "uses": "LEADS", "built on": "USES", "odd": "ODD", "": "RELATED_TO"}
    kinds = spark.createDataFrame([("Person", [1.0, 0.0]), ("Task", [0.0, 1.0])], "canonical string, embedding array<float>")
    found = {r.raw: (r.type, round(r.sim, 3)) for r in coerce.coerce_entity_types(spark.createDataFrame([("CEO", [0.0, 1.0]), ("bloke", [1.0, 0.0]), ("blob", [-1.0, 0.0]), (" ", [1.0, 0.0])], "raw string, embedding array<float>"), kinds).collect()}
    assert found == {"CEO": ("Person", 1.0), "bloke": ("Person", 1.0), "blob": ("blob", 0.0), " ": ("Concept", 0.0)}


def test_resolution_by_type_and_of_unknown_type(spark):
    stored = spark.createDataFrame([("p", "Person", [1.0, 0.0]), ("o", "Organization", [0.99, 0.14])], "entity_id string, type string, embedding array<float>")
    mentions = spark.createDataFrame([(1, "Person", [1.0, 0.1]), (2, "Organization", [0.0, 1.0]), (3, "Unknown", [1.0, 0.01]), (4, "Unknown", [0.5, 0.8])], "mention_id int, type string, embedding array<float>")
    found = {r.mention_id: r.entity_id for r in coerce.resolve_entities(mentions, stored).collect()}
    assert found == {1: "p", 2: None, 3: "p", 4: None}


def test_aliases(spark):
    e = spark.createDataFrame([("1", "Ada", "Person", ["A."]), ("2", "Bob", "Person", [])], "entity_id string, name string, type string, aliases array<string>")
    r = spark.createDataFrame([("ADA", "1", 0.9), ("A.", "1", 0.9), ("Lady A", "1", 0.9), ("Lady A", "1", 0.95)], "alias string, canonical_id string, sim double")
    entities, stubs, same_as = provenance.add_aliases(e, r)
    assert {x.entity_id: x.aliases for x in entities.collect()} == {"1": ["A.", "Lady A"], "2": []}
    assert [(x.name, x.canonical) for x in stubs.collect()] == [("Lady A", False)]
    assert [(x.canonical_id, x.confidence) for x in same_as.collect()] == [("1", 0.95)]


def test_conversations_and_turns(spark):
    rows = [("s", "1", datetime(2024, 1, 2), None), ("s", "2", datetime(2024, 1, 3), "Named"), ("a:b", "1", datetime(2024, 1, 1), None), ("s", "1", datetime(2024, 1, 9), "later")]
    turns = spark.createDataFrame(rows, "session_id string, turn_id string, ts timestamp, title string")
    found = {r.session_id: r for r in provenance.merge_conversations(turns).collect()}
    assert found["s"].title == "Named" and found["s"].last_active_at == datetime(2024, 1, 9)
    assert found["a:b"].title.startswith("agent:20240101T000000Z:")
    assert sorted(r.turn_key for r in provenance.merge_turns(turns).collect()) == ["s:1", "s:2"]
    assert provenance.quarantine(turns).count() == 1


def test_documents_already_stored_are_left_out(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "doc_id int, text string")
    stored = provenance.merge_documents(docs.where("doc_id = 3"))
    assert [r.doc_id for r in provenance.merge_documents(docs, stored).collect()] == [1]


def test_splitting_keeps_headings_and_overlaps():
    text = "intro words here\n\n# One\n" + "a b c. " * 60 + "\n\n## Two\nshort"
    chunks = chunking.split_text(text, 40, 8)
    assert chunks[0][1] == "intro words here" and chunks[1][1].startswith("# One") and chunks[-1][1] == "## Two\nshort"
    assert all(chunking.word_length(c) <= 40 for _, c in chunks)
    assert chunks[2][1].split()[0] in chunks[1][1].split()
    assert chunking.split_text("  \n ") == [] and chunking.split_text("x" * 50, 10, 2, len)[0] == (0, "x" * 10)


def test_encoder_and_extractor(spark):
    docs = spark.createDataFrame([(1, "Ada works at Acme. Bob works at Initech."), (2, None)], "doc_id int, text string")
    found = {(r.subject, r.object) for r in chunking.extract_by_patterns(docs, {"WORKS_FOR": r"(\w+) works at (\w+)"}).collect()}
    assert found == {("Ada", "Acme"), ("Bob", "Initech")}
    vec = chunking.encode_texts(docs, chunking.HashingEncoder(16)).collect()
    assert len(vec[0].embedding) == 16 and sum(x * x for x in vec[0].embedding) == pytest.approx(1, abs=1e-5)


def test_metrics(spark):
    results = spark.createDataFrame([(1, 1, "x"), (1, 2, "Big Corp"), (2, 1, "y")], "question_id int, rank int, name string")
    wanted = spark.createDataFrame([(1, "corp"), (2, "zzz")], "question_id int, wanted string")
    row = evals.hit_rate_and_mrr(evals.first_hits(results, wanted)).first()
    assert (row.hit_rate, row.mrr) == (0.5, 0.25)
    a, b = (spark.createDataFrame([(x,) for x in v], "k string") for v in (["p", "q"], ["q", "r", "s"]))
    row = evals.match_scores(a, b, ["k"]).first()
    assert (row.tp, row.precision, row.f1) == (1, 0.5, pytest.approx(0.4))
    assert evals.match_scores(a.limit(0), b, ["k"]).first().f1 == 0
    sessions = spark.createDataFrame([(f"s{i}",) for i in range(9)], "session_id string")
    assert [r.session_id for r in evals.haystack(sessions, spark.createDataFrame([("s7",)], "session_id string"), 3).collect()][0] == "s7"


def test_chunks_by_tokens_against_a_plain_splitter(spark, tiny):
    """The registered query's chunks: within the limit in tokens, cut from the text in order, sharing at most the overlap, and as a splitter that looks at whole pieces makes them."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from recollect.queries import documents

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    length = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)

    def pieces(text, cuts=("\n\n", "\n", ". ", " ", "")):
        if length(text) <= 200 or not cuts:
            return [text]
        cut, rest = next(((c, cuts[i + 1 :]) for i, c in enumerate(cuts) if c == "" or c in text), ("", ()))
        parts = list(text) if cut == "" else [p + cut for p in text.split(cut)[:-1]] + text.split(cut)[-1:]
        return [x for p in parts if p for x in (pieces(p, rest) if length(p) > 200 and cut else [p])]

    def plain(text):
        out, held = [], []
        for piece in pieces(text.strip()):
            if held and sum(map(length, held)) + length(piece) > 200:
                out.append("".join(held))
                while held and (sum(map(length, held)) > 25 or sum(map(length, held)) + length(piece) > 200):
                    held.pop(0)
            held.append(piece)
        return out + ["".join(held)] if held else out

    rows = spark.read.parquet(f"{tiny}/documents.parquet").where("length(text) < 6000").limit(25).collect()
    cut = chunking.chunk_documents(spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string"), 200, 25, chunking.TokenLength(public_tokenizers.path("word_bpe_49k.json"))).collect()
    for r in rows:
        mine = [c.text for c in sorted((c for c in cut if c.doc_id == r.doc_id), key=lambda c: c.chunk_index)]
        assert mine == [c.strip() for c in plain(r.text or "") if c.strip()]
        assert all(c in r.text and length(c) <= 200 for c in mine)
    assert documents.recursive_chunks(spark, tiny).columns == ["doc_id", "chunk_index", "position", "chunk_id", "n_chars"]
