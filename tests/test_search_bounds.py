"""A search leaves out, before it looks for paths, what can't be among its results, and does nothing twice."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from recollect.operators import graph, retrieve, vectors
from recollect.queries import graph as queries
from tests.test_retrieval_at_size import NOW, plain_search, plan_of


@pytest.mark.parametrize("seed, age, limit", [(1, 30, 3), (2, 900, 2), (3, 900, 40)])
def test_seeds_that_cannot_matter_get_no_paths(spark, monkeypatch, seed, age, limit):
    """fewer seeds and hops where a query has strong seeds, and the results of every path."""
    rng = random.Random(seed)
    names = [f"e{i:02}" for i in range(50)]
    at = lambda: NOW - timedelta(hours=rng.randrange(1, age))
    entities = {e: (rng.random() < 0.9, rng.randrange(9), at()) for e in names}
    docs = [(e, rng.randrange(5)) for e in names]
    relations = [(f"r{i:03}", *rng.sample(names, 2), rng.random(), rng.randrange(4), at(), rng.random() < 0.2) for i in range(70)]
    # Chunks far from all queries but the first one's.
    chunk, asked = {f"k{i}": (i, [1.0, i / 9]) for i in range(5)}, {0: [1.0, 0.0], 1: [0.2, 1.0]}
    memory = retrieve.Memory(
        spark.createDataFrame([(e, e, "T", c, n, t, [0.0, -1.0]) for e, (c, n, t) in entities.items()], "entity_id string, name string, type string, canonical boolean, access_count long, last_accessed timestamp_ntz, embedding array<double>"),
        spark.createDataFrame([(k, d, v) for k, (d, v) in chunk.items()], "chunk_id string, doc_id long, embedding array<double>"),
        spark.createDataFrame(docs, "entity_id string, doc_id long"),
        spark.createDataFrame([(i, s, o, "T", None, c, n, t, NOW if dead else None) for i, s, o, c, n, t, dead in relations],
                              "edge_id string, subject_id string, object_id string, type string, subtype string, confidence double, access_count long, last_accessed timestamp_ntz, valid_until timestamp_ntz"),
    )
    seen, plain = [], graph.shortest_paths
    monkeypatch.setattr(graph, "shortest_paths", lambda seeds, edges, hops, *a, **k: seen.append((seeds, hops)) or plain(seeds, edges, hops, *a, **k))
    found = retrieve.search(memory, spark.createDataFrame(list(asked.items()), "query_id long, embedding array<double>"), F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'"), limit=limit, seed_k=2)[0].collect()
    cos = lambda a, b: (a[0] * b[0] + a[1] * b[1]) / ((a[0] ** 2 + a[1] ** 2) * (b[0] ** 2 + b[1] ** 2)) ** 0.5
    every = set()
    for q, v in asked.items():
        near = [(e, cos(v, [0.0, -1.0])) for e in names[:2]]
        hits = [(chunk[k][0], s) for k, s in sorted(((k, cos(v, w)) for k, (_, w) in chunk.items()), key=lambda x: (-x[1], x[0]))[:2]]
        every |= {e for e, d in docs if d in {h for h, _ in hits}}
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        want = plain_search(entities, docs, relations, near, hits, limit)
        assert [(r.entity_id, r.distance) for r in mine] == [(e, d) for e, _, d in want]
        assert [r.score for r in mine] == pytest.approx([s for _, s, _ in want])
    alive = {e for e in every if entities[e][0] and (not any(e in r[1:3] for r in relations) or any(e in r[1:3] for r in relations if not r[6]))}
    if limit == 3:
        assert seen[0][0].count() < len(alive) or seen[0][1] == 1
    if limit == 40:
        assert seen[0][0].count() >= len(alive) and seen[0][1] == 2


def test_reinforce_log_ranks_once(spark, tiny):
    """entities and edges from one pass over the results."""
    assert plan_of(queries.reinforce_log(spark, tiny)).count("max_by(") <= 1


def test_retriever_rows_reads_results_once(spark, tiny):
    """F8: results are kept for their rows and their count, and the few chunks go to the passages."""
    plan = plan_of(queries.retriever_rows(spark, tiny))
    assert "max_by(" not in plan and any("broadcast" in x for x in plan.splitlines() if "Join" in x and "chunk_id" in x)


def searched_once(monkeypatch, make):
    """The plan of a search whose queries are collected once, for both vector searches."""
    times, plain = [], vectors.asked
    monkeypatch.setattr(vectors, "asked", lambda *a, **k: times.append(1) or plain(*a, **k))
    plan = plan_of(make())
    assert times == [1] and any("broadcast" in x for x in plan.splitlines() if "Join" in x and "chunk_id" in x)


def test_search_json_collects_queries_once(spark, tiny, monkeypatch):
    """and the few chunks go to the passages."""
    searched_once(monkeypatch, lambda: queries.search_json(spark, tiny))


def test_search_text_collects_queries_once(spark, tiny, monkeypatch):
    """and the few chunks go to the passages."""
    searched_once(monkeypatch, lambda: queries.search_text(spark, tiny))


def test_search_text_sends_few_seeds_to_edges(spark, tiny, monkeypatch):
    """what queries met stays in the driver, edges of few seeds stay where they are, and moved ones give the same."""
    few, plain = [], graph.shortest_paths
    monkeypatch.setattr(graph, "shortest_paths", lambda *a, **k: few.append(k["few"]) or plain(*a, **k))
    monkeypatch.setattr(retrieve, "documents_of", None)
    sent = sorted(map(tuple, queries.search_text(spark, tiny).collect()))
    monkeypatch.setattr(retrieve, "FEW", -1)
    assert sorted(map(tuple, queries.search_text(spark, tiny).collect())) == sent and few == [True, False]


def test_both_ways_of_edges_come_from_one_pass(spark):
    """F10."""
    edges = spark.createDataFrame([("r", "a", "b"), ("s", "a", "a"), ("t", None, "b"), ("r", "a", "b")], "edge_id string, subject_id string, object_id string")
    both = graph.undirected(edges)
    assert sorted(map(tuple, both.collect())) == [("a", "b", "r"), ("a", "b", "r"), ("b", "a", "r"), ("b", "a", "r")] and "Union" not in plan_of(both)


def test_documents_are_met_with_the_vectors(spark):
    """items bring the columns that are asked for, those without a vector too."""
    items = spark.createDataFrame([("k", 1, [1.0, 0.0]), ("l", None, [0.9, 0.1]), ("m", 2, None), ("n", 2, [0.0, 1.0])], "item_id string, doc_id long, embedding array<double>")
    found = vectors.top_k(spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<double>"), items, 4, carry=("doc_id",))
    assert [(r.item_id, r.doc_id, r.sim is None) for r in found.orderBy("rank").collect()] == [("k", 1, False), ("l", None, False), ("n", 2, False), ("m", 2, True)]
