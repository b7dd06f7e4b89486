"""Retrieval does a query's work once for all queries, and what it leaves out is never among the results."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recollect.operators import graph, retrieve, vectors
from recollect.queries import graph as queries
from recollect.queries import model as M

NOW = datetime(2024, 2, 1)


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_top_k_compares_in_tasks_and_sends_on_no_vectors(spark):
    """copies and vectors that can't be compared are ranked by id, and k rows for each task and query leave it."""
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(60)] + [(60, None), (61, [1.0]), (62, [float("nan"), 1.0]), (63, [0.0, 0.0])]
    items = spark.createDataFrame(rows, "item_id long, embedding array<float>").coalesce(1)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0]), (3, None)], "query_id long, embedding array<float>")
    found = vectors.top_k(asked, items, 4)
    by_query = {q: [(r.item_id, r.sim) for r in found.where(F.col("query_id") == q).orderBy("rank").collect()] for q in (1, 2, 3)}
    assert by_query[1] == [(1, 1.0), (3, 1.0), (5, 1.0), (7, 1.0)]
    assert by_query[2] == [(61, 1.0), (0, None), (1, None), (2, None)] and by_query[3] == [(i, None) for i in range(4)]
    assert "zip_with" not in plan_of(found).lower()


def test_chunk_baseline_joins_found_items_only(spark, tiny):
    """no join of queries and items by label alone."""
    assert "type#" not in "".join(line for line in plan_of(queries.chunk_baseline(spark, tiny)).splitlines() if "Join" in line and "question_id#" not in line)


@pytest.mark.parametrize("name", ["eval_pk_mrr", "eval_by_hops"])
def test_evaluations_take_the_first_entities_of_documents(spark, tiny, monkeypatch, name):
    """ten results for each query are asked for, which are those of the whole ranking."""
    memory, asked, limits, plain = M.vector_memory(spark, tiny), M.vector_queries(spark, tiny), [], retrieve.vector_only
    whole = plain(memory, asked).where("rank <= 10")
    assert sorted(map(tuple, plain(memory, asked, limit=10).collect())) == sorted(map(tuple, whole.collect()))
    monkeypatch.setattr(retrieve, "vector_only", lambda *a, limit=None: limits.append(limit) or plain(*a, limit=limit))
    assert getattr(queries, name)(spark, tiny).count() and limits == [10]


@pytest.mark.parametrize("name", ["hybrid_retrieve", "path_render", "reinforce_log", "retriever_rows", "search_json", "search_text"])
def test_paths_are_found_once_for_all_queries(spark, tiny, monkeypatch, name):
    """F4, F5, F6, F8, F9, F10."""
    seen, plain = [], graph.shortest_paths
    monkeypatch.setattr(graph, "shortest_paths", lambda seeds, *a, **k: seen.append(seeds) or plain(seeds, *a, **k))
    getattr(queries, name)(spark, tiny)
    assert [s.columns for s in seen] == [["seed"]] and seen[0].count() == seen[0].distinct().count()


def test_chunks_need_no_paths(spark, tiny, monkeypatch):
    """F7."""
    monkeypatch.setattr(graph, "shortest_paths", None)
    assert queries.retrieved_chunks(spark, tiny).count() == 30


@pytest.mark.parametrize("frame", [lambda s, d: queries.seed_propagation(s, d), lambda s, d: queries.vector_only_retrieve(s, d)])
def test_entities_of_documents_are_joined_in_place(spark, tiny, frame):
    """the few documents of queries go to the entities and not the other way round; rows of a query meet once."""
    plan = plan_of(frame(spark, tiny))
    joins = [line for line in plan.splitlines() if "Join" in line and "doc_id" in line]
    assert joins and all("broadcast" in line for line in joins)


def plain_search(entities, docs, relations, sims, hits, limit):
    """Ranked (entity, score, distance) of one query, path by path."""
    def boost(n, at):
        return min(math.log1p(n) * math.exp(-math.log(2) / 604_800 * max((NOW - at).total_seconds(), 0)), 2.0) if n and at else 0.0

    live, touched = [r for r in relations if not r[6]], {x for r in relations for x in r[1:3]}
    seeds = {}
    for e, sim in [*sims, *((e, max(s for d, s in hits if d == doc)) for e, doc in docs if doc in {d for d, _ in hits})]:
        if entities[e][0] and (e not in touched or any(e in r[1:3] for r in live)):
            seeds[e] = max(sim, seeds.get(e, -9))
    best = {}
    for seed, sim in seeds.items():
        seen, level = {seed: []}, {seed: []}
        for _ in range(2):
            reached = {}
            for node, path in level.items():
                for r in live:
                    for a, b in ((r[1], r[2]), (r[2], r[1])):
                        if a == node and a != b and b not in seen:
                            reached[b] = min(reached.get(b, [("~",)]), [*path, r])
            seen |= reached
            level = reached
        for target, path in seen.items():
            if entities[target][0]:
                conf = sum(r[3] for r in path) / max(1, len(path))
                b = max([boost(*entities[target][1:]), *(boost(r[4], r[5]) for r in path)])
                score = (min(max(sim, 0), 1) + 0.8 / (1 + len(path)) + 0.3 * conf) * (1 + 0.2 * b)
                best[target] = max(best.get(target, (-1, 0)), (score, -len(path)))
    return sorted(((e, s, -d) for e, (s, d) in best.items()), key=lambda x: (-x[1], x[2], x[0]))[:limit]


def test_bounded_search_against_every_path(spark):
    rng = random.Random(5)
    names = [f"e{i:02}" for i in range(60)]
    at = lambda: NOW - timedelta(hours=rng.randrange(900))
    entities = {e: (rng.random() < 0.9, rng.randrange(3), at()) for e in names}
    docs = sorted({(rng.choice(names), rng.randrange(6)) for _ in range(80)})
    relations = [(f"r{i:03}", *rng.sample(names, 2), rng.random(), rng.randrange(9), at(), rng.random() < 0.2) for i in range(90)]
    vector = lambda: [rng.gauss(0, 1) for _ in range(3)]
    vec, chunk, asked = {e: vector() for e in names}, {f"k{i:02}": (i % 6, vector()) for i in range(20)}, {q: vector() for q in range(5)}
    memory = retrieve.Memory(
        spark.createDataFrame([(e, e, "T", c, n, t, vec[e]) for e, (c, n, t) in entities.items()], "entity_id string, name string, type string, canonical boolean, access_count long, last_accessed timestamp_ntz, embedding array<double>"),
        spark.createDataFrame([(k, d, v) for k, (d, v) in chunk.items()], "chunk_id string, doc_id long, embedding array<double>"),
        spark.createDataFrame(docs, "entity_id string, doc_id long"),
        spark.createDataFrame([(i, s, o, "T", None, c, n, t, NOW if dead else None) for i, s, o, c, n, t, dead in relations],
                              "edge_id string, subject_id string, object_id string, type string, subtype string, confidence double, access_count long, last_accessed timestamp_ntz, valid_until timestamp_ntz"),
    )
    frame = spark.createDataFrame(list(asked.items()), "query_id long, embedding array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    now = F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'")
    for limit in (4, 100):
        found = retrieve.search(memory, frame, now, limit=limit)[0].collect()
        odd = retrieve.search(memory, frame, now, limit=limit, allowed_entities=spark.createDataFrame([(e,) for e in names[1::2]], "entity_id string"))[0].collect()
        for q, v in asked.items():
            near = sorted(((e, cos(v, w)) for e, w in vec.items()), key=lambda x: (-x[1], x[0]))[:5]
            hits = [(chunk[k][0], s) for k, s in sorted(((k, cos(v, w)) for k, (_, w) in chunk.items()), key=lambda x: (-x[1], x[0]))[:5]]
            want = plain_search(entities, docs, relations, near, hits, 1_000)
            for rows, kept in ((found, want[:limit]), (odd, [x for x in want if int(x[0][1:]) % 2][:limit])):
                mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
                assert [(r.entity_id, r.distance) for r in mine] == [(e, d) for e, _, d in kept]
                assert [r.score for r in mine] == pytest.approx([s for _, s, _ in kept])
