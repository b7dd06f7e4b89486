"""A table that one task reads is worked on by many, with the same results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import retrieve, vectors
from recollect.queries import graph as queries
from recollect.queries import model as M


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def below(plan, mark):
    """The lines of the subtree whose root holds ``mark``."""
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if mark in x)
    deep = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    return "\n".join(x for i, x in enumerate(lines) if i > at and all(d > deep[at] for d in deep[at + 1 : i + 1]))


def test_many_queries_deal_items_out(spark, monkeypatch):
    """and similarities that differ less than single precision can tell are ranked in doubles."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    rows = [(i, (base + 1e-6 * rng.normal(size=8)).tolist()) for i in range(400)] + [(i, base.tolist()) for i in range(400, 410)] + [(500, None), (501, [float("nan")] * 8), (502, [0.0] * 8)]
    items = spark.createDataFrame(rows, "item_id long, embedding array<double>").coalesce(1)
    asked = [(i, (base + rng.normal(size=8) * (i % 3)).tolist()) for i in range(40)]
    monkeypatch.setattr(vectors, "MANY", 40)
    found = vectors.top_k(spark.createDataFrame(asked, "query_id long, embedding array<double>"), items, 6)
    assert "RepartitionByExpression" in below(plan_of(found), "MapInArrow")
    by_query = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        by_query.setdefault(r.query_id, []).append(r.item_id)
    known = [(i, np.array(v)) for i, v in rows if v and v[0] == v[0]]
    for q, v in asked:
        v = np.array(v) / np.sqrt(vectors.in_order(np.array([v]), np.array([v])))
        units = np.array([w / max(np.sqrt(vectors.in_order(w[None], w[None]))[0], 1e-300) for _, w in known])
        sims = vectors.in_order(units, np.repeat(v[None], len(units), 0))
        assert by_query[q] == [i for _, i in sorted(zip(-sims, [i for i, _ in known]))][:6]


def test_eval_by_hops_deals_items_out(spark, tiny, monkeypatch):
    """F3."""
    want = sorted(map(tuple, queries.eval_by_hops(spark, tiny).collect()))
    monkeypatch.setattr(vectors, "MANY", 1)
    found = queries.eval_by_hops(spark, tiny)
    assert "RepartitionByExpression" in below(plan_of(found), "MapInArrow") and sorted(map(tuple, found.collect())) == want


def test_vector_only_deals_entities_out_before_they_meet_queries(spark, tiny):
    """F11."""
    found = queries.vector_only_retrieve(spark, tiny)
    mark = next(x for x in plan_of(found).splitlines() if "Join" in x and "doc_id" in x)
    assert "RepartitionByExpression [entity_id" in below(plan_of(found), mark)


def test_seeds_are_gathered_where_their_entities_were_dealt(spark, tiny):
    """the rows of queries and entities are not moved again."""
    plan = queries.seed_propagation(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x]
    assert any("hashpartitioning(entity_id" in x for x in moved) and not any("query_id" in x and "entity_id" in x.split("hashpartitioning(")[1].split(")")[0] for x in moved)


def test_seeds_by_entities_themselves_and_their_documents(spark):
    """ids that are null, repeated or not in the table of entities, and documents without an id."""
    v = [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0]]
    entities = spark.createDataFrame([("a", v[0]), ("a", v[1]), (None, v[0]), ("b", v[2])], "entity_id string, embedding array<double>")
    chunks = spark.createDataFrame([("k", 1, v[1]), ("l", None, v[0]), ("m", 2, v[2])], "chunk_id string, doc_id long, embedding array<double>")
    extracted = spark.createDataFrame([("a", 1), ("c", 1), ("c", 1), (None, 1), ("d", None), ("b", 2)], "entity_id string, doc_id long")
    asked = spark.createDataFrame([(7, v[0])], "query_id long, embedding array<double>")
    found, _ = retrieve.seeds_of(retrieve.Memory(entities, chunks, extracted, None), asked, 2)
    near = 0.9 / np.sqrt(0.82)
    assert {(r.query_id, r.entity_id, round(r.sim, 9)) for r in found.collect()} == {(7, "a", 1.0), (7, None, 1.0), (7, "c", round(near, 9))} and found.count() == 3


@pytest.mark.parametrize("name", ["path_render", "reinforce_log", "retriever_rows", "search_json", "search_text"])
def test_searches_deal_items_out_and_look_up_relations_once(spark, tiny, monkeypatch, name):
    """F5, F6, F8, F9, F10: relations are not joined with the seeds before they are summed up, and the rows are those of items left where they were."""
    want = sorted(map(tuple, getattr(queries, name)(spark, tiny).collect()))
    plans, plain = [], vectors.top_k
    monkeypatch.setattr(vectors, "MANY", 1)
    monkeypatch.setattr(vectors, "top_k", lambda *a, **k: plans.append(plain(*a, **k)) or plans[-1])
    monkeypatch.setattr(retrieve, "hydrate", None)
    found = sorted(map(tuple, getattr(queries, name)(spark, tiny).collect()))
    assert found == want and len(plans) == 2 and all("RepartitionByExpression" in below(plan_of(p), "MapInArrow") for p in plans)
