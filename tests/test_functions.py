from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recollect.functions import scoring, text
from recollect.functions import vocabulary as V

NOW = datetime(2024, 2, 1)


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("n", "days", "value"),
    [(1, 0, 0.693147), (5, 0, 1.791759), (10, 0, 2.0), (100, 7, 2.0), (100, 14, 1.153780), (0, 0, 0.0), (1, -3, 0.693147)],
)
def test_reinforcement(spark, n, days, value):
    last = F.lit(NOW - timedelta(days=days))
    assert one(spark, scoring.reinforcement(F.lit(n), last, F.lit(NOW))) == pytest.approx(value, abs=1e-6)


def test_never_accessed_has_no_boost(spark):
    assert one(spark, scoring.reinforcement(F.lit(3), F.lit(None).cast("timestamp"), F.lit(NOW))) == 0


@pytest.mark.parametrize(
    ("sim", "distance", "confidence", "boost", "value"),
    [(0.5, 1, 0.5, 0.0, 1.05), (0.5, 1, 0.5, 1.791759, 1.426269), (0.9, 0, 0.0, 0.0, 1.7), (0.9, 2, 0.9, 0.0, 1.436667), (5.0, 0, 7.0, 2.0, 2.94)],
)
def test_score(spark, sim, distance, confidence, boost, value):
    assert one(spark, scoring.score(*map(F.lit, (sim, distance, confidence, boost)))) == pytest.approx(value, abs=1e-6)
    assert scoring.Weights().ceiling == pytest.approx(2.94)


def test_cosine_of_a_zero_vector(spark):
    zero, unit = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, scoring.cosine(zero, unit)) == 0 and one(spark, scoring.cosine(unit, unit)) == pytest.approx(1)
    assert one(spark, scoring.unit(zero)) == [0, 0] and one(spark, scoring.unit(unit)) == pytest.approx([0.6, 0.8])


@pytest.mark.parametrize(("raw", "canonical"), [("works at", "WORKS_FOR"), ("\tpart of ", "MEMBER_OF"), ("leads", "LEADS"), ("KNOWS well", "KNOWS_WELL"), ("", "RELATED_TO"), (None, "RELATED_TO"), ("owned by", "BELONGS_TO")])
def test_relation_types(spark, raw, canonical):
    assert one(spark, V.normalize_relation_type(F.lit(raw).cast("string"))) == canonical


@pytest.mark.parametrize(("raw", "kind"), [("PERSON", "Person"), ("ceo", "Person"), ("To-Do", "Task"), ("  ", "Concept"), (None, "Concept"), ("gizmo", None)])
def test_entity_types(spark, raw, kind):
    assert one(spark, V.normalize_entity_type(F.lit(raw).cast("string"))) == kind


@pytest.mark.parametrize(("raw", "subtype"), [("Favorite  Color!", "favorite_color"), ("__", None), ("", None), (None, None), ("a", "a")])
def test_subtypes(spark, raw, subtype):
    assert one(spark, V.normalize_subtype(F.lit(raw).cast("string"))) == subtype


def test_vocabulary_sizes(spark):
    assert len(V.RELATION_TYPES) == 18 and len(V.ENTITY_TYPES) == 11
    assert V.relation_synonyms(spark).count() == 69
    assert {r.canonical for r in V.relation_synonyms(spark).collect()} == set(V.RELATION_TYPES) - {"RELATED_TO", "REPORTS_TO"}


def test_eligibility(spark):
    ok = lambda *v: one(spark, text.eligible(*[F.lit(x).cast("string") for x in v]))
    assert ok("s", "t", "user", "x") and ok("s", "t", None, "x")
    assert not any([ok("s", "t", "Tool ", "x"), ok("s", "t", "function", "x"), ok(" ", "t", "user", "x"), ok("s", None, "user", "x"), ok("s", "t", "user", "\n")])


def test_rendering(spark):
    n = F.lit(None).cast("string")
    assert one(spark, text.edge_label(F.lit("USES"), F.lit("daily"), F.lit("count"), F.lit("3"), F.lit("kg"), F.lit("2024"))) == "USES[daily] {count=3 kg, scope=2024}"
    assert one(spark, text.edge_label(F.lit("USES"), n, n, n, n, n)) == "USES"
    assert one(spark, text.entity_header(F.lit("A"), F.lit("Person"), F.lit(0), F.array(F.lit("x")))) == "A (Person) [seed]"
    assert one(spark, text.entity_header(F.lit("A"), F.lit("Person"), F.lit(2), F.array(F.lit("x"), F.lit("y")))) == "A (Person) [2 hops via x → y]"
    assert one(spark, text.verdict(F.lit('```json\n{"verdict": "Correct"}\n```'))) == "correct"
    assert one(spark, text.verdict(F.lit("no idea"))) == "incorrect"
    assert one(spark, text.safe_id(F.lit("a:b/c d"))) == "a_b_c_d"
    assert one(spark, text.fuzzy_contains(F.lit("Big Corp"), F.lit("corp"))) and not one(spark, text.fuzzy_contains(F.lit("a"), F.lit("b")))
    assert text.since(F.lit(NOW), 0) is None
    assert one(spark, text.f1(F.lit(0.0), F.lit(0.0))) == 0
