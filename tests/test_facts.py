from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from recollect.operators import facts

START = datetime(2024, 1, 1)
SCHEMA = "case int, seq int, ts timestamp_ntz, subject string, type string, object string, subtype string, confidence double, source_doc string"


def fold(kind, rows):
    """The decision table, row by row: reinforce a live edge, else supersede the slot's, else create."""
    edges = []
    for seq, (obj, sub) in enumerate(rows):
        live = [e for e in edges if e["until"] is None]
        agrees = lambda e: e["object"] == obj and (kind != "object" or e["sub"] is None or sub is None or e["sub"] == sub)  # noqa: B023, E731
        same = next((e for e in live if agrees(e)), None)
        if same:
            same["n"] += 1
            same["sub"] = sub if sub is not None else same["sub"]
            continue
        old = {
            "additive": None,
            "subject": next((e for e in live if e["object"] != obj), None),
            "object": next((e for e in live if e["object"] == obj and e["sub"] is not None and sub is not None and e["sub"] != sub), None),
            "subtype": next((e for e in live if e["object"] != obj and e["sub"] is not None and e["sub"] == sub), None),
        }[kind]
        if old:
            old["until"] = seq
        edges.append({"object": obj, "sub": sub, "from": seq, "until": None, "n": 1})
    return sorted(((e["object"], e["sub"], e["from"], e["until"], e["n"]) for e in edges), key=str)


def run(spark, function, cases):
    """All cases in one job, each as a subject of its own."""
    rows = [(c, i, START + timedelta(minutes=i), f"s{c}", "T", o, s, 0.5, f"d{i}") for c, case in enumerate(cases) for i, (o, s) in enumerate(case)]
    found = {c: [] for c in range(len(cases))}
    minute = lambda t: None if t is None else int((t - START).total_seconds() // 60)
    for e in function(spark.createDataFrame(rows, SCHEMA)).collect():
        found[int(e.subject[1:])].append((e.object, e.subtype, minute(e.valid_from), minute(e.valid_until), e.access_count))
    return [sorted(found[c], key=str) for c in range(len(cases))]


ASSERTION = st.tuples(st.sampled_from("abc"), st.sampled_from([None, "x", "y"]))
CASES = st.lists(st.lists(ASSERTION, min_size=1, max_size=9), min_size=40, max_size=40)
RELAXED = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.mark.parametrize("kind", ["additive", "subject", "object", "subtype"])
def test_windows_equal_the_fold(spark, kind):
    function = {"additive": facts.additive, "subject": facts.subject_keyed, "object": facts.object_keyed, "subtype": facts.subtype_keyed}[kind]

    @RELAXED
    @given(CASES)
    def check(cases):
        assert run(spark, function, cases) == [fold(kind, c) for c in cases]

    check()


def test_restricted_subtype_windows_equal_the_fold(spark):
    cases = [[(o, o.upper() if o != "c" else "A") for o in case] for case in ("abca", "acac", "aabbcc", "b", "cab")]
    assert run(spark, facts.subtype_keyed_single, cases) == [fold("subtype", c) for c in cases]


def test_two_edges_may_come_to_share_a_slot():
    """Asserting a live object under another subtype rewrites its edge; a later assertion closes only the older one."""
    assert [e[:2] for e in fold("subtype", [("a", "x"), ("b", "y"), ("a", "y")])] == [("a", "y"), ("b", "y")]


def test_qualifiers_and_provenance(spark):
    rows = [(0, START, "s", "T", "o", "x", 0.4, "d1", "5", None), (1, START, "s", "T", "o", None, 0.9, "d1", None, "kg"), (2, START, "s", "T", "o", "y", 0.1, "d2", "6", None)]
    frame = spark.createDataFrame(rows, "seq int, ts timestamp_ntz, subject string, type string, object string, subtype string, confidence double, source_doc string, quantity_value string, quantity_unit string")
    (e,) = facts.additive(frame).collect()
    assert (e.subtype, e.confidence, e.source_docs, e.quantity_value, e.quantity_unit, e.access_count) == ("y", 0.9, ["d1", "d2"], "6", "kg", 3)


def test_incomplete_assertions_are_set_aside(spark):
    frame = spark.createDataFrame([("a", "T", "b"), (None, "T", "b"), ("a", " ", "b"), ("a", "T", None)], "subject string, type string, object string")
    ok, rest = facts.reject_incomplete(frame)
    assert (ok.count(), rest.count()) == (1, 3)


def test_empty_log(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for function in (facts.additive, facts.subject_keyed, facts.object_keyed, facts.subtype_keyed):
        assert function(empty).count() == 0
