from datetime import datetime

import pytest

from recollect.plans import adhoc
from recollect.sources import files
from recollect.streaming import turns as T

ALLOWED = [
    "SELECT 1", "SELECT 'DROP TABLE x' AS s -- CREATE", "WITH a AS (SELECT 1 AS x) SELECT * FROM a", "SELECT * FROM VALUES (1), (2) AS t(x) WHERE x IN (SELECT 1)",
    "SELECT x, row_number() OVER (ORDER BY x) FROM VALUES (1) AS t(x) ORDER BY x LIMIT 1", "SELECT explode(array(1, 2))", "SELECT 1 UNION SELECT 2",
]
REFUSED = [
    "DROP TABLE x", "CREATE TABLE y AS SELECT 1", "INSERT INTO x VALUES (1)", "SET a = 1", "WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a", "SELECT 1; DROP TABLE x", "CACHE TABLE x",
    "USE other", "EXPLAIN SELECT 1", "SHOW TABLES", "/* hm */ DELETE FROM x", "TRUNCATE TABLE x", "REFRESH TABLE x", "DESCRIBE x", "BEGIN SELECT 1; END",
]


@pytest.mark.parametrize("statement", ALLOWED)
def test_reading_is_allowed(spark, statement):
    adhoc.run(spark, statement).collect()


@pytest.mark.parametrize("statement", REFUSED)
def test_writing_is_refused(spark, statement):
    with pytest.raises(adhoc.NotReadOnly):
        adhoc.assert_read_only(spark, statement)


def test_parameters(spark):
    assert adhoc.run(spark, "SELECT :x + 1 AS y", args={"x": 4}).first().y == 5


def test_text_files(spark, tmp_path):
    for name, body in (("b.md", b"# B"), ("a.md", "é".encode()), ("c.txt", b"no"), ("d.md", b"\xff\xfe")):
        (tmp_path / name).write_bytes(body)
    docs = files.text_documents(spark, str(tmp_path), "*.md")
    assert {r.title: r.text for r in docs.collect()} == {"a": "é", "b": "# B", "d": None}
    assert files.quarantine(docs).count() == 1
    assert {r.title: r.turn_id for r in files.numbered_turns(docs, "s").collect()} == {"a": "t0", "b": "t1", "d": "t2"}


def test_questions(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"questions": [{"question_id": "1", "question_type": "x"}, {"question_id": "2", "question_type": "y"}, {"question_id": "3", "question_type": "y"}]}')
    assert files.questions(spark, str(tmp_path / "q.json"), "y", 1).count() == 1
    (tmp_path / "l.json").write_text('[{"question_id": "1", "question_type": "x"}]')
    assert files.questions(spark, str(tmp_path / "l.json")).first().question_id == "1"


def test_store(spark, tmp_path):
    store = files.Store(spark, str(tmp_path / "store"))
    store.create("t", "id long")
    store.create("u", "id long, name string")
    assert store.read("t").count() == 0 and not store.exists("t")
    batch = store.begin()
    batch.write("t", spark.range(3))
    batch.write("u", spark.range(1).selectExpr("'x' AS name", "id"))
    assert store.read("t").count() == 0
    batch.commit()
    assert store.read("t").count() == 3 and store.read("u").first().name == "x"
    # Two writers of one number: the second one fails, and nothing of it is seen.
    one, two = store.begin(), store.begin()
    for b in (one, two):
        b.write("t", spark.range(10, 12))
    one.commit()
    with pytest.raises(Exception, match="exist"):
        two.commit()
    assert store.read("t").count() == 5
    other = files.Store(spark, str(tmp_path / "store"))
    other.create("t", "id long")
    other.create("u", "id long, name string")
    other.compact()
    assert sorted(r.id for r in store.read("t").collect()) == [0, 1, 2, 10, 11] and store.begin().number == 4
    files.write_json(store.read("t"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 5
    with pytest.raises(ValueError):
        store.wipe()
    store.wipe(confirm=True)
    assert not store.exists("t")


SCHEMA = "session_id string, turn_id string, role string, text string, ts timestamp"


def test_capture_of_a_stream(spark, tmp_path):
    """Turns are taken once, by their text and ids; a turn that fails doesn't hold up the others and comes again until it is taken."""
    def arrive(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    explicit = spark.createDataFrame([("s", "3")], "session_id string, turn_id string")
    taken, failed, broken = [], [], [True]

    def ingest(batch, number):
        got = [(r.turn_id, r.role, r.text, r.title) for r in batch.collect()]
        if broken[0] and any(x[2] == "boom" for x in got):
            raise RuntimeError("boom")
        taken.extend(got)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        query = T.capture(stream, str(tmp_path / "ckpt"), ingest, lambda b, n, e: failed.append(str(e)), explicit)
        query.awaitTermination(120)
        assert query.exception() is None

    day = datetime(2024, 1, 1)
    first = [("1", "user", "hello", "conversation:s:1:user"), ("5", "user", "fine", "conversation:s:5:user")]
    arrive(("s", "1", "User", " hello ", day), ("s", "1", "user", "hello", datetime(2024, 1, 1, 0, 1)), ("s", "2", "tool", "x", day), ("s", "3", "user", "explicit", day), ("s", "4", None, "boom", day), ("s", "5", "user", "fine", day))
    run()
    assert sorted(taken) == first and failed == ["boom"]
    arrive(("s", "1", "user", "hello", datetime(2024, 1, 5)), ("s", "6", "user", "new", day))
    run()
    assert sorted(taken) == [*first, ("6", "user", "new", "conversation:s:6:user")] and failed == ["boom"] * 2
    broken[0] = False
    arrive(("s", "4", None, "boom", datetime(2024, 1, 6)))
    run()
    assert sorted(taken) == sorted([*first, ("6", "user", "new", "conversation:s:6:user"), ("4", "unknown", "boom", "conversation:s:4:unknown")])
    assert len(failed) == 2


def test_capture_state_gathers_what_was_seen(spark, tmp_path):
    state = T.CaptureState(spark, str(tmp_path / "state"))
    for n in range(3):
        state.write("seen", n, spark.createDataFrame([(f"f{n}",)], "fingerprint string"))
    like = spark.createDataFrame([], "fingerprint string")
    assert state.numbers("seen") == [0, 1, 2] and state.read("seen", like).count() == 3
    state.drop("seen", [0, 1])
    assert [r.fingerprint for r in state.read("seen", like).collect()] == ["f2"] and state.read("owed", like).count() == 0


def test_touches_of_a_stream(spark, tmp_path):
    rows = [("a", datetime(2024, 1, 1, 1)), ("a", datetime(2024, 1, 1, 2)), ("b", datetime(2024, 1, 2))]
    spark.createDataFrame(rows, "entity_id string, ts timestamp").write.parquet(str(tmp_path / "in"))
    counts = T.touch_counts(spark.readStream.schema("entity_id string, ts timestamp").parquet(str(tmp_path / "in")))
    query = counts.writeStream.format("memory").queryName("touches_seen").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.entity_id, r.touches) for r in spark.table("touches_seen").collect()) == [("a", 2), ("b", 1)]


def test_look_back(spark):
    frame = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2024, 1, 3),)], "ts timestamp")
    from pyspark.sql import functions as F

    now = F.lit(datetime(2024, 1, 3, 12))
    assert T.since(frame, now, 24).count() == 1 and T.since(frame, now, 0).count() == 2
