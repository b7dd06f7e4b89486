"""Capture of conversation turns from a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def prepared(turns: DataFrame) -> DataFrame:
    """Eligible turns with their fingerprint and title, in a batch or a stream; text is stripped, the role normal."""
    ids = (F.col("session_id"), F.col("turn_id"), F.col("role"))
    kept = turns.where(T.eligible(*ids, F.col("text")))
    marked = kept.withColumns({"fingerprint": T.turn_fingerprint(*ids, F.col("text")), "title": T.turn_title(*ids)})
    return marked.withColumns({"role": T.normal_role(F.col("role")), "text": T.stripped(F.col("text"))})


def without_explicit(turns: DataFrame, explicit: DataFrame) -> DataFrame:
    """Turns that weren't stored explicitly; ``explicit(session_id, turn_id)`` may be a static table beside a stream."""
    named = explicit.select("session_id", "turn_id").distinct().withColumn("__explicit", F.lit(True))
    return turns.join(named, ["session_id", "turn_id"], "left").where("__explicit IS NULL").drop("__explicit")


def unique_turns(turns: DataFrame, at: str = "ts") -> DataFrame:
    """The first turn of each fingerprint by time."""
    first = Window.partitionBy("fingerprint").orderBy(at, "session_id", "turn_id")
    return turns.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


class CaptureState:
    """What a capture has stored and what it still owes, as folders of Parquet by number of the micro-batch.

    A turn counts as seen once its ingest has succeeded; one whose ingest failed is owed and comes again with the next micro-batch.
    """

    def __init__(self, spark: SparkSession, folder: str, gather: int = 100) -> None:
        self.spark, self.folder, self.gather = spark, folder.rstrip("/"), gather

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self, kind: str) -> list[int]:
        fs, top = self._fs(), self._path(kind)
        names = [x.getPath().getName() for x in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(n) for n in names if fs.exists(self._path(f"{kind}/{n}/_SUCCESS")))

    def read(self, kind: str, like: DataFrame) -> DataFrame:
        paths = [f"{self.folder}/{kind}/{n}" for n in self.numbers(kind)]
        return self.spark.read.schema(like.schema).parquet(*paths) if paths else like.limit(0)

    def write(self, kind: str, number: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{kind}/{number}")

    def drop(self, kind: str, numbers: list[int]) -> None:
        for n in numbers:
            self._fs().delete(self._path(f"{kind}/{n}"), True)


def capture(turns: DataFrame, checkpoint: str, ingest: Callable[[DataFrame, int], None], failed: Callable[[DataFrame, int, Exception], None], explicit: DataFrame | None = None, **trigger):
    """Starts the capture of a stream of ``(session_id, turn_id, role, text, ts)``.

    Each turn is ingested once, by its fingerprint. A micro-batch whose ingest fails is halved until the turns that fail are found; these
    go to ``failed`` and are tried again with the next micro-batch, and the stream goes on. Turns in ``explicit`` are left out.
    The state is kept beside the checkpoint and survives restarts; a micro-batch that is run again takes nothing twice.
    """
    ready = prepared(turns)
    state = CaptureState(turns.sparkSession, f"{checkpoint.rstrip('/')}-turns")

    def attempt(rows: DataFrame, number: int, depth: int = 0) -> DataFrame | None:
        """The rows that failed, if any."""
        try:
            ingest(rows, number)
            return None
        except Exception as error:  # noqa: BLE001  a failing turn must not stop the capture
            if depth >= 16 or rows.count() <= 1:
                failed(rows, number, error)
                return rows
        bad = [attempt(half, number, depth + 1) for half in (rows.where(F.pmod(F.xxhash64("fingerprint", F.lit(depth)), F.lit(2)) == side) for side in (0, 1)) if not half.isEmpty()]
        bad = [b for b in bad if b is not None]
        return None if not bad else bad[0] if len(bad) == 1 else bad[0].unionByName(bad[1])

    def each(batch: DataFrame, number: int) -> None:
        if number in state.numbers("seen"):
            return
        known = explicit if explicit is None else explicit.select("session_id", "turn_id")
        prints = batch.select("fingerprint")
        owed = [n for n in state.numbers("owed") if n < number]
        todo = unique_turns(batch.unionByName(state.read("owed", batch))).join(state.read("seen", prints), "fingerprint", "left_anti")
        todo = todo if known is None else without_explicit(todo, known)
        state.write("work", number, todo.select(*batch.columns))
        rows = state.spark.read.schema(batch.schema).parquet(f"{state.folder}/work/{number}")
        bad = attempt(rows, number) if not rows.isEmpty() else None
        done = rows.select("fingerprint") if bad is None else rows.select("fingerprint").join(bad.select("fingerprint"), "fingerprint", "left_anti")
        gathered = state.numbers("seen") if number % state.gather == state.gather - 1 else []
        if bad is not None:
            state.write("owed", number, bad)
        state.write("seen", number, done.unionByName(state.read("seen", prints)) if gathered else done)
        state.drop("owed", owed)
        state.drop("seen", gathered)
        state.drop("work", [number])

    return ready.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def touch_counts(touches: DataFrame, at: str = "ts", delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Accesses by entity and day of a stream of ``(entity_id, ts)``; late ones within the delay count."""
    return touches.withWatermark(at, delay).groupBy(F.window(at, window).alias("w"), "entity_id").agg(F.count(F.lit(1)).alias("touches"), F.max(at).alias("last_accessed"))


def since(turns: DataFrame, now, hours: int) -> DataFrame:
    """Turns of the last ``hours`` before ``now``, as of the time of the query."""
    start = T.since(now, hours)
    return turns if start is None else turns.where(F.col("ts") >= start)
