"""What the operators of this subpackage share: table access, batch bounds, the shared folder, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = 2_000, megabytes: int = 3) -> None:
    """Bounds what one Arrow batch holds, so that long texts don't fill a Python worker.

    These are settings of the session, read when a query runs, so they stay as they are set here.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")


_HELD: dict[tuple, object] = {}


def held_in_worker(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept in this process until another key is asked for: a worker that serves one operator after another holds one model and cache, not all of them."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or for a local session without one a new folder.

    Raises where a cluster names none, since a machine-local folder would lose rows there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="recollect-")
    return _LOCAL_FOLDERS[app]


#: Folders that ``settled`` wrote, by application, for those who clear them.
_WRITTEN: dict[str, list[str]] = {}


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and cut from its lineage; lost executors can read it again."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    done = df.checkpoint(eager=True)
    written = done._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if written.isDefined():
        _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(written.get())
    return done


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes what ``settled`` writes within; for work whose result is stored elsewhere by the end."""
    written = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    first = len(written)
    try:
        yield
    finally:
        for folder in written[first:]:
            delete(spark, folder)
        del written[first:]


def give_back(spark: SparkSession) -> None:
    """Lets the driver drop what finished work left in its heap, and Spark the broadcasts and shuffles that nothing refers to."""
    gc.collect()
    spark._jvm.System.gc()


def own_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def is_held_out(doc_id) -> F.Column:
    """crc32 of the id's decimal text leaves 2 modulo 4; a null id counts as held out, since nothing may be learned from it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node per node of an undirected graph: ``edges(a, b)`` to ``(node, component)``.

    Alternating large-star and small-star rounds: each joins every edge's larger end to a
    smaller neighbour, so paths shorten by a constant factor a round. A round's edges are
    written to the shared folder; only their number and checksum reach the driver. Nodes
    without edges don't appear. Duplicate edges and loops are allowed, null ends are ignored.
    """
    now = settled(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    while True:
        # Large star: the larger neighbours of a node are joined to its smallest neighbour or itself.
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: the smaller neighbours of a node, and the node, are joined to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        after = settled(small.where("u <> v").distinct())
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = after
        if tuple(state) == before:
            break
        before = tuple(state)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
