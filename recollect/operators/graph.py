"""Bounded traversal of live relations as unrolled frontier joins."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_HOPS = 5


def undirected(edges: DataFrame) -> DataFrame:
    """``(src, dst, edge_id, ...)`` in both directions without self-loops, from ``edges(edge_id, subject_id, object_id, ...)``."""
    rest = [c for c in edges.columns if c not in ("subject_id", "object_id")]
    # Both from one pass over the edges.
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    ways = F.explode(F.array(way("subject_id", "object_id"), way("object_id", "subject_id")))
    return edges.where("subject_id <> object_id").select(ways.alias("way"), *rest).select("way.src", "way.dst", *rest)


def shortest_paths(seeds: DataFrame, edges: DataFrame, hops: int, carry: Column | None = None, group: list[str] | None = None, worth: Callable[[DataFrame, DataFrame], DataFrame] | None = None, goes: Callable[[int], DataFrame] | None = None, few: bool = False) -> DataFrame:
    """``(<group>, seed, target, distance[, path])``: one shortest path from each seed to each node it reaches, the seed itself left out.

    ``seeds(<group>, seed)`` may be grouped by a query. ``carry`` is a struct of an edge's
    columns, gathered along the path; of several shortest paths the one with the smallest
    sequence of edge ids is kept, which the struct must begin with. Each hop joins the last
    frontier with the edges, keeps a row for each seed and node, and leaves out what earlier
    hops reached.

    ``worth(frontier, steps)`` may name the pairs ``(<group>, seed, node)`` of ``frontier`` joined with ``steps(src, dst, step)``
    that matter; of those that only the last of several hops reaches, no others are returned. ``goes(h)`` may name the seeds ``(<group>, seed)``
    of which something at a distance of ``h`` or more matters; others go no further.
    ``few`` seeds are sent to the edges, which then need not move.
    """
    if not 1 <= hops <= MOST_HOPS:
        raise ValueError(f"hops must be from 1 to {MOST_HOPS}")
    by = [*(group or []), "seed"]
    both = undirected(edges)
    both = both.select("src", "dst", *([carry.alias("step")] if carry is not None else []))
    # Where few frontiers matter, edges meet them first; repeated ones fall together with the paths.
    both = both.distinct() if worth is None else both
    start = seeds.select(*by).distinct()
    frontier = start.withColumn("node", F.col("seed"))
    if carry is not None:
        kind = both.schema["step"].dataType.simpleString()
        frontier = frontier.withColumn("path", F.from_json(F.lit("[]"), f"array<{kind}>"))
    seen, found = frontier.select(*by, "node"), None
    for h in range(1, hops + 1):
        ahead, steps, pairs = frontier if goes is None or h == 1 else frontier.join(goes(h), by, "left_semi"), both, None
        if worth is not None and 1 < h == hops:
            pairs = held(worth(ahead, both))
            ahead = ahead.join(pairs.select(*by).distinct(), by, "left_semi")
            steps = both.join(pairs.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")
        ahead = F.broadcast(ahead) if few and h == 1 else ahead
        reached = ahead.join(steps, ahead["node"] == steps["src"]).drop("node", "src").withColumnRenamed("dst", "node")
        if pairs is not None:
            reached = reached.join(pairs, [*by, "node"], "left_semi")
        if carry is not None:
            reached = reached.withColumn("path", F.array_append("path", F.col("step"))).drop("step").groupBy(*by, "node").agg(F.min("path").alias("path"))
        else:
            reached = reached.select(*by, "node").distinct()
        # The first hop reaches no seed itself, as edges have two ends.
        frontier = reached.join(seen, [*by, "node"], "left_anti") if h > 1 else reached
        if h < hops:
            frontier = held(frontier)
            seen = seen.unionByName(frontier.select(*by, "node"))
        new = frontier.withColumn("distance", F.lit(h))
        found = new if found is None else found.unionByName(new)
    return found.withColumnRenamed("node", "target")


def held(df: DataFrame) -> DataFrame:
    """``df`` kept for several uses: in the session's checkpoint folder if it has one, else in its cache."""
    has = not df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty()
    return df.checkpoint() if has else df.cache()


def at_once(spark: SparkSession, *jobs: Callable[[], Any]) -> list[Any]:
    """What each of the jobs gives, run at the same time: small ones leave most of a cluster idle."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(j)) for j in jobs]]


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt out by ``by`` to as many tasks as a shuffle has, for rows of which each becomes many: one task may have read them all."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def reachable(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """``(seed, target, distance)`` of all nodes within ``hops``; for callers that need no path."""
    return shortest_paths(seeds, edges, hops).select("seed", "target", "distance")


def all_paths(seeds: DataFrame, edges: DataFrame, hops: int, names: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """``(seed, target, distance, edge_ids)``: every path of at most ``min(hops, 3)`` edges that uses no edge twice and doesn't end at its seed.

    With ``names(target)`` and ``limit`` a seed goes no further once it has that many paths to such targets, for callers
    that take the nearest ones.
    """
    both = undirected(edges).select("src", "dst", "edge_id")
    paths = seeds.select("seed", F.col("seed").alias("node"), F.array().cast("array<string>").alias("edge_ids")).distinct()
    found = met = None
    for h in range(1, min(hops, 3) + 1):
        stepped = paths.join(both, F.col("node") == F.col("src")).where(~F.array_contains("edge_ids", F.col("edge_id").cast("string")))
        paths = held(stepped.select("seed", F.col("dst").alias("node"), F.array_append("edge_ids", F.col("edge_id").cast("string")).alias("edge_ids")))
        new = paths.withColumn("distance", F.lit(h))
        found = new if found is None else found.unionByName(new)
        if limit is not None and h < min(hops, 3):
            here = paths.where("node <> seed").join(names, F.col("node") == F.col("target"), "left_semi").groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
            met = here if met is None else met.unionByName(here).groupBy("seed").agg(F.sum("n").alias("n"))
            paths = paths.join(met.where(F.col("n") >= limit).select("seed"), "seed", "left_anti")
    return found.where("node <> seed").withColumnRenamed("node", "target")


def neighbours(seeds: DataFrame, edges: DataFrame, names: DataFrame, hops: int = 2, limit: int = 25) -> DataFrame:
    """Paths of ``all_paths`` with the target's name, each seed's nearest ``limit`` by distance, name and path."""
    targets = names.select(F.col("entity_id").alias("target"), "name")
    named = all_paths(seeds, edges, hops, targets.select("target"), limit).join(targets, "target")
    order = Window.partitionBy("seed").orderBy("distance", "name", "edge_ids")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def incidence_counts(entities: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` entities, by name and type, whose live relations were accessed most."""
    ends = undirected(edges.where("valid_until IS NULL")).select(F.col("src").alias("entity_id"), F.coalesce("access_count", F.lit(0)).alias("n"))
    # Summed by id first, so that a hub's edges don't meet in the join.
    per_id = ends.groupBy("entity_id").agg(F.sum("n").alias("n"))
    summed = per_id.join(entities.select("entity_id", "name", "type"), "entity_id").groupBy("name", "type").agg(F.sum("n").alias("total"))
    return summed.orderBy(F.desc("total"), "name", "type").limit(k)
