"""Exact vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: From so many queries on, comparing a vector costs more than moving it.
MANY = 256


def unit_matrix(lists: pa.ListArray, size: int) -> np.ndarray:
    """Rows of length one in doubles; zero stays zero. Lists that are null, of another length or hold nulls or NaN are all NaN."""
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.nan_to_num(np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.float64)).astype(np.int64)
    whole = np.full((len(lists), size), np.nan)
    rows = np.flatnonzero(lengths == size)
    if size and len(rows):
        whole[rows] = values[(np.cumsum(lengths)[rows] - size)[:, None] + np.arange(size)[None, :]]
    norm = np.sqrt(in_order(whole, whole))[:, None]
    return np.where(norm == 0, 0.0, whole / np.where(norm == 0, 1.0, norm))


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of both, added up in the order of coordinates."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def slack(size: int) -> float:
    """What two similarities of ``size`` coordinates in single precision may be off by together, and their bound by its rounding."""
    return 2 * (size + 8) * 2.0**-24


def may_be_nearest(sims: np.ndarray, k: int, least: np.ndarray, off: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the similarities, known but for ``off``, that may be among the ``k`` greatest of their row and reach its ``least``; NaN is the least of all."""
    known = sims
    if np.isneginf(least).any():
        known = np.where(np.isnan(sims), np.float32(-np.inf), sims)
        if sims.shape[1] > k:
            least = np.maximum(least, np.partition(known, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k])
    return np.divmod(np.flatnonzero(known >= (least - off).astype(np.float32)[:, None]), max(1, sims.shape[1]))


def first_of_each(found: pa.Table, k: int) -> pa.Table:
    """The first ``k`` rows of each query of ``found(q, sim, id)`` by similarity, NaN last, and then by id, null first."""
    keys = found.append_column("far", pa.array(-found["sim"].to_numpy())).append_column("bad", pa.compute.is_nan(found["sim"])).append_column("has", pa.compute.is_valid(found["id"]))
    ordered = found.take(pa.compute.sort_indices(keys, [(c, "ascending") for c in ("q", "bad", "far", "has", "id")]))
    q = ordered["q"].to_numpy()
    return ordered.take(pa.array(np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) < k)))


def asked(queries: DataFrame, most_queries: int = 5_000, same_type: bool = False) -> list[tuple]:
    """``queries`` collected as ``top_k`` compares them, which several calls may share: for each round ``(__q, query_id)`` as a frame, and the numbers, vectors by length and types, broadcast."""
    rounds = max(1, -(-queries.count() // most_queries))
    q = queries.select("query_id", "embedding", *(["type"] if same_type else []))
    taken = []
    for r in range(rounds):
        part = (q if rounds == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r)).withColumn("__q", F.row_number().over(Window.orderBy("query_id")))
        found = part.toArrow()
        part = queries.sparkSession.createDataFrame(found.select(["__q", "query_id"]))
        numbers = found["__q"].to_numpy()
        kinds = np.array(found["type"].to_pylist(), dtype=object) if same_type else None
        lists = found["embedding"].combine_chunks()
        lengths = np.nan_to_num(np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.float64), nan=-1).astype(np.int64)
        # Queries of each length, which are compared with items of that length; those without a vector with none.
        asks = [(size, unit_matrix(lists.filter(pa.array(lengths == size)), max(size, 0)), np.flatnonzero(lengths == size)) for size in np.unique(lengths).tolist()]
        taken.append((part, len(numbers), queries.sparkSession.sparkContext.broadcast((asks, numbers, kinds))))
    return taken


def top_k(queries: DataFrame, items: DataFrame, k: int, item_id: str = "item_id", most_queries: int = 5_000, same_type: bool = False, taken: list[tuple] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(query_id, <item_id>, <carry>, sim, rank)``: each query's ``k`` nearest items by cosine, ties by id.

    Queries are collected, ``most_queries`` at a time, and each batch of items is multiplied with their matrix in single precision;
    what may be among the ``k`` nearest is compared again in doubles, by the sum in the order of coordinates, and ``k`` rows for
    each task and query go on, without vectors. More queries are taken in that many rounds. For ``MANY`` queries items are dealt
    out first, once for all rounds, so that a table that one task reads is compared by all. ``same_type`` also asks for
    equal types; null types equal none. Items whose vector is null or of another length have a null similarity and come last.
    ``taken`` are the same queries as ``asked`` gave them before. ``carry`` names columns of the items that go on with them.
    """
    taken = asked(queries, most_queries, same_type) if taken is None else taken
    # One batch has all types, so a type's matches are found among those of its own.
    i = items.select(item_id, "embedding", *(["type"] if same_type and "type" not in carry else []), *carry)
    i = i.repartition(item_id) if sum(n for _, n, _ in taken) >= MANY else i
    schema = items.select(F.lit(0).alias("__q"), item_id, *carry, F.lit(None).cast("double").alias("sim")).schema
    found = None
    for part, _, known in taken:

        def rows(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            asks, numbers, kinds = known.value
            step = max(k + 1, 4_000_000 // max(1, len(numbers)))
            least, held, new = np.full(len(numbers), -np.inf), [], 0
            for whole in batches:
                for at in range(0, len(whole) if len(numbers) else 0, step):
                    batch = whole.slice(at, step)
                    lists, own = batch.column("embedding"), np.array(batch.column("type").to_pylist(), dtype=object) if same_type else None
                    lengths = np.nan_to_num(np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.float64), nan=-1).astype(np.int64)
                    for size, matrix, at_size in asks:
                        units = unit_matrix(lists, max(size, 0))
                        units[(lengths != size) | (size < 0)] = np.nan
                        groups = [(np.arange(len(batch)), np.arange(len(at_size)))]
                        if same_type:
                            of = kinds[at_size]
                            groups = [(np.flatnonzero(own == t), np.flatnonzero(of == t)) for t in set(of) & set(own) if t is not None]
                        for items_of, queries_of in groups:
                            some, asking = units[items_of], matrix[queries_of]
                            sims = asking.astype(np.float32) @ some.T.astype(np.float32)
                            sims[:, (lengths[items_of] != size) | (size < 0)] = np.nan
                            row, column = may_be_nearest(sims, k, least[at_size[queries_of]], slack(size))
                            for first in range(0, len(row), 200_000):
                                a, b = row[first : first + 200_000], column[first : first + 200_000]
                                exact = np.where(np.isnan(sims[a, b]), np.nan, in_order(some[b], asking[a]))
                                held.append(pa.table({"q": at_size[queries_of[a]], "sim": exact, "id": batch.column(item_id).take(pa.array(items_of[b]))} | {f"+{c}": batch.column(c).take(pa.array(items_of[b])) for c in carry}))
                                new += len(a)
                    if new > k * len(numbers) // 2:
                        best = first_of_each(pa.concat_tables(held), k)
                        held, new = [best], 0
                        every, sims = best["q"].to_numpy(), best["sim"].to_numpy()
                        full = np.flatnonzero(np.arange(len(every)) - np.searchsorted(every, every) == k - 1)
                        least[every[full]] = np.where(np.isnan(sims[full]), -np.inf, sims[full])
            if held:
                best = first_of_each(pa.concat_tables(held), k)
                sims = best["sim"].to_numpy()
                with_them = [best[f"+{c}"].combine_chunks() for c in carry]
                yield pa.RecordBatch.from_arrays([pa.array(numbers[best["q"].to_numpy()], pa.int32()), best["id"].combine_chunks(), *with_them, pa.array(sims, mask=np.isnan(sims))], ["__q", item_id, *carry, "sim"])

        near = i.mapInArrow(rows, schema)
        scored = near.join(F.broadcast(part), "__q").select("query_id", item_id, *carry, "sim")
        order = Window.partitionBy("query_id").orderBy(F.desc("sim"), item_id)
        ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = ranked if found is None else found.unionByName(ranked)
    return found


def upsert(stored: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """Rows of both by ``key``, the latest by ``at`` of each."""
    both = stored.unionByName(new, allowMissingColumns=True)
    last = Window.partitionBy(key).orderBy(F.desc(at))
    return both.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def check_dimension(vectors: DataFrame, size: int, column: str = "embedding") -> DataFrame:
    """The same rows; fails on a vector of another size."""
    wrong = F.raise_error(F.format_string("vector of %d instead of " + str(size), F.size(column)))
    return vectors.withColumn(column, F.when(F.size(column) == size, F.col(column)).otherwise(wrong.cast(vectors.schema[column].dataType)))
