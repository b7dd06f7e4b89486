"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with a cosine of at least c are at a squared distance of at most 2 - 2c. They are
turned to the principal axes of a sample, whose axes are dealt to blocks in turn, so that each
block has some that tell vectors apart. If a distance is within the whole budget, some block's is
within its share, so each block is range-joined under its share.

For that a block is divided into cells, each vector being in that of the nearest pivot. A vector
meets another cell only if its ball, as wide as the share's root, reaches the ball that holds that
cell and the pivots' bisector; a tile of two cells gets just such vectors, by their ids and the
block's coordinates, and tells which of them may have a partner. Only for these the whole vectors
are fetched, and verified by their cosine in double precision. A pair counts in the first block
that finds it. A tile returns counts and a spanning forest of its links, so large groups of
copies don't become pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

SLACK = 1e-9
#: What coordinates in single precision may add to a squared distance.
LOOSE = 2e-5


def rotation(size: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def bounds(size: int, blocks: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, size, min(blocks, size) + 1).astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def shares(size: int, blocks: int, cosine: float) -> list[float]:
    """Squared-distance budget of each block, in proportion to its coordinates."""
    return [(2 - 2 * cosine) * (b - a) / size + SLACK for a, b in bounds(size, blocks)]


def principal_axes(sample: np.ndarray, blocks: int) -> np.ndarray:
    """An orthonormal basis as columns: the sample's axes by their variance, dealt to the blocks in turn."""
    _, axes = np.linalg.eigh(np.cov(sample, rowvar=False).reshape(sample.shape[1], -1))
    size, turn = sample.shape[1], []
    cut = bounds(size, blocks)
    for at in range(max(b - a for a, b in cut)):
        turn += [a + at for a, b in cut if a + at < b]
    dealt = np.empty((size, size))
    dealt[:, turn] = axes[:, ::-1]
    return dealt


def nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Squared distances of rows to pivots."""
    found = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.maximum(found, 0)


def pivots_of(sample: np.ndarray, cells: int, rounds: int = 4) -> np.ndarray:
    """``cells`` pivots at most: rows spread evenly over the sample, moved to the means of their cells."""
    distinct = np.unique(sample, axis=0)
    pivots = distinct[np.random.default_rng(5).permutation(len(distinct))[:cells]]
    for _ in range(rounds if len(pivots) > 1 else 0):
        home = nearest(sample, pivots).argmin(axis=1)
        count = np.bincount(home, minlength=len(pivots))
        total = np.zeros_like(pivots)
        np.add.at(total, home, sample)
        pivots = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], pivots)
    return pivots


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A spanning forest of the links among ``n`` nodes as rows (root, node), each node joined to the smallest of its tree."""
    parent = np.arange(n)
    left, right = np.asarray(left, dtype=np.int64), np.asarray(right, dtype=np.int64)
    while len(left):
        low, high = np.minimum(parent[left], parent[right]), np.maximum(parent[left], parent[right])
        apart = low != high
        left, right = left[apart], right[apart]
        np.minimum.at(parent, high[apart], low[apart])
        while not np.array_equal(parent, parent[parent]):
            parent = parent[parent]
    moved = np.flatnonzero(parent != np.arange(n))
    return np.stack([parent[moved], moved], axis=1)


@dataclass
class Layout:
    """How vectors of each length are turned and divided into cells: a rotation, and pivots for each block."""

    blocks: int
    cosine: float
    turns: dict[int, np.ndarray] = field(default_factory=dict)
    pivots: dict[int, list[np.ndarray]] = field(default_factory=dict)
    #: For each length and block the cells' radii and numbers of parts.
    radii: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    parts: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def turn(self, size: int) -> np.ndarray:
        if size not in self.turns:
            self.turns[size] = rotation(size)
        return self.turns[size]

    def pivots_in(self, size: int) -> list[np.ndarray]:
        return self.pivots.get(size) or [np.zeros((1, b - a)) for a, b in bounds(size, self.blocks)]


def learn_layout(classes: DataFrame, cosine: float, blocks: int, cell_rows: int, most_cells: int = 4_096, sample: int = 4_096) -> Layout:
    """Axes and pivots from a sample of about ``sample`` vectors, or eight for each cell.

    There is a cell for every ``cell_rows`` vectors up to ``most_cells``, so the list of cells and the
    sample are bounded; beyond that cells grow and are cut into parts.
    """
    rows = classes.count()
    cells = min(most_cells, -(-rows // cell_rows))
    share = min(1.0, max(sample, 8 * cells) / max(rows, 1))
    drawn = classes.where(F.pmod("h1", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * max(sample, 8 * cells)).select("e").toArrow()
    layout = Layout(blocks, cosine)
    for size, (_, units) in unit_rows(drawn["e"].combine_chunks()).items():
        if len(units) < 2:
            continue
        layout.turns[size] = principal_axes(units, blocks)
        turned = units @ layout.turns[size]
        layout.pivots[size] = [pivots_of(turned[:, a:b], cells) for a, b in bounds(size, blocks)]
    return layout


def unit_rows(lists: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length the rows that have it and their vectors, made to length one."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
    found = {}
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        v = values[(ends[rows] - size)[:, None] + np.arange(size)[None, :]].astype(np.float64)
        v /= np.abs(v).max(axis=1, keepdims=True)
        found[int(size)] = rows, v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    return found


def packed(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of an array."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def unpacked(column: pa.ChunkedArray | pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def classes_of(rows: DataFrame) -> DataFrame:
    """``(k, rep, copies, e, h1, h2)``: distinct usable vectors, each with an own number, the smallest id and the number of rows that have it, and 128 bits of hash."""
    same = rows.where("h1 IS NOT NULL").groupBy("e").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return shared.settled(same.select(F.monotonically_increasing_id().alias("k"), "rep", "copies", "e", *hashes("e")))


def hashes(e: str) -> list[F.Column]:
    return [F.xxhash64(e).alias("h1"), F.xxhash64(F.lit(1), e).alias("h2")]


def hashed_rows(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``(vec_id, e, h1, h2)``: the vector in double precision and its hashes, which are null where it can't link."""
    usable = (
        F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("e", lambda x: x != 0)
    )
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(F.col(embedding).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("e"))
    return rows.select("vec_id", "e", *[F.when(usable, h).alias(n) for h, n in zip(hashes("e"), ("h1", "h2"), strict=True)])


def placed(classes: DataFrame, layout: Layout) -> DataFrame:
    """``(k, copies, size, v, cells, far)``: turned unit vectors as packed doubles, the cell of each block and the distance from its pivot."""
    known = classes.sparkSession.sparkContext.broadcast(layout)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = known.value
        for batch in batches:
            for size, (at, units) in unit_rows(batch.column("e")).items():
                v = units @ layout.turn(size)
                cells, far = [], []
                for (a, b), pivots in zip(bounds(size, layout.blocks), layout.pivots_in(size), strict=True):
                    d = nearest(v[:, a:b], pivots)
                    cells.append(d.argmin(axis=1).astype(np.int32))
                    far.append(np.sqrt(d.min(axis=1)))
                k, copies = (batch.column(c).take(pa.array(at)) for c in ("k", "copies"))
                lists = [pa.array(list(np.stack(x, axis=1)), t) for x, t in ((cells, pa.list_(pa.int32())), (far, pa.list_(pa.float64())))]
                yield pa.RecordBatch.from_arrays([k, copies, pa.array(np.full(len(at), size, dtype=np.int32)), packed(v), *lists], ["k", "copies", "size", "v", "cells", "far"])

    return shared.settled(classes.select("k", "copies", "e").mapInArrow(rows, "k long, copies long, size int, v binary, cells array<int>, far array<double>"))


TILE = ["size", "block", "c1", "p1", "c2", "p2"]


def measure_cells(units: DataFrame, layout: Layout, part_rows: int) -> int:
    """Sets the cells' radii and parts of at most about ``part_rows`` vectors; the number of tiles that there may be."""
    cells = units.select("size", F.posexplode("cells").alias("block", "cell"), "far").withColumn("d", F.get("far", F.col("block")))
    tiles = 0
    for r in cells.groupBy("size", "block", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius")).collect():
        own = len(layout.pivots_in(r["size"])[r["block"]])
        layout.radii.setdefault((r["size"], r["block"]), np.full(own, -np.inf))[r["cell"]] = r["radius"] + SLACK
        layout.parts.setdefault((r["size"], r["block"]), np.zeros(own, dtype=np.int64))[r["cell"]] = -(-r["n"] // part_rows)
    for parts in layout.parts.values():
        tiles += int(parts.sum()) * (int(parts.sum()) + 1) // 2
    return tiles


def tiles_of(units: DataFrame, layout: Layout, tasks: int) -> DataFrame:
    """A row ``(size, block, c1, p1, c2, p2, side, k, x)`` for each tile that a vector may have a partner in; x are the block's coordinates in single precision."""
    known = units.sparkSession.sparkContext.broadcast(layout)
    schema = pa.schema([*((c, pa.int32()) for c in TILE), ("side", pa.int32()), ("k", pa.int64()), ("x", pa.binary())])

    def meets(x: np.ndarray, home: np.ndarray, far: np.ndarray, pivots: np.ndarray, radii: np.ndarray, reach: float) -> np.ndarray:
        """Which cells each row's ball may share a vector with: it reaches the cell's own ball and the bisector of the two pivots."""
        d = nearest(x, pivots)
        found = np.sqrt(d) <= radii[None, :] + reach + 1e-6
        between = np.sqrt(nearest(pivots, pivots))[home]
        found &= d - (far * far)[:, None] <= 2 * between * (reach + 1e-6) + 1e-6
        found[np.arange(len(x)), home] = True
        return found & np.isfinite(radii)[None, :]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = known.value
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(at))
                k, v = part.column("k").to_numpy(), unpacked(part.column("v"), np.float64, int(size))
                cells, far = (np.stack(part.column(c).to_numpy(zero_copy_only=False)) for c in ("cells", "far"))
                cut, budget = bounds(int(size), layout.blocks), shares(int(size), layout.blocks, layout.cosine)
                for block, (a, b) in enumerate(cut):
                    x, home, parts = v[:, a:b], cells[:, block], layout.parts[size, block]
                    row, cell = np.nonzero(meets(x, home, far[:, block], layout.pivots_in(int(size))[block], layout.radii[size, block], np.sqrt(budget[block])))
                    # A cell's parts are dealt by the vectors' numbers; a row goes to the tiles of its own part with each part of the cell.
                    own = (k % np.maximum(parts[home], 1))[row]
                    many = parts[cell]
                    row, cell, own = (np.repeat(z, many) for z in (row, cell, own))
                    other = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                    mine = home[row]
                    first = (mine < cell) | ((mine == cell) & (own <= other))
                    whole = [np.where(first, mine, cell), np.where(first, own, other), np.where(first, cell, mine), np.where(first, other, own), 1 - first.astype(int)]
                    small = x.astype(np.float32)
                    for start in range(0, len(row), 20_000):
                        s = slice(start, start + 20_000)
                        n = len(row[s])
                        columns = [np.full(n, size), np.full(n, block), *(z[s] for z in whole)]
                        yield pa.RecordBatch.from_arrays([*(pa.array(z.astype(np.int32)) for z in columns), pa.array(k[row[s]]), packed(small[row[s]])], schema=schema)

    spread = units.select("size", "k", "v", "cells", "far").mapInArrow(rows, ", ".join(f"{c} int" for c in [*TILE, "side"]) + ", k long, x binary")
    return spread.repartition(tasks, *TILE)


def partners(a: np.ndarray, b: np.ndarray, same: bool, budget: float, step: int = 1_024) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of each side have a row of the other within the budget, in single precision. ``same``: both sides are one."""
    one = lambda x: np.ones((len(x), 1), dtype=np.float32)
    norm = lambda x: (x * x).sum(axis=1, keepdims=True)
    left, right = np.hstack([-2 * a, norm(a), one(a)]), np.ascontiguousarray(np.hstack([b, one(b), norm(b)]).T)
    has_a, has_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    for at in range(0, len(a), step):
        for to in range(at if same else 0, len(b), 4 * step):
            near = left[at : at + step] @ right[:, to : to + 4 * step] <= budget + LOOSE
            if same and to == at:
                n = min(near.shape)
                near[np.arange(n), np.arange(n)] = False
            count = np.count_nonzero(near)
            if count > near.size // 64:
                has_a[at : at + step] |= near.any(axis=1)
                has_b[to : to + 4 * step] |= near.any(axis=0)
            elif count:
                i, j = np.nonzero(near)
                has_a[at + i], has_b[to + j] = True, True
    if same:
        has_a |= has_b
        has_b = has_a
    return has_a, has_b


def first_links(a: np.ndarray, b: np.ndarray, block: int, blocks: int, cosine: float) -> np.ndarray:
    """Which pairs of turned unit vectors link and are within this block's share, but not within an earlier block's."""
    found = a @ b.T >= cosine
    if not found.any():
        return found
    for n, ((lo, hi), budget) in enumerate(zip(bounds(a.shape[1], blocks), shares(a.shape[1], blocks, cosine), strict=True)):
        if n > block:
            break
        x, y = a[:, lo:hi], b[:, lo:hi]
        d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
        within = d <= budget
        # Near the limit the sum of squares decides, which is alike in every tile.
        i, j = np.nonzero(found & (np.abs(d - budget) < 1e-11))
        within[i, j] = ((x[i] - y[j]) ** 2).sum(axis=1) <= budget
        found &= within if n == block else ~within
    return found


def link_vectors(units: DataFrame, layout: Layout, tiles: int) -> DataFrame:
    """Tiles' results: rows ``(a, b, n)``, a spanning link where b isn't null, else n links of other vectors to vector a."""
    blocks, cosine = layout.blocks, layout.cosine
    tasks = max(units.sparkSession.sparkContext.defaultParallelism, min(tiles, 4_096))
    found_schema = pa.schema([*((c, pa.int32()) for c in TILE), ("side", pa.int32()), ("k", pa.int64())])

    def sides_of(key: tuple, table: pa.Table) -> tuple[bool, list[pa.Table]]:
        same = key[2:4] == key[4:6]
        side = table["side"].to_numpy()
        sides = [table] if same else [table.take(pa.array(np.flatnonzero(side == s))) for s in (0, 1)]
        return same, [t.take(pa.array(np.argsort(t["k"].to_numpy(), kind="stable"))) for t in sides]

    def near(key: tuple, table: pa.Table) -> pa.Table:
        key = tuple(x.as_py() for x in key)
        same, sides = sides_of(key, table)
        lo, hi = bounds(key[0], blocks)[key[1]]
        x = [unpacked(t["x"], np.float32, hi - lo) for t in sides]
        has = partners(x[0], x[-1], same, shares(key[0], blocks, cosine)[key[1]])
        kept = pa.concat_tables([t.take(pa.array(np.flatnonzero(h))) for t, h in zip(sides, has, strict=False)])
        return kept.select([*TILE, "side", "k"]).cast(found_schema)

    columns = ", ".join(f"{c} int" for c in [*TILE, "side"]) + ", k long"
    may = shared.settled(tiles_of(units, layout, tasks).groupBy(*TILE).applyInArrow(near, columns))
    whole = may.join(units.select("k", "copies", "v"), "k").repartition(tasks, *TILE)

    def linked(key: tuple, table: pa.Table) -> pa.Table:
        key = tuple(x.as_py() for x in key)
        same, sides = sides_of(key, table)
        v = [unpacked(t["v"], np.float64, key[0]) for t in sides]
        ids = np.concatenate([t["k"].to_numpy() for t in sides])
        copies = np.concatenate([t["copies"].to_numpy() for t in sides])
        left, right, shift = v[0], v[-1], 0 if same else len(v[0])
        met, tree = np.zeros(len(ids)), np.zeros((0, 2), dtype=np.int64)
        step = 512
        for at in range(0, len(left), step):
            for to in range(at if same else 0, len(right), step):
                links = first_links(left[at : at + step], right[to : to + step], key[1], blocks, cosine)
                if same and at == to:
                    links = np.triu(links, 1)
                i, j = np.nonzero(links)
                if len(i):
                    i, j = i + at, j + to + shift
                    met += np.bincount(i, copies[j], minlength=len(ids)) + np.bincount(j, copies[i], minlength=len(ids))
                    tree = forest(len(ids), np.r_[tree[:, 0], i], np.r_[tree[:, 1], j])
        has = np.flatnonzero(met)
        a = np.r_[ids[has], ids[tree[:, 0]]]
        b = pa.array(np.r_[ids[has], ids[tree[:, 1]]], mask=np.r_[np.ones(len(has), dtype=bool), np.zeros(len(tree), dtype=bool)])
        return pa.table({"a": pa.array(a, pa.int64()), "b": b, "n": pa.array(np.r_[met[has], np.zeros(len(tree))].astype(np.int64))})

    return whole.groupBy(*TILE).applyInArrow(linked, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", blocks: int = 4, cell_rows: int = 16_384) -> DataFrame:
    """``(vec_id, n_links, component_id)`` for every row of ``vectors``.

    Links are pairs of rows at ``cosine`` or more in double precision. Null, empty and zero
    vectors, and those with null or non-finite components, link with nothing, and vectors
    link only with others of their length. Equal vectors are compared once, however many rows
    have them; each links with all its copies. Rows repeated in id are copies of each other. A
    null id links like any other; its component's id is the smallest that isn't null, if there is one.
    ``cell_rows`` is the number of vectors in a cell of a block, on average.
    """
    shared.bound_batches(vectors.sparkSession)
    rows = hashed_rows(vectors, vec_id, embedding)
    classes = classes_of(rows)
    layout = learn_layout(classes, cosine, blocks, cell_rows)
    units = placed(classes, layout)
    tiles = measure_cells(units, layout, 2 * cell_rows)
    found = shared.settled(link_vectors(units, layout, tiles))
    counted = found.where("b IS NULL").groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("n"))
    groups = shared.components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "k")
    members = classes.select("k", "h1", "h2", "rep", "copies").join(counted, "k", "left").join(groups, "k", "left").withColumn("component", F.coalesce("component", "k"))
    least = members.groupBy("component").agg(F.min("rep").alias("component_id"))
    links = (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    # Between two written tables a frequent vector's partition can be split.
    members = shared.settled(members.join(least, "component").select("h1", "h2", links, "component_id"))
    linking = rows.where("h1 IS NOT NULL").select("vec_id", "h1", "h2").join(members, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    return linking.unionByName(rows.where("h1 IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def op5(spark, sf_dir):
    found = near_duplicates(shared.table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


OP5_SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM link WHERE a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN comp USING (vec_id)
"""
