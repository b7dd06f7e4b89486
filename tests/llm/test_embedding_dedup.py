import numpy as np
import pytest

from recollect.llm import embedding_dedup as E


def brute_force(rows, cosine):
    ok = [(n, np.array(v, dtype=float)) for n, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {n: set() for n in range(len(rows))}
    for i, (a, u) in enumerate(ok):
        for b, v in ok[i + 1 :]:
            if len(u) == len(v) and u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= cosine:
                links[a].add(b)
                links[b].add(a)
    out = []
    for n, (own, _) in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            for m in links[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        out.append((own, len(links[n]), min(rows[m][0] for m in seen)))
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(12):
        base = rng.standard_normal(64)
        rows += [base + rng.standard_normal(64) * s for s in (0, 0.1, 0.3, 0.42, 0.46, 0.5)]
    near = rng.standard_normal(64)
    rows += [near + rng.standard_normal(64) * 0.05 for _ in range(60)]
    rows += [near * 3, near * 3, near, -near]
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(rows)]
    n = len(rows)
    return rows + [(n, None), (n + 1, []), (n + 2, [0.0] * 64), (n + 3, [0.0] * 64), (n + 4, [float("nan")] * 64), (n + 5, [1.0, None]), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0]), (n + 8, [float("inf")] * 64)]


@pytest.mark.parametrize("cell_rows", [16_384, 16])
def test_matches_brute_force(spark, vectors, cell_rows):
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in E.near_duplicates(frame, cell_rows=cell_rows).collect())
    assert found == brute_force([(i, v) for i, v in vectors], 0.9)


def test_a_hot_group_of_near_copies_large_ids_and_null_ids(spark):
    rng = np.random.default_rng(3)
    base, far = rng.standard_normal((2, 32))
    big = 1 << 53
    rows = [(big + 1 + i, base + rng.standard_normal(32) * 0.12) for i in range(150)] + [(i, rng.standard_normal(32)) for i in range(300)]
    rows += [(big - 3, far), (None, far * 1.0001 + 0.01), (None, rng.standard_normal(32)), (big + 1, -far)]
    rows = [(i, v.tolist()) for i, v in rows]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(((r.vec_id, r.n_links, r.component_id) for r in E.near_duplicates(frame, cell_rows=40).collect()), key=str)
    named = [(big + 10_000 + n if i is None else i, v) for n, (i, v) in enumerate(rows)]
    want = [(None if i > big + 9_999 else i, n, None if c > big + 9_999 else c) for i, n, c in brute_force(named, 0.9)]
    assert found == sorted(want, key=str)


def test_cells_leave_out_no_pair(spark, vectors):
    """Vectors of few dimensions, where cells do prune, against every pair."""
    rng = np.random.default_rng(4)
    points = rng.standard_normal((1_200, 3)) @ rng.standard_normal((3, 12)) + rng.standard_normal((1_200, 12)) * 0.05
    rows = [(i, v.tolist()) for i, v in enumerate(points)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted((r.vec_id, r.n_links) for r in E.near_duplicates(frame, 0.999, cell_rows=30).collect())
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    assert found == [(i, int(n) - 1) for i, n in enumerate((unit @ unit.T >= 0.999).sum(axis=1))]


def test_forest_joins_what_links_join():
    rng = np.random.default_rng(2)
    left, right = rng.integers(0, 400, (2, 350))
    tree = E.forest(400, left, right)
    root = np.arange(400)
    root[tree[:, 1]] = tree[:, 0]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(left, right, strict=True):
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert root.tolist() == [find(x) for x in range(400)]


def test_empty_table_and_more_columns(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], 5, 2), (2, [1.0, 0.01], 5, 2), (None, [1.0, 0.0], None, None)], "vec_id long, embedding array<float>, rep int, n int")
    found = {(r.vec_id, r.n_links) for r in E.near_duplicates(frame).collect()}
    assert found == {(1, 2), (2, 2), (None, 2)}
    assert E.near_duplicates(frame.limit(0)).count() == 0


def test_shares_cover_the_whole_budget():
    for size in (2, 3, 64, 65):
        assert sum(E.shares(size, 4, 0.9)) >= 0.2
        assert E.bounds(size, 4)[-1][1] == size
