import zlib
from collections import Counter

from pyspark.sql import functions as F

from recollect.llm import sharding as H


def check(docs, shards):
    rows = H.shard_documents(docs, shards).collect()
    assert len(rows) == docs.count()
    sizes = Counter(r.shard for r in rows)
    if rows:
        assert set(sizes) <= set(range(shards)) and max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    expected = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expected
    return rows


def test_odd_rows(odd_documents, no_documents):
    check(odd_documents, 4)
    check(odd_documents, 24)
    assert check(no_documents, 24) == []


def cut_links(rows, group):
    """Cut links of each row by comparing every pair of rows of a group."""
    return {r.doc_id: sum(group(o) == group(r) and o.shard != r.shard for o in rows) for r in rows}


def test_groups_stay_together_and_a_hot_one_fills_whole_shards(spark, monkeypatch):
    monkeypatch.setattr(H, "BUCKET_ROWS", 40)
    rows = [(i, f"group {i // 3}") for i in range(300)] + [(1_000 + i, f"single {i}") for i in range(300)] + [(5_000 + i, "hot") for i in range(300)]
    text = dict(rows)
    found = check(spark.createDataFrame(rows, "doc_id long, text string"), 10)
    shard = {r.doc_id: r.shard for r in found}
    assert all(len({shard[3 * g + k] for k in range(3)}) == 1 for g in range(100))
    assert len({shard[5_000 + i] for i in range(300)}) == 4
    links = cut_links(found, lambda r: text[r.doc_id])
    assert {r.doc_id: r.links_cut for r in found} == links
    # The hot group of 300 can't do better than three shards of 90 and 30 rows more; nothing else is cut.
    assert sum(links.values()) == 300 * 299 - 3 * 90 * 89 - 30 * 29 < sum(r.links_cut_before for r in found)
    assert {r.n_links for r in found if r.doc_id < 300} == {2} and {r.n_links for r in found if 1_000 <= r.doc_id < 5_000} == {0}


def test_small_graphs_against_all_layouts(spark):
    """Groups that all fit somewhere are never cut, as the best of all layouts shows."""
    import itertools

    for sizes, shards in (((4, 3, 2), 3), ((2, 2, 1, 1), 2), ((3, 2, 2, 1, 1), 3), ((5, 1, 1, 1), 2)):
        rows = [(10 * g + k, f"text {g}") for g, size in enumerate(sizes) for k in range(size)]
        found = check(spark.createDataFrame(rows, "doc_id long, text string"), shards)
        mine = sum(r.links_cut for r in found) // 2
        quota = sorted(H.quotas(len(rows), shards))
        best = min(
            sum(rows[i][1] == rows[j][1] and layout[i] != layout[j] for i in range(len(rows)) for j in range(i))
            for layout in itertools.product(range(shards), repeat=len(rows))
            if sorted(layout.count(s) for s in range(shards)) == quota
        )
        assert mine == best, (sizes, shards)


def test_pairs_in_most_of_the_table_are_all_gathered(spark):
    rows = [(i, f"pair {i // 2}") for i in range(2_000)] + [(5_000 + i, f"single {i}") for i in range(400)]
    found = check(spark.createDataFrame(rows, "doc_id long, text string"), 24)
    assert sum(r.links_cut for r in found) == 0 and sum(r.links_cut_before for r in found) > 1_500


def test_more_grouped_rows_than_a_shard_takes(spark):
    rows = [(i, f"trio {i // 3}") for i in range(240)]
    found = check(spark.createDataFrame(rows, "doc_id long, text string"), 7)
    # Shards of 34 or 35 take 11 groups each; of the three that are left each lies in two or three shards.
    assert sum(r.links_cut > 0 for r in found) == 9


def test_a_given_group_links(spark):
    rows = spark.createDataFrame([(i, f"t{i}", i // 4 if i < 40 else None) for i in range(80)], "doc_id long, text string, g long")
    found = H.shard_documents(rows, 8, group=F.col("g")).collect()
    assert {r.n_links for r in found if r.doc_id < 40} == {3} and {r.n_links for r in found if r.doc_id >= 40} == {0}
    assert sum(r.links_cut for r in found) == 0


def test_running_sums(spark):
    rows = spark.createDataFrame([(i % 3, i, i % 5, 2) for i in range(50)], "k int, v int, __b int, n int")
    found = H.running(rows, ["k"], ["v"], "n").collect()
    for k in range(3):
        own = sorted((r for r in found if r.k == k), key=lambda r: (r["__b"], r.v))
        assert [r.before for r in own] == [2 * i for i in range(len(own))]
