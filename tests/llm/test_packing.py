import random
from collections import defaultdict

import pandas as pd

from recollect.llm import packing as P
from recollect.llm import simhash


def plain(frame, capacity, per_source):
    """Best fit by looking at every bin."""
    frame = frame.sort_values(["size", "doc_id", "cluster"], ascending=[False, True, True], kind="stable")
    pieces = [(capacity if k < s // capacity else s % capacity, d, k, src, c) for d, s, src, c in frame[["doc_id", "size", "source", "cluster"]].itertuples(index=False) for k in range(-(-s // capacity))]
    pieces.sort(key=lambda p: -p[0])
    bins, out = [], []
    for size, d, k, src, c in pieces:
        fit = [(room, n) for n, (room, sources, clusters) in enumerate(bins) if room >= size and c not in clusters and sources.count(src) < per_source]
        n = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append([capacity, [], set()])
        out.append((d, k, size, n, capacity - bins[n][0]))
        bins[n][0] -= size
        bins[n][1].append(src)
        bins[n][2].add(c)
    return out


def test_equals_plain_best_fit():
    rng = random.Random(1)
    for _ in range(20):
        frame = pd.DataFrame([(i, rng.randint(1, 250), rng.choice("abc"), rng.choice([1, 2, 3, i + 10])) for i in range(80)], columns=["doc_id", "size", "source", "cluster"])
        found = P.pack(frame, 100, 2)
        assert [tuple(x) for x in found[["doc_id", "piece", "n_units", "bin_id", "bin_offset"]].itertuples(index=False)] == plain(frame, 100, 2)


def test_odd_rows(spark, odd_documents, no_documents):
    docs = P.measured(odd_documents)
    rows = P.pack_documents(docs, "n_tokens", capacity=1_000, per_source=1, partition_rows=5).collect()
    by_bin = defaultdict(list)
    for r in rows:
        by_bin[r.bin_id].append(r)
    for members in by_bin.values():
        assert sum(r.n_units for r in members) == members[0].bin_fill <= 1_000
        assert len(members) == members[0].bin_pieces
        at = 0
        for r in sorted(members, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_units
    want = defaultdict(int)
    for r in odd_documents.collect():
        want[r.doc_id] += len(tokenizer().encode_ordinary(r.text or ""))
    found = defaultdict(int)
    for r in rows:
        found[r.doc_id] += r.n_units
        assert r.begin == r.piece * 1_000
    assert found == {d: n for d, n in want.items() if n}
    assert P.pack_documents(P.measured(no_documents), "n_tokens").count() == 0


def tokenizer():
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, special_tokens={})


def test_null_and_large_ids_stay_as_they_are(spark):
    big = (1 << 53) + 1
    docs = spark.createDataFrame([(big, 7, "s", 1), (big + 2, 7, None, None), (None, 7, "s", None), (None, None, "s", 1), (5, 0, "s", 1)], "doc_id long, size int, source string, cluster long")
    assert sorted((r.doc_id or 0, r.n_units) for r in P.pack_documents(docs, "size", capacity=10).collect()) == [(0, 7), (big, 7), (big + 2, 7)]


def test_whole_query_equals_plain_best_fit(spark, tiny):
    """The registered query in one partition, against the library's lengths, op10's components and a search through every bin."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    cluster = {r.doc_id: r.component_id for r in simhash.op10(spark, tiny).collect()}
    frame = pd.DataFrame([(r.doc_id, len(tokenizer().encode_ordinary(r.text or "")), r.source or "\0", cluster[r.doc_id]) for r in docs], columns=["doc_id", "size", "source", "cluster"])
    found = P.op8(spark, tiny).collect()
    assert sorted((r.doc_id, r.piece, r.n_units, r.bin_id, r.bin_offset) for r in found) == sorted(plain(frame, P.CAPACITY, 8))


def test_pieces_rebuild_the_texts(spark, tiny):
    """Each bin is filled from the documents' tokens by the result alone, and read back."""
    texts = {r.doc_id: tokenizer().encode_ordinary(r.text or "") for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    rows = P.op8(spark, tiny).collect()
    bins = {r.bin_id: [None] * r.bin_fill for r in rows}
    for r in rows:
        bins[r.bin_id][r.bin_offset : r.bin_offset + r.n_units] = texts[r.doc_id][r.begin : r.begin + r.n_units]
    assert all(None not in b and len(b) <= P.CAPACITY for b in bins.values())
    back = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        back[r.doc_id] += bins[r.bin_id][r.bin_offset : r.bin_offset + r.n_units]
    assert back == {d: t for d, t in texts.items() if t}


def test_a_hot_cluster_is_never_twice_in_a_bin(spark):
    docs = spark.createDataFrame([(i, 10, "s", 1 if i % 3 == 0 else i) for i in range(3_000)], "doc_id long, size int, source string, cluster long")
    rows = P.pack_documents(docs, "size", capacity=100, per_source=10, partition_rows=500).collect()
    hot = [r.bin_id for r in rows if r.doc_id % 3 == 0]
    assert len(rows) == 3_000 and len(hot) == len(set(hot)) == 1_000
