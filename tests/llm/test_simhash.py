import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from recollect.llm import shared
from recollect.llm import simhash as S


def plain_components(values):
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    listed = sorted(values)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


def test_golay_code_is_perfect():
    assert len(np.unique(S.leaders())) == 2048
    words = np.random.default_rng(1).integers(0, 1 << 23, 2_000)
    nearest = words ^ S.leaders()[S.remainders(words)]
    assert (S.remainders(nearest) == 0).all()
    assert max(int(x).bit_count() for x in (nearest ^ words)) <= 3


@settings(max_examples=200, deadline=None)
@given(st.integers(0, (1 << 23) - 1), st.integers(0, 22), st.integers(0, 22))
def test_two_errors_share_a_key(word, a, b):
    other = word ^ (1 << a) ^ (1 << b if a != b else 0)
    keys = S.fuzzy_keys(np.array([word, other], dtype=np.int64))
    assert set(keys[0]) & set(keys[1])
    assert len(set(keys[0])) in (1, 6)


def test_fingerprint_is_the_majority_of_bits():
    words = "A b C d é F g".split()
    low = [w.encode().lower() for w in words]
    hashes = [xxhash.xxh64_intdigest(b" ".join(low[i : i + 3]), seed=42) for i in range(5)]
    expected = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 5)
    assert S.fingerprint("A b  C\td é\nF g".encode()) == expected
    assert S.fingerprint(b"one TWO") == xxhash.xxh64_intdigest(b"one two", seed=42)
    assert S.fingerprint(None) == S.fingerprint(b" \n") == 0


@pytest.mark.parametrize("bucket", [64, 2])
def test_links_connect_what_pairs_connect(spark, bucket):
    rng = random.Random(5)
    values = set()
    for _ in range(30):
        v = rng.getrandbits(64)
        for _ in range(6):
            values.add(v)
            for _ in range(rng.choice([1, 2, 3])):
                v ^= 1 << rng.randrange(64)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r.node: r.component for r in shared.components(S.links(fps, bucket)).collect()}
    expected = plain_components(signed)
    groups = {}
    for v, r in expected.items():
        groups.setdefault(r, set()).add(v)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {
        frozenset(v for v in found if found[v] == c) for c in set(found.values())
    }


@settings(max_examples=100, deadline=None)
@given(st.integers(0, (1 << 64) - 1), st.integers(0, 63), st.integers(0, 63))
def test_two_errors_share_a_key_of_the_third_segment_too(value, a, b):
    """Some segment is equal, and each of the others shares a key: that is what the joins go by."""
    other = value ^ (1 << a) ^ (1 << b if a != b else 0)
    parts = [[(v >> at) & ((1 << size) - 1) for at, size in S.SEGMENTS] for v in (value, other)]
    keys = [[set(S.fuzzy_keys(np.array([x], dtype=np.int64))[0]) for x in p] for p in parts]
    assert any(parts[0][n] == parts[1][n] and keys[0][(n + 1) % 3] & keys[1][(n + 1) % 3] and keys[0][(n + 2) % 3] & keys[1][(n + 2) % 3] for n in range(3))


def test_crowded_buckets_are_dealt_by_the_third_segment(spark):
    """Fingerprints that share two segments and spread in the third: pairs come out of the finer buckets."""
    rng = random.Random(9)
    fps = [(rng.getrandbits(17) << 46) | 12345 for _ in range(400)]
    fps = sorted({*fps, *(v ^ (1 << 50) for v in fps[:100])})
    frame = spark.createDataFrame([(v,) for v in fps], "fp long")
    keys = S.golay_keys(frame, third=True)
    pairs, large = S.bucket_pairs(keys, 64)
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 2}
    assert {tuple(r) for r in pairs.distinct().collect()} == want and large.count() == 0
    assert keys.groupBy("fp").count().selectExpr("max(count)").first()[0] <= 108


def test_whole_query_against_a_plain_version(spark, tiny):
    """The registered query against a fingerprint bit by bit and a comparison of all pairs."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    value = {}
    for r in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
        value[r.doc_id] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    root, least = plain_components(set(value.values())), {}
    for d, v in value.items():
        least[root[v]] = min(d, least.get(root[v], d))
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in S.op10(spark, tiny).collect()} == {(d, f"{v:016x}", least[root[v]]) for d, v in value.items()}


def test_similar_documents_on_odd_rows(spark, odd_documents, no_documents):
    found = S.similar_documents(odd_documents).collect()
    assert len(found) == odd_documents.count()
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7, 8: 8, 9: 9}
    assert S.similar_documents(no_documents).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (1, 0)]
    found = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark, odd_documents, no_documents):
    found = S.near_duplicates(odd_documents).collect()
    assert len(found) == odd_documents.count()
    component = {r.doc_id: r.component_id for r in found if r.doc_id is not None}
    assert component == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7, 8: 8, 9: 9}
    assert sorted(str(r.component_id) for r in found if r.doc_id is None) == ["3", "None"]
    assert S.near_duplicates(no_documents).count() == 0


def test_similar_documents_finds_edited_copies_and_keeps_others(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(300)]
    rows = [(0, " ".join(base))]
    for n in range(1, 30):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(300)] = word()
        rows.append((n, " ".join(copy)))
    rows += [(100 + n, " ".join(word() for _ in range(300))) for n in range(30)]
    found = {r.doc_id: r.component_id for r in S.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[n] == 0 for n in range(30))
    assert all(found[100 + n] == 100 + n for n in range(30))


def linked(spark, texts, **sizes):
    """The links of similar_links alone, by index of the text."""
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "fp long, text string").selectExpr("fp", "text", "xxhash64(text) AS t")
    sets = S.with_sketches(docs.withColumnRenamed("fp", "row"), "text", 5, 4).drop("fp", "text").withColumnRenamed("row", "fp")
    return {frozenset((r.a, r.b)) for r in S.similar_links(sets, docs.select("t", "text"), 0.8, 5, **sizes).collect()}


def words_of(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def jaccard(a, b):
    x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_pairs_below_the_similarity_are_no_links(spark):
    """Two texts share a head and differ in their tails: 0.75, and from 0.79 to 0.81 around the bound."""
    rng = random.Random(5)
    texts, want = [], set()
    for size in (30, 33, 34, 35, 36, 37, 38, 40):
        for _ in range(12):
            head = words_of(rng, 304)
            pair = [head + words_of(rng, size), head + words_of(rng, size)]
            if jaccard(*pair) >= 0.8:
                want.add(frozenset((len(texts), len(texts) + 1)))
            texts += pair
    assert 0 < len(want) < len(texts) / 2
    found = linked(spark, texts)
    assert found <= want
    # A pair that shares none of its four smallest hashes doesn't meet, at 0.8 about 3 in 10,000.
    assert len(found) >= len(want) - 1


def test_repeated_passages_count_once(spark):
    rng = random.Random(6)
    text = words_of(rng, 300)
    again = text + (text[:20] * 40)
    assert jaccard(text, again) >= 0.8
    assert linked(spark, [text, again]) == {frozenset((0, 1))}


def test_a_chain_of_edited_copies_is_one_component(spark):
    """Each text is 0.8 alike to the next only, and they come in any order."""
    rng = random.Random(7)
    for n in range(6):
        long = words_of(rng, 420)
        chain = [long[20 * i : 20 * i + 300] for i in range(4)]
        assert jaccard(chain[0], chain[1]) >= 0.8 > jaccard(chain[0], chain[2])
        docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(chain)], "doc_id long, text string")
        assert {r.component_id for r in S.similar_documents(docs).collect()} == {0}


def test_large_buckets_compare_every_pair(spark):
    """All texts share their smallest hash; pairs share no other one."""
    rng = random.Random(8)
    texts = []
    passage = words_of(rng, 5)
    while len(texts) < 80:
        head = words_of(rng, 30)
        pair = [passage + head + words_of(rng, 3), passage + head + words_of(rng, 3)]
        if jaccard(*pair) >= 0.8:
            texts += pair
    want = {frozenset((i, i + 1)) for i in range(0, 80, 2)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "fp long, text string").selectExpr("fp", "text", "xxhash64(text) AS t")
    sets = S.with_sketches(docs.withColumnRenamed("fp", "row"), "text", 5, 4).drop("fp", "text").withColumnRenamed("row", "fp")
    hot = sets.selectExpr("every", "fp", "t", "wide", "n", "array(1L) AS keys")
    for sizes in ({}, {"rows": 9}, {"hashes": 300}):
        assert {frozenset((r.a, r.b)) for r in S.similar_links(hot, docs.select("t", "text"), 0.8, 5, **sizes).collect()} == want
