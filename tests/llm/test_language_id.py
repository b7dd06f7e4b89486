import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from recollect.llm import language_id as L
from recollect.llm import shared


def brute_force(word, vocabulary, p):
    """Sum over all ways to cut the marked word into pieces."""
    marked, total = L.START + word, 0.0
    for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
        parts, at = [], 0
        for i, cut in enumerate(cuts, 1):
            if cut:
                parts.append(marked[at:i])
                at = i
        parts.append(marked[at:])
        total += math.prod(p[vocabulary.index[x]] if x in vocabulary.index else (p[-1] if len(x) == 1 else 0.0) for x in parts)
    return total


def test_forward_sums_all_segmentations():
    pieces = [L.START, L.START + "a", "a", "b", "ab", "aba", L.START + "ab", "ba"]
    v = L.PieceVocabulary({x: i for i, x in enumerate(pieces)}, frozenset(x[:n] for x in pieces for n in range(1, len(x) + 1)))
    p = np.random.default_rng(3).random(len(v))
    words = ["ab", "abab", "a", "bxa", "bbbb"]
    edges, lengths = L.lattice(words, v)
    alpha = L.forward(edges, len(words), p[:, None])
    for w, word in enumerate(words):
        assert math.isclose(alpha[w, lengths[w], 0], brute_force(word, v, p), rel_tol=1e-9)


def test_expected_counts_add_up():
    pieces = [L.START, "a", "b", "ab"]
    v = L.PieceVocabulary({x: i for i, x in enumerate(pieces)}, frozenset(x[:n] for x in pieces for n in range(1, len(x) + 1)))
    p = np.array([0.2, 0.3, 0.3, 0.1, 1e-7])
    counts = L.expected_counts(["ab"], np.array([2.0]), v, p)
    split = 0.3 * 0.3 / (0.3 * 0.3 + 0.1)
    assert np.allclose(counts, [2, 2 * split, 2 * split, 2 * (1 - split), 0])


def test_held_out_accuracy(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    model = L.fit(docs.where(~shared.is_held_out(F.col("doc_id"))))
    found = L.identify_languages(docs, model).where(shared.is_held_out(F.col("doc_id"))).select("lang", "lang_pred", "lang_score").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    assert all(0 <= r.lang_score <= 1 for r in found)


def test_odd_rows(spark, odd_documents, no_documents):
    model = L.fit(odd_documents)
    assert model.languages == ["en", "fr"]
    found = L.identify_languages(odd_documents, model).collect()
    assert len(found) == odd_documents.count()
    for r in found:
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
        assert r.words == "w"
    assert L.fit(no_documents) is None
    assert L.identify_languages(odd_documents, None).where("lang_pred <> 'und'").count() == 0
    assert L.identify_languages(no_documents, model).count() == 0


def test_number_signs_are_no_letters_and_long_runs_count_whole(spark):
    assert L.letter_runs("½ ² ① Ⅷ ٣ x² é½a Ωπ 漢字_ん") == ["x", "é", "a", "Ωπ", "漢字", "ん"]
    rows = [(1, "½ ² ①", "fr"), (2, "der hund und " + "schiff" * 40, "de"), (3, "le chien et la maison", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert model.languages == ["de", "fr"]
    found = {r.doc_id: r.lang_pred for r in L.identify_languages(docs, model).collect()}
    assert found == {1: "und", 2: "de", 3: "fr"}
    # What follows the 48th letter of a run is learned from as well.
    tail = spark.createDataFrame([(1, "a" * 48 + "zzzzzz", "xx"), (2, "b", "yy")], "doc_id long, text string, lang string")
    model = L.fit(tail)
    assert {r.lang_pred for r in L.identify_languages(spark.createDataFrame([(1, "zzz")], "doc_id long, text string"), model).collect()} == {"xx"}


def test_whole_query_against_a_plain_version(spark, tiny):
    """The registered query against sums over all pieces of each word, a dictionary and a loop per text."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "lang")
    model = L.fit(docs.where(~shared.is_held_out(F.col("doc_id"))))
    get, p = model.vocabulary.index, model.probabilities
    known = {}

    def total(word):
        if word not in known:
            marked = L.START + word
            alpha = [np.ones(p.shape[1])] + [np.zeros(p.shape[1]) for _ in marked]
            for j in range(1, len(marked) + 1):
                for i in range(j):
                    k = get.get(marked[i:j], len(get) if j == i + 1 else None)
                    if k is not None:
                        alpha[j] = alpha[j] + alpha[i] * p[k]
            known[word] = np.log(np.maximum(alpha[-1], 1e-300))
        return known[word]

    found = {r.doc_id: r for r in L.op1(spark, tiny).collect()}
    rows = docs.collect()
    assert len(found) == len(rows)
    for r in rows:
        words = [w for run in L.letter_runs((r.text or "").lower()) for w in [run[i : i + L.RUN] for i in range(0, len(run), L.RUN)]]
        if not words:
            assert found[r.doc_id].lang_pred == "und"
            continue
        logits = sum(total(w) for w in words)
        assert found[r.doc_id].lang_pred == model.languages[int(np.argmax(logits))]
        weights = np.exp((logits - logits.max()) * min(1.0, model.evidence / len(words)))
        assert math.isclose(found[r.doc_id].score, weights.max() / weights.sum(), rel_tol=1e-6)
