import numpy as np
import pytest

from recollect.llm import toxicity as X


def subsequence_value(a, b):
    """The kernel by its definition: all pairs of equal subsequences of three, within the span."""
    def paths(word):
        codes = [X.EDGE, *[X.code(c) for c in word], X.EDGE]
        n = range(len(codes))
        return [((codes[i], codes[j], codes[k]), X.DECAY ** (k - i)) for i in n for j in n for k in n if i < j < k <= i + X.SPAN]

    def square(word):
        """Of the features where letters repeat, else of the occurrences."""
        total = {}
        for n, (s, w) in enumerate(paths(word)):
            key = s if 2 * len(set(word)) <= len(word) else n
            total[key] = total.get(key, 0) + w
        return sum(w * w for w in total.values())

    p, q = paths(a), paths(b)
    return sum(x * y for s, x in p for t, y in q if s == t) / np.sqrt(square(a) * square(b))


def test_kernel_is_the_subsequence_kernel():
    words = ["idiot", "idixot", "clown", "é", "anna", "banana"]
    found = X.kernel(words, X.features(["idiot", "banana"]))
    for i, a in enumerate(words):
        for j, b in enumerate(["idiot", "banana"]):
            assert found[i, j] == pytest.approx(subsequence_value(a, b), abs=1e-6)


def test_long_runs_of_letters_have_no_large_value():
    model = X.train_words(["idiot", "moron", "papa"], ["house", "garden", "window", "anna"])
    lengths = ["a" * n for n in (20, 200, 5_000)] + ["ab" * n for n in (20, 200, 5_000)]
    values = model.values(lengths)
    assert np.allclose(values[:3], values[0], atol=0.1) and np.allclose(values[3:], values[3], atol=0.1)
    assert (np.abs(values - model.bias) <= np.linalg.norm(model.weights) + 1e-6).all()


def test_folding_equals_the_sum_over_landmarks():
    basis = X.features(["idiot", "clown", "house"])
    beta = np.array([1.0, -2.0, 0.5])
    words = ["idiots", "cloven", "mouse"]
    assert np.allclose(X.word_values(words, basis.T @ beta), X.kernel(words, basis) @ beta, atol=1e-6)


def test_gaps_and_inserted_characters_are_caught():
    clean = [a + b for a in ("the", "on", "er", "hea", "sh", "tion", "ly", "and") for b in ("ing", "ed", "nd", "at", "re", "est", "ble", "wh", "in")]
    model = X.train_words(["idiot", "moron", "worthless", "clown"], clean)
    cache = X.TokenCache(model)
    hit = X.worst(["you are an i d i o t now", "what an id.i.ot!", "m0ron", "wor-th-less", "the clowxn"], cache)
    miss = X.worst(["theing oned ered", "and the lyest tioned", "", None], cache)
    assert min(hit) > max(miss)


def test_machine_equals_a_plain_kernel_machine():
    """Kernel values by definition and plain gradient descent on the same loss, against the folded machine."""
    words = ["idiot", "idiots", "moron", "house", "garden", "stone", "river", "idle", "more"]
    y = np.array([1, 1, 1, -1, -1, -1, -1, -1, -1.0])
    weight = np.array([2, 1, 1, 1, 1, 1, 1, 0.5, 0.5])
    landmarks = ["idiot", "moron", "house", "idle"]
    model = X.machine(words, y, weight, landmarks)
    inner = np.array([[subsequence_value(a, b) for b in landmarks] for a in landmarks])
    values, vectors = np.linalg.eigh(inner)
    root = vectors / np.sqrt(values)
    new = ["idixot", "morons", "houses", "tree"]
    x, x_new = (np.array([[subsequence_value(a, b) for b in landmarks] for a in w]) @ root for w in (words, new))
    w, bias = np.zeros(4), 0.0
    for _ in range(20_000):
        slack = np.maximum(0, 1 - y * (x @ w + bias)) * weight * y
        w, bias = w - 0.01 * (w - 2 * x.T @ slack), bias - 0.01 * (1e-3 * bias - 2 * slack.sum())
    assert np.allclose(model.values(new), x_new @ w + bias, atol=1e-3)


def test_only_words_that_mark_toxic_sentences_count_as_toxic():
    """Sentences' labels alone: words that both kinds share, and those that come once, are not learned as toxic."""
    rng = np.random.default_rng(0)
    syllables = ["th", "er", "on", "re", "at", "ing", "st", "en", "nd", "ti", "es", "or", "an", "ed"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 5)))
    bad, good = {}, {}
    for n in range(3_000):
        toxic = n % 10 == 0
        sentence = {word() for _ in range(12)} | {"the", "and"} | ({str(rng.choice(["idiot", "moron", "clown", "loser"]))} if toxic else set())
        for w in sentence:
            (bad if toxic else good)[w] = (bad if toxic else good).get(w, 0) + 1
    words = sorted({*bad, *good})
    model, positive, counts = X.train_sentences(words, np.array([bad.get(w, 0) for w in words]), np.array([good.get(w, 0) for w in words]))
    assert set(positive) == {"idiot", "moron", "clown", "loser"} and sorted(counts) == sorted(bad[w] for w in positive)
    assert min(model.values(["idiot", "moron", "clown", "loser", "idixot", "clowen"])) > max(model.values(["the", "and", "therering", "stander"]))
    assert X.train_sentences(["a", "b"], np.array([0, 0]), np.array([3, 4])) is None


def test_sentences_are_distinct_and_clean_if_a_clean_text_has_them(spark):
    rows = spark.createDataFrame([("One two. Bad words!", 1), ("one two\nGood one", 0), ("bad words. bad words", 1), ("", 1), ("... 1 2", 0), ("w" * 30_000, 0)], "text string, toxic int")
    found = {tuple(r.words): r.toxic for r in X.sentences_of(rows).collect()}
    assert found == {("one", "two"): 0, ("bad", "words"): 1, ("good", "one"): 0, ("w" * 30_000,): 0}
    many = spark.createDataFrame([(" ".join(chr(97 + i // 26) + chr(97 + i % 26) for i in range(70)), 1)], "text string, toxic int")
    assert sorted(len(r.words) for r in X.sentences_of(many).collect()) == [10, 30, 30]


def test_held_out_labels(spark):
    """Of the held-out quarter, by the table's labels; some of them mark texts that no word sets apart."""
    base = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{base}/labels.parquet").select("doc_id", "toxic")
    rows = X.op9(spark, base).join(labels, "doc_id").where("held_out").select("predicted", "toxic", "score").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.8 * sum(r.toxic for r in rows)
    assert hit >= 0.8 * sum(r.predicted for r in rows)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, None), (None, 1, 1), (2, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert X.fit(X.labelled(odd_documents, labels)) is None
    assert X.fit(X.labelled(no_documents, labels.limit(0))) is None
    model = X.train_words(["idiot"], ["house", "garden", "window"])
    found = X.score_toxicity(odd_documents, model).collect()
    assert len(found) == odd_documents.count() and all(0 <= r.tox_score <= 1 for r in found)
    assert X.score_toxicity(odd_documents, None).where("tox_score > 0").count() == 0
    assert X.score_toxicity(no_documents, model).count() == 0
