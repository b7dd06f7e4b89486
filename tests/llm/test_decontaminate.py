import random
import re

import pytest

from recollect.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(docs, items):
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, named = words(text), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                found = wins.get(tuple(w[i : i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    named |= found - {"None"}
        out.append((doc, len(w), len(hit), ",".join(sorted(named))))
    return sorted(out, key=str)


@pytest.mark.parametrize(("broadcast_rows", "broadcast_bytes"), [(100_000, 64_000_000), (0, 64_000_000), (100_000, 10)])
def test_matches_brute_force(spark, broadcast_rows, broadcast_bytes):
    rng = random.Random(4)
    vocabulary = ["a", "b", "É", "ça", "Dog9", "x1"]
    text = lambda n: rng.choice([" ", "-", ", "]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 4, 9, 10, 11, 25]))) for i in range(12)] + [(3, text(14)), (50, None), (51, "  ")]
    docs = [(i, text(rng.choice([0, 5, 30, 90]))) for i in range(40)] + [(100 + i, f"{text(6)} {t} {text(6)}") for i, (_, t) in enumerate(items) if t]
    docs += [(7, None), (8, ""), docs[45], docs[45]]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = [(r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in D.contamination(d, b, broadcast_rows, broadcast_bytes).collect()]
    assert sorted(found, key=str) == brute_force(docs, items)


def test_odd_rows(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(None, "hello there"), (1, "this is a plain text of some words"), (1, None)], "item_id long, text string")
    found = D.contamination(odd_documents, items).collect()
    assert len(found) == odd_documents.count()
    assert {(r.doc_id, r.n_hit, tuple(r["items"])) for r in found if r.n_hit} == {(1, 10, ("1",)), (2, 10, ("1",))}
    assert D.contamination(no_documents, items).count() == 0
    assert D.contamination(odd_documents, items.limit(0)).where("n_hit > 0").count() == 0


def test_whole_long_text_is_searched(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "filler " * 60_000 + item)], "doc_id long, text string")
    (row,) = D.contamination(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert (row.n_words, row.n_hit, row["items"]) == (60_012, 12, ["9"])
