import random

import corpus_pipeline as C
from recollect.llm import shared, token_counts


def test_stages_on_planted_documents(spark, tmp_path):
    """Each stage rejects what is planted for it, and clean documents reach the sequences whole."""
    rng = random.Random(3)
    syllables = {"en": ["th", "er", "on", "an", "re", "ing", "ed", "nd"], "fr": ["eau", "oi", "ère", "que", "ou", "ai", "ché", "eux"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.choice([1, 2, 3])))
    text = lambda lang, n=120: " ".join(word(lang) for _ in range(n))
    insult = lambda t: " ".join(x if i % 40 else "idiot" for i, x in enumerate(t.split()))
    rows, labels = [], []
    for i in range(160):
        lang = "fr" if i % 4 == 0 else "en"
        bad = i % 8 == 3
        rows.append((i, insult(text(lang)) if bad else text(lang), lang, f"s{i % 3}"))
        labels.append((i, 1, int(bad)))
    item = text("en", 30)
    rows += [(500, "12 34 %%", "en", "s0"), (501, None, "en", "s0"), (502, rows[1][1], "en", "s0"), (503, rows[1][1].replace(" ", "  ", 3) + " extra", "en", "s0")]
    rows += [(504, text("en", 60) + " " + item + " " + text("en", 60), "en", "s0")]
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    gone = {500, 501, 502, 503, 504} | {i for i in range(160) if i % 8 == 3}
    found = C.run(spark, str(tmp_path)).collect()
    kept = {}
    for r in found:
        kept[r.doc_id] = kept.get(r.doc_id, 0) + r.n_units
    encode = token_counts.ByteLevelLengths(token_counts.byte_level_tokenizer()).counts
    assert kept == {r[0]: encode([r[1]])[0] for r in rows if r[0] not in gone}


def test_empty_documents(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_one_id_with_different_texts(spark):
    """Texts of one id that are no near duplicates are decided each by its own group."""
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(60))
    rows = [(1, text(1)), (5, text(1)), (5, text(2)), (5, text(2)), (5, text(3)), (7, text(3)), (None, text(1))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r.doc_id or 0, r.text) for r in C.unique(spark, docs, "").collect()))
    assert kept == [(0, text(1)), (1, text(1)), (5, text(2)), (5, text(3))]


def test_stages_on_odd_documents(spark, odd_documents, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, and columns whose names stages use within: all but the last stage return the columns of documents."""
    spark.createDataFrame([(1, 1, 0), (7, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "vous plaît"), (None, "hello there"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = odd_documents.withColumnRenamed("fp", "t").withColumnRenamed("words", "sig").withColumnRenamed("size", "component").withColumnRenamed("cluster", "bad_id")
    for name, stage in C.STAGES:
        for docs in (odd, odd.limit(0)):
            found = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert found.columns == C.COLUMNS
                assert found.count() <= docs.count()
    kept = lambda stage: sorted(((r.doc_id or 0, len(r.text or "")) for r in stage(spark, odd, str(tmp_path)).collect()))
    texts = [(r.doc_id or 0, r.text) for r in odd.collect()]
    assert kept(C.identified) == sorted((i, len(t)) for i, t in texts if t and any(c.isalpha() for c in t))
    assert kept(C.civil) == sorted((i, len(t or "")) for i, t in texts)
    # Documents without words are one group; of equal texts one stays; those without an id all stay.
    assert [i for i, _ in kept(C.unique)] == [0, 0, 1, 3, 6, 7, 8, 9]
    # An item without an id counts like any other.
    assert [i for i, _ in kept(C.unseen)] == sorted(i for i, t in texts if not any(item in (t or "").lower() for item in ("vous plaît", "hello there")))


def test_a_run_leaves_only_its_result(spark, tmp_path):
    import os

    rows = [(i, f"the quick brown fox number w{i} jumps over the lazy dog", "en", "s", 50) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing like it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    folder = shared.shared_folder(spark).removeprefix("file:")
    listed = lambda: {os.path.join(top, d) for top, dirs, _ in os.walk(folder) for d in dirs if d.startswith(("rdd-", "pipeline-"))}
    before = listed()
    found = C.run(spark, str(tmp_path))
    assert found.count() > 0
    assert [os.path.basename(x).rsplit("-", 1)[0] for x in listed() - before] == ["pipeline-packing"]
