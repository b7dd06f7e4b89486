"""What the pipeline's driver holds: landmarks once, and nothing of the stages before."""

import numpy as np

import corpus_pipeline
from recollect.llm import shared, toxicity


def test_landmarks_are_held_once():
    basis = toxicity.features(["alpha", "beta", "idiot"])
    assert np.shares_memory(basis, np.ascontiguousarray(basis.T))


def test_each_stage_begins_by_giving_back(spark, tiny, monkeypatch):
    given, plain = [], shared.give_back
    monkeypatch.setattr(shared, "give_back", lambda s: given.append(plain(s)))
    docs = shared.table(spark, tiny, "documents").limit(20)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        stage(spark, docs, tiny)
        assert len(given) == n
