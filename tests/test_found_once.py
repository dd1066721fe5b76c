"""What a search finds is one table for the resolution and the features, though equal queries leave a choice of title."""

from seguelab.plans import texts


def test_candidates_are_chosen_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(texts.caches, "training_pairs", lambda videos, found, features, deep: (None, None, seen.extend((found, features))))
    texts.training_pairs(spark, "/root/testdata/sf0.001")
    found, features = seen
    assert set(found.inputFiles()) == set(features.inputFiles()) and all("/found-" in f for f in found.inputFiles())
