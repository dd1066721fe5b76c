"""The model queries train the operator's own size of model."""

import pytest

from seguelab.plans import scores


@pytest.mark.parametrize("query, want", [(scores.forest_scores, {}), (scores.perceptron_scores, {"kind": "mlp"})])
def test_models_have_the_default_size(monkeypatch, query, want):
    class Trained(Exception):
        pass

    def train(pairs, **given):
        raise Trained(given)

    monkeypatch.setattr(scores, "_labelled", lambda *_: None)
    monkeypatch.setattr(scores.M, "train", train)
    with pytest.raises(Trained) as seen:
        query(None, "")
    assert seen.value.args == (want,)
