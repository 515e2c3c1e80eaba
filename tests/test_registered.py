"""Queries are registered with the whole work of their operator."""

import inspect

from marchland.operators import baselines
from marchland.plans import reference


def test_mlp_predict_uses_the_operators_layers_and_rounds(monkeypatch):
    seen = {}

    def spy(*args, **kwargs):
        bound = inspect.signature(real).bind(*args, **kwargs)
        bound.apply_defaults()
        seen.update(bound.arguments)

    real = baselines.perceptron
    monkeypatch.setattr(baselines, "perceptron", spy)
    monkeypatch.setattr(reference, "emb64", lambda spark, d: None)
    reference.mlp_predict(None, "")
    assert seen["hidden"] == (100, 50, 25) and seen["rounds"] == 75
