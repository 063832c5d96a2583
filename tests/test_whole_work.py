from cadenza.operators import learning, signals
from cadenza.plans import models


def test_coherence_is_registered_with_all_permutations(monkeypatch):
    seen = []
    monkeypatch.setattr(models.S, "injection", lambda *a: None)
    monkeypatch.setattr(models.K, "rates", lambda *a: None)

    def coherence(injection, panel, upto, permutations=150):
        seen.append(permutations)
        raise StopIteration

    default = signals.coherence.__defaults__
    monkeypatch.setattr(models.N, "coherence", coherence)
    try:
        models.coherence_pairs(None, "")
    except StopIteration:
        pass
    assert seen == [150] and default == (150,)


def test_tree_models_have_the_surveyed_size(spark):
    assert [(m.getMaxIter(), m.getStepSize(), m.getMaxDepth()) for m in (learning.forecaster(), learning.stacker())] == [(600, 0.03, 5), (300, 0.05, 4)]
