"""What the models learn from a row: FTRL-proximal against a scalar version, the network's step against differences of its loss."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest

from hedgeline.llm import pseudo_likelihood, toxicity


def scalar_ftrl(samples: list[tuple[set, int]], s: toxicity.Settings) -> dict[int, float]:
    """One coordinate at a time; -1 is the bias, which has no L1 bound."""
    z, n = {}, {}

    def weight(i: int) -> float:
        bound, at = (0.0 if i == -1 else s.l1), z.get(i, 0.0)
        return 0.0 if abs(at) <= bound else -(at - math.copysign(bound, at)) / ((s.beta + math.sqrt(n.get(i, 0.0))) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for features, label in samples:
            w = {i: weight(i) for i in [*features, -1]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i, old in w.items():
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / s.alpha * old
                n[i] = before + g * g
    return {i: w for i in z if (w := weight(i))}


@pytest.mark.parametrize("l1", [0.0, 0.3, 2.0])
def test_weights_equal_scalar_ftrl(l1):
    rng = random.Random(4)
    settings = toxicity.Settings(bits=12, l1=l1, epochs=3)
    texts = [" ".join(rng.choices(["you", "fool", "fools", "fine", "day", "a", "the", "Idiot!", "nice"], k=rng.randint(0, 12))) for _ in range(150)]
    labels = [int("fool" in t or "Idiot" in t) for t in texts]
    found = pd.concat(list(toxicity.fit(iter([pd.DataFrame({"text": texts[:70], "toxic": labels[:70]}), pd.DataFrame({"text": texts[70:], "toxic": labels[70:]})]), settings)))
    samples = [({int(f) for _, hashed in toxicity.features([t], settings.bits) for f in hashed}, y) for t, y in zip(texts, labels, strict=True)]
    expected = scalar_ftrl(samples, settings)
    weights = dict(zip(found["feature"], found["weight"], strict=True))
    assert weights.keys() == expected.keys() and -1 in weights
    assert all(weights[i] == pytest.approx(w, rel=1e-9) for i, w in expected.items())
    assert l1 < 2 or len(weights) < 4000  # the bound leaves few


def test_a_step_follows_the_gradient_of_the_loss():
    shape = pseudo_likelihood.Shape(classes=3, members=4, shared=2, width=5)
    rng = np.random.default_rng(9)
    trainer = pseudo_likelihood.Trainer(shape)
    trainer.net.flat[:] = rng.normal(0, 0.5, len(trainer.net.flat))
    ids, weight = rng.integers(0, shape.size, 16), rng.integers(0, 2, 12).astype(np.float32)
    weight[0] = 1.0
    e, c, m = (part.astype(np.float64) for part in (trainer.net.e, trainer.net.c, trainer.net.m))

    def loss() -> float:
        """The mean of -log p over the words, in double precision, a place at a time."""
        total = 0.0
        for place, w in enumerate(weight, 2):
            if w:
                h = np.append(np.tanh(sum(e[k, ids[place + offset]] for k, offset in enumerate(pseudo_likelihood.OFFSETS))), 1.0)
                group, member = divmod(int(ids[place]), shape.members)
                log_softmax = lambda x, i: x[i] - math.log(np.exp(x).sum())
                total -= w * (log_softmax(h @ c, group) + log_softmax(h @ m[group], member))
        return total / weight.sum()

    def differences(of: np.ndarray) -> np.ndarray:
        out = np.zeros_like(of)
        for at in np.ndindex(of.shape):
            kept, ends = of[at], []
            for step in (1e-5, -1e-5):
                of[at] = kept + step
                ends.append(loss())
            of[at], out[at] = kept, (ends[0] - ends[1]) / 2e-5
        return out

    expected = [differences(part) for part in (e, c, m)]
    trainer.step(ids, weight)
    # Adagrad: what a weight moved by, times the root of its sum, is the gradient
    moved = [(old - new) / shape.rate for old, new in zip((e, c, m), (trainer.net.e, trainer.net.c, trainer.net.m), strict=True)]
    roots = [np.sqrt(trainer.seen[0])[:, :, None], np.sqrt(trainer.seen[1]), np.sqrt(trainer.seen[2])]
    for gradient, delta, root in zip(expected, moved, roots, strict=True):
        assert np.abs(gradient).max() > 1e-3
        assert delta * root == pytest.approx(gradient, abs=2e-4)
