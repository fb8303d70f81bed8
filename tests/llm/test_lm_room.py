"""Operator 4: the gradient works in memory that is used again; what is left there from another batch changes nothing."""

import tracemalloc

import numpy as np

from intervalia.llm import lm


def batch(n, seed):
    r = np.random.default_rng(seed)
    context, targets = (r.integers(0, lm.PIECES + 1, (n, lm.WINDOW)).astype(np.int16) for _ in range(2))
    return context, targets, (r.random((n, lm.WINDOW)) < 0.9).astype(np.float32)


def test_memory_is_used_again():
    w, room = lm.started(), lm.Room()
    for k, n in enumerate((300, 1, 70, 1024, 65, 1024)):
        some = batch(n, k)
        fresh = lm.gradient(w, *some)
        tracemalloc.start()
        again = lm.gradient(w, *some, room=room)
        asked = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert set(fresh) == set(again) and all(np.array_equal(fresh[x], again[x]) for x in fresh)
    # Of the last batch, whose states, sums and hidden layers alone are over 18 MB.
    assert asked < 6_000_000


def test_large_logits():
    """Sums of exponentials that leave the range of float32 are taken again, shifted."""
    some = batch(40, 1)
    for size in (150, -150):
        w = {k: x.astype(np.float64) for k, x in lm.started().items()}
        w["g"] += size
        w["m"][:] += size
        exact = lm.gradient(w, *some)
        got = lm.gradient({k: x.astype(np.float32) for k, x in w.items()}, *some)
        assert all(np.allclose(got[k], exact[k], rtol=1e-2, atol=1e-4 * np.abs(exact[k]).max()) for k in exact)


def test_adam():
    r, w = np.random.default_rng(2), {"a": np.full((3, 4), 0.5, np.float32)}
    adam, plain, m, v = lm.Adam(w), w["a"].astype(np.float64), 0.0, 0.0
    for step in range(1, 40):
        g = (r.normal(size=(3, 4)) * 10.0 ** r.integers(-6, 1, (3, 4))).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g.astype(np.float64) ** 2
        plain -= 0.01 * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        adam.down({"a": g.copy()}, 0.01)
    assert np.allclose(w["a"], plain, atol=1e-5)
