import numpy as np
import pytest

pytest.importorskip("pagewright.llm")
from pagewright.llm import gru  # noqa: E402


def model():
    rng = np.random.default_rng(0)
    m = gru.fresh(rng.integers(1, 9, gru.VOCABULARY).astype(float))
    return {k: v.astype(float) + 0.1 * rng.normal(size=v.shape) for k, v in m.items()}


def loss(m, last, ids, h):
    """Plain restatement: one gated step after the other, whole softmaxes."""
    s, total = gru.STATE, 0.0
    sig = lambda x: 1 / (1 + np.exp(-x))
    for t in range(len(ids)):
        for i in range(ids.shape[1]):
            before = np.zeros(s) if last[t, i] == gru.END else h[i]
            x, u = m["x"][last[t, i]] + m["b"], before @ m["u"]
            z, r = sig(x[:s] + u[:s]), sig(x[s : 2 * s] + u[s : 2 * s])
            c = np.tanh(x[2 * s :] + r * u[2 * s :])
            h[i] = c + z * (before - c)
            k, j = divmod(int(ids[t, i]), gru.MEMBERS)
            a, b = h[i] @ m["c"] + m["cb"], m["w"][k] @ h[i] + m["wb"][k]
            total -= a[k] - np.log(np.exp(a).sum()) + b[j] - np.log(np.exp(b).sum())
    return total


def test_gradients_equal_finite_differences():
    rng, m = np.random.default_rng(1), model()
    last, ids = rng.integers(0, 300, (4, 3)), rng.integers(0, gru.VOCABULARY, (4, 3))
    last[2, 1] = gru.END
    h = np.tanh(rng.normal(size=(3, gru.STATE)))
    g, after, rows = gru._gradients(m, last, ids, h.copy())
    again = h.copy()
    loss(m, last, ids, again)
    assert np.allclose(after, again)
    for k in m:
        places = {"x": (rows[1], 5), "w": (ids[0, 0] // gru.MEMBERS, ids[0, 0] % gru.MEMBERS, 3), "wb": (ids[1, 1] // gru.MEMBERS, 7)}.get(k, tuple(n // 2 for n in m[k].shape))
        step, moved = 1e-5, []
        for sign in (1, -1):
            other = {n: v.copy() for n, v in m.items()}
            other[k][places] += sign * step
            moved.append(loss(other, last, ids, h.copy()))
        want = (moved[0] - moved[1]) / (2 * step)
        got = g["x"][1, 5] if k == "x" else g[k][places]
        assert abs(want - got) < 1e-4 * max(1, abs(want)), k


def test_training_learns_an_order_and_carries_it_across_windows():
    rng, cycle = np.random.default_rng(2), np.arange(2, 42)
    texts = [np.append(np.tile(cycle, 3)[: rng.integers(20, 100)], gru.END).astype(np.int32) for _ in range(600)]
    counts = np.bincount(np.concatenate(texts), minlength=gru.VOCABULARY).astype(float)
    start = gru.fresh(counts)
    m = gru.train(start, texts)
    n = sum(map(len, texts))
    assert gru.score(m, texts).sum() / n > gru.score(start, texts).sum() / n / 2
    assert all(np.isfinite(v).all() for v in m.values())
    # one long text scores as its steps in turn, whatever the windows
    long = np.append(np.tile(cycle, 200), gru.END).astype(np.int32)
    whole, was = gru.score(m, [long])[0], gru.SCORE_STEPS
    try:
        gru.SCORE_STEPS = 7
        assert abs(gru.score(m, [long])[0] - whole) < 1e-3 * abs(whole)
    finally:
        gru.SCORE_STEPS = was


def test_training_takes_few_and_no_tokens():
    start = gru.fresh(np.ones(gru.VOCABULARY))
    assert gru.train(start, [np.array([gru.END], np.int32)])["u"].shape == start["u"].shape
    assert gru.train(start, [np.array([5, gru.END], np.int32)])["x"].dtype == np.float32
