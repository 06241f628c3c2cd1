"""A small gated recurrent language model in numpy: class-factored softmax, truncated backpropagation.

Ids are ordered by frequency and cut into classes of equal length, so that a word's probability is that of its
class times that of the word within it: two short softmaxes instead of a long one. The state runs through a
document from its start to its end, from window to window.
"""

from __future__ import annotations

import numpy as np

#: Size of the state, number of classes and of words in each.
STATE, CLASSES, MEMBERS = 16, 48, 48
VOCABULARY = CLASSES * MEMBERS
#: Ids of the end of a document and of all words beyond the vocabulary.
END, OTHER = 0, 1
#: Steps in a window of scoring at most, and states that it holds at a time; steps in a window of training, and streams
#: trained side by side.
SCORE_STEPS, SCORE_STATES, STEPS, STREAMS = 512, 1 << 14, 20, 256
#: Windows that a pass over few texts has at least, by fewer streams.
WINDOWS = 100
#: Adam: the rate, how both means fade, and the share of the windows over which the rate rises at first.
RATE, FADE, FADE_SQUARES, WARM = 0.03, 0.9, 0.99, 0.1

Model = dict[str, np.ndarray]


def fresh(counts: np.ndarray, seed: int = 3) -> Model:
    """A model that starts as the unigram distribution of ``counts``, by id."""
    rng, c = np.random.default_rng(seed), counts.reshape(CLASSES, MEMBERS) + 0.5
    draw = lambda *shape: (rng.normal(size=shape) * 0.1).astype(np.float32)
    return {
        "x": draw(VOCABULARY, 3 * STATE), "u": draw(STATE, 3 * STATE) * 2, "b": np.zeros(3 * STATE, np.float32),
        "c": draw(STATE, CLASSES), "cb": np.log(c.sum(1) / c.sum()).astype(np.float32),
        "w": draw(CLASSES, MEMBERS, STATE), "wb": np.log(c / c.sum(1, keepdims=True)).astype(np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _classes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """An order of ``ids`` by class; classes and members in it, and where each class begins there."""
    classes = ids // MEMBERS
    order = np.argsort(classes.astype(np.uint8), kind="stable")
    classes = classes[order]
    return order, classes, ids[order] - classes * MEMBERS, np.searchsorted(classes, np.arange(CLASSES + 1)).tolist()


def _bounded(m: Model) -> bool:
    """Whether no logit can overflow after states within -1 and 1, so that softmaxes need no shift."""
    return bool(max((abs(m["c"]).sum(0) + abs(m["cb"])).max(), (abs(m["w"]).sum(2) + abs(m["wb"])).max()) < 60)


def _member_logits(m: Model, states: np.ndarray, cut: list[int]) -> np.ndarray:
    """Logits of the members of each state's class; states in the order of classes."""
    out = np.empty((len(states), MEMBERS), np.result_type(states, m["w"]))
    for k in range(CLASSES):
        a, b = cut[k], cut[k + 1]
        if a < b:
            np.matmul(states[a:b], m["w"][k].T, out=out[a:b])
            out[a:b] += m["wb"][k]
    return out


def _exp(logits: np.ndarray, bounded: bool) -> np.ndarray:
    """exp in place, shifted where it must be; returns the row sums."""
    if not bounded:
        logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], logits.dtype)


def log10_probabilities(m: Model, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """log10 of each id's probability after its state (components within -1 and 1)."""
    bounded, rows = _bounded(m), np.arange(len(ids))
    order, classes, members, cut = _classes(ids)
    states, found = h[order], np.zeros(len(ids))
    for logits, at in ((states @ m["c"] + m["cb"], classes), (_member_logits(m, states, cut), members)):
        if not bounded:
            logits -= logits.max(1, keepdims=True)
        found += logits[rows, at]
        found -= np.log(_exp(logits, True))
    out = np.empty(len(ids))
    out[order] = found
    return out / np.log(10)


def score(m: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each whole text (ids, the end included), side by side, longest first.

    States are held by component, so that every gate of all texts is one contiguous block. A window has the fewer
    steps the more texts are live, so that its softmaxes take the same memory for one long text and for many.
    """
    n = np.array([len(t) for t in texts], np.int64)
    out = np.zeros(len(texts))
    order = np.argsort(-n, kind="stable")
    flat, sizes = np.concatenate([texts[i] for i in order] or [np.zeros(0, np.int32)]), n[order]
    starts = np.cumsum(sizes) - sizes
    half = np.repeat(np.array([0.5, 1.0], np.float32), [2 * STATE, STATE])  # sigmoid(a) = tanh(a / 2) / 2 + 1 / 2
    x, u = np.ascontiguousarray((m["x"] + m["b"]) * half), np.ascontiguousarray((m["u"] * half).T)
    h = np.zeros((STATE, len(texts)), np.float32)
    first, longest = 0, int(n.max(initial=0))
    while first < longest:
        longer = lambda t: int(np.searchsorted(-sizes, -t, side="left"))  # noqa: E731  texts longer than t
        steps = max(1, min(SCORE_STEPS, SCORE_STATES // longer(first)))
        live = [longer(t) for t in range(first, first + steps)]
        total = sum(live)
        states, targets, owners, at = np.empty((total, STATE), np.float32), np.empty(total, np.int32), np.empty(total, np.int64), 0
        for t, k in enumerate(live, first):
            if not k:
                break
            last = flat[starts[:k] + t - 1] if t else np.full(k, END)
            now, g = h[:, :k], x[last].T
            a = u @ now
            zr = a[: 2 * STATE]
            zr += g[: 2 * STATE]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            c = a[2 * STATE :]
            c *= zr[STATE:]
            c += g[2 * STATE :]
            np.tanh(c, out=c)
            h = now - c
            h *= zr[:STATE]
            h += c
            states[at : at + k], targets[at : at + k], owners[at : at + k] = h.T, flat[starts[:k] + t], order[:k]
            at += k
        got = log10_probabilities(m, states, targets)
        out += np.bincount(owners, got.astype(np.float64), len(texts))
        first += steps
    return out


def _gradients(m: Model, last: np.ndarray, ids: np.ndarray, h: np.ndarray) -> tuple[Model, np.ndarray, np.ndarray]:
    """Truncated backpropagation through one window: ``last``, ``ids`` (steps, streams), state before it ->
    gradients, state after it, and the ids whose rows the gradient of "x" holds."""
    (steps, streams), two, kind = ids.shape, 2 * STATE, m["u"].dtype
    begins, inputs = last == END, m["x"][last] + m["b"]
    before, after, un = (np.empty((steps, streams, STATE), kind) for _ in range(3))
    gates = np.empty((steps, streams, 3 * STATE), kind)
    z, r, c = gates[:, :, :STATE], gates[:, :, STATE:two], gates[:, :, two:]
    for t in range(steps):
        before[t] = h
        before[t][begins[t]] = 0  # a document begins
        u = before[t] @ m["u"]
        gates[t, :, :two] = _sigmoid(inputs[t, :, :two] + u[:, :two])
        un[t] = u[:, two:]
        c[t] = np.tanh(inputs[t, :, two:] + r[t] * un[t])
        h = after[t]
        np.subtract(before[t], c[t], out=h)
        h *= z[t]
        h += c[t]
    bounded, flat = _bounded(m), ids.ravel()
    order, classes, members, cut = _classes(flat)
    states, rows, g = after.reshape(-1, STATE)[order], np.arange(len(flat)), {}
    d = states @ m["c"] + m["cb"]
    d *= 1 / _exp(d, bounded)[:, None]
    d[rows, classes] -= 1
    g["c"], g["cb"], dh = states.T @ d, d.sum(0), d @ m["c"].T
    d = _member_logits(m, states, cut)
    d *= 1 / _exp(d, bounded)[:, None]
    d[rows, members] -= 1
    g["w"], g["wb"] = np.zeros_like(m["w"]), np.zeros_like(m["wb"])
    for k in range(CLASSES):
        a, b = cut[k], cut[k + 1]
        if a < b:
            np.matmul(d[a:b].T, states[a:b], out=g["w"][k])
            g["wb"][k] = d[a:b].sum(0)
            dh[a:b] += d[a:b] @ m["w"][k]
    each = np.empty_like(dh)
    each[order] = dh
    each = each.reshape(steps, streams, STATE)
    # what a change of the new state does to the inputs of candidate, update and reset gate
    to_c = (1 - z) * (1 - c * c)
    to_z = (before - c) * z * (1 - z)
    to_r = un * r * (1 - r)
    dx, du, dh, turned = np.empty_like(gates), np.empty_like(gates), np.zeros((streams, STATE), kind), np.ascontiguousarray(m["u"].T)
    for t in reversed(range(steps)):
        dh += each[t]
        dx[t, :, two:] = dh * to_c[t]
        dx[t, :, :STATE] = dh * to_z[t]
        dx[t, :, STATE:two] = dx[t, :, two:] * to_r[t]
        du[t, :, :two] = dx[t, :, :two]
        du[t, :, two:] = dx[t, :, two:] * r[t]
        dh *= z[t]
        dh += du[t] @ turned
        dh[begins[t]] = 0
    dx, came = dx.reshape(-1, 3 * STATE), last.ravel()
    g["u"], g["b"] = before.reshape(-1, STATE).T @ du.reshape(-1, 3 * STATE), dx.sum(0)
    order = np.argsort(came.astype(np.int16), kind="stable")
    found, at = np.unique(came[order], return_index=True)
    g["x"] = np.add.reduceat(dx[order], at)
    return g, h, found


def train(m: Model, texts: list[np.ndarray]) -> Model:
    """One pass over whole texts, laid end to end in parallel streams, by Adam with a rate that rises, then falls. What the
    streams leave over is a last stream of its own. Rows of "x" move when their word occurs."""
    m, flat = {k: v.copy() for k, v in m.items()}, np.concatenate([[END], *texts]).astype(np.int32)
    total = len(flat) - 1
    streams = max(1, min(STREAMS, total // (WINDOWS * STEPS)))
    length = total // streams
    rest = flat[streams * length :, None]
    parts = [
        (flat[: streams * length].reshape(streams, length).T, flat[1 : streams * length + 1].reshape(streams, length).T),
        (rest[:-1], rest[1:]),
    ]
    mean, squares = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    n, windows = 0, sum(-(-len(ids) // STEPS) for _, ids in parts)
    for last, ids in parts:
        h = np.zeros((ids.shape[1], STATE), np.float32)
        for at in range(0, len(ids), STEPS):
            n += 1
            now = ids[at : at + STEPS]
            g, h, rows = _gradients(m, last[at : at + STEPS], now, h)
            # a window counts by its tokens, so that a few left over don't pull like a full one
            rate = RATE * min(1, n / (WARM * windows)) * max(0.1, 1 - n / windows) * min(1, now.size / (streams * STEPS))
            rate, even = np.float32(rate / (1 - FADE**n)), np.float32(1 / (1 - FADE_SQUARES**n))
            for k, v in g.items():
                v *= np.float32(1 / now.size)
                some = rows if k == "x" else slice(None)
                a, b = mean[k][some], squares[k][some]
                a *= FADE
                a += (1 - FADE) * v
                v *= v
                v *= 1 - FADE_SQUARES
                b *= FADE_SQUARES
                b += v
                if k == "x":
                    mean[k][some], squares[k][some] = a, b
                np.sqrt(b * even, out=v)
                v += 1e-6
                m[k][some] -= rate * a / v
    return m
