import math

import numpy as np

from lakeweave.llm import html
from lakeweave.llm.html import HIDDEN_UNITS as K


def small(seed=3, inputs=5):
    rng = np.random.default_rng(seed)
    make = lambda *s: (0.5 * rng.standard_normal(s)).astype(np.float64)
    model = html.Labeller([make(inputs, 4 * K), make(K, 4 * K), make(4 * K), make(inputs, 4 * K), make(K, 4 * K), make(4 * K), make(2 * K + inputs), make(1)])
    x = rng.standard_normal((3, 6, inputs))
    mask = np.array([[1] * 6, [1] * 4 + [0] * 2, [1] + [0] * 5], np.float64)
    return model, x * mask[:, :, None], mask, (rng.random((3, 6)) < 0.5) * mask, rng


def plain(model, rows):
    """Each block's probability, one number at a time."""
    wf, uf, bf, wb, ub, bb, v, a = model.weights
    sig = lambda z: 1 / (1 + math.exp(-z))

    def walk(w, u, b, order):
        h, c, out = [0.0] * K, [0.0] * K, {}
        for t in order:
            z = [b[j] + sum(rows[t][i] * w[i][j] for i in range(len(rows[t]))) + sum(h[i] * u[i][j] for i in range(K)) for j in range(4 * K)]
            c = [sig(z[K + j] + 1) * c[j] + sig(z[j]) * math.tanh(z[3 * K + j]) for j in range(K)]
            h = [sig(z[2 * K + j]) * math.tanh(c[j]) for j in range(K)]
            out[t] = h
        return out

    ahead, back = walk(wf, uf, bf, range(len(rows))), walk(wb, ub, bb, range(len(rows) - 1, -1, -1))
    return [sig(sum(p * q for p, q in zip([*ahead[t], *back[t], *rows[t]], v)) + a[0]) for t in range(len(rows))]


def test_probabilities_against_plain_loops():
    model, x, mask, _, _ = small()
    p, _ = model.run(x, mask)
    for page, m, row in zip(x, mask, p):
        n = int(m.sum())
        assert np.allclose(row[:n], plain(model, page[:n].tolist()), atol=1e-5)


def test_gradients_against_differences():
    model, x, mask, y, rng = small()

    def loss():
        p, _ = model.run(x, mask)
        return float(-(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum())

    grads = model.gradients(x, mask, y)
    for i, g in enumerate(grads):
        way = rng.standard_normal(g.shape)
        kept, step = model.weights[i], 1e-3
        losses = []
        for sign in (1, -1):
            model.weights[i] = kept + sign * step * way
            losses.append(loss())
        model.weights[i] = kept
        assert math.isclose((losses[0] - losses[1]) / (2 * step), float((g * way).sum()), rel_tol=0.02, abs_tol=1e-4)


def test_labelling_keeps_no_tape():
    model, x, mask, _, _ = small()
    _, (_, ahead, back) = model.run(x, mask)
    assert not any(ahead) and not any(back)
