"""A bidirectional gated recurrent network over bytes, in numpy.

It labels every byte of a window: two GRUs read the window forwards and
backwards, a softmax on both states gives a distribution per position.
Training is backpropagation through time with Adam. Windows of one length form
a batch, so no position is ever padded.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

GATES = ("z", "r", "n")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def new_model(classes: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p: dict[str, np.ndarray] = {}
    for d in "fb":
        p[f"{d}x"] = rng.normal(0, 0.3, (256, 3 * hidden))          # one row per byte, biases included
        p[f"{d}h"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        p[f"{d}o"] = rng.normal(0, 1 / np.sqrt(2 * hidden), (hidden, classes))
    p["bias"] = np.zeros(classes)
    return {k: v.astype(np.float32) for k, v in p.items()}


def run_gru(x: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (T, B, H) for gate inputs ``x`` (T, B, 3H)."""
    steps, batch, width = x.shape
    hidden = width // 3
    h = np.zeros((batch, hidden), dtype=x.dtype)
    out = np.empty((steps, batch, hidden), dtype=x.dtype)
    for t in range(steps):
        a = h @ u
        zr = sigmoid(x[t, :, :2 * hidden] + a[:, :2 * hidden])
        z, r = zr[:, :hidden], zr[:, hidden:]
        n = np.tanh(x[t, :, 2 * hidden:] + r * a[:, 2 * hidden:])
        if keep is not None:
            keep.append((h, z, r, n, a[:, 2 * hidden:]))
        h = n + z * (h - n)
        out[t] = h
    return out


def back_gru(grad: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs and of ``u`` from those of the states."""
    steps, batch, hidden = grad.shape
    dx = np.empty((steps, batch, 3 * hidden), dtype=grad.dtype)
    du = np.zeros_like(u)
    dh = np.zeros((batch, hidden), dtype=grad.dtype)
    for t in range(steps - 1, -1, -1):
        h, z, r, n, an = kept[t]
        dh = dh + grad[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * an * r * (1 - r)
        dx[t] = np.concatenate([dz, dr, dn], axis=1)
        da = np.concatenate([dz, dr, dn * r], axis=1)
        du += h.T @ da
        dh = dh * z + da @ u.T
    return dx, du


def positions(p: dict[str, np.ndarray], windows: np.ndarray) -> np.ndarray:
    """Class probabilities (T, B, C) at each byte of ``windows`` (B, T)."""
    seq = windows.T
    f = run_gru(p["fx"][seq], p["fh"])
    b = run_gru(p["bx"][seq[::-1]], p["bh"])[::-1]
    return softmax(f @ p["fo"] + b @ p["bo"] + p["bias"])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def gradients(p: dict[str, np.ndarray], windows: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions, and its gradients."""
    seq = windows.T
    kf: list = []
    kb: list = []
    f = run_gru(p["fx"][seq], p["fh"], kf)
    b = run_gru(p["bx"][seq[::-1]], p["bh"], kb)
    q = softmax(f @ p["fo"] + b[::-1] @ p["bo"] + p["bias"])
    n = q.shape[0] * q.shape[1]
    hit = np.arange(q.shape[1])
    loss = float(-np.log(q[:, hit, labels] + 1e-12).sum() / n)
    d = q
    d[:, hit, labels] -= 1
    d /= n
    flat = lambda x: x.reshape(-1, x.shape[-1])
    g = {"fo": flat(f).T @ flat(d), "bo": flat(b[::-1]).T @ flat(d), "bias": flat(d).sum(axis=0)}
    dxf, g["fh"] = back_gru(d @ p["fo"].T, p["fh"], kf)
    dxb, g["bh"] = back_gru((d @ p["bo"].T)[::-1], p["bh"], kb)
    for k, dx, s in (("fx", dxf, seq), ("bx", dxb, seq[::-1])):
        g[k] = np.zeros_like(p[k])
        np.add.at(g[k], s.reshape(-1), flat(dx))
    return loss, g


def train(windows: Sequence[bytes], labels: Sequence[int], classes: int, hidden: int = 12, epochs: int = 6, batch: int = 256, rate: float = 0.01, seed: int = 7) -> dict[str, np.ndarray]:
    p = new_model(classes, hidden, seed)
    rng = np.random.default_rng(seed)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(windows):
        by_length.setdefault(len(w), []).append(i)
    packed = {n: (np.frombuffer(b"".join(windows[i] for i in own), dtype=np.uint8).reshape(-1, n), np.array([labels[i] for i in own])) for n, own in sorted(by_length.items()) if n}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    step, total = 0, epochs * sum(1 + (len(y) - 1) // batch for _, y in packed.values())
    for _ in range(epochs):
        parts = []
        for n, (x, y) in packed.items():
            order = rng.permutation(len(y))
            parts += [(n, order[i:i + batch]) for i in range(0, len(y), batch)]
        for k in rng.permutation(len(parts)):
            n, own = parts[k]
            x, y = packed[n]
            _, g = gradients(p, x[own], y[own])
            step += 1
            lr = rate * (1 - step / (total + 1))
            for name, grad in g.items():
                grad = np.clip(grad, -1, 1)
                m[name] += 0.1 * (grad - m[name])
                v2[name] += 0.01 * (grad * grad - v2[name])
                p[name] -= (lr * (m[name] / (1 - 0.9 ** step)) / (np.sqrt(v2[name] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return p
