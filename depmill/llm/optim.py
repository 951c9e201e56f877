"""Adam for dicts of numpy arrays, with gradients of whole arrays or of rows."""

from __future__ import annotations

import numpy as np


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float = 3e-3, shares: dict[str, float] | None = None) -> None:
        """shares: what part of the rate holds for some parameters."""
        self.params, self.rate, self.shares, self.t = params, rate, shares or {}, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray | tuple[np.ndarray, np.ndarray]], clip: float = 5.0) -> None:
        """grads: an array for each name, or (distinct rows, their gradients)."""
        self.t += 1
        norm = np.sqrt(sum(float((g[1] if isinstance(g, tuple) else g).ravel() @ (g[1] if isinstance(g, tuple) else g).ravel()) for g in grads.values()))
        scale = min(1.0, clip / (norm + 1e-9))
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            at, g = g if isinstance(g, tuple) else (slice(None), g)
            g = g * scale
            m = self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * g
            v = self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * g * g
            self.params[k][at] -= (rate * self.shares.get(k, 1.0) * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gru_step(a: np.ndarray, h: np.ndarray, wh: np.ndarray, bn: np.ndarray) -> tuple:
    """One step of a gated recurrent unit; a: the input's part of the gates r, z, n. Returns h and what backward needs."""
    k = h.shape[1]
    g = h @ wh
    rz = sigmoid(a[:, : 2 * k] + g[:, : 2 * k])
    r, z = rz[:, :k], rz[:, k:]
    q = g[:, 2 * k :] + bn
    n = np.tanh(a[:, 2 * k :] + r * q)
    return n + z * (h - n), (h, r, z, q, n)


def gru_back(dh: np.ndarray, kept: tuple, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the gradient of a step's output: those of the earlier h, of a, of wh and of bn."""
    h, r, z, q, n = kept
    dn = dh * (1 - z) * (1 - n * n)
    dz = dh * (h - n) * z * (1 - z)
    dr = dn * q * r * (1 - r)
    dq = dn * r
    da = np.concatenate([dr, dz, dn], 1)
    dg = np.concatenate([dr, dz, dq], 1)
    return dh * z + dg @ wh.T, da, h.T @ dg, dq.sum(0)


def by_gate(w: np.ndarray) -> np.ndarray:
    """Weights of three gates side by side, to one array each."""
    return np.ascontiguousarray(w.reshape(len(w), 3, -1).swapaxes(0, 1))


def gru_next(a: np.ndarray, h: np.ndarray, wide: np.ndarray, bn: np.ndarray) -> np.ndarray:
    """The state after h; (gate, row, unit) inputs, overwritten, and weights of r and z are halves."""
    g = np.matmul(h, wide)
    x = np.add(a[:2], g[:2], out=a[:2])
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    q = g[2]
    q += bn
    q *= x[0]
    q += a[2]
    np.tanh(q, out=q)
    out = h - q
    out *= x[1]
    out += q
    return out


def gru_run(a: np.ndarray, h: np.ndarray, fresh: np.ndarray, wh: np.ndarray, bn: np.ndarray) -> tuple[np.ndarray, tuple]:
    """gru_step over (gate, time, row, unit) inputs, the state multiplied by ``fresh`` before each; outputs, and what backward needs."""
    t, half = a.shape[1], np.array([0.5, 0.5, 1], a.dtype)[:, None, None]  # sigmoid(x) is tanh(x / 2) / 2 + 1 / 2
    wide = by_gate(wh) * half
    prev, q, n, out = (np.empty(a.shape[1:], a.dtype) for _ in range(4))
    rz = a[:2] * half[:2, None]
    for i in range(t):
        np.multiply(h, fresh[i], out=prev[i])
        g = np.matmul(prev[i], wide)
        x = rz[:, i]
        x += g[:2]
        np.tanh(x, out=x)
        x *= 0.5
        x += 0.5
        np.add(g[2], bn, out=q[i])
        y = np.multiply(x[0], q[i], out=n[i])
        y += a[2, i]
        np.tanh(y, out=y)
        h = np.subtract(prev[i], y, out=out[i])
        h *= x[1]
        h += y
    return out, (prev, rz, q, n)


def gru_run_back(dout: np.ndarray, fresh: np.ndarray, kept: tuple, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the gradients of gru_run's outputs: those of a (gate, row of all times, unit), of wh and of bn."""
    prev, (r, z), q, n = kept
    t, s, k = n.shape
    # a step's gradients by r, z, n and q are those by its output times factors that need no recursion
    factors = np.empty((4, t, s, k), n.dtype)
    rest = 1 - z
    dr, dz, dn, dq = factors
    np.multiply(n, n, out=dn)
    np.subtract(1, dn, out=dn)
    dn *= rest
    np.multiply(dn, r, out=dq)
    np.subtract(prev, n, out=dz)
    dz *= z
    dz *= rest
    np.multiply(dq, q, out=dr)
    dr *= np.subtract(1, r, out=rest)
    (back_r, back_z, back_q), dh = by_gate(wh).swapaxes(1, 2), np.zeros((s, k), n.dtype)
    for i in range(t - 1, -1, -1):
        d = dout[i] + dh
        f = factors[:, i]
        f *= d
        dh = np.multiply(d, z[i], out=d)
        dh += f[0] @ back_r
        dh += f[1] @ back_z
        dh += f[3] @ back_q
        dh *= fresh[i]
    flat = factors.reshape(4, t * s, k)
    before = prev.reshape(t * s, k).T
    return flat[:3], np.concatenate([before @ flat[j] for j in (0, 1, 3)], 1), np.ones(t * s, n.dtype) @ flat[3]
