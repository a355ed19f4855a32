"""Logistic regression on hashed features, learned by follow-the-regularised-leader updates (per coordinate)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa


@dataclass
class Ftrl:
    bits: int = 18
    alpha: float = 0.2
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 1.0
    epochs: int = 3
    updates: int = 30_000  # few rows are gone through more often, up to this many updates
    seed: int = 9

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
        """rows: feature numbers, values and label of each document, at most once per number. Returns weights and bias.
        No rows: all weights 0 and the bias 0, so every score is one half."""
        n = 1 << self.bits
        z, g2, w = np.zeros(n), np.zeros(n), np.zeros(n)
        zb = nb = bias = 0.0
        order = np.random.Generator(np.random.PCG64(self.seed))
        for _ in range(max(self.epochs, self.updates // max(1, len(rows)))):
            for k in order.permutation(len(rows)):
                idx, x, y = rows[k]
                zi, ni = z[idx], g2[idx]
                wi = np.where(np.abs(zi) <= self.l1, 0.0, -(zi - np.sign(zi) * self.l1) / ((self.beta + np.sqrt(ni)) / self.alpha + self.l2))
                bias = -zb / ((self.beta + np.sqrt(nb)) / self.alpha)
                p = 1.0 / (1.0 + np.exp(-np.clip(wi @ x + bias, -30, 30)))
                g = (p - y) * x
                s = (np.sqrt(ni + g * g) - np.sqrt(ni)) / self.alpha
                z[idx] = zi + g - s * wi
                g2[idx] = ni + g * g
                gb = p - y
                zb += gb - (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / self.alpha * bias
                nb += gb * gb
        live = np.abs(z) > self.l1
        w[live] = -(z[live] - np.sign(z[live]) * self.l1) / ((self.beta + np.sqrt(g2[live])) / self.alpha + self.l2)
        bias = -zb / ((self.beta + np.sqrt(nb)) / self.alpha) if rows else 0.0
        return w.astype(np.float32), float(bias)


def sparse_rows(got: pa.Table, value: float | None = None) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Rows of label, idx and (unless a constant) val as fit() takes them, in an order that partitions don't affect.
    They are views of the Arrow buffers: no Python object per feature."""
    if not got.num_rows:
        return []
    label = got["label"].to_numpy()
    idx = got["idx"].combine_chunks()
    off, at = idx.offsets.to_numpy(), idx.values.to_numpy()
    val = got["val"].combine_chunks().values.to_numpy() if value is None else None
    total = np.r_[0, np.cumsum(at, dtype=np.int64)]
    sums = total[off[1:]] - total[off[:-1]]
    out = []
    for k in np.lexsort((label, sums, np.diff(off))):
        a, b = off[k], off[k + 1]
        out.append((at[a:b], np.full(b - a, value) if val is None else val[a:b], int(label[k])))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))
