"""Small models fitted on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 1.0, decay: float = 1e-4, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic model for labels in [0, 1], by gradient steps with momentum; rows weigh alike, or as given (1 in all)."""
    share = 1 / len(x) if weight is None else weight
    w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(rounds):
        slope = x.T @ ((sigmoid(x @ w) - y) * share) + decay * w
        speed = 0.9 * speed - rate * slope
        w = w + speed
    return w


class Adam:
    """Steps for a list of arrays, changed in place."""

    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.first = [np.zeros_like(a) for a in arrays]
        self.second = [np.zeros_like(a) for a in arrays]

    def step(self, slopes: list[np.ndarray]) -> None:
        self.t += 1
        for a, g, m, v in zip(self.arrays, slopes, self.first, self.second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
