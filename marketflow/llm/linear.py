"""Small linear models in numpy, fitted on the driver on samples of bounded size."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Adam:
    """Full-batch steps of a fixed size; the same data give the same weights."""

    def __init__(self, shape, rate: float = 0.05):
        self.w, self.m, self.v, self.t, self.rate = np.zeros(shape, np.float32), 0.0, 0.0, 0, rate

    def step(self, gradient: np.ndarray) -> None:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        self.w = (self.w - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 150, penalty: float = 1e-4) -> np.ndarray:
    """Weights of logistic regressions, a column for each column of y (0 or 1); weight: of each row and column, sums to 1."""
    fit = Adam((x.shape[1], y.shape[1]))
    for _ in range(steps):
        fit.step(x.T @ ((sigmoid(x @ fit.w) - y) * weight) + penalty * fit.w)
    return fit.w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from the scores of a positive-against-unlabelled model on rows that it
    was not fitted on: the least ratio of the shares above a threshold, with a bound on its error added."""
    p, u = np.sort(positive), np.sort(unlabelled)
    cuts = np.quantile(p, np.linspace(0.05, 0.9, 60))
    above_p = 1 - np.searchsorted(p, cuts) / len(p)
    above_u = 1 - np.searchsorted(u, cuts) / len(u)
    # the bound by which both empirical shares hold at once with 90 %
    slack = np.sqrt(np.log(40) / 2) * (np.sqrt(1 / len(p)) + np.sqrt(1 / len(u)))
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def non_negative_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, penalty: float = 1e-4) -> np.ndarray:
    """Weights that minimise prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) with logistic loss.

    Where the second term is below 0, its gradient is reversed, so it is driven back to 0.
    """
    fit = Adam(positive.shape[1])
    for _ in range(steps):
        zp, zu = positive @ fit.w, unlabelled @ fit.w
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_positive = positive.T @ (-(1 - sigmoid(zp)) / len(zp))
        g_negative = unlabelled.T @ (sigmoid(zu) / len(zu)) - prior * (positive.T @ (sigmoid(zp) / len(zp)))
        gradient = prior * g_positive + g_negative if negative >= 0 else -g_negative
        fit.step(gradient + penalty * fit.w)
    return fit.w
