"""Logistic regression in numpy, for models of few features."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights, the bias last, by Newton's method on the ridge-penalised likelihood."""
    design = np.column_stack([x, np.ones(len(x))])
    weights = np.zeros(design.shape[1])
    penalty = np.full(design.shape[1], ridge * max(len(x), 1))
    penalty[-1] = 1e-9
    for _ in range(rounds):
        p = sigmoid(design @ weights)
        gradient = design.T @ (y - p) - penalty * weights
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        # Newton steps of separable data would run away.
        step *= min(1, 4 / max(np.abs(step).max(), 1e-12))
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights
