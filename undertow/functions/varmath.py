"""k x k algebra of a vector autoregression, from moment matrices alone."""

from __future__ import annotations

import numpy as np

from undertow.operators.moments import ols


def select_order(part, k: int, p_max: int, criterion: str = "bic") -> int:
    """Order with the smallest criterion on the common sample; design is [1, lags 1..p_max, y], ``part`` its (n, means, moments)."""
    n = part[0]
    ys = list(range(1 + k * p_max, 1 + k * p_max + k))
    best, best_value = 0, np.inf
    for p in range(0, p_max + 1):
        free = n - k * p - 1
        if free <= 0:
            break
        _, rest = ols(part, range(0, 1 + k * p), ys)
        sign, logdet = np.linalg.slogdet(rest / n)
        if sign <= 0:
            continue
        m = p * k * k + k
        value = {
            "bic": logdet + m * np.log(n) / n,
            "aic": logdet + 2 * m / n,
            "hqic": logdet + 2 * m * np.log(np.log(n)) / n,
            "fpe": k * np.log((n + k * p + 1) / free) + logdet,
        }[criterion]
        if value < best_value:
            best, best_value = p, value
    return best


def fit(part, k: int, p: int, p_max: int):
    """Intercept, lag matrices (p, k, k) and residual covariance with adjusted degrees of freedom."""
    ys = list(range(1 + k * p_max, 1 + k * p_max + k))
    free = part[0] - k * p - 1
    if free <= 0:
        raise np.linalg.LinAlgError("too few rows for the order")
    beta, rest = ols(part, range(0, 1 + k * p), ys)
    lags = np.stack([beta[1 + k * i : 1 + k * (i + 1)].T for i in range(p)])
    return beta[0], lags, rest / free


def companion_radius(lags: np.ndarray) -> float:
    """Largest modulus of the companion eigenvalues; below 1 means stable."""
    p, k, _ = lags.shape
    top = np.concatenate(list(lags), axis=1)
    companion = np.vstack([top, np.eye(k * (p - 1), k * p)])
    return float(np.abs(np.linalg.eigvals(companion)).max())


def moving_average(lags: np.ndarray, horizon: int) -> np.ndarray:
    """Phi_0 .. Phi_{horizon-1}."""
    p, k, _ = lags.shape
    phi = np.zeros((horizon, k, k))
    phi[0] = np.eye(k)
    for h in range(1, horizon):
        phi[h] = sum(lags[i] @ phi[h - 1 - i] for i in range(min(p, h)))
    return phi


def decompose(phi: np.ndarray, sigma: np.ndarray, method: str = "cholesky") -> np.ndarray:
    """Row-normalised variance shares per horizon: theta[h, to, from]."""
    if method in ("cholesky", "recursive"):
        impact = phi @ np.linalg.cholesky(sigma)
    elif method == "generalized":
        impact = phi @ sigma / np.sqrt(np.diag(sigma))
    else:
        raise ValueError(f"unknown identification {method}")
    part = np.cumsum(impact**2, axis=0)
    return part / part.sum(axis=2, keepdims=True)
