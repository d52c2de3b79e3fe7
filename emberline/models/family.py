"""Response families: gradient and curvature in the linear predictor, log likelihood."""

from __future__ import annotations

import numpy as np

from .special import digamma, gammaln, trigamma

FAMILIES = ("bernoulli", "binomial", "negbinomial", "gaussian")


def check_family(name: str) -> None:
    if name not in FAMILIES:
        raise ValueError(f"unknown family {name!r}; known: {FAMILIES}")


def mean(name, eta, trials):
    if name in ("bernoulli", "binomial"):
        return trials / (1.0 + np.exp(-np.clip(eta, -500, 500)))
    if name == "negbinomial":
        return np.exp(np.clip(eta, -500, 500))
    return eta


def score(name, y, eta, trials, shape):
    """(gradient, expected curvature) of the log likelihood in eta, per row."""
    mu = mean(name, eta, trials)
    if name in ("bernoulli", "binomial"):
        return y - mu, mu * (1.0 - mu / trials)
    if name == "negbinomial":
        damp = 1.0 + mu / shape
        return (y - mu) / damp, mu / damp
    return (y - mu) / shape**2, np.full_like(y, 1.0 / shape**2)


def log_lik(name, y, eta, trials, shape):
    """Log likelihood per row; ``y`` and ``trials`` may broadcast against ``eta``."""
    if name in ("bernoulli", "binomial"):
        choose = gammaln(trials + 1) - gammaln(y + 1) - gammaln(trials - y + 1)
        return choose + y * eta - trials * np.logaddexp(0.0, eta)
    if name == "negbinomial":
        log_mu = np.clip(eta, -500, 500)
        total = np.logaddexp(np.log(shape), log_mu)
        binom = gammaln(y + shape) - gammaln(shape) - gammaln(y + 1)
        return binom + shape * (np.log(shape) - total) + y * (log_mu - total)
    return -0.5 * np.log(2 * np.pi) - np.log(shape) - 0.5 * ((y - eta) / shape) ** 2


def shape_terms(name, y, eta, trials, shape):
    """Two sums the scale update needs: shape derivatives, or squared residuals."""
    if name == "negbinomial":
        mu = mean(name, eta, trials)
        total = shape + mu
        first = digamma(y + shape) - digamma(shape) + np.log(shape) + 1 - np.log(total) - (y + shape) / total
        second = trigamma(y + shape) - trigamma(shape) + 1 / shape - 2 / total + (y + shape) / total**2
        return first.sum(), second.sum()
    if name == "gaussian":
        return float(((y - eta) ** 2).sum()), 0.0
    return 0.0, 0.0
