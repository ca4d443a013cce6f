"""Forecasting models of one series, in numpy: each fits on history and returns holdout and future values."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

# Exponential smoothing


def holt_winters(y: np.ndarray, horizon: int, period: int = 0, alpha: float | None = None, beta: float | None = None, gamma: float | None = None) -> np.ndarray:
    """Additive trend, and additive season where two cycles are there; smoothing by least squared one-step errors.

    Searches a coarse grid, then halves the step around the best point; a constant series takes small fixed values.
    """
    seasonal = period > 1 and len(y) >= 2 * period
    if seasonal:
        first, second = y[:period].mean(), y[period : 2 * period].mean()
        start = (first, (second - first) / period, y[:period] - first)
    else:
        start = (y[0], y[1] - y[0] if len(y) > 1 else 0.0, np.zeros(1))

    def run(a: float, b: float, g: float) -> tuple[float, float, float, np.ndarray]:
        level, trend, season, error = start[0], start[1], start[2].copy(), 0.0
        k = len(season)
        for t, v in enumerate(y):
            s = season[t % k] if seasonal else 0.0
            miss = v - (level + trend + s)
            error += miss * miss
            before = level
            level = a * (v - s) + (1 - a) * (level + trend)
            trend = b * (level - before) + (1 - b) * trend
            if seasonal:
                season[t % k] = g * (v - level) + (1 - g) * s
        return error, level, trend, season

    if alpha is None:
        if y.std() < 1e-8:
            alpha, beta, gamma = 0.1, 0.01, 0.01
        else:
            grid = [(a, b, g) for a in (0.1, 0.4, 0.8) for b in (0.02, 0.2) for g in ((0.05, 0.3) if seasonal else (0.0,))]
            best = min(grid, key=lambda p: run(*p)[0])
            step = 0.2
            while step > 0.02:
                moves = [tuple(float(np.clip(v + (d if i == j else 0), 0.001, 0.999)) for i, v in enumerate(best)) for j in range(3 if seasonal else 2) for d in (-step, step)]
                near = min([best, *moves], key=lambda p: run(*p)[0])
                best, step = (near, step) if near != best else (best, step / 2)
            alpha, beta, gamma = best
    _, level, trend, season = run(alpha, beta, gamma or 0.0)
    ahead = np.arange(1, horizon + 1)
    return level + trend * ahead + (season[(len(y) + ahead - 1) % len(season)] if seasonal else 0.0)


# ARIMA(1, d, 1) by conditional sum of squares


def arima(y: np.ndarray, horizon: int, d: int = 1, exog: np.ndarray | None = None) -> np.ndarray:
    """ARIMA(1, d, 1); exogenous columns enter by regression first, with zeros ahead."""
    base = np.zeros(len(y))
    if exog is not None and exog.shape[1]:
        x = np.column_stack((np.ones(len(y)), exog))
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        base = x[:, 1:] @ beta[1:]
    z, tails = y - base, []
    for _ in range(d):
        tails.append(z[-1])
        z = np.diff(z)
    mean = z.mean() if d == 0 else 0.0
    z = z - mean

    def errors(phi: float, theta: float) -> np.ndarray:
        e = np.zeros(len(z))
        for t in range(1, len(z)):
            e[t] = z[t] - phi * z[t - 1] - theta * e[t - 1]
        return e

    best, step = (0.1, 0.1), 0.4
    cost = lambda p: float((errors(*p) ** 2).sum())
    while step > 0.01:
        moves = [(float(np.clip(best[0] + a, -0.98, 0.98)), float(np.clip(best[1] + b, -0.98, 0.98))) for a, b in ((step, 0), (-step, 0), (0, step), (0, -step))]
        near = min([best, *moves], key=cost)
        best, step = (near, step) if near != best else (best, step / 2)
    phi, theta = best
    last, shock = z[-1], errors(phi, theta)[-1]
    out = []
    for _ in range(horizon):
        last = phi * last + theta * shock
        shock = 0.0
        out.append(last + mean)
    ahead = np.array(out)
    for tail in reversed(tails):
        ahead = tail + np.cumsum(ahead)
    return ahead


# Feature-based models


def lag_matrix(y: np.ndarray, lags: list[int], rolling: tuple[int, ...] = ()) -> np.ndarray:
    """Lags and trailing rolling mean and std of each row; NaN where history is short."""
    n = len(y)
    cols = [np.concatenate((np.full(k, np.nan), y[: n - k])) for k in lags]
    for w in rolling:
        mean, std = np.full(n, np.nan), np.full(n, np.nan)
        if n > w:
            view = np.lib.stride_tricks.sliding_window_view(y[:-1], w)
            mean[w:], std[w:] = view.mean(axis=1), view.std(axis=1, ddof=1)
        cols += [mean, std]
    return np.column_stack(cols)


def basis(x: np.ndarray, order: int, family: str) -> np.ndarray:
    """Bias and functional expansion of normed columns: powers, sines and cosines, both, or orthogonal polynomials."""
    blocks = [np.ones((len(x), 1))]
    if family in ("polynomial", "mixed"):
        blocks += [x**k for k in range(1, order + 1)]
    if family in ("trigonometric", "mixed"):
        blocks += [f(k * np.pi * x) for k in range(1, order + 1) for f in (np.sin, np.cos)]
    if family in ("chebyshev", "legendre"):
        inside = np.clip(x, -1, 1)
        vander = np.polynomial.chebyshev.chebvander if family == "chebyshev" else np.polynomial.legendre.legvander
        blocks += [vander(inside[:, j], order)[:, 1:] for j in range(x.shape[1])]
    if len(blocks) == 1:
        raise ValueError(f"unknown basis {family!r}")
    return np.hstack(blocks)


ACTIVATIONS = {"sigmoid": lambda a: 1 / (1 + np.exp(-np.clip(a, -30, 30))), "relu": lambda a: np.maximum(a, 0), "tanh": np.tanh, "sin": np.sin}


@dataclass
class ExpansionModel:
    """Functional-link models: plain, with recurrent inputs, or with random hidden units and direct links.

    The first column of the design is left out of the ridge penalty; for the random variant that is the first
    feature, and the bias is penalised: kept, as results depend on it.
    """

    variant: str = "flann"
    family: str = "mixed"
    order: int = 3
    ridge: float = 1e-2
    depth: int = 1
    hidden: int = 64
    activation: str = "sigmoid"
    seed: int = 42
    _fit: dict = field(default_factory=dict)

    def _normed(self, x: np.ndarray) -> np.ndarray:
        spread = self._fit["spread"]
        return np.clip((x - self._fit["centre"]) / np.where(np.abs(spread) < 1e-8, 1.0, spread), -4, 4)

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = self._normed(x)
        if self.variant != "rvfl":
            return basis(z, self.order, self.family)
        if "w" not in self._fit:
            rng, d = np.random.default_rng(self.seed), z.shape[1]
            limit = np.sqrt(6 / (d + self.hidden))
            self._fit["w"] = rng.uniform(-limit, limit, (d, self.hidden))
            self._fit["b"] = rng.uniform(-limit, limit, self.hidden)
        return np.hstack((z, ACTIVATIONS[self.activation](z @ self._fit["w"] + self._fit["b"]), np.ones((len(z), 1))))

    def fit(self, x: np.ndarray, y: np.ndarray) -> ExpansionModel:
        if self.variant == "recurrent_flann":  # teacher forcing: what was observed stands in for past output
            x = np.hstack((x, np.column_stack([np.concatenate((np.zeros(min(k, len(y))), y[: len(y) - k])) for k in range(1, self.depth + 1)])))
        self._fit = {"centre": x.mean(axis=0), "spread": x.std(axis=0)}
        z = self._design(x)
        penalty = self.ridge * np.eye(z.shape[1])
        penalty[0, 0] = 0
        self._fit["beta"] = np.linalg.lstsq(z.T @ z + penalty, z.T @ y, rcond=None)[0]
        return self

    def predict(self, x: np.ndarray, past: np.ndarray | None = None) -> np.ndarray:
        if self.variant == "recurrent_flann":
            x = np.hstack((x, np.zeros((len(x), self.depth)) if past is None else past))
        return self._design(x) @ self._fit["beta"]

    def ahead(self, row: np.ndarray, horizon: int, lag_columns: list[int]) -> np.ndarray:
        """Iterated forecast from the last row's features: lag columns shift by rank, others keep their values."""
        row, past, out = row.copy(), np.zeros((1, self.depth)), []
        for _ in range(horizon):
            out.append(float(self.predict(row, past)[0]))
            past = np.hstack(([[out[-1]]], past[:, :-1]))
            held = row[0, lag_columns].copy()
            row[0, lag_columns] = np.concatenate(([out[-1]], held[:-1]))
        return np.array(out)


def expansion(y: np.ndarray, holdout: int, horizon: int, period: int, exog: np.ndarray | None = None, **options) -> tuple[np.ndarray, np.ndarray] | None:
    """Fit an ExpansionModel on lags 1 to 3 and around the period, rolling 3 and 7, exogenous columns."""
    lags = sorted({1, 2, 3} | ({period, period + 1} if period > 1 else set()))
    lags = [k for k in lags if k < len(y)]
    rolling = tuple(w for w, least in ((3, 4), (7, 8)) if len(y) >= least)
    x = lag_matrix(y, lags, rolling)
    if exog is not None:
        x = np.column_stack((x, exog))
    whole = ~np.isnan(x).any(axis=1)
    train, test = whole & (np.arange(len(y)) < len(y) - holdout), whole & (np.arange(len(y)) >= len(y) - holdout)
    if whole.sum() < 8 or train.sum() < 5 or not test.any():
        return None
    model = ExpansionModel(**options).fit(x[train], y[train])
    return model.predict(x[test]), model.ahead(x[whole][-1:], horizon, list(range(len(lags))))


def croston(y: np.ndarray, horizon: int, variant: str, alpha: float = 0.1, beta: float = 0.1) -> np.ndarray | None:
    hits = np.flatnonzero(y > 0)
    if not len(hits):
        return np.zeros(horizon)
    if variant == "tsb":
        z, p = y[hits[0]], len(hits) / len(y)
        for v in y:
            z = z + alpha * (v - z) if v > 0 else z
            p += beta * ((v > 0) - p)
        return np.full(horizon, max(0.0, z * p))
    z, p = y[hits[0]], max(1.0, hits[0] + 1.0)
    for gap, at in zip(np.diff(hits), hits[1:]):
        z, p = z + alpha * (y[at] - z), p + alpha * (gap - p)
    return np.full(horizon, max(0.0, z / p * (1 - alpha / 2 if variant == "sba" else 1)))


def run_models(y: np.ndarray, holdout: int, horizon: int, period: int, d: int, wanted: list[str], exog: np.ndarray | None = None, **options) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Holdout and future values of each model that can be fitted; in registration order."""
    train = y[: len(y) - holdout]
    both = {
        "Croston": lambda: tuple(croston(part, n, "croston") for part, n in ((train, holdout), (y, horizon))),
        "SBA": lambda: tuple(croston(part, n, "sba") for part, n in ((train, holdout), (y, horizon))),
        "TSB": lambda: tuple(croston(part, n, "tsb") for part, n in ((train, holdout), (y, horizon))),
        "ETS": lambda: tuple(holt_winters(part, n, period) for part, n in ((train, holdout), (y, horizon))),
        "ARIMA": lambda: tuple(arima(part, n, d) for part, n in ((train, holdout), (y, horizon))),
        "ARIMAX": lambda: (arima(train, holdout, d, exog[: len(train)]), arima(y, horizon, d, exog)) if exog is not None else None,
        "FLANN": lambda: expansion(y, holdout, horizon, period, exog, variant="flann", **options),
        "RecurrentFLANN": lambda: expansion(y, holdout, horizon, period, exog, variant="recurrent_flann", **options),
        "RVFL": lambda: expansion(y, holdout, horizon, period, exog, variant="rvfl", **options),
    }
    unknown = set(wanted) - set(both)
    if unknown:
        raise ValueError(f"unknown models {sorted(unknown)}")
    out = {}
    for name in both:
        if name in wanted and len(train) >= 4:
            made = both[name]()
            if made is not None and len(made[0]) == holdout and all(np.isfinite(m).all() for m in made):
                out[name] = made
    return out
