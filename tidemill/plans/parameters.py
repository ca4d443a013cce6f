"""Parameter suggestions for forecasting models, from what is known of a series."""

from __future__ import annotations


def folds(n: int, horizon: int) -> int:
    """Cross-validation folds that a series of ``n`` values can bear at a horizon."""
    return min(5, max(2, n // (3 * max(1, horizon))))


def suggest(n: int, horizon: int, period: int, differencing: int = 0, trend: float = 0.0, seasonal: float = 0.0, has_zero: bool = False, lags: list[int] | None = None) -> dict[str, dict]:
    """Starting parameters by model family; trend and seasonal are strengths between 0 and 1."""
    cyclic = period > 1 and n >= 2 * period and seasonal > 0.3
    season = ("mul" if not has_zero and seasonal > 0.6 else "add") if cyclic else None
    return {
        "arima": {"order": (1, differencing, 1), "seasonal_order": (1, int(seasonal > 0.6), 1, period) if cyclic else None},
        "ets": {"trend": "add" if trend > 0.3 else None, "damped": trend > 0.6 and horizon > period, "seasonal": season, "period": period if cyclic else None},
        "croston": {"alpha": 0.1, "beta": 0.1, "variant": "sba"},
        "lightgbm": {"lags": lags or [1, 2, 3, *([period] if period > 3 else [])], "leaves": 31 if n > 500 else 15, "rounds": min(800, max(100, n)), "rate": 0.05},
        "tbats": {"periods": [period] if cyclic else [], "trend": trend > 0.3, "boxcox": not has_zero},
        "flann": {"variant": "flann", "family": "mixed", "order": 3 if n > 100 else 2, "ridge": 1e-2, "depth": 1},
        "rvfl": {"variant": "rvfl", "hidden": min(64, max(8, n // 4)), "activation": "sigmoid", "ridge": 1e-2},
        "validation": {"folds": folds(n, horizon), "horizon": horizon},
    }
