"""Per-ticker logistic model, its holdout and the walk-forward evaluation.

Fits run in a grouped map: a ticker's feature matrix goes to its worker once, and one task makes
the fits of one (ticker, horizon).  The fit is Newton's method on the ridge-penalised likelihood of
population-standardised features, the objective of a logistic regression with C = 0.5.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.config import FEATURES, HOLDOUT_DAYS, MIN_TRAIN, PRIOR_WEIGHTS, RIDGE_C, WALK_FORWARD
from barline.operators import indicators as ind
from barline.operators import signals

COLUMNS = [f"f_{k}" for k in FEATURES]


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float = RIDGE_C, steps: int = 50, tol: float = 1e-10):
    """(mean, scale, weights with the free intercept last), or None for one class."""
    if len(y) == 0 or y.min() == y.max():
        return None
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1.0
    z = np.column_stack([(x - mean) / scale, np.ones(len(y))])
    ridge = np.full(z.shape[1], 1.0)
    ridge[-1] = 0.0
    w = np.zeros(z.shape[1])

    def loss(v):
        m = z @ v
        return c * (np.logaddexp(0, m) - y * m).sum() + 0.5 * (ridge * v * v).sum()

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        g = c * z.T @ (p - y) + ridge * w
        h = c * (z.T * np.maximum(p * (1 - p), 1e-12)) @ z + np.diag(ridge)
        step, t = np.linalg.solve(h, g), 1.0
        while (new := loss(w - t * step)) > now + 1e-12 and t > 1e-6:
            t /= 2
        w, now = w - t * step, new
        if np.abs(t * step).max() < tol:
            break
    return mean, scale, w


def predict(model, x: np.ndarray) -> np.ndarray:
    mean, scale, w = model
    return 1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ w[:-1] + w[-1], -35, 35)))


def _logit(p):
    p = np.clip(p, 0.03, 0.97)
    return np.log(p / (1 - p))


def blend(base, tech, p_ml=None, weights=PRIOR_WEIGHTS):
    x = _logit(base) + weights["tech"] * tech
    if p_ml is not None:
        x = x + weights["k_ml"] * (_logit(p_ml) - _logit(base))
    return 1 / (1 + np.exp(-x))


def scored(bars: DataFrame) -> DataFrame:
    """Sessions with features, complete and tech, all that the fits need."""
    return ind.features(signals.signals(ind.indicators(bars))).select("ticker", "dt", "i", "n", "close", "tech", "complete", *COLUMNS)


def base_rates(close: np.ndarray, h: int) -> np.ndarray:
    out = np.full(len(close), np.nan)
    if len(close) > h:
        up = np.cumsum(close[h:] > close[:-h])
        i = np.arange(h + 29, len(close))
        out[i] = up[i - h] / (i - h + 1)
    return out


def points(sessions: DataFrame, h: int, most: int, stride: int) -> DataFrame:
    """Prediction points: from the last resolvable session back in strides, at most ``most``."""
    back = F.col("n") - 1 - h - F.col("i")
    return sessions.where((back >= 0) & (back % stride == 0) & (back / stride < most))


WALKED = "ticker string, horizon string, h int, dt date, p_up double, p_ml double, base double, tech double, outcome_up boolean, fwd_return double, correct boolean, correct_ml boolean, variant string"


def walk_forward(bars: DataFrame, horizons=WALK_FORWARD) -> DataFrame:
    """Out-of-sample predictions; each model is trained on outcomes resolved by its session only."""
    plan = bars.sparkSession.createDataFrame(list(horizons), "horizon string, h int, most int, stride int")
    tasks = scored(bars).crossJoin(F.broadcast(plan))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        label, h, most, stride = pdf.iloc[0][["horizon", "h", "most", "stride"]]
        x, close, whole, tech = pdf[COLUMNS].to_numpy(float), pdf["close"].to_numpy(float), pdf["complete"].to_numpy(bool), pdf["tech"].to_numpy(float)
        base_at, ml, rows = base_rates(close, h), whole.sum() >= MIN_TRAIN + 60, []
        for i in sorted(range(len(close) - 1 - h, -1, -stride)[:most]):
            p_ml = None
            if ml:
                j = np.nonzero(whole[: max(0, i - h + 1)])[0]
                if not whole[i] or len(j) < MIN_TRAIN:
                    continue
                model = fit_logistic(x[j], (close[j + h] > close[j]).astype(float))
                p_ml = float(predict(model, x[i : i + 1])[0]) if model else None
            base = base_at[i] if np.isfinite(base_at[i]) else 0.5
            p = float(np.clip(blend(base, tech[i], p_ml), 0.05, 0.95))
            up = bool(close[i + h] > close[i])
            rows.append((pdf["ticker"].iloc[0], label, int(h), pdf["dt"].iloc[i], round(p, 4), None if p_ml is None else round(p_ml, 4), round(float(base), 4), round(float(tech[i]), 3), up, round(float(close[i + h] / close[i] - 1), 5), (p >= 0.5) == up, None if p_ml is None else (p_ml >= 0.5) == up, "ml+tech" if ml else "drift+tech"))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in WALKED.split(", ")])

    return tasks.groupBy("ticker", "h").applyInPandas(run, WALKED)


HELD = "ticker string, base double, p_ml double, hit_rate double, baseline double, holdout_days int, effective_n int, train_rows int"


def price_model(bars: DataFrame, h: int = 5, embargo: bool = False) -> DataFrame:
    """Per ticker base, p_ml of the last session and the holdout of the blended output.

    With ``embargo`` the last h training labels before the holdout are left out; without it they
    reach into the holdout, as in the surveyed live path.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        x, close, whole, tech = pdf[COLUMNS].to_numpy(float), pdf["close"].to_numpy(float), pdf["complete"].to_numpy(bool), pdf["tech"].to_numpy(float)
        base_at = base_rates(close, h)
        base = float(base_at[-1]) if np.isfinite(base_at[-1]) else 0.5
        row = dict(ticker=pdf["ticker"].iloc[0], base=round(base, 3), p_ml=None, hit_rate=None, baseline=None, holdout_days=None, effective_n=None, train_rows=None)
        j = np.nonzero(whole[: max(0, len(close) - h)])[0]
        if len(j) >= MIN_TRAIN + 20 and whole[-1]:
            y = (close[j + h] > close[j]).astype(float)
            k = min(max(HOLDOUT_DAYS, 12 * h), len(j) // 3)
            train = j[:-k][j[:-k] + h <= j[-k]] if embargo else j[:-k]
            model = fit_logistic(x[train], y[: len(train)])
            p_ml = predict(model, x[j[-k:]]) if model else None
            b = np.where(np.isfinite(base_at[j[-k:]]), base_at[j[-k:]], 0.5)
            p = blend(b, tech[j[-k:]], p_ml)
            row.update(hit_rate=round(float(((p >= 0.5) == (y[-k:] > 0.5)).mean()), 3), baseline=round(float(y[-k:].mean()), 3), holdout_days=k, effective_n=max(1, k // h), train_rows=len(train))
            live = fit_logistic(x[j], y)
            row["p_ml"] = round(float(predict(live, x[-1:])[0]), 4) if live else None
        return pd.DataFrame([row])

    return scored(bars).groupBy("ticker").applyInPandas(run, HELD)
