"""Curve fitting, one small group of dose points at a time."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FIT = "curve string, top double, bottom double, log_ic50 double, slope double, low double, high double"


def logistic(u: np.ndarray, top: float, bottom: float, log_ic50: float, slope: float) -> np.ndarray:
    return bottom + (top - bottom) / (1 + 10.0 ** np.clip(slope * (u - log_ic50), -60, 60))


def fit_one(u: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """Least squares: over a grid of midpoints and slopes that halves around its best, the ends being linear."""
    mid, width, slope, spread = (u.min() + u.max()) / 2, (u.max() - u.min()) / 2 + 0.5, 0.0, 3.0
    best = (np.inf, y.max(), y.min(), mid, 1.0)
    for _ in range(14):
        for m in np.linspace(mid - width, mid + width, 9):
            for s in np.linspace(slope - spread, slope + spread, 9):
                f = 1 / (1 + 10.0 ** np.clip(s * (u - m), -60, 60))
                a = np.stack([f, 1 - f], 1)
                ends = np.linalg.lstsq(a, y, rcond=None)[0]
                loss = float(((a @ ends - y) ** 2).sum())
                if loss < best[0]:
                    best = (loss, *map(float, ends), float(m), float(s))
        mid, slope, width, spread = best[3], best[4], width * 0.5, spread * 0.5
    return best[1:]


def fit_hill(points: DataFrame, bootstraps: int = 200, seed: int = 0) -> DataFrame:
    """Four-parameter fit of each curve (curve, log_dose, y), with a bootstrap interval of log_ic50; the draws depend on the curve's name only. A flat curve has no fit."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["log_dose", "y"])
        u, y, name = rows["log_dose"].to_numpy(float), rows["y"].to_numpy(float), rows["curve"].iloc[0]
        if np.ptp(y) == 0 or len(y) < 4:
            return pd.DataFrame([[name, *[None] * 6]], columns=[c.split(" ")[0] for c in FIT.split(", ")])
        own = fit_one(u, y)
        rest = y - logistic(u, *own)
        rng = np.random.default_rng([seed, zlib.crc32(str(name).encode())])
        ic50 = [fit_one(u, logistic(u, *own) + rng.choice(rest, len(rest)))[2] for _ in range(bootstraps)]
        return pd.DataFrame([[name, *own, *np.percentile(ic50, [2.5, 97.5])]], columns=[c.split(" ")[0] for c in FIT.split(", ")])

    return points.groupBy("curve").applyInPandas(run, FIT)
