"""Exact tests in Arrow batches, where an expression would be interpreted term by term."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ln_factorial(n: np.ndarray) -> np.ndarray:
    """ln n! by Stirling's series after moving the argument above 10."""
    x = np.asarray(n, float) + 1
    shift = np.ceil(np.maximum(0.0, 10 - x))
    product = np.ones_like(x)
    for k in range(10):
        product *= np.where(k < shift, x + k, 1.0)
    z = x + shift
    r = 1 / (z * z)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / z - np.log(product)


def hypergeom_tails(k: np.ndarray, n_total: np.ndarray, n_term: np.ndarray, n_cluster: np.ndarray) -> np.ndarray:
    """P(X >= k), all cases side by side: each tail is summed away from the mode until its terms vanish."""
    obs, big, sub, draw = (np.asarray(a, float) for a in (k, n_total, n_term, n_cluster))
    low, high = np.maximum(0.0, sub + draw - big), np.minimum(sub, draw)
    up = obs > draw * sub / np.maximum(big, 1)
    out = np.where(obs <= low, 1.0, np.where(obs > high, 0.0, np.nan))
    todo = np.isnan(out)
    if not todo.any():
        return out
    obs, big, sub, draw, low, high, up = (a[todo] for a in (obs, big, sub, draw, low, high, up))
    i = np.where(up, obs, obs - 1)
    term = np.exp(
        ln_factorial(sub) - ln_factorial(i) - ln_factorial(sub - i) + ln_factorial(big - sub) - ln_factorial(draw - i) - ln_factorial(big - sub - draw + i)
        - ln_factorial(big) + ln_factorial(draw) + ln_factorial(big - draw)
    )
    total = np.zeros_like(term)
    while True:
        live = term > total * 1e-18
        if not live.any():
            break
        total += term
        nxt = np.where(up, (sub - i) * (draw - i) / ((i + 1) * np.maximum(big - sub - draw + i + 1, 1)), i * (big - sub - draw + i) / np.maximum((sub - i + 1) * (draw - i + 1), 1))
        i = np.where(up, i + 1, i - 1)
        term = np.where(live & (i >= low) & (i <= high), term * nxt, 0.0)
    out[todo] = np.clip(np.where(up, total, 1 - total), 0, 1)
    return out


@F.pandas_udf(T.DoubleType())
def _tails(k: pd.Series, n_total: pd.Series, n_term: pd.Series, n_cluster: pd.Series) -> pd.Series:
    return pd.Series(hypergeom_tails(k.to_numpy(), n_total.to_numpy(), n_term.to_numpy(), n_cluster.to_numpy()))


def hypergeom_tail(k: Column, n_total: Column, n_term: Column, n_cluster: Column) -> Column:
    """As ``functions.math.hypergeom_tail``, a batch at a time; no argument may be null."""
    return _tails(*(c.cast("double") for c in (k, n_total, n_term, n_cluster)))
