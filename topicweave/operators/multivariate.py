"""Factor structure of an indicator matrix (M4-M8, M26), numpy on a few hundred topics at most; p-values by series.

The matrix has one row per topic and one column per indicator: it is aggregated by Spark before, and its size is checked.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Rows that are accepted on the driver.
MAX_ROWS = 100_000


def matrix(df: DataFrame, columns: list[str], least_sd: float = 0.01) -> tuple[list[str], np.ndarray]:
    """(columns that vary, complete rows) of a topic table; refuses a table that is no topic table."""
    rows = df.select(*columns).limit(MAX_ROWS + 1).toPandas().dropna()
    if len(rows) > MAX_ROWS:
        raise ValueError("the matrix has a row per topic, not per record")
    kept = [c for c in columns if rows[c].std() >= least_sd]
    return kept, rows[kept].to_numpy(float)


def correlation(x: np.ndarray) -> np.ndarray:
    return np.corrcoef(x, rowvar=False)


def anti_image(r: np.ndarray) -> np.ndarray:
    inv = np.linalg.pinv(r)
    d = np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
    return -inv / d


def kmo(r: np.ndarray) -> float:
    """M5: Kaiser-Meyer-Olkin measure: squared correlations against squared partial correlations off the diagonal."""
    off = ~np.eye(len(r), dtype=bool)
    a, b = (r[off] ** 2).sum(), (anti_image(r)[off] ** 2).sum()
    return float(a / (a + b))


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-15:
                break
        return 1 - total * scale
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def bartlett(r: np.ndarray, n: int) -> tuple[float, int, float]:
    """M5: (χ², degrees of freedom, p) of the test that the correlations are those of independent columns."""
    p = len(r)
    chi = -(n - 1 - (2 * p + 5) / 6) * np.linalg.slogdet(r)[1]
    df = p * (p - 1) // 2
    return float(chi), df, gamma_q(df / 2, chi / 2)


def smc(r: np.ndarray) -> np.ndarray:
    """M5: squared multiple correlations."""
    return np.clip(1 - 1 / np.diag(np.linalg.pinv(r)), 0, 1)


def common_eigenvalues(r: np.ndarray) -> np.ndarray:
    """M5: eigenvalues of the correlations with squared multiple correlations on the diagonal, descending."""
    m = r.copy()
    np.fill_diagonal(m, smc(r))
    return np.linalg.eigvalsh(m)[::-1]


def parallel_analysis(x: np.ndarray, reps: int = 200, seed: int = 42) -> tuple[np.ndarray, np.ndarray, int]:
    """M6: (observed eigenvalues, 95th percentiles of random data, how many in a row exceed them)."""
    rng = np.random.default_rng(seed)
    obs = common_eigenvalues(correlation(x))
    null = np.array([common_eigenvalues(correlation(rng.standard_normal(x.shape))) for _ in range(reps)])
    p95 = np.percentile(null, 95, axis=0)
    over = obs > p95
    return obs, p95, len(obs) if over.all() else int(np.argmin(over))


def principal_axis(r: np.ndarray, k: int, rounds: int = 500) -> np.ndarray:
    """M4: unrotated loadings of k common factors, iterated from squared multiple correlations (a substitute for minimum residuals)."""
    h = smc(r)
    for _ in range(rounds):
        m = r.copy()
        np.fill_diagonal(m, h)
        w, v = np.linalg.eigh(m)
        load = v[:, ::-1][:, :k] * np.sqrt(np.clip(w[::-1][:k], 0, None))
        new = np.clip((load**2).sum(axis=1), 0, 1)
        if np.abs(new - h).max() < 1e-8:
            break
        h = new
    return load


def oblimin(load: np.ndarray, rounds: int = 500, step: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """M4: (pattern, factor correlations) of a direct quartimin rotation by projected gradients.

    The pattern times the correlations times the pattern keeps the communalities of the unrotated loadings.
    """
    k = load.shape[1]
    t = np.eye(k)
    f = lambda a: (((a**2).T @ (a**2))[~np.eye(k, dtype=bool)]).sum() / 4
    for _ in range(rounds):
        inv = np.linalg.inv(t)
        a = load @ inv.T
        grad_a = a * ((a**2) @ (1 - np.eye(k)))
        g = -(a.T @ grad_a @ inv).T
        gp = g - t * (t * g).sum(axis=0)
        if np.linalg.norm(gp) < 1e-7:
            break
        now = f(a)
        while step > 1e-10:
            x = t - step * gp
            x /= np.linalg.norm(x, axis=0)
            if f(load @ np.linalg.inv(x).T) < now:
                break
            step /= 2
        t, step = x, step * 2
    return load @ np.linalg.inv(t).T, t.T @ t


def pca(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """M7: (explained variance shares, components as columns) of standardised columns."""
    w, v = np.linalg.eigh(correlation(x))
    return w[::-1] / w.sum(), v[:, ::-1]


def theory_coherence(pattern: np.ndarray, columns: list[str], dimensions: dict[str, list[str]]) -> pd.DataFrame:
    """M8: per dimension the share of its indicators whose strongest factor is the dimension's most common one."""
    strongest = dict(zip(columns, np.abs(pattern).argmax(axis=1), strict=True))
    rows = []
    for d, members in dimensions.items():
        f = [strongest[m] for m in members if m in strongest]
        share = max(map(f.count, f)) / len(f) if f else None
        rows.append((d, len(f), share, None if share is None else "coherent" if share >= 2 / 3 else "partial" if share >= 0.5 else "split"))
    return pd.DataFrame(rows, columns=["dimension", "indicators", "share", "verdict"])


def own_shares(r: np.ndarray) -> np.ndarray:
    """Share of each column's variance that no other column explains, 1 / diag(R⁻¹)."""
    return 1 / np.diag(np.linalg.pinv(r))


def effective_number(r: np.ndarray) -> float:
    """(Σλ)² / Σλ² of the eigenvalues."""
    w = np.linalg.eigvalsh(r)
    return float(w.sum() ** 2 / (w**2).sum())


def student_p(rho: float, n: int) -> float:
    """Two-sided p-value of a correlation by Student's t, through the incomplete beta function."""
    from topicweave.operators.candidates import beta_cdf

    if n < 3 or abs(rho) >= 1:
        return 0.0 if n >= 3 else 1.0
    t2 = rho**2 * (n - 2) / (1 - rho**2)
    return beta_cdf((n - 2) / (n - 2 + t2), (n - 2) / 2, 0.5)
