"""Ordered probit with two cut points, by Newton steps whose sums are taken in Spark."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_cdf = np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))


@dataclass
class Fit:
    columns: list[str]
    beta: np.ndarray
    cuts: np.ndarray
    covariance: np.ndarray
    llf: float
    n: int

    @property
    def aic(self) -> float:
        return 2 * (len(self.beta) + 2) - 2 * self.llf

    def probabilities(self, row: dict[str, float]) -> tuple[float, float, float]:
        e = sum(b * row[c] for b, c in zip(self.beta, self.columns, strict=True))
        low, high = _cdf(self.cuts[0] - e), _cdf(self.cuts[1] - e)
        return float(low), float(high - low), float(1 - high)


def _sums(x: np.ndarray, y: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and Hessian over rows; theta: beta, then two cut points; y: 0, 1, 2."""
    k = x.shape[1]
    e = x @ theta[:k]
    cuts = np.concatenate(([-np.inf], theta[k:], [np.inf]))
    a, b = cuts[y] - e, cuts[y + 1] - e
    pdf = lambda v: np.where(np.isfinite(v), np.exp(-0.5 * np.where(np.isfinite(v), v, 0) ** 2) / math.sqrt(2 * math.pi), 0.0)
    cdf = lambda v: np.where(v == np.inf, 1.0, np.where(v == -np.inf, 0.0, _cdf(np.where(np.isfinite(v), v, 0.0))))
    p = np.maximum(cdf(b) - cdf(a), 1e-300)
    # d(a), d(b) by theta: -x for beta, one for the cut in question.
    da, db = (np.concatenate((-x, np.stack((y == i, y == j), 1)), 1) for i, j in ((1, 2), (0, 1)))
    fa, fb = pdf(a)[:, None], pdf(b)[:, None]
    g = (fb * db - fa * da) / p[:, None]
    curve = lambda v, f, d: (-(np.where(np.isfinite(v), v, 0) * f[:, 0] / p))[:, None, None] * d[:, :, None] * d[:, None, :]
    h = curve(b, fb, db) - curve(a, fa, da) - g[:, :, None] * g[:, None, :]
    return float(np.log(p).sum()), g.sum(0), h.sum(0)


def fit(df: DataFrame, y: str, columns: list[str], rounds: int = 60) -> Fit:
    """Maximum likelihood for y in (-1, 0, 1). Each round sends back one row of sums a partition. Rows with nulls take no part."""
    data = df.select(y, *columns).na.drop().cache()
    k, names = len(columns), [y, *columns]
    counts = {int(r[0]): r[1] for r in data.groupBy(y).count().collect()}
    n = sum(counts.values())
    inverse = lambda q: _bisect(q)
    share = np.cumsum([counts.get(v, 0) for v in (-1, 0)]) / max(n, 1)
    theta = np.concatenate((np.zeros(k), [inverse(min(max(s, 1e-4), 1 - 1e-4)) for s in share]))
    theta[k + 1] = max(theta[k + 1], theta[k] + 1e-3)

    def total(t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def part(batches):
            out = None
            for pdf in batches:
                if len(pdf):
                    s = _sums(pdf[names[1:]].to_numpy(float), pdf[names[0]].to_numpy(int) + 1, t)
                    out = s if out is None else tuple(u + v for u, v in zip(out, s, strict=True))
            if out is not None:
                yield pd.DataFrame({"v": [[out[0], *out[1], *out[2].ravel()]]})

        rows = [np.array(r.v) for r in data.mapInPandas(part, "v array<double>").collect()]
        s = sum(rows, np.zeros(1 + (k + 2) + (k + 2) ** 2))
        return float(s[0]), s[1 : k + 3], s[k + 3 :].reshape(k + 2, k + 2)

    ll, g, h = total(theta)
    for _ in range(rounds):
        step = np.linalg.solve(h - 1e-9 * np.eye(k + 2), -g)
        scale = 1.0
        while scale > 1e-6:
            new = theta + scale * step
            if new[k] < new[k + 1] and (got := total(new))[0] >= ll - 1e-12:
                break
            scale /= 2
        else:
            break
        done = abs(got[0] - ll) < 1e-10
        theta, (ll, g, h) = new, got
        if done:
            break
    data.unpersist()
    return Fit(columns, theta[:k], theta[k:], np.linalg.inv(-h), ll, n)


def _bisect(q: float) -> float:
    low, high = -10.0, 10.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _cdf(mid) < q else (low, mid)
    return (low + high) / 2


def null_loglik(df: DataFrame, y: str) -> float:
    counts = [r[1] for r in df.groupBy(y).count().collect()]
    return sum(c * math.log(c / sum(counts)) for c in counts)


def test_variable(df: DataFrame, y: str, variable: str, controls: list[str]) -> dict:
    """Does a standardised variable help beyond controls: coefficient, likelihood-ratio test, AIC, pseudo R2."""
    sample = df.na.drop(subset=[*controls, variable, y])
    mean, sd = sample.agg(F.avg(variable), F.stddev_pop(variable)).first()
    z = f"{variable}_z"
    sample = sample.withColumn(z, (F.col(variable) - mean) / sd)
    base, full, ll0 = fit(sample, y, controls), fit(sample, y, [*controls, z]), null_loglik(sample, y)
    lr = 2 * (full.llf - base.llf)
    coef, se = float(full.beta[-1]), math.sqrt(full.covariance[len(controls), len(controls)])
    return {
        "n": full.n, "coef": coef, "se": se, "p_coef": math.erfc(abs(coef / se) / math.sqrt(2)), "lr": lr, "p_lr": math.erfc(math.sqrt(max(lr, 0) / 2)),
        "aic_base": base.aic, "aic_full": full.aic, "r2_base": 1 - base.llf / ll0, "r2_full": 1 - full.llf / ll0, "oos_gain": out_of_sample_gain(sample, y, controls, z), "fit": full, "sample": sample, "z": z,
    }


def out_of_sample_gain(df: DataFrame, y: str, base: list[str], variable: str, split_year: int = 2018) -> float | None:
    """Mean gain in log-likelihood after the split year from adding the variable; None with under 15 later rows or without all three outcomes before."""
    train, later = df.where(F.col("year") <= split_year), df.where(F.col("year") > split_year)
    if later.count() < 15 or train.select(y).distinct().count() < 3:
        return None
    mean = []
    for columns in (base, [*base, variable]):
        f = fit(train, y, columns)

        def gains(frames, f=f):
            for rows in frames:
                logs = [math.log(max(f.probabilities(r)[int(r[y]) + 1], 1e-9)) for r in rows.to_dict("records")]
                yield pd.DataFrame({"total": [float(sum(logs))], "n": [len(logs)]})

        total, n = later.select(*(F.col(k).cast("double").alias(k) for k in (y, *columns))).mapInPandas(gains, "total double, n long").agg(F.sum("total"), F.sum("n")).first()
        mean.append(total / n)
    return mean[1] - mean[0]


def scenarios(result: dict, controls: list[str]) -> dict[str, tuple[float, float, float]]:
    """Probabilities of the three outcomes with the variable one deviation below, at and above its mean, controls at theirs."""
    means = dict(zip(controls, result["sample"].agg(*map(F.avg, controls)).first(), strict=True)) if controls else {}
    return {name: result["fit"].probabilities(means | {result["z"]: shift}) for name, shift in (("-1 sd", -1.0), ("average", 0.0), ("+1 sd", 1.0))}


def spec_grid(df: DataFrame, y: str, variables: list[str], momentum: str, inflation: str, least: int = 40) -> list[dict]:
    """`test_variable` for each variable with momentum as control, and with inflation beside it where at least `least` rows have a value."""
    controls = [[momentum]] + ([[momentum, inflation]] if df.where(F.col(inflation).isNotNull()).count() >= least else [])
    return [{"variable": v, "controls": " + ".join(c)} | test_variable(df, y, v, c) for v in variables for c in controls]
