"""Linear mixed models: posterior draws from cross-products, a chain a task.

One aggregate sums the products of all terms by cell (levels of all factors
together); a chain reads nothing else. Coefficients and effects are integrated
out, the deviations are drawn by slice sampling from what is left, and then
coefficients and effects at once. Priors: normal on coefficients and on the
intercept (of centred terms), exponential on deviations. Slopes of a factor vary
independently. Cells and coefficients must be few (the square of the latter is
held, and solved some ten times a deviation and draw); rows may be many.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import _gram, posterior_summary, sufficient

INTERCEPT = "intercept"


class Model:
    """Cross-products of the whole design: fixed terms first, then each factor's levels by slopes."""

    def __init__(self, cells: pd.DataFrame, fixed: Sequence[str], factors: dict[str, Sequence[str]], terms: Sequence[str], priors: dict):
        grams = [_gram(row, len(terms) + 2) for _, row in cells.iterrows()]
        place = {INTERCEPT: 0} | {t: i for i, t in enumerate(terms, 1)}
        self.levels = {f: sorted(cells[f].unique().tolist(), key=str) for f in factors}
        self.names = [("b", t, None) for t in fixed] + [(f, s, level) for f, slopes in factors.items() for level in self.levels[f] for s in slopes]
        self.scales = [(f, s) for f, slopes in factors.items() for s in slopes]
        total, last = sum(grams), len(terms) + 1
        self.n, self.yy = total[0, 0], total[last, last]
        self.centre = np.array([total[0, place[t]] / self.n if INTERCEPT in fixed and t != INTERCEPT else 0.0 for t in fixed])
        size = len(self.names)
        self.a, self.r = np.zeros((size, size)), np.zeros(size)
        at = {name: i for i, name in enumerate(self.names)}
        for gram, (_, row) in zip(grams, cells.iterrows(), strict=True):
            use = [at["b", t, None] for t in fixed] + [at[f, s, row[f]] for f, slopes in factors.items() for s in slopes]
            column = [place[t] for t in fixed] + [place[s] for slopes in factors.values() for s in slopes]
            self.a[np.ix_(use, use)] += gram[np.ix_(column, column)]
            self.r[use] += gram[column, last]
        # centred fixed terms: each less its mean times the intercept
        turn = np.eye(size)
        for i, c in enumerate(self.centre):
            if c:
                turn[at["b", INTERCEPT, None], i] = -c
        self.a, self.r = turn.T @ self.a @ turn, turn.T @ self.r
        self.fixed_precision = [1 / (priors["intercept"] if t == INTERCEPT else priors["coefficient"]) ** 2 for t in fixed]
        self.scale_of = np.array([self.scales.index((f, s)) for f, s, _ in self.names[len(fixed) :]], dtype=int)
        self.rates, self.fixed = priors, list(fixed)

    def posterior(self, log_scales: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log density of the logarithms of (deviations, sigma); factor and mean of the coefficients."""
        sd, sigma = np.exp(log_scales[:-1]), np.exp(log_scales[-1])
        precision = np.concatenate([self.fixed_precision, sd[self.scale_of] ** -2.0])
        factor = np.linalg.cholesky(self.a / sigma**2 + np.diag(precision))
        half = np.linalg.solve(factor, self.r / sigma**2)
        log = -self.n * np.log(sigma) + 0.5 * np.log(precision).sum() - np.log(np.diag(factor)).sum()
        log += 0.5 * (half @ half - self.yy / sigma**2)
        prior = log_scales.sum() - self.rates["sd"] * sd.sum() - self.rates["sigma"] * sigma
        return log + prior, factor, half

    def draw(self, log_scales: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        _, factor, half = self.posterior(log_scales)
        found = np.linalg.solve(factor.T, half + rng.standard_normal(len(half)))
        if INTERCEPT in self.fixed:
            found[self.fixed.index(INTERCEPT)] -= self.centre @ found[: len(self.fixed)]
        return found

    def labels(self) -> list[str]:
        own = [f"b_{t}" if f == "b" else f"r_{f}[{level},{t}]" for f, t, level in self.names]
        return [*own, *(f"sd_{f}__{s}" for f, s in self.scales), "sigma"]


def slice_step(x: np.ndarray, i: int, log: Callable[[np.ndarray], float], now: float, rng: np.random.Generator, width: float = 1.0) -> tuple[np.ndarray, float]:
    """A slice sampling step of one coordinate, with stepping out and shrinking."""
    level = now - rng.exponential()
    moved = x.copy()
    low = x[i] - width * rng.random()
    high = low + width

    def at(v: float) -> float:
        moved[i] = v
        return log(moved)

    while at(low) > level and low > x[i] - 30:
        low -= width
    while at(high) > level and high < x[i] + 30:
        high += width
    while True:
        v = rng.uniform(low, high)
        if (found := at(v)) > level:
            return moved.copy(), found
        low, high = (v, high) if v < x[i] else (low, v)


def sample(model: Model, chain: int, draws: int, warm_up: int, seed: int) -> pd.DataFrame:
    """(draw, one column a parameter) of one chain."""
    rng = np.random.default_rng([seed, chain])
    state = rng.normal(-1, 1, len(model.scales) + 1)
    log = lambda s: model.posterior(s)[0]
    now, kept = log(state), []
    for k in range(warm_up + draws):
        for i in range(len(state)):
            state, now = slice_step(state, i, log, now, rng)
        if k >= warm_up:
            kept.append(np.concatenate([model.draw(state, rng), np.exp(state)]))
    return pd.DataFrame(kept, columns=model.labels())


PRIORS = {"coefficient": 0.1, "intercept": 5.0, "sd": 1.0, "sigma": 1.0}


def mixed_model(
    df: DataFrame, y: str, fixed: Sequence[str], factors: dict[str, Sequence[str]], chains: int = 4, draws: int = 1000, warm_up: int = 1000, seed: int = 42, priors: dict | None = None
) -> DataFrame:
    """(chain, draw, parameter, value) of y ~ fixed + (slopes | factor) + ...

    ``fixed`` and slopes name numeric columns, or INTERCEPT. ``priors``: deviations
    of the normal ones ("coefficient", "intercept"), rates of the exponential ones
    ("sd", "sigma"). Rows that lack a value take no part. Parameters: b_<term>,
    r_<factor>[<level>,<slope>], sd_<factor>__<slope> and sigma.
    """
    used = dict.fromkeys([*fixed, *(s for slopes in factors.values() for s in slopes)])
    terms = [t for t in used if t != INTERCEPT]
    cells = sufficient(df.dropna(subset=list(factors)), list(factors), terms, y)
    how = PRIORS | (priors or {})

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        model = Model(rows, fixed, factors, terms, how)
        chain = int(rows["chain"].iloc[0])
        found = sample(model, chain, draws, warm_up, seed)
        found.insert(0, "draw", np.arange(len(found)))
        return found.melt("draw", var_name="parameter").assign(chain=chain)[["chain", "draw", "parameter", "value"]]

    each = cells.orderBy(*factors).withColumn("chain", F.explode(F.sequence(F.lit(1), F.lit(chains))))
    return each.groupBy("chain").applyInPandas(run, "chain int, draw long, parameter string, value double")


def split_rhat(draws: DataFrame, by: Sequence[str] = ("parameter",)) -> DataFrame:
    """(by, rhat): every chain cut into halves, between and within their variances; null where all draws agree."""
    length = draws.groupBy("chain").agg(F.max("draw").alias("__last"))
    half = (F.col("draw") * 2 > F.col("__last")).alias("__half")
    parts = draws.join(F.broadcast(length), "chain").groupBy(*by, "chain", half)
    parts = parts.agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("n"))
    s = parts.groupBy(*by).agg(F.avg("v").alias("w"), F.var_samp("m").alias("b"), F.avg("n").alias("n"))
    return s.select(*by, F.sqrt(F.try_divide((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b"), F.col("w"))).alias("rhat"))


def model_summary(draws: DataFrame) -> DataFrame:
    """(parameter, mean, sd, median, central 95 % interval, share above zero, sign, rhat)."""
    s = draws.groupBy("parameter").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return s.join(posterior_summary(draws, ["parameter"], "value"), "parameter").join(split_rhat(draws), "parameter")
