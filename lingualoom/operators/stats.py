"""Summaries, regressions from sufficient statistics, and tests."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import forget, written
from .ranges import summarised

Z95 = 1.96


def mean_ci(df: DataFrame, by: Sequence[str], value: str, z: float = Z95) -> DataFrame:
    """n, mean, sd and mean -+ z * sd / sqrt(n) of non-missing values."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    s = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    half = F.try_divide(z * F.col("sd"), F.sqrt(F.col("n").cast("double")))
    return s.withColumns({"lower": F.col("mean") - half, "upper": F.col("mean") + half})


def describe(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """count, mean, std, min, interpolated quartiles, max."""
    aggregates = [
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]
    out = summarised(df, by, value, aggregates, [0.25, 0.5, 0.75], "__q")
    quartiles = [F.col("__q")[i].alias(q) for i, q in enumerate(("q25", "q50", "q75"))]
    return out.select(*by, "count", "mean", "std", "min", *quartiles, "max")


def describe_counts(df: DataFrame, value: str, weight: str) -> DataFrame:
    """As ``describe`` of all rows, each value given once with its number: for values of which there are few different ones."""
    v, n = F.col(value), F.col(weight)
    df = df.where(v.isNotNull())
    all_rows = df.agg(F.sum(n).alias("__all"), (F.sum(v.cast("double") * n) / F.sum(n)).alias("mean"))
    order = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("__to", F.sum(n).over(order)).crossJoin(F.broadcast(all_rows))

    def quantile(p: float) -> Column:
        place = (F.max("__all") - 1) * F.lit(p)
        at = lambda r: F.element_at(F.filter(F.sort_array(F.collect_list(F.struct("__to", v.cast("double").alias("v")))), lambda x: x["__to"] > r), 1)["v"]
        low, high = at(F.floor(place)), at(F.ceil(place))
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    std = F.sqrt(F.try_divide(F.sum(n * F.pow(v - F.col("mean"), F.lit(2.0))), F.max("__all") - 1))
    quartiles = [F.when(F.count("*") > 0, quantile(p)).alias(q) for p, q in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    return rows.agg(F.coalesce(F.max("__all"), F.lit(0)).alias("count"), F.max("mean").alias("mean"), std.alias("std"), F.min(v).alias("min"), *quartiles, F.max(v).alias("max"))


def correlation(df: DataFrame, by: Sequence[str], x: str, y: str, out: str = "r") -> DataFrame:
    """Pearson correlation of complete pairs; null if either side is constant."""
    s = df.dropna(subset=[x, y]).groupBy(*by)
    s = s.agg(F.count("*").alias("n"), F.covar_samp(x, y).alias("__c"), F.stddev_samp(x).alias("__x"), F.stddev_samp(y).alias("__y"))
    return s.withColumn(out, F.try_divide(F.col("__c"), F.col("__x") * F.col("__y"))).drop("__c", "__x", "__y")


def accuracy(df: DataFrame, correct: Column, sets: Sequence[Sequence[str]]) -> DataFrame:
    """total, correct and ratio for every grouping set, in one pass."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    flagged = df.withColumn("__ok", correct.cast("int"))
    grouped = flagged.groupingSets([[F.col(c) for c in s] for s in sets], *names) if names else flagged.groupBy()
    s = grouped.agg(F.count("*").alias("total"), F.sum("__ok").alias("correct"))
    return s.withColumn("accuracy", F.try_divide(F.col("correct").cast("double"), F.col("total")))


def posterior_summary(draws: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Median, central 95 % interval, share above zero, and the sign that this share supports."""
    above = F.avg((F.col(value) > 0).cast("double")).alias("prob_pos")
    s = summarised(draws, by, value, [above], [0.5, 0.025, 0.975], "__q")
    s = s.select(*by, *[F.col("__q")[i].alias(q) for i, q in enumerate(("median", "q025", "q975"))], "prob_pos")
    s = s.withColumn("significant", (F.col("prob_pos") > 0.975) | (F.col("prob_pos") < 0.025))
    return s.withColumn(
        "direction", F.when(~F.col("significant"), "none").when(F.col("prob_pos") > 0.5, "positive").otherwise("negative")
    )


def sufficient(df: DataFrame, by: Sequence[str], terms: Sequence[str], y: str) -> DataFrame:
    """Sums of products of (1, terms, y) by group: all that least squares needs."""
    full = [F.lit(1.0), *[F.col(t).cast("double") for t in terms], F.col(y).cast("double")]
    sums = [F.sum(a * b).alias(f"s_{i}_{j}") for i, a in enumerate(full) for j, b in enumerate(full) if i <= j]
    return df.dropna(subset=[*terms, y]).groupBy(*by).agg(*sums)


def _gram(row: pd.Series, p: int) -> np.ndarray:
    m = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            m[i, j] = m[j, i] = row[f"s_{i}_{j}"]
    return m


def fit_gram(gram: np.ndarray, columns: Sequence[int]) -> tuple[np.ndarray, float]:
    """Coefficients (the intercept first) and residual standard deviation.

    The last row of ``gram`` is the outcome. Aliased terms get zero, and don't
    count as parameters.
    """
    pick, last = [0, *columns], gram.shape[0] - 1
    xx, xy, yy, n = gram[np.ix_(pick, pick)], gram[pick, last], gram[last, last], gram[0, 0]
    scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    beta, _, rank, _ = np.linalg.lstsq(xx / np.outer(scale, scale), xy / scale, rcond=1e-10)
    beta = beta / scale
    rss = max(0.0, yy - 2 * beta @ xy + beta @ xx @ beta)
    return beta, math.sqrt(rss / (n - rank)) if n > rank else float("nan")


def held_out_likelihood(gram: np.ndarray, beta: np.ndarray, sigma: float, columns: Sequence[int]) -> float:
    """Mean normal log density of the rows behind ``gram``."""
    pick, last = [0, *columns], gram.shape[0] - 1
    rss = gram[last, last] - 2 * beta @ gram[pick, last] + beta @ gram[np.ix_(pick, pick)] @ beta
    return -math.log(sigma) - 0.5 * math.log(2 * math.pi) - max(0.0, rss) / gram[0, 0] / (2 * sigma**2)


def cross_validated_gain(
    df: DataFrame, grid: Sequence[str], fold: str, y: str, base: Sequence[str], target: Sequence[str]
) -> DataFrame:
    """(grid, fold, dll): gain in held-out mean log likelihood of the target
    formula (base terms and more) over the base formula.

    One aggregate gives the products of every grid point and fold; training
    products are the totals less the fold's. Only these sums are solved in
    Python, one small system a fold, grouped by grid point.
    """
    terms = [*base, *[t for t in target if t not in base]]
    stats = sufficient(df, [*grid, fold], terms, y)
    p, b, t = len(terms) + 2, [1 + terms.index(c) for c in base], [1 + terms.index(c) for c in dict.fromkeys([*base, *target])]

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        grams = [_gram(r, p) for _, r in rows.iterrows()]
        total, out = sum(grams), []
        for g in grams:
            train = total - g
            gain = [held_out_likelihood(g, *fit_gram(train, c), c) for c in (t, b)]
            out.append(gain[0] - gain[1])
        return rows[[*grid, fold]].assign(dll=out)

    keys = [f"{f.name} {f.dataType.simpleString()}" for f in stats.schema if f.name in (*grid, fold)]
    one = stats if grid else stats.withColumn("__all", F.lit(1))
    return one.groupBy(*(grid or ["__all"])).applyInPandas(solve, ", ".join([*keys, "dll double"]))


def per_row_gain(df: DataFrame, fold: str, y: str, base: Sequence[str], target: Sequence[str], out: str = "dll") -> DataFrame:
    """Add each row's gain in log density, by models fit on the other folds.

    The models are one row a fold, joined by broadcast.
    """
    formulas = {"b": list(base), "t": list(dict.fromkeys([*base, *target]))}
    terms = formulas["t"]
    stats = sufficient(df, [fold], terms, y)
    p, kind = len(terms) + 2, stats.schema[fold].dataType.simpleString()

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        grams = [_gram(r, p) for _, r in rows.iterrows()]
        total, made = sum(grams), {}
        for name, formula in formulas.items():
            fits = [fit_gram(total - g, [1 + terms.index(c) for c in formula]) for g in grams]
            made |= {f"__{name}": [b.tolist() for b, _ in fits], f"__{name}_sd": [s for _, s in fits]}
        return pd.DataFrame({fold: rows[fold], **made})

    models = stats.withColumn("__all", F.lit(1)).groupBy("__all").applyInPandas(
        solve, f"{fold} {kind}, __b array<double>, __b_sd double, __t array<double>, __t_sd double"
    )
    rows = df.dropna(subset=[*terms, y]).join(F.broadcast(models), fold)

    def density(name: str) -> Column:
        mu = F.col(f"__{name}")[0]
        for i, c in enumerate(formulas[name], 1):
            mu = mu + F.col(f"__{name}")[i] * F.col(c)
        return log_density(F.col(y), mu, F.col(f"__{name}_sd"))

    return rows.withColumn(out, density("t") - density("b")).drop("__b", "__b_sd", "__t", "__t_sd")


def fold_summary(folds: DataFrame, by: Sequence[str], value: str = "dll", z: float = Z95) -> DataFrame:
    """Folds, mean and mean -+ z * sd / sqrt(folds); bounds are null for one fold."""
    return mean_ci(folds, by, value, z).drop("sd").withColumnRenamed("n", "n_folds")


def coefficients(df: DataFrame, by: Sequence[str], terms: Sequence[str], y: str) -> DataFrame:
    """(by, term, estimate, sigma) of least squares in each group."""
    stats = sufficient(df, by, terms, y)
    p, names = len(terms) + 2, ["intercept", *terms]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for _, r in rows.iterrows():
                beta, sigma = fit_gram(_gram(r, p), range(1, p - 1))
                out += [(*[r[c] for c in by], n, e, sigma) for n, e in zip(names, beta, strict=True)]
            yield pd.DataFrame(out, columns=[*by, "term", "estimate", "sigma"])

    keys = [f"{f.name} {f.dataType.simpleString()}" for f in stats.schema if f.name in by]
    return stats.mapInPandas(solve, ", ".join([*keys, "term string, estimate double, sigma double"]))


def triangles(df: DataFrame, by: Sequence[str], terms: Sequence[str], y: str, block: int = 4096, fan: int = 64) -> DataFrame:
    """(by, n, r): the triangular factor of (1, terms, y) of each group, row by row.

    A task factors blocks of rows and passes its factors on; groups of ``fan``
    factors are then stacked and factored again until one is left, so no task holds
    a group, and nothing is squared.
    """
    names, p = [*terms, y], len(terms) + 2
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "n long, r array<double>, part long"])

    def factor(rows: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.vstack([rows, np.zeros((max(0, p - len(rows)), p))]), mode="r")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            groups = batch.groupby(list(by), dropna=False) if by else [((), batch)]
            out = []
            for k, (key, own) in enumerate(groups):
                rows = np.column_stack([np.ones(len(own)), own[names].to_numpy(float)])
                r = np.zeros((0, p))
                for i in range(0, len(rows), block):
                    r = factor(np.vstack([r, rows[i : i + block]]))
                out.append((*(None if x != x else x for x in key), len(own), r.ravel().tolist(), k + id(batch) % 1_000_003))
            yield pd.DataFrame(out, columns=[*by, "n", "r", "part"])

    def stack(rows: pd.DataFrame) -> pd.DataFrame:
        r = factor(np.vstack([np.reshape(x, (p, p)) for x in rows["r"]]))
        return rows.iloc[:1].assign(n=rows["n"].sum(), r=[r.ravel().tolist()])

    use = df.select(*by, *[F.col(c).cast("double").alias(c) for c in names]).dropna(subset=names)
    now = written(use.mapInPandas(first, schema), "triangles")
    most = now.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        most = -(-most // fan)
        part = F.pmod(F.xxhash64("part", "n", "r"), F.lit(most))
        then = written(now.withColumn("part", part).groupBy(*by, "part").applyInPandas(stack, schema), "triangles")
        forget(now)
        now = then
    return now.drop("part")


def stable_coefficients(df: DataFrame, by: Sequence[str], terms: Sequence[str], y: str, block: int = 4096, fan: int = 64) -> DataFrame:
    """(by, term, estimate, sigma) of least squares in each group, from triangular factors; aliased terms get zero."""
    names, p = ["intercept", *terms], len(terms) + 2
    factors = triangles(df, by, terms, y, block, fan)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for _, row in rows.iterrows():
                r = np.reshape(row["r"], (p, p))
                kept: list[int] = []
                for i in range(p - 1):  # a term that the ones before it explain counts as none
                    if abs(r[i, i]) > 1e-12 * max(np.linalg.norm(r[:, i]), 1e-300):
                        kept.append(i)
                beta = np.zeros(p - 1)
                if kept:
                    beta[kept] = np.linalg.lstsq(r[: p - 1, kept], r[: p - 1, -1], rcond=None)[0]
                rest = r[:, -1] - r[:, : p - 1] @ beta
                free = row["n"] - len(kept)
                sigma = float(np.sqrt(rest @ rest / free)) if free > 0 else None
                out += [(*[row[c] for c in by], t, e, sigma) for t, e in zip(names, beta.tolist(), strict=True)]
            yield pd.DataFrame(out, columns=[*by, "term", "estimate", "sigma"])

    keys = [f"{f.name} {f.dataType.simpleString()}" for f in factors.schema if f.name in by]
    return factors.mapInPandas(solve, ", ".join([*keys, "term string, estimate double, sigma double"]))


def log_density(y: Column, mu: Column, sigma: Column) -> Column:
    return -F.ln(sigma) - 0.5 * F.ln(2 * F.pi()) - F.pow(y - mu, F.lit(2.0)) / (2 * F.pow(sigma, F.lit(2.0)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def student_quantile(p: float, df: float) -> float:
    """Quantile of Student's t for p in (0, 1), by bisection."""
    if p < 0.5:
        return -student_quantile(1 - p, df)
    low, high = 0.0, 1.0
    while 1 - student_two_sided(high, df) / 2 < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - student_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([student_two_sided(a, b) if b == b and b > 0 and a == a else None for a, b in zip(t, df, strict=True)])


@F.pandas_udf(T.DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([student_quantile(a, b) if b == b and b > 0 else None for a, b in zip(p, df, strict=True)])


def t_statistic(df: DataFrame, by: Sequence[str], value: str, mu: float = 0.0) -> DataFrame:
    """n, mean, t and degrees of freedom of a one-sample test; t is null for a constant sample."""
    s = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("__sd"))
    t = F.try_divide(F.col("mean") - mu, F.col("__sd") / F.sqrt(F.col("n").cast("double")))
    return s.withColumn("t", t).withColumn("df", F.col("n") - 1).drop("__sd")


def t_test(df: DataFrame, by: Sequence[str], value: str, mu: float = 0.0) -> DataFrame:
    """One-sample two-sided t test."""
    return t_statistic(df, by, value, mu).withColumn("p", p_value(F.col("t"), F.col("df").cast("double")))


def group_means(df: DataFrame, group: str, y: str) -> DataFrame:
    """Regression on group indicators without intercept: estimate = group mean,
    standard error from the pooled residual deviation, with its t interval."""
    g = df.dropna(subset=[group, y]).groupBy(group).agg(F.count("*").alias("n"), F.avg(y).alias("estimate"), F.var_samp(y).alias("__v"))
    pooled = g.agg(
        F.sum((F.col("n") - 1) * F.coalesce("__v", F.lit(0.0))).alias("__rss"), (F.sum("n") - F.count("*")).alias("df")
    )
    out = g.crossJoin(F.broadcast(pooled))
    se = F.sqrt(F.try_divide(F.col("__rss"), F.col("df"))) / F.sqrt(F.col("n").cast("double"))
    out = out.withColumn("std_error", se).withColumn("__q", t_quantile(F.lit(0.975), F.col("df").cast("double")))
    half = F.col("__q") * F.col("std_error")
    return out.withColumns({"lower": F.col("estimate") - half, "upper": F.col("estimate") + half}).drop("__v", "__rss", "__q")


def histogram(df: DataFrame, by: Sequence[str], value: str, low: float, high: float, bins: int, weight: str | None = None) -> DataFrame:
    """Counts and densities of equal bins; the last bin holds its upper end. With ``weight``, a row's number of times."""
    width = (high - low) / bins
    inside = df.where(F.col(value).between(low, high))
    b = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    n = F.sum(weight) if weight else F.count("*")
    s = inside.groupBy(*by, b.alias("bin")).agg(n.alias("n"))
    total = inside.groupBy(*by).agg(n.alias("__t")) if by else inside.agg(n.alias("__t"))
    s = s.join(total, list(by)) if by else s.crossJoin(F.broadcast(total))
    return s.withColumn("density", F.col("n") / (F.col("__t") * width)).drop("__t")


def kernel_density(df: DataFrame, value: str, grid: Sequence[float], bandwidth: float) -> DataFrame:
    """Gaussian kernel density at each grid point (a short list), clipped at zero."""
    points = df.select(F.col(value).cast("double").alias("v"), F.explode(F.array(*[F.lit(float(x)) for x in grid])).alias("x"))
    kernel = F.exp(-F.pow((F.col("x") - F.col("v")) / bandwidth, F.lit(2.0)) / 2) / (bandwidth * math.sqrt(2 * math.pi))
    return points.groupBy("x").agg(F.greatest(F.avg(kernel), F.lit(0.0)).alias("density"))


def automatic_bins(df: DataFrame, value: str, weight: str | None = None) -> tuple[float, float, int]:
    """(low, high, bins): the narrower of the widths by Freedman and Diaconis (2 IQR / cube
    root of n, range / (2 root of n) at least) and Sturges (range / (log2 n + 1))."""
    found = (describe_counts(df, value, weight) if weight else describe(df, [], value)).first()
    n, low, high = found["count"], found["min"], found["max"]
    if not n or low == high:
        return (low or 0.0) - 0.5, (high or 0.0) + 0.5, 1
    wide, iqr = high - low, found["q75"] - found["q25"]
    width = min(max(2 * iqr / n ** (1 / 3), wide / math.sqrt(n) / 2), wide / (math.log2(n) + 1))
    return float(low), float(high), math.ceil((high - low) / width)


def automatic_histogram(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """(bin, from, to, n, density) of the automatic bins that hold a value; with ``weight``, a row's number of times."""
    low, high, bins = automatic_bins(df, value, weight)
    width = (high - low) / bins
    h = histogram(df, [], value, low, high, bins, weight)
    return h.select("bin", (F.col("bin") * width + low).alias("from"), ((F.col("bin") + 1) * width + low).alias("to"), "n", "density")


def automatic_density(
    df: DataFrame, value: str, points: int = 200, cut: float = 3.0, least: float | None = None, most: float | None = None, cells: int = 4096, weight: str | None = None
) -> DataFrame:
    """(x, density): Gaussian kernel density at evenly spaced points from ``cut`` bandwidths
    below the least value to as many above the largest, within ``least`` and ``most``.

    The bandwidth is Scott's: sd * n^(-1/5). Each value is shared by the two nearest
    of ``cells`` places, so rows cost two terms each, and then places cost terms at
    points: no product of rows and points. Empty where the deviation is null or zero.
    With ``weight``, a column of how many times each row counts.
    """
    if weight:
        s = describe_counts(df, value, weight).select(F.col("count").alias("n"), F.col("std").alias("sd"), F.col("min").alias("low"), F.col("max").alias("high")).first()
    else:
        s = df.agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high")).first()
    if not s["n"] or not s["sd"]:
        return df.sparkSession.createDataFrame([], "x double, density double")
    width = s["sd"] * s["n"] ** -0.2
    first, last = s["low"] - cut * width, s["high"] + cut * width
    first, last = first if least is None else max(first, least), last if most is None else min(last, most)
    step = (s["high"] - s["low"]) / (cells - 1)
    place = (F.col(value).cast("double") - s["low"]) / step
    cell = F.least(F.floor(place), F.lit(cells - 2))
    shares = F.array(F.struct(cell.alias("cell"), (cell + 1 - place).alias("w")), F.struct((cell + 1).alias("cell"), (place - cell).alias("w")))
    times = F.col(weight) if weight else F.lit(1)
    mass = df.where(F.col(value).isNotNull()).select(times.alias("__times"), F.inline(shares)).groupBy("cell").agg(F.sum(F.col("w") * F.col("__times")).alias("w"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: k * ((last - first) / (points - 1)) + first)
    kernel = F.exp(-F.pow((F.col("x") - (F.col("cell") * step + s["low"])) / width, F.lit(2.0)) / 2)
    out = mass.withColumn("x", F.explode(grid)).groupBy("x").agg(F.sum(F.col("w") * kernel).alias("__s"))
    return out.select("x", (F.col("__s") / (s["n"] * width * math.sqrt(2 * math.pi))).alias("density"))


def box_numbers(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    names = ("low", "q1", "median", "q3", "high")
    s = summarised(df, by, value, [F.count("*").alias("__n")], [0.0, 0.25, 0.5, 0.75, 1.0], "__q")
    return s.select(*by, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])
