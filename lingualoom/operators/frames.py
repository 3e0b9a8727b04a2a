"""Frames of observations on an integer axis: outcomes, lags, scaling, folds."""

from __future__ import annotations

import math
import re
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import join_null_safe, quantiles, ranks

__all__ = ["join_null_safe"]


def value_of(column: str) -> Column:
    """The column with NaN as null, so that means and counts leave it out."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def mean_outcome(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value_of(value)).alias(out))


def composite_key(*columns: str, missing: str = "NA", separator: str = "-") -> Column:
    """Columns pasted together; a null becomes the text ``missing``."""
    return F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in columns])


def matching_columns(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def spillover(df: DataFrame, story: str, zone: str, columns: Sequence[str], lags: Sequence[int] = (1, 2), how: str = "inner") -> DataFrame:
    """Add each column's value at zone - lag as ``<column>_so<lag>``.

    Rows match by the zone's number, not by order: where zone - lag is missing,
    ``inner`` drops the row and ``left`` leaves nulls. Repeated keys multiply.
    """
    out = df
    for lag in lags:
        earlier = df.select(F.col(story), (F.col(zone) + lag).alias(zone), *[F.col(c).alias(f"{c}_so{lag}") for c in columns])
        out = out.join(earlier, [story, zone], how)
    return out


def spillover_range(df: DataFrame, story: str, zone: str, columns: Sequence[str], lags: Sequence[int] = (1, 2)) -> DataFrame:
    """As ``spillover`` with inner matches, for unique (story, zone): one sort, no join."""
    out = df
    for lag in lags:
        at = Window.partitionBy(story).orderBy(zone).rangeBetween(-lag, -lag)
        out = out.withColumn(f"__at{lag}", F.count("*").over(at))
        for c in columns:
            out = out.withColumn(f"{c}_so{lag}", F.first(c).over(at))
    for lag in lags:
        out = out.where(F.col(f"__at{lag}") > 0).drop(f"__at{lag}")
    return out


def zscore(df: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """Scale by mean and sample standard deviation of the whole frame.

    The statistics are one row, joined by broadcast; null where the deviation is
    null or zero.
    """
    stats = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])
    out = df.crossJoin(F.broadcast(stats))
    for c in columns:
        scaled = (F.col(c) - F.col(f"__mean_{c}")) / F.nullif(F.col(f"__sd_{c}"), F.lit(0.0))
        out = out.withColumn(c + suffix, scaled)
    return out.drop(*stats.columns)


def hashed_rank(df: DataFrame, key: Column, out: str, digits: int | None = None) -> DataFrame:
    """Gapless rank from 0 by (md5 of the key, key), without a one-task sort.

    Rows are dealt by the first hex digits of the hash, whose counts are summed
    first; so many digits that a bucket has some 20,000 rows, 3 at least.
    """
    if digits is None:
        digits = max(3, math.ceil(math.log(max(1, df.count() / 20_000), 16)))
    text = key.cast("string")
    df = df.withColumn("__k", text).withColumn("__h", F.md5(text.cast("binary"))).withColumn("__b", F.substring("__h", 1, digits))
    counts = df.groupBy("__b").agg(F.count("*").alias("__n"))
    # in two steps, so that no task sums all buckets
    head = F.substring("__b", 1, max(1, digits - 3))
    heads = counts.groupBy(head.alias("__h3")).agg(F.sum("__n").alias("__s"))
    heads = heads.select("__h3", (F.sum("__s").over(Window.orderBy("__h3")) - F.col("__s")).alias("__earlier"))
    own = F.sum("__n").over(Window.partitionBy("__h3").orderBy("__b")) - F.col("__n")
    before = counts.withColumn("__h3", head).withColumn("__own", own).join(heads, "__h3").select("__b", (F.col("__own") + F.col("__earlier")).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__b").orderBy("__h", "__k"))
    out_df = df.withColumn("__r", inner).join(before, "__b").withColumn(out, (F.col("__before") + F.col("__r") - 1).cast("long"))
    return out_df.drop("__k", "__h", "__b", "__r", "__before")


def balanced_folds(df: DataFrame, key: Column, k: int = 10, out: str = "fold") -> DataFrame:
    """Folds 0..k-1 whose sizes differ by one at most; the same on every run."""
    return hashed_rank(df, key, "__rank").withColumn(out, (F.col("__rank") % k).cast("int")).drop("__rank")


def attach_vector(df: DataFrame, vector: DataFrame, row_no: str, name: str, mismatch: str = "error") -> DataFrame:
    """Attach values by explicit row number; both sides must have as many rows.

    ``vector`` has (row_no, value). A difference in length is an error; with
    ``mismatch`` "skip" a warning, the column being left out, and with "fill" the
    column is null.
    """
    values = vector.select(F.col(row_no), F.col("value").alias(name))
    if mismatch != "error":
        a, b = df.count(), vector.count()
        if a == b:
            return df.join(values, row_no)
        if mismatch == "skip":
            warnings.warn(f"{name}: {a} rows but {b} values; left out", stacklevel=2)
            return df
        return df.withColumn(name, F.lit(None).cast(vector.schema["value"].dataType))
    counts = df.agg(F.count("*").alias("a")).crossJoin(vector.agg(F.count("*").alias("b")))
    same = F.assert_true(F.col("a") == F.col("b"), F.concat_ws(" ", F.lit("rows and values differ:"), "a", "b"))
    checked = counts.where(same.isNull()).select(F.lit(1).alias("__one"))
    return df.join(values, row_no).crossJoin(F.broadcast(checked)).drop("__one")


def large_groups(df: DataFrame, by: Sequence[str], least: int, out: str = "group_n") -> DataFrame:
    """Rows of groups with at least ``least`` rows, with the group's size."""
    sizes = df.groupBy(*by).agg(F.count("*").alias(out)).where(F.col(out) >= least)
    return df.join(sizes, list(by))


def quantile_trim(df: DataFrame, by: Sequence[str], value: str, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Rows within the group's interpolated quantiles, bounds included."""
    bounds = quantiles(df, by, value, [low, high], "__q")
    return df.join(bounds, list(by)).where(F.col(value).between(F.col("__q")[0], F.col("__q")[1])).drop("__q")


def evenly_spaced(df: DataFrame, order: str, n: int) -> DataFrame:
    """About n rows evenly spaced by rank of a small dimension table, ends included."""
    total = df.count()
    if total <= n:
        return df
    picks = sorted({int(1 + k * (total - 1) / (n - 1) + 0.5) for k in range(n)})
    return df.withColumn("__r", F.row_number().over(Window.orderBy(order))).where(F.col("__r").isin(picks)).drop("__r")


def first_appearance(df: DataFrame, key: str, order: str, out: str = "rank") -> DataFrame:
    """(key, rank from 1) by the first row in which a key appears: minima first, so
    only the keys are sorted, by ranges."""
    firsts = df.groupBy(key).agg(F.min(order).alias("__f"))
    return ranks(firsts, ["__f", key], out).select(key, out)


def chosen_stories(df: DataFrame, story: str, order: str, ids: Sequence | None = None, numbers: Sequence[int] | None = None) -> DataFrame:
    """Rows of the stories with these ids, or with these numbers (from 1, by first appearance); all if neither is given."""
    if ids is not None:
        return df.where(F.col(story).isin(*ids))
    if numbers is None:
        return df
    picked = first_appearance(df, story, order, "__rank").where(F.col("__rank").isin(*numbers)).select(story)
    return df.join(picked, story, "left_semi")


def level_order(name: Column, canonical: Sequence[str]) -> Column:
    """Sort key: listed levels in their order, then the rest by name."""
    rank = F.create_map(*[F.lit(x) for i, level in enumerate(canonical) for x in (level, i)])
    return F.struct(F.coalesce(F.try_element_at(rank, name), F.lit(len(canonical))), name)


def long_with_bounds(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Wide (mean_x, lower_x, upper_x) columns to long (kind, mean, lower, upper)."""
    triples = F.array(
        *[F.struct(F.lit(m).alias("kind"), F.col(f"mean_{m}").alias("mean"), F.col(f"lower_{m}").alias("lower"), F.col(f"upper_{m}").alias("upper")) for m in measures]
    )
    return df.select(*keys, F.explode(triples).alias("x")).select(*keys, "x.*")


def flipped(df: DataFrame, mean: str = "mean", lower: str = "lower", upper: str = "upper") -> DataFrame:
    """Change the sign; the bounds change places."""
    return df.withColumns({mean: -F.col(mean), lower: -F.col(upper), upper: -F.col(lower)})


def union_frames(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def parameter_grid(*dimensions: DataFrame, available: DataFrame | None = None) -> DataFrame:
    """All combinations of small dimension tables; with ``available``, those that it has (by its columns)."""
    out = dimensions[0]
    for d in dimensions[1:]:
        out = out.crossJoin(F.broadcast(d))
    return out if available is None else out.join(available, available.columns, "left_semi")


def draws_long(draws: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """(keys, parameter, value) of the columns that begin with a prefix, which is taken off."""
    names = [c for c in draws.columns if c.startswith(prefix)]
    long = draws.unpivot(list(keys), names, "parameter", "value")
    return long.withColumn("parameter", F.substr(F.col("parameter"), F.lit(len(prefix) + 1)))


def recoded(name: Column, labels: dict[str, str]) -> Column:
    """A level's label; others stay as they are."""
    pairs = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, name), name)
