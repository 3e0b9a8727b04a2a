"""Tables behind reports and figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import ranks
from .stats import correlation, mean_ci


def is_true(column: str) -> Column:
    """A flag kept as text."""
    return F.lower(F.trim(F.col(column))) == "true"


def chosen(label: str, a: str, b: str) -> Column:
    return F.when(F.col(label) == "A", F.col(a)).otherwise(F.col(b))


def missed_rows(answers: DataFrame) -> DataFrame:
    """Wrong answers with the chosen text."""
    wrong = answers.where(~F.coalesce(is_true("is_correct"), F.lit(False)))
    return wrong.withColumn("generated_answer", chosen("generated_label", "option_a", "option_b"))


def in_report_order(rows: DataFrame, out: str = "row_no") -> DataFrame:
    """Add the row's number from 1 in a report: by condition and numeric ids, then the ids as
    text; ids that aren't numbers come last. Rows of one condition and ids must be one."""
    number = lambda c: (F.col(c).try_cast("long").isNull(), F.col(c).try_cast("long"), F.col(c).cast("string"))
    return ranks(rows, [F.col("condition"), *number("story_index"), *number("question_index")], out)


def first_levels(rows: DataFrame, order: Sequence[Column], n: int = 11) -> DataFrame:
    """The first n levels of a small table; also what a report prints at most."""
    return rows.orderBy(*order).limit(n)


def summary_lines(rows: DataFrame, pattern: str, columns: Sequence[str]) -> DataFrame:
    """(line): a printed summary, a line a row, in the pattern of ``format_string``; NA for null."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("NA")) if t == "string" else F.col(c) for c, t in rows.select(*columns).dtypes]
    return rows.select(F.format_string(pattern, *shown).alias("line"))


def sanity(scores: DataFrame, by: Sequence[str], value: str = "surprisal", reference: str = "unisurp") -> DataFrame:
    """Mean with interval, and correlation with a reference predictor."""
    return mean_ci(scores, by, value).join(correlation(scores, by, value, reference).drop("n"), list(by), "left")


def degradation(results: DataFrame, by: Sequence[str], base: str = "mean_orig", changed: str = "mean_pron") -> DataFrame:
    """Per group: rows, means and deviations of the loss against a positive base, and its percentage."""
    d = results.where(F.col(base) > 0).withColumn("delta", F.col(base) - F.col(changed))
    d = d.withColumn("percent", 100 * F.try_divide("delta", base))
    return d.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(base).alias("mean_base"),
        F.avg("delta").alias("mean_delta"),
        F.avg("percent").alias("mean_percent"),
        F.stddev_samp("delta").alias("sd_delta"),
        F.stddev_samp("percent").alias("sd_percent"),
    )


def fold_deltas(folds: DataFrame, by: Sequence[str], pairs: Sequence[tuple[str, str, str]], variant: str = "variant", fold: str = "fold", value: str = "dll") -> DataFrame:
    """Paired differences of variants in each fold: (name, minuend, subtrahend)."""
    names = sorted({x for _, a, b in pairs for x in (a, b)})
    wide = folds.groupBy(*by, fold).pivot(variant, names).agg(F.first(value))
    rows = F.array(*[F.struct(F.lit(n).alias("kind"), (F.col(a) - F.col(b)).alias(value)) for n, a, b in pairs])
    return wide.select(*by, fold, F.explode(rows).alias("x")).select(*by, fold, "x.*")


def context_change(scores: DataFrame, keys: Sequence[str], context: str, short: int, long: int, value: str = "surprisal") -> DataFrame:
    """Value at the short context less that at the long one, in one pass."""
    at = lambda c: F.max(F.when(F.col(context) == c, F.col(value)))
    out = scores.where(F.col(context).isin(short, long)).groupBy(*keys).agg(at(short).alias("__s"), at(long).alias("__l"))
    return out.select(*keys, (F.col("__s") - F.col("__l")).alias("delta")).dropna(subset=["delta"])


def capped(df: DataFrame, dataset: str, context: str, limited: Sequence[str], cap: int) -> DataFrame:
    """All rows but those of limited datasets above the cap."""
    return df.where(~(F.col(dataset).isin(*limited) & (F.col(context) > cap)))


def family(model: Column, prefixes: dict[str, str], other: str = "other") -> Column:
    out = F.lit(other)
    for prefix, name in sorted(prefixes.items(), key=lambda x: len(x[0])):
        out = F.when(F.startswith(model, F.lit(prefix)), name).otherwise(out)
    return out
