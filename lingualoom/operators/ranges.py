"""Order over ranges: ranks, running sums, quantiles and as-of matches of any group.

Rows are dealt out by ranges of their order, whose ends Spark samples, each range
is sorted once and written with its number and the rows' places in it. What comes
before a range follows from one row a range (and group), so neither the rows of
the table nor those of a group meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import forget, written

_PLACE = (1 << 33) - 1


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other."""
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(named, same, how).drop(*[f"__{k}" for k in keys])


def in_ranges(df: DataFrame, order: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    """Written with ``__p``, the number of the row's range, and ``__i``, its place from 0 in it."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))
    return written(dealt.withColumns({"__p": F.spark_partition_id(), "__i": place}), "ranges")


def ranks(df: DataFrame, order: Sequence[str | Column], out: str = "rank", parts: int | None = None) -> DataFrame:
    """Add the row's number from 1 in an order (without ties)."""
    rows = in_ranges(df, order, parts)
    sizes = rows.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))  # a row a range
    return rows.join(F.broadcast(before), "__p").withColumn(out, F.col("__before") + F.col("__i") + 1).drop("__p", "__i", "__before")


def running_sums(
    df: DataFrame, by: Sequence[str], order: Sequence[str], measure: Column, out: str, parts: int | None = None
) -> DataFrame:
    """Add the sum of ``measure`` up to the row, itself included, in the order (without ties) of its group, or of the table."""
    rows = in_ranges(df.withColumn("__m", measure), [*by, *order], parts)
    sums = rows.groupBy(*by, "__p").agg(F.sum("__m").alias("__s"))
    before = sums.select(*by, "__p", (F.sum("__s").over(Window.partitionBy(*by).orderBy("__p")) - F.col("__s")).alias("__before"))
    inside = Window.partitionBy("__p", *by).orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    rows = join_null_safe(rows.withColumn("__own", F.sum("__m").over(inside)), before, [*by, "__p"])
    return rows.withColumn(out, F.col("__before") + F.col("__own")).drop("__p", "__i", "__m", "__own", "__before")


def quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], out: str = "quantiles", parts: int | None = None
) -> DataFrame:
    """(by, array of exact quantiles, interpolated) of the values that aren't null; NaN is the largest.

    Counts by range and group say where the wanted ranks lie, and only these rows
    are looked up. Rows with one value may lie in several ranges.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL").withColumn("__t", F.rand(1))
    rows = in_ranges(rows, [*by, "__v", "__t"], parts)
    own = Window.partitionBy(*by)
    runs = rows.groupBy(*by, "__p").agg(F.count("*").alias("__n"), F.min("__i").alias("__from"))
    runs = runs.withColumns({"__before": F.sum("__n").over(own.orderBy("__p")) - F.col("__n"), "__all": F.sum("__n").over(own)})
    # both neighbours of each wanted place
    asked = []
    for j, p in enumerate(probs):
        place = (F.col("__all") - 1) * F.lit(float(p))
        asked += [F.struct(F.lit(2 * j + k).alias("slot"), f(place).cast("long").alias("rank"), place.alias("place")) for k, f in enumerate((F.floor, F.ceil))]
    wanted = runs.withColumn("w", F.explode(F.array(*asked))).where("w.rank >= __before AND w.rank < __before + __n")
    wanted = wanted.select(*by, "__p", (F.col("__from") + F.col("w.rank") - F.col("__before")).alias("__i"), "w.slot", "w.rank", "w.place")
    found = wanted.join(rows.select("__p", "__i", "__v"), ["__p", "__i"])
    at = lambda slot, c: F.max(F.when(F.col("slot") == slot, F.col(c)))
    cells = [c for j in range(len(probs)) for c in (at(2 * j, "__v").alias(f"l{j}"), at(2 * j + 1, "__v").alias(f"h{j}"), at(2 * j, "place").alias(f"x{j}"))]
    found = found.groupBy(*by).agg(*cells)

    def between(j: int) -> Column:
        low, high, x = F.col(f"l{j}"), F.col(f"h{j}"), F.col(f"x{j}")
        return F.when(low == high, low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high)

    done = written(found.select(*by, F.array(*[between(j) for j in range(len(probs))]).alias(out)), "quantiles")
    forget(rows)
    return done


def summarised(
    df: DataFrame, by: Sequence[str], value: str, aggregates: Sequence[Column], probs: Sequence[float], out: str = "quantiles"
) -> DataFrame:
    """(by, aggregates of ``value``, array of its exact quantiles): a row a group, quantiles null where all values are.

    The values are written first, so what leads to them is run once.
    """
    rows = written(df.select(*by, value), "values")
    base, found = rows.groupBy(*by).agg(*aggregates), quantiles(rows, by, value, probs, out)
    done = written(join_null_safe(base, found, by, "left") if by else base.join(F.broadcast(found), how="left"), "summary")
    forget(rows)
    forget(found)
    return done


def as_of(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str, values: Sequence[str], tie: str | None = None, parts: int | None = None
) -> DataFrame:
    """Each left row with the ``values`` of the last right row at or before it; of
    left rows before all right rows, with those of the first.

    Right rows at one place come in the order of ``tie``. A range carries the last
    values of the ranges before it, so a group of any size is spread over ranges.
    """
    place = F.col(tie) if tie else F.lit(0)
    pack = F.struct(*[F.col(c) for c in values])
    r = right.select(*by, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), place.alias("__tie"), pack.alias("__v"))
    lf = left.select(*by, F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"))
    both = in_ranges(r.unionByName(lf, allowMissingColumns=True), [*by, "__at", "__side", "__tie"], parts)
    inside = Window.partitionBy("__p", *by).orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("__own", F.last("__v", ignorenulls=True).over(inside)).where("__side = 1")
    of_right = F.when(F.col("__side") == 0, F.col("__i"))
    ends = both.groupBy(*by, "__p").agg(F.max_by("__v", of_right).alias("__last"), F.min_by("__v", of_right).alias("__first"))
    over = Window.partitionBy(*by).orderBy("__p")
    ends = ends.select(
        *by, "__p",
        F.last("__last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"),
        F.first("__first", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__start"),
    )
    out = join_null_safe(rows, ends, [*by, "__p"]).withColumn("__found", F.coalesce("__own", "__carried", "__start"))
    return out.select("__row.*", *[F.col(f"__found.{c}").alias(f"asof_{c}") for c in values])
