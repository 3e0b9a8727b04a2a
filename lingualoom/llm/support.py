"""Shared helpers: shared-folder tables, Arrow batching and distributed prefix sums."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import forget, shared_dir, shared_path, spread, written

__all__ = ["Scratch", "forget", "shared_dir", "shared_path", "spread", "written"]


class Scratch:
    """Tables written on the way to a result that doesn't read them any more."""

    def __init__(self):
        self.made: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.made.append(written(df, name))
        return self.made[-1]

    def remove(self) -> None:
        while self.made:
            forget(self.made.pop())

#: Words are maximal runs without these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
#: Bits of the seeded shuffle key.
KEY_BITS = 60


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(spark: SparkSession, rows: int, rows_per_bucket: int = 20_000) -> int:
    """Number of buckets: grows with the rows, so that no bucket does."""
    return max(4 * parallelism(spark), -(-rows // rows_per_bucket))


def shuffle_key(seed: str, *cols: Column) -> Column:
    """A uniform 60-bit key that depends on the seed and the columns only."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    digest = F.md5(F.concat_ws("|", F.lit(seed), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def row_key(seed: str, id_col: Column, text: Column) -> Column:
    """A shuffle key of a row's id, or of its text where it has none: rows without id don't share a key."""
    return shuffle_key(seed, F.coalesce(id_col.cast("string"), F.md5(text.cast("binary"))))


def key_bucket(key: Column, n: int) -> Column:
    """Bucket 0..n-1 of a shuffle key; buckets follow the order of the key."""
    return F.floor(key / F.lit(float((1 << KEY_BITS) // n + 1))).cast("long")


def running_sum(
    df: DataFrame, *, group: list[str], bucket: str, order: list[str], measure: Column, name: str, total: str | None = None
) -> DataFrame:
    """Add ``name``: the sum of ``measure`` over the earlier rows of the group.

    ``bucket`` must follow ``order`` within a group. Sums by (group, bucket) are
    made first and summed over buckets, so a group of any size is spread over as
    many tasks as it has buckets. ``total`` names the sum over the whole group.
    No column of ``group`` or ``bucket`` may be null.
    """
    df = df.withColumn("__m", measure)
    sums = df.groupBy(*group, bucket).agg(F.sum("__m").alias("__s"))
    over = Window.partitionBy(*group).orderBy(bucket)
    whole = Window.partitionBy(*group)
    base = sums.select(
        *group,
        bucket,
        (F.sum("__s").over(over) - F.col("__s")).alias("__base"),
        *([F.sum("__s").over(whole).alias(total)] if total else []),
    )
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("__local", F.coalesce(F.sum("__m").over(inner), F.lit(0)))
    # without a group the sums are one row a bucket
    return local.join(base, [*group, bucket]).withColumn(name, F.col("__base") + F.col("__local")).drop("__m", "__local", "__base")


def source_key(source: Column) -> Column:
    """Never null, and sorts as the source does by code point, null last."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("z"))


def texts_to_batches(
    rows: Iterator[pa.RecordBatch], column: str, make: Callable[[list], list[pa.Array]], names: list[str], bytes_at_once: int = 16 << 20
) -> Iterator[pa.RecordBatch]:
    """Replace ``column`` by what ``make`` returns for slices of bounded bytes.

    A slice holds about ``bytes_at_once`` of text, or one row if that is longer.
    """
    for batch in rows:
        at = batch.schema.get_field_index(column)
        kept = [i for i in range(batch.num_columns) if i != at]
        for part in slices(batch, at, bytes_at_once):
            made = make(part.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(i) for i in kept] + made, names=[batch.schema.field(i).name for i in kept] + names
            )
    give_back()


def give_back() -> None:
    """Return what a Python worker has freed to the system: idle workers stay while later stages run."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, at: int, bytes_at_once: int) -> Iterator[pa.RecordBatch]:
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + bytes_at_once, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
