"""Sharding by proportional stratified interleaving (DataFrame functions only).

Rows are shuffled by a seeded key within each source and ranked there; the
fractional rank (2r - 1) / (2n) orders all rows, so that every stretch of that
order holds each source in proportion. The order is cut into shards whose row
counts differ by one at most (law ``rows``).

Both ranks are sums over buckets first (see ``support.running_sum``): neither a
source with a third of all rows nor the global order meets in one task.

Defined results: a null source is a source of its own; a null text counts no
bytes and is hashed as the empty text; rows without id are shuffled by their
text; repeated rows take places of their own;
an empty table gives an empty table; with fewer rows than shards some shards
are empty. Only the id, text and source columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import buckets_for, key_bucket, row_key, running_sum, source_key, written


def interleave(
    df: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: str = "shard-1"
) -> DataFrame:
    """(id, size, text_crc32, source_key, source_rank, position, shard, slot).

    ``position`` is the gapless place in the interleaved order, ``slot`` the
    gapless place in the shard, both from 0.
    """
    spark = df.sparkSession
    content = F.coalesce(F.col(text), F.lit(""))
    base = df.select(
        F.col(id_col).alias("id"),
        (F.octet_length(content).cast("long") + 1).alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        source_key(F.col(source)).alias("source_key"),
        row_key(seed, F.col(id_col), F.col(text)).alias("key"),
    )
    base = written(base, "shard-rows")
    rows = base.count()
    n = buckets_for(spark, rows)
    base = base.withColumn("bucket", key_bucket(F.col("key"), n))
    ranked = running_sum(
        base, group=["source_key"], bucket="bucket", order=["key", "id", "text_crc32", "size"], measure=F.lit(1), name="before", total="of"
    )
    ranked = ranked.withColumn("part", (2 * F.col("before") + 1) / (2 * F.col("of")))
    ranked = ranked.withColumn("bucket", F.least(F.floor(F.col("part") * n), F.lit(n - 1)).cast("long"))
    placed = running_sum(ranked, group=[], bucket="bucket", order=["part", "source_key", "before"], measure=F.lit(1), name="position")
    shard = F.expr(f"CAST((position * {shards}L) div {max(1, rows)}L AS INT)")
    start = F.expr(f"(shard * {rows}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", shard).select(
        "id", "size", "text_crc32", "source_key", (F.col("before") + 1).alias("source_rank"), "position", "shard", (F.col("position") - start).alias("slot")
    )
