"""Mixing sources to target weights with a low-discrepancy schedule.

The mix is a sequence of K slots of equal word counts. Slot k lies at the k-th
van der Corput point (the POINT_BITS bits of k in reverse, as a fraction); the
cumulative target shares map that point to a source, and the r-th slot of a
source takes that source's r-th block. A source's blocks are cut from its
stream: its documents, shuffled by a seeded key, and then the same once more, so
that a document is taken at most twice. How many slots a source gets is what
the first K points give it: nothing else decides what is taken. Of the first K
points an interval of length s holds K * s, up to 2 * log2(K + 1), so a source's
words are within so many blocks of its target.

A block has BLOCK words, or less where that would make fewer than SLOTS slots.

Defined results: a null source is a source of its own and comes last; a null
text has size 0; documents of size 0 are never taken; repeated rows are
separate documents; rows without id are shuffled by their text; an empty table
gives an empty table. Columns whose names clash with those here are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import WORD, buckets_for, key_bucket, row_key, running_sum, source_key, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Words of a block at most, and slots at least where there are as many words.
BLOCK = 256
SLOTS = 10_000
#: Bits of a point; the points are cut into 2**CELL_BITS cells to find a point's source by an equi-join.
POINT_BITS = 52
CELL_BITS = 12


def slot_count(words: int, block: int = BLOCK, least: int = SLOTS) -> int:
    """K: the mix has so many slots, each of ``block`` words or less and one word or more."""
    return min(words, max(least, -(-words // block)))


def radical_inverse(k: Column, bits: int = POINT_BITS) -> Column:
    """The van der Corput point of k in base 2, as a multiple of 2**-bits: its bits in reverse."""
    return F.conv(F.reverse(F.lpad(F.bin(k), bits, "0")), 2, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add ``target`` to (source_key, source_size), one row a source.

    With fill level x, a source gets min(most * size, x * weight). Sources are
    sorted by the level at which they are full; the level of all after the full
    ones is what is left over the weights that are left.
    """
    place = F.row_number().over(Window.orderBy("source_key"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("most") / F.col("weight"), "source_key")
    after = order.rowsBetween(0, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    s = s.withColumn("left", F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.sum("weight").over(after))
    fits = F.col("level") * F.col("weight") <= F.col("most")
    level = F.min(F.when(fits, F.struct(F.col("most") / F.col("weight"), "source_key", "level"))).over(every)["level"]
    full = F.least(F.col("most"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return s.withColumn("target", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(full)).select("source_key", "source_size", "target")


def schedule(sources: DataFrame, slots: int, words: int) -> DataFrame:
    """(slot, source_key, block): which block of which source each slot of the mix takes.

    ``sources`` has (source_key, quota), the quotas adding up to ``words``.
    """
    upto = F.sum("quota").over(Window.orderBy("source_key"))
    point = lambda w: F.ceil(w.cast("double") / F.lit(float(words)) * F.lit(float(1 << POINT_BITS))).cast("long")
    shares = sources.where("quota > 0").select("source_key", point(upto - F.col("quota")).alias("from"), point(upto).alias("to")).where("from < to")
    shift = POINT_BITS - CELL_BITS
    cells = shares.withColumn("cell", F.explode(F.sequence(F.shiftright("from", shift), F.shiftright(F.col("to") - 1, shift))))
    spark = sources.sparkSession
    points = spark.range(slots).select(F.col("id").alias("slot"), radical_inverse(F.col("id")).alias("point"))
    given = points.withColumn("cell", F.shiftright("point", shift)).join(cells, "cell").where("point >= from AND point < to").select("slot", "source_key")
    width = -(-slots // buckets_for(spark, slots))
    given = given.withColumn("bucket", F.expr(f"slot div {width}L"))
    return running_sum(given, group=["source_key"], bucket="bucket", order=["slot"], measure=F.lit(1), name="block").select("slot", "source_key", "block")


def mix(
    df: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix-1", block: int = BLOCK,
    slots: int = SLOTS, keep: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """The documents and the pieces of the mix.

    Documents: (id, source_key, size, source_size, target, start, ...), ``start``
    being the document's place in its source's stream. Pieces: (slot, epoch,
    source_key, block, id, start, from_word, to_word, ...) for each stretch of a
    document that a slot takes, words counted from 0 in the document. Both have
    the columns ``keep`` too.
    """
    spark = df.sparkSession
    base = df.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        source_key(F.col(source)).alias("source_key"),
        row_key(seed, F.col(id_col), F.col(text)).alias("key"),
        F.xxhash64(F.col(text)).alias("text_key"),
        *keep,
    )
    base = written(base, "mix-rows")
    n = buckets_for(spark, base.count())
    sizes = base.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    sources = written(targets(sizes), "mix-sources").withColumn("quota", F.round("target").cast("long"))
    words = sources.agg(F.sum("quota")).first()[0] or 0
    k = slot_count(words, block, slots)
    step = words / max(1, k)
    # blocks beyond its quota that the points may give a source
    beyond = 2 * (k + 1).bit_length() + 2

    base = base.withColumn("bucket", key_bucket(F.col("key"), n))
    docs = running_sum(base, group=["source_key"], bucket="bucket", order=["key", "id", "size", "text_key"], measure=F.col("size"), name="start")
    docs = docs.drop("bucket", "key", "text_key").join(sources, "source_key")

    edge = lambda b: F.floor(b.cast("double") * F.lit(step)).cast("long")
    spans = docs.where("size > 0").withColumn("epoch", F.explode(F.array(*[F.lit(k) for k in range(MOST)])))
    spans = spans.withColumn("at", F.col("start") + F.col("epoch") * F.col("source_size")).where(F.col("at") < F.col("quota") + beyond * step)
    spans = spans.withColumn("end", F.col("at") + F.col("size"))
    # a block more on either side, for rounding: what doesn't overlap goes
    reach = F.sequence(F.greatest(F.floor(F.col("at") / F.lit(step)) - 1, F.lit(0)), F.least(F.floor(F.col("end") / F.lit(step)), F.ceil(F.col("quota") / F.lit(step)) + beyond) + 1)
    pieces = spans.withColumn("block", F.explode(reach))
    pieces = pieces.withColumn("from_word", F.greatest("at", edge(F.col("block"))) - F.col("at"))
    pieces = pieces.withColumn("to_word", F.least("end", edge(F.col("block") + 1)) - F.col("at")).where("from_word < to_word")
    pieces = pieces.join(schedule(sources, k, words), ["source_key", "block"]) if words else pieces.withColumn("slot", F.col("block")).where("false")
    return docs, pieces.select("slot", "epoch", "source_key", "block", "id", "start", "size", "source_size", "target", "from_word", "to_word", *keep)


def taken(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """(id, source_key, start, size, source_size, target, taken): words that the slots take of each document.

    A document with words is known by its source and start, which are its own.
    """
    keys = ["id", "source_key", "start", "size", "source_size", "target"]
    zero = F.lit(0).cast("long").alias("taken")
    some = pieces.select(*keys, (F.col("to_word") - F.col("from_word")).alias("taken")).unionAll(docs.where("size > 0").select(*keys, zero))
    return some.groupBy(*keys).agg(F.sum("taken").alias("taken")).unionAll(docs.where("size = 0").select(*keys, zero))
