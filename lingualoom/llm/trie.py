"""Prefix trie of conversations, built level by level.

Per depth, the conversations that still share their node with another one are
grouped by (parent node, next turn); a group is a node, named by its least
conversation. A node's key is the digest of its parent's key and its turn's
digest, so the texts are read once. A conversation that is alone in its node
meets no other any more: what is left of it is a chain of nodes, made at once.
Then leaves and savings are rolled up level by level in reverse, each level's
sums joined to the level above.

The first LEVELS depths are levels of their own. Deeper down, where few
conversations are left, a step takes half as many depths again as lie above it,
STEP at most; the keys of its depths are chained in order, and all its depths
are grouped at once. So the number of steps grows as the logarithm of the depth
up to 2 * STEP.

No join is on a key that many rows share but that to a node's parent, which is
last in its stage, where adaptive execution can split it. The digest of the
conversations that end at a node needs their ids in order, in one stream a node:
ids are joined to runs of up to RUN ids first, so that this stream is short.

Defined results: rows without conversation id take no part; within a
conversation turns are ordered by turn (null first), then role and text; a null
role or text is empty; repeated rows are repeated turns; a conversation may have
no turn; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import Scratch, parallelism, written

#: Depths that are steps of their own, and depths of a step at most.
LEVELS = 16
STEP = 1024
#: Ids that are joined at once.
RUN = 4096
#: Rebuilt conversations take fewer than this many turns of another.
HEADS = 9


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv, pos from 1, digest, bytes): the turns in order, without their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    at = Window.partitionBy("conv").orderBy("turn", "role", "text")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text")
    )
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), F.concat("role", "text")).cast("binary"), 256))
    return rows.select("conv", F.row_number().over(at).alias("pos"), digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with the first h turns of c - c % 5 in place of its own,
    h = crc32(c) % 9: turns (conv, depth, digest, bytes) and (conv, n turns)."""
    turns = written(numbered(conversations), "turns")
    borrowed = lambda c: F.crc32(c.cast("string").cast("binary")) % HEADS
    sizes = turns.groupBy("conv").agg(F.count("*").alias("own"))
    bases = sizes.select(F.col("conv").alias("base"), F.col("own").alias("there"))
    convs = sizes.withColumn("h", borrowed(F.col("conv"))).withColumn("base", F.col("conv") - F.col("conv") % 5)
    convs = convs.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("there", F.lit(0))))
    convs = written(convs.select("conv", "h", "head", (F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "convs")
    # of negative ids the base follows its conversations
    near = turns.where((F.col("conv") % 5 == 0) & (F.col("pos") < HEADS)).withColumn("base", F.col("conv"))
    near = near.withColumn("conv", F.explode(F.sequence(F.col("base") - 4, F.col("base") + 4)))
    near = near.where((F.col("conv") - F.col("conv") % 5 == F.col("base")) & (F.col("pos") <= borrowed(F.col("conv"))))
    heads = near.join(convs.select("conv"), "conv", "left_semi").select("conv", F.col("pos").cast("long").alias("depth"), "digest", "bytes")
    own = turns.join(convs, "conv").where(F.col("pos") > F.col("h"))
    tails = own.select("conv", (F.col("pos") - F.col("h") + F.col("head")).alias("depth"), "digest", "bytes")
    return heads.unionByName(tails), convs.select("conv", "n")


def _chained(key: Column, digest: Column) -> Column:
    return F.unhex(F.sha2(F.concat(key, digest), 256))


def _step(rest: DataFrame, first: int, last: int) -> DataFrame:
    """(conv, n, depth, bytes, pkey, key) of the depths first to last."""
    own = rest.where(F.col("depth") <= last)
    if first == last:
        return own.select("conv", "n", "depth", "bytes", F.col("key").alias("pkey"), _chained(F.col("key"), F.col("digest")).alias("key"))
    own = own.groupBy("conv", "n", "key").agg(F.sort_array(F.collect_list(F.struct("depth", "digest", "bytes"))).alias("s"))
    chain = lambda keys, x: F.concat(keys, F.array(_chained(F.element_at(keys, -1), x["digest"])))
    own = own.withColumn("keys", F.aggregate("s", F.array("key"), chain))
    own = own.select("conv", "n", "keys", F.posexplode("s").alias("i", "x"))
    return own.select("conv", "n", "x.depth", "x.bytes", F.col("keys")[F.col("i")].alias("pkey"), F.col("keys")[F.col("i") + 1].alias("key"))


def _ends(ended: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of the ids (conv) of a key, ascending and joined by commas."""
    runs = ended.groupBy("key", F.floor(F.col("conv") / RUN).alias("run")).agg(
        F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends": [sha.hexdigest()]})

        for batch in batches:
            done = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k == key:
                    sha.update(b",")
                else:
                    if key is not None:
                        done.append(row())
                    key, sha = k, hashlib.sha256()
                sha.update(ids.encode())
            yield from done
        if key is not None:
            yield row()

    dealt = runs.repartition(parallelism(ended.sparkSession), "key").sortWithinPartitions("key", "run")
    return dealt.mapInArrow(digest, "key binary, ends string")


def prefix_trie(turns: DataFrame, convs: DataFrame, levels: int = LEVELS, step: int = STEP) -> DataFrame:
    """A row for each node: (conv, depth, parent, n_convs, n_children, n_leaves, saved, ends).

    ``turns``: (conv, depth from 1 without gaps, digest, bytes), ``convs``: (conv,
    n turns), a row for each. ``parent`` is the least conversation of the node
    above, ``saved`` the bytes that are stored once instead of once a conversation,
    over the node's subtree.
    """
    scratch = Scratch()
    root = F.unhex(F.sha2(F.lit("").cast("binary"), 256))
    rest = scratch(turns.join(convs, "conv").withColumn("key", root), "live")
    steps, a = [], 0
    while not rest.isEmpty():
        b = a + 1 if a < levels else a + max(1, min(a // 2, step))
        rows = _step(rest, a + 1, b)
        grouped = rows.groupBy("depth", "pkey", "key").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("n").alias("n"))
        nodes = scratch(grouped, "nodes")
        alone = nodes.where((F.col("n_convs") == 1) & (F.col("depth") == b)).select("conv")
        left = rest.where(F.col("depth") > b).drop("key")
        chains = left.join(alone, "conv", "left_semi").select("conv", "depth", "n")
        shared = rows.where((F.col("depth") == b) & (F.col("n") > b)).select("conv", "key").join(alone, "conv", "left_anti")
        steps.append((a, b, rows, nodes, chains))
        rest, a = scratch(left.join(shared, "conv"), "live"), b

    # upwards: sums of the children, by their parent's key
    kids, totals = None, []
    for a, b, rows, nodes, _ in reversed(steps):
        sums = nodes.groupBy(F.col("pkey").alias("k")).agg(F.count("*").alias("n_children")) if b > a + 1 else None
        if kids is not None:
            below = kids.select("k", "n_children")
            sums = below if sums is None else sums.unionByName(below)
        own = nodes.join(sums, nodes.key == sums.k, "left").drop("k") if sums is not None else nodes.withColumn("n_children", F.lit(None).cast("long"))
        if kids is not None:
            own = own.join(kids.select("k", "leaves", "saved"), own.key == kids.k, "left").drop("k")
        else:
            own = own.withColumns({"leaves": F.lit(None).cast("long"), "saved": F.lit(None).cast("long")})
        one = F.col("n_convs") == 1
        own = own.withColumn("n_children", F.when(one, (F.col("n") > F.col("depth")).cast("long")).otherwise(F.coalesce("n_children", F.lit(0).cast("long"))))
        # a lone conversation's leaf counts once in a step: at the last of its depths
        leaf = F.when(one, F.col("depth") == F.least("n", F.lit(b))).otherwise(F.col("n_children") == 0).cast("long")
        own = own.withColumns(
            {"leaves": F.coalesce("leaves", F.lit(0)) + leaf, "saved": F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("bytes")}
        )
        if b > a + 1:
            # what a node has counts for all nodes above it in the step: those on its least conversation's path
            here = scratch(own, "own")
            path = rows.select("conv", "depth", "key").join(here.select("conv", "depth", "leaves", "saved"), ["conv", "depth"], "left")
            up = Window.partitionBy("conv").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
            path = path.select("key", F.sum("leaves").over(up).alias("leaves"), F.sum("saved").over(up).alias("saved"))
            whole = path.groupBy(F.col("key").alias("k")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
            own = here.drop("leaves", "saved").join(whole, F.col("key") == F.col("k")).drop("k")
        total = scratch(own.select("key", "pkey", "conv", "depth", "n_convs", "n_children", "leaves", "saved"), "totals")
        totals.append(total)
        kids = total.where(F.col("depth") == a + 1).groupBy(F.col("pkey").alias("k")).agg(F.count("*").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    long = lambda x: F.lit(x).cast("long")
    top = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0").withColumn("key", root)
    if kids is None:
        top = top.withColumns({"n_children": long(0), "leaves": long(1), "saved": long(0)})
    else:
        top = top.join(kids, F.col("key") == F.col("k"), "left").drop("k")
    top = top.select("key", F.lit(None).cast("binary").alias("pkey"), "conv", long(0).alias("depth"), "n_convs", "n_children", "leaves", "saved")
    top = scratch(top, "totals")

    ended = convs.where("n = 0").select("conv", root.alias("key"))
    nodes, chains = top, None
    for (_, _, rows, _, chain), total in zip(steps, reversed(totals), strict=True):
        ended = ended.unionByName(rows.where(F.col("depth") == F.col("n")).select("conv", "key"))
        nodes = nodes.unionByName(total)
        chains = chain if chains is None else chains.unionByName(chain)
    ends = _ends(ended)
    above = nodes.where("n_convs > 1 OR depth = 0").select(F.col("key").alias("k"), F.col("conv").alias("parent"))
    found = nodes.join(ends, "key", "left").join(above, F.col("pkey") == F.col("k"), "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    made = ["conv", "depth", "parent", "n_convs", "n_children", "leaves", "saved", "ends"]
    found = found.withColumns(
        {"parent": F.when(F.col("depth") > 0, F.coalesce("parent", "conv")), "ends": F.coalesce("ends", none)}
    ).select(*made)
    if chains is not None:
        done = F.col("depth") == F.col("n")
        found = found.unionByName(
            chains.select(
                "conv", "depth", F.col("conv").alias("parent"), long(1).alias("n_convs"), (~done).cast("long").alias("n_children"), long(1).alias("leaves"), long(0).alias("saved"),
                F.when(done, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(none).alias("ends"),
            )
        )
    out = written(found.withColumnRenamed("leaves", "n_leaves"), "trie")
    scratch.remove()
    return out
