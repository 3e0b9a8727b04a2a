"""Near-duplicate documents: word shingles with a Jaccard similarity of 0.8 or more.

Fingerprints, shingles, the tree of vantage points and components are those of
:mod:`simhash`; fingerprints are of the set of shingles. The tree deals points
out to pieces, by distances to vantage points and then by ranges of sizes, and
a point meets each piece that neither the triangle bound nor the ratio of sizes
rules out for its radius; so all pairs within the radius are met, and none is
left to a chance of meeting. At this similarity fingerprints differ in 15 % of
their bits, a radius which rules out little but what sizes rule out: comparisons,
of 8 bytes each, grow as the square of the points. Pairs within reach in the
first 64 bits and within WIDE_REACH in all 256 are links of a coarse partition:
texts of its components are read again, and linked by the similarity itself. A
pair right at 0.8 is within both with probability 0.9999.

The latter step works alike on components of any size. Every member is first
compared with its component's least member, in one join. Members near it are linked; of the
others ("rest"), if there are any, each is compared with all members, in blocks
of bounded bytes. So a large group of copies costs one comparison of shingles a
member, no component meets in one task, and no pair of two near members is listed.

Defined results: texts of equal shingles are one point, so all texts without a
word are near each other; fewer words than a shingle are one shingle; repeated
passages have no weight; repeated rows are near each other; rows whose id is
null get no component; an empty table gives an empty table. Other columns of
the input, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import Forest, components
from .simhash import SAMPLE_PER_SHARD, TOP_SHARDS, VantageTree, _counted, _far, shingles
from .support import Scratch, parallelism, spread, texts_to_batches, written

WIDTH, LEAST = 5, 0.8
#: Of 64 bits 9.7 differ at a similarity of 0.8, with a deviation of 2.9; of 256 bits 38.7, with
#: a deviation of 5.7: these are more than 4 deviations more.
WORDS, REACH, WIDE_REACH = 4, 22, 64
#: Four of five shingles are the one case of more: 12 of 64 bits, and 48 of 256.
SMALL, SMALL_REACH, SMALL_WIDE_REACH = 5, 25, 74
#: Of the second 64 bits, to see soon which pairs are near in the first by chance: lost with a probability below 0.00001.
SECOND_REACH = 27
#: Points of a piece, of some 60 bytes each: two pieces meet in a task.
PIECE_ROWS = 200_000
#: Points of a piece at least, where tasks ask for more pieces.
LEAST_PIECE_ROWS = 1000
#: Rows of the driver's sample at most.
MAX_SAMPLE = 1 << 18
#: Bytes of a block of a group, and of what a task reads.
BLOCK_BYTES = 8 << 20
LEAST_BLOCK_BYTES = 32 << 10
#: For rounding: a similarity of exactly 0.8 counts.
SLACK = 1e-9
_WIDE = [f"w{k}" for k in range(WORDS)]


def set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def sketches(df: DataFrame, id_col: str, text: str, width: int = WIDTH) -> DataFrame:
    """(id, set_key, n, w0, ...) of the different shingles of each text: one narrow pass over whole texts."""

    def make(texts: list) -> list[pa.Array]:
        sets = [shingles(t, width) for t in texts]
        wide = np.zeros((len(sets), WORDS), dtype=np.int64)
        for k, own in enumerate(sets):
            total, n = _counted([own], WORDS)
            wide[k] = np.packbits(2 * total > n, bitorder="little").view("<i8")
        return [pa.array([set_key(own) for own in sets], pa.binary()), pa.array([len(own) for own in sets], pa.int64()), *[pa.array(w) for w in wide.T]]

    names = ["set_key", "n", *_WIDE]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return texts_to_batches(rows, "text", make, names, 4 << 20)

    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return spread(own).mapInArrow(run, "id long, set_key binary, n long, " + ", ".join(f"{w} long" for w in _WIDE))


def _close(least: float, prefix: str = "l_") -> Column:
    """Whether wide fingerprints and numbers of shingles allow the similarity."""
    differ = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(prefix + w))).cast("int") for w in _WIDE[1:]), F.bit_count(F.col(_WIDE[0]).bitwiseXOR(F.col(prefix + _WIDE[0]))).cast("int"))
    sizes = F.least("n", prefix + "n") >= (least - SLACK) * F.greatest("n", prefix + "n")
    return (differ <= F.when(F.greatest("n", prefix + "n") <= SMALL, SMALL_WIDE_REACH).otherwise(WIDE_REACH)) & sizes


class Pieces:
    """Pieces of points: leaves of a tree of vantage points, and ranges of sizes in each leaf.

    Leaves get ranges by their part of the sample. A size shared by many is cut by a hash of the point.
    """

    def __init__(self, fp: np.ndarray, n: np.ndarray, rep: np.ndarray, pieces: int, least: float):
        self.least = least
        self.tree = VantageTree(fp, min(TOP_SHARDS, max(1, round(pieces**0.5))))
        self.cuts = [np.zeros(0, dtype=np.int64)] * self.tree.shards
        key = self._key(n, rep)
        for leaf, at, home in self.tree.visit(fp, 0):
            own = np.sort(key[at[home]])
            ranges = max(1, round(pieces * len(own) / len(fp)))
            if len(own):
                self.cuts[leaf] = own[np.arange(1, ranges) * len(own) // ranges]
        self.base = np.cumsum([0, *(len(c) + 1 for c in self.cuts)])
        self.count = int(self.base[-1])

    @staticmethod
    def _key(n: np.ndarray, rep: np.ndarray) -> np.ndarray:
        mixed = rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (n << 20) + (mixed >> np.uint64(44)).astype(np.int64)

    def meet(self, fp: np.ndarray, n: np.ndarray, rep: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, their home, a piece they meet), in parts: each point meets its home once, and
        each other piece that may hold a point near it."""
        key = self._key(n, rep)
        small = np.ceil(self.least * n - SLACK).astype(np.int64) << 20
        large = (np.floor(n / self.least + SLACK).astype(np.int64) + 1 << 20) - 1
        visits = list(self.tree.visit(fp, SMALL_REACH))
        homes = np.zeros(len(fp), dtype=np.int64)
        for leaf, at, home in visits:
            homes[at[home]] = self.base[leaf] + np.searchsorted(self.cuts[leaf], key[at[home]], "right")
        for leaf, at, _ in visits:
            first, last = (np.searchsorted(self.cuts[leaf], x[at], "right") for x in (small, large))
            for k in range(len(self.cuts[leaf]) + 1):
                some = at[(first <= k) & (k <= last)]
                if len(some):
                    yield some, homes[some], np.full(len(some), self.base[leaf] + k)


def near_prints(t: np.ndarray, q: np.ndarray, fp: np.ndarray, n: np.ndarray, least: float, seen: Callable, slice_rows: int = 1024) -> None:
    """Call ``seen(rows of t, rows of q)`` for all pairs within reach in 64 bits whose sizes, but for
    the slice's width, allow the similarity. If q is t, each pair comes at least once.

    In a slice of sizes both sides are ordered by their distance to a vantage point.
    """
    same = q is t
    t = t[np.argsort(n[t], kind="stable")]
    q = t if same else q[np.argsort(n[q], kind="stable")]
    nq = n[q]
    for k in range(0, len(t), slice_rows):
        own = t[k : k + slice_rows]
        start = np.searchsorted(nq, least * n[own[0]] - SLACK)
        other = q[max(start, k if same else 0) : np.searchsorted(nq, n[own[-1]] / least + SLACK, "right")]
        reach = SMALL_REACH if n[own[0]] <= SMALL else REACH
        vantage = int(fp[own[len(own) // 2]])
        dt, dq = _far(fp[own], vantage), _far(fp[other], vantage)
        own, other = own[np.argsort(dt, kind="stable")], other[np.argsort(dq, kind="stable")]
        dt.sort()
        dq.sort()
        ft, fq = fp[own], fp[other]
        # blocks of half a megabyte stay in a core's cache
        for i in range(0, len(own), 16):
            block = ft[i : i + 16, None]
            stop = np.searchsorted(dq, dt[i : i + 16][-1] + reach, "right")
            for j in range(np.searchsorted(dq, dt[i] - reach), stop, 4096):
                some = fq[j : min(j + 4096, stop)]
                at = np.flatnonzero(np.bitwise_count(block ^ some) <= reach)
                if len(at):
                    seen(own[i + at // len(some)], other[j + at % len(some)])


def vantage_links(points: DataFrame, least: float, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(a, b): links that connect points (rep, n, w0, ...) whose fingerprints and sizes are near.

    Two pieces meet in a task, which returns a spanning forest of their links, not the links.
    """
    spark = points.sparkSession
    total = points.count()
    pieces = max(-(-total // piece_rows), min(math.ceil((4 * parallelism(spark)) ** 0.5), -(-total // LEAST_PIECE_ROWS)))
    rows = min(MAX_SAMPLE, SAMPLE_PER_SHARD * pieces) if pieces > 1 else 0
    sample = points.select("w0", "n", "rep").orderBy(F.xxhash64("w0", "n"), "rep").limit(rows).toArrow()
    dealt_by = Pieces(sample["w0"].to_numpy().view(np.uint64), sample["n"].to_numpy(), sample["rep"].to_numpy(), pieces, least)
    count = dealt_by.count
    names = ["rep", "n", *_WIDE]

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The piece of two with the lesser number has the targets."""
        for batch in rows:
            rep, n, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for at, home, met in dealt_by.meet(fp.view(np.uint64), n, rep):
                cell = np.minimum(home, met) * count + np.maximum(home, met)
                some = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(home <= met), *some.columns], names=["cell", "target", *names])

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        target, rep, n = (table[c].to_numpy() for c in ("target", "rep", "n"))
        wide = np.stack([table[w].to_numpy() for w in _WIDE], axis=1).view(np.uint64)
        first, second = (np.ascontiguousarray(wide[:, k]) for k in range(2))
        forest = Forest(len(rep))
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def unite() -> None:
            if held:
                forest.unite(*(np.concatenate(x) for x in zip(*held)))
                held.clear()

        def seen(x: np.ndarray, y: np.ndarray) -> None:
            near = np.flatnonzero(np.bitwise_count(second[x] ^ second[y]) <= SECOND_REACH)
            x, y = x[near], y[near]
            new = forest.label[x] != forest.label[y]
            x, y = x[new], y[new]
            less, more = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            ok = np.bitwise_count(wide[x] ^ wide[y]).sum(axis=1, dtype=np.int64) <= np.where(more <= SMALL, SMALL_WIDE_REACH, WIDE_REACH)
            ok &= less >= (least - SLACK) * more
            if ok.any():
                held.append((x[ok], y[ok]))
                if sum(len(x) for x, _ in held) >= 1 << 14:
                    unite()

        t, q = np.flatnonzero(target), np.flatnonzero(~target)
        cell = table["cell"][0].as_py()
        if len(q) or cell // count == cell % count:
            near_prints(t, q if len(q) else t, first, n, least, seen)
        unite()
        moved = np.flatnonzero(forest.label != np.arange(len(rep)))
        return pa.table({"a": rep[moved], "b": rep[forest.label[moved]]})

    kinds = "cell long, target boolean, " + ", ".join(f"{c} long" for c in names)
    return points.select("rep", "n", *_WIDE).mapInArrow(deal, kinds).groupBy("cell").applyInArrow(search, "a long, b long")


def group_links(members: DataFrame, near: Column, least: float, block_bytes: int, scratch: Scratch) -> DataFrame:
    """(a, b): links that connect what is near in each group.

    Members: (g, lead, rep, n, w0, ..., shingles), each rep once a group g,
    ``lead`` being its least rep. ``near`` tells whether a member is near its leader (columns l_...).
    """
    spark = members.sparkSession
    carried = ["n", *_WIDE, "shingles"]
    leaders = members.where("rep = lead").select(F.col("g").alias("l_g"), *[F.col(c).alias(f"l_{c}") for c in carried])
    # a hot group's join is split by Spark: what follows doesn't rely on its partitioning
    led = members.where("rep != lead").join(leaders, F.col("g") == F.col("l_g")).select("g", "lead", "rep", near.alias("near"))
    led = scratch(led, "led")
    stars = led.where("near").select(F.col("rep").alias("a"), F.col("lead").alias("b"))

    weight = F.lit(64) + 8 * F.col("n")
    rest = led.where("NOT near").groupBy("g").agg(F.count("*").alias("n_rest"))
    left = members.join(rest, "g").join(led.select("g", "rep", "near"), ["g", "rep"], "left")
    left = scratch(left.withColumn("near", F.coalesce("near", F.lit(True))), "left")
    of = scratch(left.groupBy("g").agg(F.sum(weight).alias("all"), F.sum(F.when(~F.col("near"), weight)).alias("some")), "sizes")
    total = of.agg(F.sum("all")).first()[0]
    if not total:
        return stars
    # of little there are small blocks, so that no task has much more than others
    block_bytes = min(block_bytes, max(LEAST_BLOCK_BYTES, total // (4 * parallelism(spark))))
    of = of.select("g", *[F.ceil(F.col(c) / F.lit(block_bytes)).cast("int").alias(c) for c in ("all", "some")], F.col("all").alias("bytes"))
    bytes_ = of.agg(F.sum(F.col("bytes") * (F.col("all") + F.col("some")))).first()[0]
    # each of the rest meets each block of members, each member each block of the rest
    tasks = max(4 * parallelism(spark), -(-bytes_ // (2 * block_bytes)))
    block = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
    to = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = left.join(of, "g")
    asking = left.where("NOT near").withColumn("i", block("some")).withColumn("j", to("all")).withColumn("asks", F.lit(True))
    asked = left.withColumn("j", block("all")).withColumn("i", to("some")).withColumn("asks", F.lit(False))
    names = ["g", "i", "j", "asks", "near", "lead", "rep", *carried]
    both = asking.select(*names).unionByName(asked.select(*names)).withColumn("task", F.pmod(F.xxhash64("g", "i", "j"), F.lit(tasks)))
    found = both.groupBy("task").applyInArrow(_search(least), "a long, b long")
    return stars.unionAll(found)


def _search(least: float) -> Callable[[pa.Table], pa.Table]:
    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        col = {c: table[c].to_numpy() for c in ("g", "i", "j", "asks", "near", "lead", "rep", "n", *_WIDE)}
        wide = np.stack([col[w] for w in _WIDE], axis=1).view(np.uint64)
        order = np.lexsort((~col["asks"], col["j"], col["i"], col["g"]))
        same = np.ones(len(order), dtype=bool)
        for c in ("g", "i", "j"):
            same[1:] &= col[c][order][1:] == col[c][order][:-1]
        starts = np.flatnonzero(~same) if not same[0] else np.concatenate([[0], np.flatnonzero(~same)])
        sets = table["shingles"].chunk(0)
        a, b = [], []
        for start, stop in zip(starts, [*starts[1:], len(order)]):
            rows = order[start:stop]
            q, t = rows[col["asks"][rows]], rows[~col["asks"][rows]]
            for x, y in _block(q, t, col, wide, sets, least):
                a.append(x)
                b.append(y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return search


def _block(q: np.ndarray, t: np.ndarray, col: dict, wide: np.ndarray, sets: pa.Array, least: float) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest between rows q, each compared with all rows t."""
    rep, n = col["rep"], col["n"]
    label: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := label.get(x, x)) != x:
            label[x] = x = label.get(up, up)
        return x

    # members near the leader are one already
    names = np.where(col["near"][t], col["lead"][t], rep[t])
    known: dict[int, np.ndarray] = {}

    def shingles_of(row: int) -> np.ndarray:
        if row not in known:
            known[row] = sets[row].values.to_numpy(zero_copy_only=False)
        return known[row]

    for k in q.tolist():
        ok = np.bitwise_count(wide[t] ^ wide[k]).sum(axis=1, dtype=np.int64) <= np.where(np.maximum(n[t], n[k]) <= SMALL, SMALL_WIDE_REACH, WIDE_REACH)
        ok &= np.minimum(n[t], n[k]) >= (least - SLACK) * np.maximum(n[t], n[k])
        for at in np.flatnonzero(ok).tolist():
            row, me = int(t[at]), root(int(rep[k]))
            other = root(int(names[at]))
            if me == other:
                continue
            both = len(np.intersect1d(shingles_of(k), shingles_of(row), assume_unique=True))
            if both < least * (n[k] + n[row] - both) - SLACK:
                continue
            label[max(me, other)] = min(me, other)
            yield int(rep[k]), int(rep[row])


def near_documents(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, least: float = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, component): the least id reachable by links of a similarity of ``least`` (0.8 or more) or above."""
    prints = written(sketches(df, id_col, text, width), "sketches")
    packed = F.max(F.struct("n", *_WIDE)).alias("x")
    points = prints.where("id IS NOT NULL").groupBy("set_key").agg(F.min("id").alias("id"), packed)
    # points have numbers of their own: an id may be repeated
    scratch = Scratch()
    points = scratch(points.select("set_key", "id", F.monotonically_increasing_id().alias("rep"), "x.*"), "points")

    candidates = scratch(components(vantage_links(points, least)), "candidates")

    # the texts of candidates, and what holds of them
    both = candidates.select("node", F.col("component").alias("g")).unionAll(candidates.select("component", "component").distinct())
    own = points.join(both, F.col("rep") == F.col("node"))
    own = own.join(df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")), "id")

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingles in place of the text; of repeated ids the rows whose text isn't the point's go."""
        for batch in texts_to_batches(rows, "text", lambda texts: [pa.array([shingles(t, width).tobytes() for t in texts], pa.binary())], ["packed"], 4 << 20):
            held = batch.column(batch.schema.get_field_index("packed")).to_pylist()
            keys = batch.column(0).to_pylist()
            good = [k for k, x in enumerate(held) if hashlib.blake2b(x, digest_size=16).digest() == keys[k]]
            some = batch.take(pa.array(good, pa.int64()))
            sets = [np.frombuffer(held[k], dtype=np.int64) for k in good]
            ends = np.cumsum([0, *map(len, sets)])
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            columns = [some.column(some.schema.get_field_index(c)) for c in ("g", "rep", "n", *_WIDE)]
            yield pa.RecordBatch.from_arrays([*columns, listed], names=["g", "rep", "n", *_WIDE, "shingles"])

    kinds = "g long, rep long, n long, " + ", ".join(f"{w} long" for w in _WIDE) + ", shingles array<long>"
    members = own.select("set_key", "g", "rep", "n", *_WIDE, "text").mapInArrow(read, kinds)
    # rows of equal id and text are one
    members = scratch(members.withColumn("lead", F.col("g")).dropDuplicates(["g", "rep"]), "members")
    common = F.size(F.array_intersect("shingles", "l_shingles"))
    links = group_links(members, _close(least) & (common >= least * (F.col("n") + F.col("l_n") - common) - SLACK), least, block_bytes, scratch)
    of = points.select("set_key", "id", "rep").join(components(links), F.col("rep") == F.col("node"), "left")
    of = written(of.select("set_key", "id", F.coalesce("component", "rep").alias("c")), "point-components")
    scratch.remove()
    of = of.select("set_key", "c").join(of.groupBy("c").agg(F.min("id").alias("component")), "c").select(F.col("set_key").alias("p_key"), "component")
    out = prints.join(of, F.col("set_key") == F.col("p_key"), "left")
    return out.select("id", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
