"""SimHash near-duplicates through vantage-point trees.

Near-duplicates by the similarity of shingles, for which the radius would be
too wide for such a tree, are in :mod:`similar`.

Fingerprints are partitioned by Hamming distance to vantage points. A tree fit
on a bounded sample splits all distinct fingerprints into shards; every
fingerprint is at home in one shard, and also queries each shard which the
triangle bound cannot rule out for its radius (later ones only: of a pair one asks). Inside a shard the same bound
prunes by bands of equal distance to further vantage points, and what remains
is compared exactly, so no pair within the radius is missed.

Defined results: a text that is null or has no word has fingerprint zero and is
linked like any other; fewer words than a shingle are one shingle; repeated
rows share a fingerprint; rows whose id is null have a fingerprint and no
component; an empty table gives an empty table. Other columns of the input,
whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, components
from .support import parallelism, spread, texts_to_batches, written

SEED = 42
#: A shard's fingerprints are 8 bytes each; this many are compared in seconds.
SHARD_ROWS = 60_000
#: Leaves of the tree at most, and sample rows for each; the tree has two numbers a split.
TOP_SHARDS = 1024
SAMPLE_PER_SHARD = 64
_BREAK = re.compile(rb"[\x20\x09-\x0D]")


def _hashes(text: str | None, width: int, block: int = 1 << 20) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles; long texts go through in blocks."""
    import xxhash

    data = (text or "").encode("utf-8", "replace").lower()  # of bytes: A-Z only
    digest = xxhash.xxh64_intdigest
    some, held, at = False, [], 0
    while at < len(data):
        stop = at + block
        if stop < len(data):
            found = _BREAK.search(data, stop)
            stop = found.start() if found else len(data)
        held += data[at:stop].split()
        at = stop
        if len(held) < width:
            continue
        joined = b" ".join(held)
        ends = np.cumsum([len(w) + 1 for w in held]) - 1
        starts = [0, *(ends[: len(held) - width] + 1).tolist()]
        some = True
        yield np.array([digest(joined[i:j], SEED) for i, j in zip(starts, ends[width - 1 :].tolist())], dtype="<u8")
        held = held[1 - width :] if width > 1 else []
    if not some and held:
        yield np.array([digest(b" ".join(held), SEED)], dtype="<u8")


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The different hashes, sorted."""
    return np.unique(np.concatenate([np.array([], dtype="<u8"), *(np.unique(h) for h in _hashes(text, width))]))


def counters(text: str | None, width: int = 4, words: int = 1, block: int = 1 << 20) -> tuple[np.ndarray, int]:
    """For each of 64 * ``words`` bits the number of shingles whose hash has it,
    and the number of shingles.

    The first 64 bits are those of XXH64; further words are mixed from it.
    """
    return _counted(_hashes(text, width, block), words)


def _counted(parts: Iterable[np.ndarray], words: int) -> tuple[np.ndarray, int]:
    total, n = np.zeros(64 * words, dtype=np.int64), 0
    for hashes in parts:
        n += len(hashes)
        for k in range(0, len(hashes), 1 << 15):
            h = hashes[k : k + (1 << 15)]
            for w in range(words):
                bits = np.unpackbits((_mixed(h, w) if w else h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                total[64 * w : 64 * w + 64] += bits.sum(axis=0, dtype=np.int64)
    return total, n


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    h = h + np.uint64(word * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def fingerprint(text: str | None, width: int = 4, block: int = 1 << 20) -> int:
    """64-bit SimHash of word shingles; zero without a word."""
    total, n = counters(text, width, 1, block)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(id, fp long): one narrow pass over the whole texts."""

    def make(texts: list) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return texts_to_batches(rows, "text", make, ["fp"])

    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return spread(own).mapInArrow(run, "id long, fp long")


def _far(a: np.ndarray, v: int) -> np.ndarray:
    return np.bitwise_count(a ^ np.uint64(v)).astype(np.int16)


class VantageTree:
    """Splits by distance to a vantage point, at the median of the sample.

    ``nodes[i]`` is (vantage, radius, inner child, outer child), or a shard's
    number. Chosen vantage: of a few sample points that with the widest spread.
    """

    def __init__(self, sample: np.ndarray, shards: int):
        self.nodes: list = []
        self.shards = 0
        self._grow(sample, max(1, shards))

    def _grow(self, sample: np.ndarray, shards: int) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        if shards > 1 and len(sample) > 1:
            near = [_far(sample, int(v)) for v in sample[np.linspace(0, len(sample) - 1, 8).astype(int)]]
            best = int(np.argmax([d.std() for d in near]))
            d, v = near[best], int(sample[np.linspace(0, len(sample) - 1, 8).astype(int)][best])
            radius = int(np.median(d))
            if (d > radius).any():
                inner = self._grow(sample[d <= radius], shards // 2)
                self.nodes[at] = (v, radius, inner, self._grow(sample[d > radius], shards - shards // 2))
                return at
        self.nodes[at] = self.shards
        self.shards += 1
        return at

    def visit(self, fps: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, places in fps that are within reach of it, whether it is their home)."""
        stack = [(0, np.arange(len(fps)), np.ones(len(fps), dtype=bool))]
        while stack:
            at, rows, home = stack.pop()
            node = self.nodes[at]
            if not isinstance(node, tuple):
                if len(rows):
                    yield node, rows, home
                continue
            v, radius, inner, outer = node
            d = _far(fps[rows], v)
            for child, inside, may in ((inner, d <= radius, d - reach <= radius), (outer, d > radius, d + reach > radius)):
                stack.append((child, rows[may], (home & inside)[may]))


def pairs(t: np.ndarray, q: np.ndarray, reach: int, seen, ti=None, qi=None, depth: int = 0, room: int = 1 << 22) -> None:
    """Call ``seen(places in t, places in q)`` for all pairs within reach."""
    ti = np.arange(len(t)) if ti is None else ti
    qi = np.arange(len(q)) if qi is None else qi
    if len(ti) * len(qi) <= room or depth == 4 or len(ti) < 64:
        step = max(1, room // max(1, len(qi)))
        for k in range(0, len(ti), step):
            own = ti[k : k + step]
            for m in range(0, len(qi), room):
                other = qi[m : m + room]
                x, y = np.nonzero(np.bitwise_count(t[own][:, None] ^ q[other][None, :]) <= reach)
                if len(x):
                    seen(own[x], other[y])
        return
    v = int(t[ti[(len(ti) * (2 * depth + 1)) // 9]])
    dt, dq = _far(t[ti], v), _far(q[qi], v)
    for band in np.unique(dt):
        own, other = ti[dt == band], qi[np.abs(dq - band) <= reach]
        if len(other):
            pairs(t, q, reach, seen, own, other, depth + 1, room)


def near_duplicates(prints: DataFrame, reach: int = 4, shard_rows: int = SHARD_ROWS, top_shards: int = TOP_SHARDS) -> DataFrame:
    """(id, fp, component) of a table (id, fp): the least id reachable by links.

    Equal fingerprints are one point. A shard's task returns a spanning forest
    of its links, at most one row a point, not the links. The tree on the driver
    has ``top_shards`` leaves at most; leaves of more than ``shard_rows`` points are
    split again by a hash, and each part of a leaf is asked.
    """
    spark = prints.sparkSession
    points = written(prints.groupBy("fp").agg(F.min("id").alias("rep")), "points")
    n = points.count()
    shards = min(top_shards, max(1, -(-n // shard_rows)))
    sample = points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE_PER_SHARD * shards).toArrow() if shards > 1 else None
    tree = VantageTree(np.array([], dtype=np.uint64) if sample is None else sample["fp"].to_numpy().view(np.uint64), shards)
    # so many parts of a leaf's targets, and of the queries to each of them: the latter
    # few, or a large cluster would copy targets thousands of times
    split = max(1, -(-n // (tree.shards * shard_rows)))
    parts = max(1, min(6, 2 * parallelism(spark) // (tree.shards * split)))

    def dealt_to(fp: np.ndarray, factor: int, n: int) -> np.ndarray:
        return (fp * np.uint64(factor) >> np.uint64(40)).astype(np.int64) % n

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A point goes as target to one part of its home, for each part of the queries,
        and as query to each part of its home and of each later shard within reach."""
        for batch in rows:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            own, asked = dealt_to(fp, 0x9E3779B97F4A7C15, split), dealt_to(fp, 0xD6E8FEB86659FD93, parts)
            home = np.zeros(len(fp), dtype=np.int64)
            visits = list(tree.visit(fp, reach))
            for shard, at, is_home in visits:
                home[at[is_home]] = shard
            for shard, at, is_home in visits:
                kept, asks = at[is_home], at[is_home | (home[at] < shard)]
                for k in range(parts):
                    if len(kept):
                        yield rows_of(batch, kept, (shard * split + own[kept]) * parts + k, True)
                for k in range(split):
                    if len(asks):
                        yield rows_of(batch, asks, (shard * split + k) * parts + asked[asks], False)

    def rows_of(batch: pa.RecordBatch, at: np.ndarray, cell: np.ndarray, target: bool) -> pa.RecordBatch:
        some = batch.take(pa.array(at))
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(at), target)), *some.columns], names=["cell", "target", "fp", "rep"])

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        target, fp, rep = table["target"].to_numpy(), table["fp"].to_numpy().view(np.uint64), table["rep"].to_numpy()
        # places of equal points fall together: a query may also be a target
        order, place = np.unique(rep, return_inverse=True)
        forest = Forest(len(order))
        t, q = np.flatnonzero(target), np.flatnonzero(~target)
        pairs(fp[t], fp[q], reach, lambda x, y: forest.unite(place[t[x]], place[q[y]]))
        moved = np.flatnonzero(forest.label != np.arange(len(order)))
        return pa.table({"a": order[moved], "b": order[forest.label[moved]]})

    dealt = points.where("rep IS NOT NULL").mapInArrow(deal, "cell long, target boolean, fp long, rep long")
    linked = components(dealt.groupBy("cell").applyInArrow(search, "a long, b long"))
    of_point = points.join(linked, points.rep == linked.node, "left").select(F.col("fp").alias("p_fp"), F.coalesce("component", "rep").alias("component"))
    return prints.join(of_point, F.col("fp") == F.col("p_fp")).select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
