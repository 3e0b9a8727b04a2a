"""Near-duplicate vectors by counting collisions of sorted projections.

Unit vectors are projected on PROJECTIONS random directions. Two vectors
collide in a projection if one lies in the window centred on the other; pairs
with enough collisions are verified by their cosine in double precision. The
number of collisions asked for is calibrated: a pair right at the least cosine
reaches it with probability RECALL.

The first projection is cut into blocks of equal counts, of BLOCK_ROWS vectors
or less. A task takes two blocks, or one with itself; a vector goes to the tasks
of its block with each block that its (wider) window reaches. There the vectors
of one block are sorted by every projection and cut into bins, the windows of
the other's become runs of bins, and the task counts in blocks of bytes which
bins lie in which runs. It returns a row for each vector with a link - its
links' number and its root in a spanning forest - not the pairs. However close
vectors are to each other, a block has so many of them only.

Projections of a few dozen dimensions leave about half of all pairs in a window,
so comparisons grow nearly as the square of the vectors, and the copies of a
vector as their number over BLOCK_ROWS.

Defined results: equal vectors are one point and link with each other; vectors
that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different lengths never link; repeated rows count as
copies; rows whose id is null get no component; an empty table gives an empty
table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, components
from .support import parallelism, written

LEAST_COSINE = 0.9
PROJECTIONS = 24
RECALL = 0.9999
#: Half-widths, in standard deviations of the difference at the least cosine.
WINDOW, SORT_WINDOW = 2.5, 3.5
#: Vectors of a block at most; so many at least, before a small table is cut for the sake of more tasks.
BLOCK_ROWS, LEAST_ROWS = 32768, 2048
#: A block is cut into so many bins a projection; one more number is for a window without any.
BINS = 255
#: Cosines this near the limit are summed in one way.
EDGE = 1e-9


def directions(dim: int, n: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng([20240101, dim]).standard_normal((dim, n))


def least_collisions(n: int, window: float, recall: float) -> int:
    """Largest count that Binomial(n, P(|N(0,1)| <= window)) reaches with probability ``recall``."""
    p = math.erf(window / math.sqrt(2))
    reached = 0.0
    for k in range(n, -1, -1):
        reached += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if reached >= recall:
            return k
    return 0


def unit(rows: np.ndarray) -> np.ndarray:
    """Unit rows in double precision; scaled first, so that no square over- or underflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def windows(t: np.ndarray, q: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each projection (a row): the bin of each value of t, and of each value of
    q the first bin of its window and the number of further ones. Bins hold equal
    counts of t in sorted order; a window takes all bins that it touches."""
    n = len(t)
    place, first, more = (np.zeros((t.shape[1], len(x)), dtype=np.uint8) for x in (t, q, q))
    for j in range(t.shape[1]):
        order = np.argsort(t[:, j], kind="stable")
        bins = (np.arange(n) * BINS // n).astype(np.uint8)
        place[j, order] = bins
        low, high = (np.searchsorted(t[order, j], q[:, j] + x, side=side) for x, side in ((-reach, "left"), (reach, "right")))
        some = low < high
        first[j] = np.where(some, bins[np.minimum(low, n - 1)], BINS)
        more[j] = np.where(some, bins[high - 1] - first[j], 0)
    return place, first, more


def links(t: np.ndarray, q: np.ndarray | None, least: float, seen) -> None:
    """Call ``seen(places in t, places in q)`` for linked pairs of unit rows; without
    q, of the rows of t with each other, each pair once."""
    same = q is None
    sd = math.sqrt(2 * (1 - least))
    a = directions(t.shape[1])
    pt = t @ a
    order_t = np.argsort(pt[:, 0], kind="stable")
    t, pt = t[order_t], pt[order_t]
    if same:
        q, pq, order_q = t, pt, order_t
    else:
        pq = q @ a
        order_q = np.argsort(pq[:, 0], kind="stable")
        q, pq = q[order_q], pq[order_q]
    place, first, more = windows(pt, pq, WINDOW * sd)
    need, wide, step = least_collisions(PROJECTIONS, WINDOW, RECALL), SORT_WINDOW * sd, 256
    for k in range(0, len(q), step):
        rows = slice(k, min(k + step, len(q)))
        low, high = np.searchsorted(pt[:, 0], [pq[rows][0, 0] - wide, pq[rows][-1, 0] + wide])
        if same:
            high = min(high, rows.stop)  # later ones ask themselves
        for m in range(low, high, 4096):
            cols = slice(m, min(high, m + 4096))
            shape = (rows.stop - rows.start, cols.stop - cols.start)
            count, off, hit = np.zeros(shape, np.uint8), np.empty(shape, np.uint8), np.empty(shape, bool)
            for j in range(PROJECTIONS):
                # unsigned: a bin before the first is far behind the last
                np.subtract(place[j, cols][None, :], first[j, rows][:, None], out=off)
                np.less_equal(off, more[j, rows][:, None], out=hit)
                np.add(count, hit.view(np.uint8), out=count)
            passed = count >= need
            if same:
                passed &= np.arange(*cols.indices(len(t)))[None, :] < np.arange(*rows.indices(len(q)))[:, None]
            y, x = np.nonzero(passed)
            if not len(x):
                continue
            if len(x) > passed.size // 50:
                cosine = (q[rows] @ t[cols].T)[y, x]
                edge = np.flatnonzero(np.abs(cosine - least) < EDGE)
                cosine[edge] = np.einsum("ij,ij->i", q[rows][y[edge]], t[cols][x[edge]])
            else:
                cosine = np.einsum("ij,ij->i", q[rows][y], t[cols][x])
            good = cosine >= least
            if good.any():
                seen(order_t[x[good] + m], order_q[y[good] + k])


def near_vectors(df: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", least: float = LEAST_COSINE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, n_links, component): number of linked other rows, least id reachable."""
    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("id").isNotNull()
    good = own.where(usable)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(3).to_numpy(zero_copy_only=False)
            for dim in np.unique(size):
                part = batch.filter(pa.array(size == dim))
                p = unit(matrix(part.column(2), dim)) @ directions(dim)[:, 0]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], names=["rep", "copies", "v", "dim", "p"])

    kind = own.schema["v"].dataType.simpleString()
    points = good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).select("rep", "copies", "v", F.size("v").alias("dim"))
    points = written(points.mapInArrow(project, f"rep long, copies long, v {kind}, dim int, p double"), "vectors")
    n = points.count()
    blocks = max(1, -(-n // block_rows), min(math.isqrt(4 * parallelism(df.sparkSession)) + 1, -(-n // LEAST_ROWS)))
    cuts = np.unique(points.approxQuantile("p", [k / blocks for k in range(1, blocks)], 0.02 / blocks)) if blocks > 1 else np.zeros(0)
    wide = SORT_WINDOW * math.sqrt(2 * (1 - least))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(4).to_numpy(zero_copy_only=False)
            home, low, high = (np.searchsorted(cuts, p + x, side="right") for x in (0, -wide, wide))
            for other in range(low.min(), high.max() + 1):
                at = np.flatnonzero((low <= other) & (other <= high))
                if len(at):
                    some, own = batch.take(pa.array(at)), home[at]
                    task = np.minimum(own, other) * (len(cuts) + 1) + np.maximum(own, other)
                    # of two blocks the lower one's vectors are targets
                    yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.array(task), pa.array(own <= other), pa.array(own == other)], names=["rep", "copies", "v", "dim", "task", "target", "same"])

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dim, rep, copies = table["dim"][0].as_py(), table["rep"].to_numpy(), table["copies"].to_numpy()
        x, same = unit(matrix(table["v"].chunk(0), dim)), table["same"][0].as_py()
        t = np.flatnonzero(table["target"].to_numpy())
        q = t if same else np.flatnonzero(~table["target"].to_numpy())
        forest, number = Forest(len(rep)), np.zeros(len(rep), dtype=np.int64)

        def seen(i: np.ndarray, j: np.ndarray) -> None:
            i, j = t[i], q[j]
            np.add.at(number, i, copies[j])
            np.add.at(number, j, copies[i])
            forest.unite(i, j)

        if len(t) and len(q):
            links(x[t], None if same else x[q], least, seen)
        some = np.flatnonzero(number)
        return pa.table({"rep": rep[some], "links": number[some], "root": rep[forest.label[some]]})

    dealt = points.mapInArrow(deal, f"rep long, copies long, v {kind}, dim int, task long, target boolean, same boolean")
    found = written(dealt.groupBy("dim", "task").applyInArrow(search, "rep long, links long, root long"), "vector-links")
    number = found.groupBy("rep").agg(F.sum("links").alias("links"))
    member = components(found.select("rep", "root"), "rep", "root")
    several = points.where("copies > 1").select(F.col("v").alias("c_v"), F.col("rep").alias("c_rep"), "copies")
    out = own.withColumn("u", F.when(usable, F.col("v"))).drop("v").join(several, F.col("u") == F.col("c_v"), "left")
    out = out.select("id", F.coalesce("c_rep", "id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
    out = out.join(number, "rep", "left").join(member.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select(
        "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
