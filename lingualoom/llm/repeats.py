"""Remove every byte of a passage that stands earlier too, by suffix sorting.

A passage is a string of ``length`` bytes. Sorting all suffixes of a corpus at
once would put it into one task, so it is cut into shards in which equal
passages meet: a passage's anchor is the least hash of its grams of GRAM bytes,
which depends on its content alone, and a run of passages with one anchor is a
piece. Anchors of one piece only hold no repeat. Equal pieces are one for the
sort: of those, all but the first go with all their passages. Different pieces
with one anchor, and those that hold it twice, are the rest; they go to the anchor's shard, whose suffixes are
sorted with their common prefixes (see :mod:`suffixes`), and of each group of
suffixes that share ``length`` bytes all but the first go.

Hashes are of 64 bits; equal strings never differ in them. Different pieces with
one anchor and one hash (2^-64 a pair) would pass as equal.

A frequent anchor: each task sends on the first of equal pieces of a batch of
texts only, so an anchor's rows are no more than the batches. The shard of an
anchor with very many different pieces may be larger than others; its queue is
on disk.

Defined results: documents come in the order of their ids (none last), and of
their texts where ids repeat; equal rows follow one another in any order; a null
text is empty; matches never cross documents; an empty table gives an empty
table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffixes import ROOM, suffixes
from .support import Scratch, give_back, parallelism, spread, written

#: Bytes of a gram; of a block of text; of a shard.
GRAM = 48
BLOCK = 64 << 10
SHARD = 1 << 20
_BASE = 0x9E3779B97F4A7C15
#: Low bits of a gram's hash that hold its place instead where the least is sought; a block is shorter.
_PLACES = (1 << 23) - 1
#: Bit of a piece, beside the number of its passages, whose anchor stands at several places.
_AGAIN = 1 << 31
_SYMBOLS = np.random.default_rng(42).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Pieces:
    """Cuts a block of texts into pieces: runs of passages with one anchor."""

    def __init__(self, length: int, gram: int = GRAM):
        self.length, self.gram = length, min(gram, length)
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def cut(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(anchor, hash, text, first place in the block, passages, whether the anchor stands at
        several places) of the texts at ``starts``."""
        n, k, width = len(data), self.gram, self.length - self.gram + 1
        none = np.empty(0, dtype=np.int64)
        if n < self.length:
            return none.view(np.uint64), none.view(np.uint64), none, none, none, none.astype(bool)
        if len(self.up) <= n:
            self.up, self.down = _powers(_BASE, n + 1), _powers(pow(_BASE, -1, 1 << 64), n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_SYMBOLS[data] * self.up[:n], out=sums[1:])
        grams = _mixed((sums[k:] - sums[:-k]) * self.down[: n - k + 1])
        # least of each window of grams, and its first place: from the left and right ends of blocks of its width
        m = len(grams)
        keys = grams & ~np.uint64(_PLACES) | np.arange(m, dtype=np.uint64)
        padded = np.full(-(-m // width) * width, (1 << 64) - 1, dtype=np.uint64)
        padded[:m] = keys
        padded = padded.reshape(-1, width)
        left = np.minimum.accumulate(padded, axis=1).ravel()
        right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(right[: m - width + 1], left[width - 1 : m]) & np.uint64(_PLACES)).view(np.int64)
        least = grams[place]
        inside = np.zeros(len(least) + 1, dtype=np.int8)
        some = sizes >= self.length
        np.add.at(inside, starts[some], 1)
        np.add.at(inside, starts[some] + sizes[some] - self.length + 1, -1)
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        change = np.flatnonzero(least[1:] != least[:-1]) + 1
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        cuts = np.unique(np.concatenate([[0], change, edge, [len(least)]]))
        first, last = cuts[:-1], cuts[1:]
        own = inside[first]
        first, last = first[own], last[own]
        whole = (sums[last + self.length - 1] - sums[first]) * self.down[first]
        text = np.searchsorted(starts, first, side="right") - 1
        again = place[first] != place[last - 1]
        return least[first], _mixed(whole + (last - first).astype(np.uint64) * np.uint64(_BASE)), text, first, last - first, again


def _blocks(batch: pa.RecordBatch, overlap: int, size: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(row, offset, bytes) of texts in the order of rows, in blocks of about ``size`` bytes; long texts in parts that overlap."""
    rows, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())
    block: tuple[list, list, list] = ([], [], [])
    held = 0
    for i in sorted(range(len(rows)), key=rows.__getitem__):
        text = texts[i].as_py() or b""
        for at in range(0, max(1, len(text) - overlap), size):
            part = text[at : at + size + overlap]
            for x, y in zip(block, (rows[i], at, part), strict=True):
                x.append(y)
            held += len(part)
            if held >= size:
                yield block
                block, held = ([], [], []), 0
    if held:
        yield block


def _found(docs: DataFrame, length: int, block: int) -> DataFrame:
    """(row, at, key): pieces that go whole (key null), and those that differ from another with their anchor (key)."""

    def first_of_copies(anchor: np.ndarray, whole: np.ndarray, row: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        """Copies within a batch, which is in the order of rows, are dealt out by themselves: to no anchor, and without hash."""
        once = np.zeros(len(anchor), dtype=bool)
        once[np.unique(anchor ^ _mixed(whole), return_index=True)[1]] = True
        key = np.where(once, anchor, _mixed(anchor + np.arange(len(anchor), dtype=np.uint64)))
        return pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(whole.view(np.int64), mask=~once), pa.array(row), pa.array(at)], names=["key", "hash", "row", "at"]
        )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Pieces(length)
        for batch in batches:
            held: list[tuple[np.ndarray, ...]] = []
            for rows, offsets, parts in _blocks(batch, length - 1, block):
                sizes = np.array([len(p) for p in parts], dtype=np.int64)
                starts = np.cumsum(sizes) - sizes
                anchor, whole, text, first, n, again = cutter.cut(np.frombuffer(b"".join(parts), dtype=np.uint8), starts, sizes)
                at = (np.array(offsets, dtype=np.int64)[text] + first - starts[text]) << 32 | n | again * _AGAIN
                held.append((anchor, whole, np.array(rows, dtype=np.int64)[text], at))
            if held:
                yield first_of_copies(*(np.concatenate(x) for x in zip(*held, strict=True)))
        give_back()

    rows = spread(docs.select("row", "text")).mapInArrow(pieces, "key long, hash long, row long, at long")
    rows = rows.repartition(parallelism(docs.sparkSession), "key")
    rows = rows.selectExpr(
        "*",
        "row_number() OVER (PARTITION BY key, hash ORDER BY row, at) > 1 AS again",
        "min(hash) OVER (PARTITION BY key) <> max(hash) OVER (PARTITION BY key) AS several",
    )
    gone = F.col("hash").isNull() | F.col("again")
    sort = F.col("several") | (F.col("at").bitwiseAND(_AGAIN) != 0)
    return rows.where(gone | sort).select("row", F.col("at").bitwiseAND(~_AGAIN).alias("at"), F.when(~gone, F.col("key")).alias("key"))


def repeated(rows: np.ndarray, at: np.ndarray, texts: list[bytes], length: int, room: int = ROOM) -> tuple[np.ndarray, np.ndarray]:
    """(row, at): runs of passages of these pieces that stand in an earlier place of them, too."""
    order = np.lexsort((at, rows))
    rows, at, texts = rows[order], at[order], [texts[i] for i in order]
    sizes = np.array([len(x) + 1 for x in texts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    t = np.frombuffer(b"\x00".join(texts) + b"\x00\x00", dtype=np.uint8).astype(np.int32) + 2
    t[starts[1:] - 1], t[-2], t[-1] = 1, 1, 0
    inside = np.zeros(len(t) + 1, dtype=np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + (at & 0xFFFFFFFF), -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    place, prefix = suffixes(t, length, room)
    group = np.cumsum(prefix < length)
    own = inside[place]
    place, group = place[own], group[own]
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    firsts = np.zeros(len(t) + 1, dtype=bool)
    firsts[np.minimum.reduceat(place, begins)] = True
    gone = np.r_[inside & ~firsts[:-1], False]
    edges = np.flatnonzero(np.diff(np.r_[False, gone].astype(np.int8)))
    first, last = edges[::2], edges[1::2]
    piece = np.searchsorted(starts, first, side="right") - 1
    return rows[piece], ((at[piece] >> 32) + first - starts[piece]) << 32 | last - first


def _sorted(docs: DataFrame, asked: DataFrame, length: int, shard: int) -> DataFrame:
    """(row, at): what goes of the pieces that differ, by shard."""
    total = asked.agg(F.sum((F.col("at").bitwiseAND(0xFFFFFFFF)) + length)).first()[0] or 0
    shards = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // shard))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {"shard": [], "row": [], "at": [], "piece": []}
            for row, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode("utf-8")
                for x in wanted:
                    start, n = x["at"] >> 32, x["at"] & 0xFFFFFFFF
                    for name, value in zip(found, (x["shard"], row, x["at"], data[start : start + n + length - 1]), strict=True):
                        found[name].append(value)
                if len(found["row"]) > 50_000:
                    yield pa.RecordBatch.from_pydict(found, schema)
                    found = {k: [] for k in found}
            yield pa.RecordBatch.from_pydict(found, schema)

    schema = pa.schema([("shard", pa.int64()), ("row", pa.int64()), ("at", pa.int64()), ("piece", pa.binary())])
    place = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    wanted = asked.groupBy("row").agg(F.collect_list(F.struct("at", place)).alias("wanted"))
    parts = docs.select("row", "text").join(wanted, "row").mapInArrow(cut, "shard long, row long, at long, piece binary")

    def sort(table: pa.Table) -> pa.Table:
        row, at = repeated(table["row"].to_numpy(), table["at"].to_numpy(), table["piece"].to_pylist(), length)
        give_back()
        return pa.table({"row": row, "at": at})

    return parts.groupBy("shard").applyInArrow(sort, "row long, at long")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 100, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(id, n_bytes, spans, kept): spans (start, end) are the maximal runs of bytes that
    lie in a passage of ``length`` bytes (up to 255) which also starts earlier, in the document or a
    former one; ``kept`` the other bytes."""
    scratch = Scratch()
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    odd = docs.groupBy("id").count().where("count > 1 OR id IS NULL")
    if odd.isEmpty():
        docs = docs.withColumn("row", F.col("id").cast("long"))
    else:
        order = [F.col("id").asc_nulls_last(), F.md5(F.col("text").cast("binary"))]
        dealt = docs.repartitionByRange(parallelism(df.sparkSession), *order).sortWithinPartitions(*order)
        docs = scratch(dealt.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = scratch(_found(docs, length, block), "pieces")
    late = scratch(_sorted(docs, found.where("key IS NOT NULL"), length, shard), "repeats")
    gone = found.where("key IS NULL").select("row", "at").unionByName(late)
    gone = gone.groupBy("row").agg(F.collect_list("at").alias("at"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, runs = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            sizes, spans, kept = [], [], []
            for data, run in zip(texts, runs, strict=True):
                data = data.encode("utf-8")
                ends: list[dict] = []
                for x in sorted(run or ()):
                    start, end = x >> 32, (x >> 32) + (x & 0xFFFFFFFF) + length - 1
                    if ends and start <= ends[-1]["end"]:
                        ends[-1]["end"] = max(end, ends[-1]["end"])
                    else:
                        ends.append({"start": start, "end": end})
                edges = [0, *(p for e in ends for p in e.values()), len(data)]
                sizes.append(len(data))
                spans.append(ends)
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    whole = docs.join(gone, "row", "left").select("id", "text", "at")
    kind = docs.schema["id"].dataType.simpleString()
    return whole.mapInArrow(keep, f"id {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
