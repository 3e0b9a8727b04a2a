"""Surprisal of a count model over rows of documents, with little to shuffle.

Documents are put together in slices of about a million tokens. A slice sends its
different grams once, as hashes of 80 bits in buckets of the hash's order, gets
their counts back in the same order, and scores its tokens. Two of 10^9 different
grams share a hash with a probability of 10^-6. Contexts need no lookup of their
own: a gram is a context as often as it occurs, less the documents that it ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written

#: Tokens of a slice, and grams of a bucket.
SLICE, BUCKET = 1 << 20, 1 << 21
_KEYS = ("lingualoom-gram-", "gram-lingualoom-")


def _packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte of their places, which the codec makes short where they are small or sorted."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(data, decompressed_size=n * width, codec="zstd"), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, n).T).view(kind).reshape(n)


def _sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Rows (slice, docs, sizes, n, body) of documents (doc, tokens); the body is the words in order."""
    part, made, held, n = TaskContext.get().partitionId(), 0, [], 0

    def row() -> pa.RecordBatch:
        docs = pa.concat_arrays([d for d, _, _ in held])
        words = pa.chunked_array([w for _, _, w in held]).dictionary_encode().combine_chunks()
        words = pa.concat_arrays(words.chunks) if isinstance(words, pa.ChunkedArray) else words
        if words.null_count:
            raise ValueError("a token is null")
        sink, block = pa.BufferOutputStream(), pa.record_batch([words], names=["word"])
        with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(block)
        sizes = pa.concat_arrays([s for _, s, _ in held])
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        cells = [pa.array([(part << 32) + made], pa.int64()), one(docs), one(sizes), pa.array([n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(cells, names=["slice", "docs", "sizes", "n", "body"])

    for b in batches:
        sizes = np.asarray(b.column(1).value_lengths().fill_null(0), dtype=np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < len(sizes):
            stop = min(len(sizes), int(np.searchsorted(ends, (ends[start - 1] if start else 0) + rows - n)) + 1)
            own = b.slice(start, stop - start)
            held.append((own.column(0), pa.array(sizes[start:stop], pa.int32()), own.column(1).flatten()))
            n, start = n + int(sizes[start:stop].sum()), stop
            if n >= rows:
                yield row()
                held, n, made = [], 0, made + 1
    if n:
        yield row()


def _mixed(x: np.ndarray) -> np.ndarray:
    """Another number for each number, with all bits stirred."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _different(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """The order of (a, b), where in it each different pair begins, and the number of each place's pair."""
    order = np.argsort(a)
    sorted_a, sorted_b = a[order], b[order]
    same_a, same_b = sorted_a[1:] == sorted_a[:-1], sorted_b[1:] == sorted_b[:-1]
    if (same_a & ~same_b).any():  # almost never: so one key is sorted, not two
        order = np.lexsort((b, a))
        sorted_a, sorted_b = a[order], b[order]
        same_a, same_b = sorted_a[1:] == sorted_a[:-1], sorted_b[1:] == sorted_b[:-1]
    new = np.concatenate([np.ones(min(len(a), 1), dtype=bool), ~(same_a & same_b)])
    which = np.empty(len(a), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), which


def _grams(body: bytes, sizes: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For grams of 1, 2 ... ``size`` tokens: where they end, the high and low part of the hash
    of each different one in its order, their counts, in how many documents each is the end, and
    which of them each place has."""
    with pa.ipc.open_stream(body) as stream:
        words = stream.read_next_batch().column(0)
    codes, known = words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False)
    lanes = [pd.util.hash_array(known, hash_key=key, categorize=False)[codes] for key in _KEYS]
    ends = np.cumsum(sizes)
    at = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    is_end = np.zeros(len(codes), dtype=bool)
    is_end[ends[sizes > 0] - 1] = True
    high, low = lanes
    for k in range(size):
        if k:
            # of places before k the hash runs over from the document before, but they aren't read
            high, low = (np.concatenate([x[:1], _mixed(x[:-1]) + w[1:]]) for x, w in zip((high, low), lanes, strict=True))
        places = np.flatnonzero(at >= k)
        a, b = _mixed(high[places]), (_mixed(low[places]) >> np.uint64(48)).astype(np.uint16)
        order, firsts, which = _different(a, b)
        counts = np.diff(np.append(firsts, len(a)))
        yield places, a[order[firsts]], b[order[firsts]], counts, np.bincount(which[is_end[places]], minlength=len(firsts)), which


def _sent(batches: Iterator[pa.RecordBatch], size: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (k, bucket, slice, n, high, low, counts, ends): what a slice asks of a bucket."""
    for b in batches:
        for name, sizes, body in zip(b.column("slice"), b.column("sizes"), b.column("body"), strict=True):
            for k, (_, high, low, counts, ends, _) in enumerate(_grams(body.as_py(), np.asarray(sizes.values), size)):
                cut = np.searchsorted(high, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
                rows = [(k, j, name.as_py(), t - f, *map(_packed, (high[f:t], low[f:t], counts[f:t], ends[f:t]))) for j, (f, t) in enumerate(zip(cut, [*cut[1:], len(high)], strict=True)) if t > f]
                yield pa.RecordBatch.from_pylist([dict(zip(_SENT.names, r, strict=True)) for r in rows], schema=_SENT)


_SENT = pa.schema([("k", pa.int32()), ("bucket", pa.int32()), ("slice", pa.int64()), ("n", pa.int64()), *[(c, pa.binary()) for c in ("high", "low", "counts", "ends")]])


def _counted(rows: pa.Table) -> pa.Table:
    """Counts of a bucket's grams over all slices, for each slice in the order in which it sent them."""
    sizes = np.asarray(rows["n"])
    read = lambda c, kind: np.concatenate([_unpacked(x.as_py(), n, kind) for x, n in zip(rows[c], sizes, strict=True)])
    a, b = read("high", np.uint64), read("low", np.uint16)
    order, firsts, which = _different(a, b)
    del a, b
    cut = np.cumsum(sizes)[:-1]
    sums = {}
    for c in ("counts", "ends"):
        total = np.add.reduceat(read(c, np.int64)[order], firsts)[which]
        sums[c] = pa.array([_packed(x) for x in np.split(total, cut)], pa.binary())
    return pa.table({"slice": rows["slice"], "k": rows["k"], "bucket": rows["bucket"], "n": rows["n"], **sums})


def _scored(own: pa.Table, found: pa.Table, size: int, discount: float, tokens: int, value: str, doc: str) -> pa.Table:
    """(doc, array of ``value``) of a slice and the counts of its grams."""
    sizes = np.asarray(own["sizes"][0].values)
    got = {}
    for r in sorted(found.to_pylist(), key=lambda r: (r["k"], r["bucket"])):
        got.setdefault(r["k"], []).append([_unpacked(r[c], r["n"], np.int64) for c in ("counts", "ends")])
    share, before = None, None
    for k, (places, high, _, _, _, which) in enumerate(_grams(own["body"][0].as_py(), sizes, size)):
        if not len(high):
            share = share * discount
            continue
        counts, ends = (np.concatenate(x)[which] for x in zip(*got[k], strict=True))
        as_context = np.zeros(int(sizes.sum()), dtype=np.int64)
        as_context[places] = counts - ends
        if share is None:
            share = counts / tokens
        else:
            # counts include the token itself: leave it out, so that a gram seen once backs off
            m = before[places - 1]
            seen = (counts > 1) & (m > 1)
            share = share * discount
            share[places[seen]] = (counts[seen] - 1) / (m[seen] - 1)
        before = as_context
    values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(-np.log2(share)))
    return pa.table({doc: own["docs"].combine_chunks().flatten(), value: values})


def ngram_surprisal_rows(docs: DataFrame, size: int, doc: str = "doc", tokens: str = "tokens", value: str = "surprisal", discount: float = 0.4, slice_tokens: int = SLICE) -> DataFrame:
    """As ``score.ngram_surprisal`` for one row a document with its tokens in an array:
    (doc, an array of ``value``, one a token). Documents without tokens may have no row."""
    kind, spark = docs.schema[doc].dataType.simpleString(), docs.sparkSession
    # names bound here, so that tasks get no more than they need
    slices = docs.select(doc, tokens).mapInArrow(lambda rows: _sliced(rows, slice_tokens), f"slice long, docs array<{kind}>, sizes array<int>, n long, body binary")
    slices = written(slices, "slices")
    all_tokens = slices.agg(F.sum("n")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, (max(parts, -(-all_tokens // BUCKET)) - 1).bit_length())
    sent = slices.mapInArrow(lambda rows: _sent(rows, size, bits), "k int, bucket int, slice long, n long, high binary, low binary, counts binary, ends binary")
    many = max(parts, -(-size * all_tokens // BUCKET))
    counted = sent.repartition(many, "k", "bucket").groupBy("k", "bucket").applyInArrow(_counted, "slice long, k int, bucket int, n long, counts binary, ends binary")
    both = slices.repartition(many, "slice").groupBy("slice").cogroup(counted.repartition(many, "slice").groupBy("slice"))
    return both.applyInArrow(lambda own, found: _scored(own, found, size, discount, all_tokens, value, doc), f"{doc} {kind}, {value} array<double>")
