"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (1 to 3) present in
both, over the root of the product of the numbers present in either. A bounded
sample of labelled rows is used: some are landmarks of a Nyström map, all of
them fit a one-versus-rest kernel ridge regression in the mapped space. As the
kernel is an inner product of presence vectors, landmarks and coefficients
multiply out to one weight for each n-gram and language, and whole texts are
scored by batched matrix products.

N-grams are counted as present in BUCKETS hashed places. Letters are
lower-cased; ASCII characters other than letters count as one blank.

Defined results: a null text and one without a letter are ``und`` with score 0,
as is every text if nothing can be learned; rows without label or text teach
nothing, and repeated rows once; repeated rows get equal results; texts of any length are read whole;
an empty table gives an empty table. Label, source and id are never inputs of a
prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import KEY_BITS, give_back, row_key, slices, spread

ORDER = 3
BUCKETS = 1 << 15
#: Bounds of what is learned from: rows a language, and rows in all. With more
#: languages each has fewer rows; only of more than MAX_SAMPLE are the rarest left out.
PER_LANGUAGE = 400
MAX_SAMPLE = 6000
LANDMARKS = 320
RIDGE = 0.3
#: Text and rows of presence that a worker holds at once.
SLICE_BYTES, ROWS_AT_ONCE = 4 << 20, 64
UND = "und"
#: Multipliers of the hash of an n-gram's characters.
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
_FOLD = np.array([i if i > 127 or 97 <= i <= 122 else 32 for i in range(256)], dtype=np.uint32)


def presence(text: str, row: np.ndarray, block: int = 1 << 20) -> None:
    """Set ``row`` (uint8, BUCKETS) to 1 at the places of the text's n-grams."""
    for k in range(0, len(text), block):
        # blocks overlap, so that no n-gram is lost between them
        codes = np.frombuffer(text[k : k + block + ORDER - 1].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = np.where(codes < 256, _FOLD[np.minimum(codes, 255)], codes)
        held = None
        for n in range(ORDER):
            if len(codes) <= n:
                break
            own = codes[n:] * _MIX[n]
            held = own if held is None else (held[:-1] ^ own)
            row[((held * np.uint32(0x27D4EB2F)) ^ (held >> np.uint32(15))) >> np.uint32(32 - 15)] = 1


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of presence, packed or not, as vectors of unit length."""
    x = (np.unpackbits(x, axis=1) if x.shape[1] < BUCKETS else x).astype(np.float32)
    return x / np.sqrt(np.maximum(1.0, x.sum(axis=1, dtype=np.float64)))[:, None].astype(np.float32)


def sampled(df: DataFrame, text: str, label: str, key: Column) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, presence rows (packed) and labels of a bounded sample, by least shuffle key."""
    rows = df.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(label).alias("label"), key.alias("key"))
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    counts = counts.orderBy(F.desc("n"), "label").limit(MAX_SAMPLE).collect()
    names = sorted(r["label"] for r in counts)
    if not names:
        return [], np.zeros((0, BUCKETS // 8), np.uint8), np.zeros(0, int)
    each = min(PER_LANGUAGE, MAX_SAMPLE // len(names))
    # the share of each language's keys that gives twice the rows wanted
    upto = [(r["label"], int(min(1.0, (2.0 * each + 16) / r["n"]) * (1 << KEY_BITS))) for r in counts]
    limits = F.broadcast(df.sparkSession.createDataFrame(upto, "label string, upto long"))  # MAX_SAMPLE rows at most
    rows = rows.join(limits, "label").where(F.col("key") < F.col("upto")).select("text", "label", "key")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, SLICE_BYTES):
                made = []
                for t in part.column(0).to_pylist():
                    row = np.zeros(BUCKETS, dtype=np.uint8)
                    if has_letter(t):
                        presence(t, row)
                    made.append(np.packbits(row).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), part.column(1), part.column(2)], names=["bits", "label", "key"])

    # copies of a row teach once, so that a key that many rows share is no more than one
    found = rows.mapInArrow(bits, "bits binary, label string, key long").distinct().toArrow().to_pylist()
    found.sort(key=lambda r: (r["label"], r["key"], r["bits"]))
    kept, seen = [], {}
    for r in found:
        seen[r["label"]] = seen.get(r["label"], 0) + 1
        if seen[r["label"]] <= each:
            kept.append(r)
    x = np.frombuffer(b"".join(r["bits"] for r in kept), dtype=np.uint8).reshape(-1, BUCKETS // 8)
    y = np.array([names.index(r["label"]) for r in kept], dtype=int)
    some = x.any(axis=1)
    return names, x[some], y[some]


def fit(x: np.ndarray, y: np.ndarray, n: int, block: int = 128) -> tuple[np.ndarray, ...]:
    """Matrices whose product (BUCKETS x n) weighs presence vectors of unit length:
    one, or, of more languages than landmarks, the smaller two.

    Rows come packed and are unpacked in blocks: only the landmarks are held.
    """
    # landmarks: rows of each language in turn
    turn = np.zeros(len(y), dtype=int)
    for k in range(n):
        turn[y == k] = np.arange((y == k).sum())
    z = _unit(x[np.lexsort((y, turn))[:LANDMARKS]])
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = values > 1e-5 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    mapped = np.concatenate([(_unit(x[k : k + block]) @ z.T).astype(np.float64) for k in range(0, len(x), block)]) @ root
    # every language weighs the same
    weight = 1.0 / np.bincount(y, minlength=n)[y]
    goal = np.where(y[:, None] == np.arange(n), 1.0, -1.0)
    left = mapped.T @ (mapped * weight[:, None]) + RIDGE / max(1, len(y)) * np.eye(mapped.shape[1])
    of_landmark = (root @ np.linalg.solve(left, mapped.T @ (goal * weight[:, None]))).astype(np.float32)
    return (z.T @ of_landmark,) if n <= LANDMARKS else (np.ascontiguousarray(z.T), of_landmark)


def identify(df: DataFrame, teach: Column, *, id_col: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to ``df``; rows where ``teach`` holds may be learned from."""
    spark = df.sparkSession
    names, x, y = sampled(df.where(teach), text, label, row_key("language-1", F.col(id_col), F.col(text)))
    model = spark.sparkContext.broadcast((names, fit(x, y, len(names)) if len(x) else None))
    df = df.drop("lang_pred", "score")
    at = df.columns.index(text)
    kept = df.schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = model.value
        for batch in batches:
            for part in slices(batch, at, SLICE_BYTES):
                texts = part.column(at).to_pylist()
                langs, scores = [UND] * len(texts), np.zeros(len(texts))
                known = [i for i, t in enumerate(texts) if weights is not None and has_letter(t)]
                for k in range(0, len(known), ROWS_AT_ONCE):
                    some = known[k : k + ROWS_AT_ONCE]
                    rows = np.zeros((len(some), BUCKETS), dtype=np.uint8)
                    for r, i in enumerate(some):
                        presence(texts[i], rows[r])
                    value = _unit(rows)
                    for m in weights:
                        value = value @ m
                    best = value.argmax(axis=1)
                    for r, i in enumerate(some):
                        langs[i] = own[best[r]]
                        scores[i] = min(1.0, max(0.0, (float(value[r, best[r]]) + 1) / 2))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])
        give_back()

    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return spread(df).mapInArrow(predict, schema)
