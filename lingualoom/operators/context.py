"""Context windows of token sequences, plain, masked, and with collapsed spans."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import held


def windows(tokens: DataFrame, size: int, by: Sequence[str] = ("doc",), at: str = "at", token: str = "token", pad: Column | None = None) -> DataFrame:
    """Add ``window`` (the last ``size`` tokens up to and with the target, padded on
    the left if ``pad`` is given), ``mask`` (1 for a token) and ``target``."""
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(-(size - 1), 0)
    out = tokens.withColumn("window", F.collect_list(token).over(w))
    missing = F.lit(size) - F.size("window")
    mask = F.concat(F.array_repeat(F.lit(0), missing), F.array_repeat(F.lit(1), F.size("window"))) if pad is not None else F.array_repeat(F.lit(1), F.size("window"))
    out = out.withColumn("mask", mask).withColumn("target", F.col(token))
    if pad is not None:
        out = out.withColumn("window", F.concat(F.array_repeat(pad, missing), F.col("window")))
    return out


def window_rows(docs: DataFrame, size: int, tokens: str = "tokens") -> DataFrame:
    """As ``windows`` for one row a document with its tokens in an array: (..., at,
    target, window) without a shuffle. Other columns are kept."""
    kept = [c for c in docs.columns if c != tokens]
    # bound to a name: else an expression behind the column could be evaluated for every token
    one = f"transform(w, (t, i) -> struct(i AS at, t AS target, slice(w, greatest(i - {size - 2}, 1), least(i + 1, {size})) AS window))"
    slices = F.expr(f"transform(array({tokens}), w -> {one})[0]")
    return docs.select(*kept, F.explode(slices).alias("__w")).select(*kept, "__w.*")


def window_arrays(docs: DataFrame, size: int, tokens: str = "tokens", sep: str = " ") -> DataFrame:
    """As ``window_rows``, a row a document: (..., windows, sizes), the windows joined by ``sep``."""
    kept = [c for c in docs.columns if c != tokens]
    part = f"slice(w, greatest(i - {size - 2}, 1), least(i + 1, {size}))"
    both = f"transform(w, (t, i) -> array_join({part}, '{sep}')) AS windows, transform(w, (t, i) -> least(i + 1, {size})) AS sizes"
    return docs.select(*kept, F.inline_outer(F.expr(f"transform(array({held(tokens)}), w -> struct({both}))")))


def masked_windows(tokens: DataFrame, size: int, hidden: str, by: Sequence[str] = ("doc",), at: str = "at", token: str = "token") -> DataFrame:
    """As ``windows``; tokens flagged ``hidden`` get mask 0, but never the target."""
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(-(size - 1), 0)
    out = tokens.withColumn("__w", F.collect_list(F.struct(F.col(token).alias("t"), F.col(hidden).alias("h"))).over(w))
    n = F.size("__w")
    mask = F.transform("__w", lambda x, i: F.when(x["h"] & (i < n - 1), 0).otherwise(1))
    return out.withColumn("window", F.col("__w.t")).withColumn("mask", mask).withColumn("target", F.col(token)).drop("__w")


def position_ids(mask: Column) -> Column:
    """Running number of unmasked tokens from 0; masked leading ones count as 0."""
    sums = F.aggregate(mask, F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("a")), lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(F.greatest(acc["s"] + x - 1, F.lit(0)))).alias("a")))
    return sums["a"]


def replacement_spans(tokens: DataFrame, by: Sequence[str] = ("doc",), at: str = "at", replacement: str = "replacement") -> DataFrame:
    """(by, replacement, start, end): runs of adjacent equal non-null replacements.
    Adjacent spans with equal text are one."""
    w, v = Window.partitionBy(*by).orderBy(at), Window.partitionBy(*by, replacement).orderBy(at)
    g = tokens.where(F.col(replacement).isNotNull()).withColumn("__g", F.col(at) - F.row_number().over(v))
    return g.groupBy(*by, replacement, "__g").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("end")).drop("__g")


def _spans(replacements: Sequence) -> list[tuple[int, int, str]]:
    out, k, n = [], 0, len(replacements)
    while k < n:
        end = k + 1
        if replacements[k] is not None:
            while end < n and replacements[end] == replacements[k]:
                end += 1
            out.append((k, end, replacements[k]))
        k = end
    return out


def collapsed_windows(ids: Sequence[int], replacements: Sequence, size: int, pronoun: Callable[[str, int], Sequence[int]], extend: bool) -> list[list[int]]:
    """The window of each token, spans inside its context collapsed to pronouns.

    A span is collapsed if it is whole in the window and ends before the target;
    of longer results the last ``size`` tokens stay. With ``extend``, the start
    moves left by one token at a time until the collapsed window is full.
    ``pronoun(text, span start)`` gives the ids of a replacement.

    The length of a window from s to t follows from prefix sums: whole collapsed
    spans, plus raw tokens of a span that s cuts or that reaches t.
    """
    n, spans = len(ids), _spans(replacements)
    made = [list(pronoun(text, start)) for start, _, text in spans]
    span_of = np.full(n, -1)
    for k, (start, end, _) in enumerate(spans):
        span_of[start:end] = k
    # length[i]: of the collapsed tokens before i, for i at no inner place of a span
    length = np.zeros(n + 1, dtype=np.int64)
    for i in range(n):
        k = span_of[i]
        if k < 0:
            length[i + 1] = length[i] + 1
        elif i == spans[k][1] - 1:
            length[i + 1] = length[spans[k][0]] + len(made[k])
    # numbers of lists, which are read far faster than those of numpy
    ids, span_of, length, out = [int(i) for i in ids], span_of.tolist(), length.tolist(), []
    for t in range(n):
        # a span that reaches the target stays raw: from its start on, tokens count singly
        last = spans[span_of[t]][0] if span_of[t] >= 0 else t

        def size_from(s: int, t: int = t, last: int = last) -> int:
            if s >= last:
                return t + 1 - s
            k = span_of[s]
            head, raw = (spans[k][1], spans[k][1] - s) if k >= 0 and s > spans[k][0] else (s, 0)
            return raw + length[last] - length[head] + t + 1 - last

        s = max(0, t + 1 - size)
        if extend:
            while s > 0 and size_from(s) < size:
                s -= 1
        window, i = [], s
        while i <= t:
            k = span_of[i]
            if k >= 0 and i == spans[k][0] and spans[k][1] <= t:
                window += made[k]
                i = spans[k][1]
            else:
                window.append(ids[i])
                i += 1
        out.append(window[-size:])
    return out


def pronoun_windows(tokens: DataFrame, pronouns: dict[tuple[str, bool, bool], list[int]], size: int, extend: bool, doc: str = "doc") -> DataFrame:
    """(doc, at, target, window) of tokens (doc, at, id, piece, replacement).

    ``pronouns``: ids by (pronoun, starts a sentence, at document start), a small
    lookup; a replacement that it lacks is an error. A sentence starts where, past opening marks, the up to 16 pieces
    before the span end in . ! or ? or are blank.
    """
    kind = tokens.schema[doc].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        ids, given = rows["id"].tolist(), [None if r is None or r != r else r for r in rows["replacement"]]
        return pd.DataFrame({doc: rows[doc], "at": rows["at"], "target": ids, "window": _document_windows(ids, rows["piece"].tolist(), given, pronouns, size, extend)})

    return tokens.select(doc, "at", "id", "piece", "replacement").groupBy(doc).applyInPandas(run, f"{doc} {kind}, at int, target long, window array<long>")


def _document_windows(ids: list[int], pieces: list[str], given: list, pronouns: dict[tuple[str, bool, bool], list[int]], size: int, extend: bool) -> list[list[int]]:
    from ..functions.text import OPENING_MARKS

    marks = "".join(OPENING_MARKS)

    def pronoun(text: str, start: int) -> list[int]:
        before = "".join(pieces[max(0, start - 16) : start]).rstrip()
        while before and before[-1] in marks:
            before = before[:-1].rstrip()
        key = (text, not before or before[-1] in ".!?", start == 0)
        if key not in pronouns:
            raise ValueError(f"no ids for the replacement {text!r} (starts a sentence: {key[1]}, a document: {key[2]})")
        return pronouns[key]

    return collapsed_windows(ids, given, size, pronoun, extend)


def pronoun_window_rows(docs: DataFrame, pronouns: dict[tuple[str, bool, bool], list[int]], size: int, extend: bool, doc: str = "doc", tokens: str = "tokens", rows_at_once: int = 256) -> DataFrame:
    """As ``pronoun_windows`` for one row a document with its tokens in an array of (id, piece,
    replacement): (doc, an array of windows, one a token) without a shuffle."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, rows_at_once):
                b = whole.slice(k, rows_at_once)
                ends = np.cumsum(np.asarray(b.column(1).value_lengths().fill_null(0), dtype=np.int64)).tolist()
                found = b.column(1).flatten()
                ids, pieces, given = (x.to_pylist() for x in found.flatten())
                made = [_document_windows(ids[i:j], pieces[i:j], given[i:j], pronouns, size, extend) for i, j in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.list_(pa.int64())))], names=[doc, "windows"])

    rows = docs.select(doc, F.transform(tokens, lambda x: F.struct(x["id"].cast("long").alias("id"), x["piece"].alias("piece"), x["replacement"].alias("replacement"))).alias(tokens))
    return rows.mapInArrow(run, f"{doc} {kind}, windows array<array<bigint>>")


#: Longest contexts of model families; others have DEFAULT_CONTEXT.
DEFAULT_CONTEXT = 2048


def context_limit(max_positions: int | None, offset_positions: bool = False) -> int:
    """Longest context of a model; families with offset positions have two less."""
    return (max_positions or DEFAULT_CONTEXT) - (2 if offset_positions else 0)


def usable_contexts(requested: Sequence[int], limit: int) -> list[int]:
    return sorted({c for c in requested if 0 < c <= limit})


def batch_rows(token_budget: int, size: int) -> int:
    return max(1, token_budget // size)


def context_plan(models: DataFrame, requested: Sequence[int], token_budget: int) -> DataFrame:
    """(model, context, batch_rows): the requested contexts that each model can take, with the
    rows of a batch within the budget. ``models``: (model, max_positions, offset_positions)."""
    limit = F.coalesce("max_positions", F.lit(DEFAULT_CONTEXT)) - F.when(F.col("offset_positions"), 2).otherwise(0)
    sizes = F.array(*[F.lit(c) for c in sorted({c for c in requested if c > 0})])
    each = models.select("model", F.explode(F.filter(sizes, lambda c: c <= limit)).alias("context"))
    return each.withColumn("batch_rows", F.greatest(F.lit(1), F.expr(f"{token_budget} div context").cast("int")))


#: Fixed value: families whose models take no position ids.
WITHOUT_POSITION_IDS = ("opt",)


def scorer_setup(families: DataFrame, family: str = "family") -> DataFrame:
    """Add a scorer's settings: the padding token and side, and whether position ids are passed."""
    own = ~F.lower(family).isin(*WITHOUT_POSITION_IDS)
    return families.withColumns({"pad_token": F.lit("eos"), "padding_side": F.lit("left"), "position_ids": own})


def token_totals(docs: DataFrame, by: Sequence[str], tokens: Column) -> DataFrame:
    """Documents, tokens and the shortest document, by group and (null) in all; empty documents are an error for a scorer."""
    return docs.withColumn("__n", F.size(tokens)).rollup(*by).agg(F.count("*").alias("n_docs"), F.sum("__n").alias("n_tokens"), F.min("__n").alias("least"))
