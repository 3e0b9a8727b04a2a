"""Ranks, sums, quantiles and matches over ranges; intervals by dyadic cells; letters of two cuts; line numbers."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lingualoom.operators import align, frames, mixed, ranges, stats
from lingualoom.sources import readers


def test_quantiles_of_one_group_of_all_rows(spark):
    r = random.Random(1)
    values = [r.choice([1.0, 1.0, 1.0, r.random() * 100]) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(7)
    probs = [0.0, 0.005, 0.25, 0.5, 0.75, 0.995, 1.0]
    got = ranges.quantiles(df, [], "v", probs, parts=9).first()["quantiles"]
    assert got == pytest.approx(np.quantile(values, probs), rel=1e-12)


def test_quantiles_by_group(spark):
    rows = [(g, float(k * k % 97)) for g in ("a", "b", None) for k in range(1 if g == "b" else 60)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.quantiles for r in ranges.quantiles(df, ["g"], "v", [0.1, 0.5], parts=5).collect()}
    for g in ("a", "b", None):
        own = [v for k, v in rows if k == g]
        assert got[g] == pytest.approx(np.quantile(own, [0.1, 0.5]))
    s = {r.g: r for r in stats.describe(df, ["g"], "v").collect()}
    assert s["none"]["count"] == 0 and s["none"].q50 is None and s[None]["count"] == 60
    assert ranges.quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_ranks_without_a_task_of_all_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    out = ranges.ranks(df, ["x"], "rank", parts=8)
    assert [(r.x, r["rank"]) for r in out.orderBy("x").collect()] == [(k, k + 1) for k in range(1000)]
    firsts = frames.first_appearance(df.withColumn("k", F.col("x") % 50), "k", "x")
    assert {r.k: r["rank"] for r in firsts.collect()} == {k: k + 1 for k in range(50)}
    plan = firsts._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window" in line]
    assert windows and all("__n" in line and "__p" in line for line in windows)  # over the ranges' sizes only


def test_running_sums(spark):
    rows = [(g, k, (k * 5 + len(g)) % 4) for g in ("a", "bb") for k in range(200)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(6)
    got = {(r.g, r.k): r.s for r in ranges.running_sums(df, ["g"], ["k"], F.col("v"), "s", parts=7).collect()}
    assert got == {(g, k): sum((j * 5 + len(g)) % 4 for j in range(k + 1)) for g in ("a", "bb") for k in range(200)}


@pytest.mark.parametrize("parts", [1, 6])
def test_as_of_of_one_group(spark, parts):
    r = random.Random(parts)
    right = [(1, r.randrange(40, 400), k) for k in range(60)] + [(2, 5, 1000)]
    left = [(1, r.randrange(0, 500), k) for k in range(200)] + [(2, 1, 200), (2, 9, 201), (3, 7, 202), (None, 4, 203)]
    rd, ld = spark.createDataFrame(right, "g int, t int, v int"), spark.createDataFrame(left, "g int, t int, k int")
    got = {x.k: x.asof_v for x in ranges.as_of(ld, rd, ["g"], "t", "t", ["v"], tie="v", parts=parts).collect()}
    for g, t, k in left:
        own = sorted((a, v) for h, a, v in right if h == g)
        before = [v for a, v in own if a <= t]
        assert got[k] == (before[-1] if before else own[0][1] if own else None)


@pytest.mark.parametrize("empty", [False, True])
def test_overlaps_of_short_and_very_long_intervals(spark, empty):
    r = random.Random(4)
    make = lambda n: [(g, s, s + r.choice([0, 1, 2, 7, 30])) for g in (1, 2) for s in (r.randrange(-60, 200) for _ in range(n))]
    a, b = [*make(60), (1, -5, 10**8), (2, 64, 128)], [*make(60), (1, 10**8 - 1, 10**8 + 3), (1, -(10**8), 10**8)]
    frame = lambda rows: spark.createDataFrame([(*x, k) for k, x in enumerate(rows)], "g int, start long, end long, k int")
    got = [(x.k, x.r_k) for x in align.overlaps(frame(a), frame(b), ["g"], empty).collect()]
    full = lambda s, e: empty or s < e
    want = {(i, j) for i, (g, s, e) in enumerate(a) for j, (h, u, v) in enumerate(b) if g == h and u < e and v > s and full(s, e) and full(u, v)}
    assert len(got) == len(set(got)) and set(got) == want


def test_letters_of_two_cuts(spark):
    words = ["Don't", "stop", "...", "NOW,", "ab-cd", "!"]
    tokens = [("Do", "AUX"), ("n't", "PART"), ("stop", "VERB"), (".", "P1"), ("..", "P2"), ("NOW", "ADV"), (",", "P3"), ("ab", "X"), ("-", "P4"), ("cd", "Y"), ("!", "P5")]
    w = spark.createDataFrame(list(enumerate(words)), "k int, word string")
    t = spark.createDataFrame([(k, *x) for k, x in enumerate(tokens)], "k int, word string, tag string")
    got = {r.word: r.tag for r in align.aligned_tags(w, t, ["k"]).collect()}
    # "Don't" loses its capital and mark: "ont" begins in "Do"; a word without letters takes the last token that starts at or before it
    assert got == {"Don't": "AUX", "stop": "VERB", "...": "X", "NOW,": "X", "ab-cd": "X", "!": "P5"}


def test_letters_of_two_cuts_by_row(spark):
    """Against the cuts laid out token by token; texts without letters, without tokens or null in runs."""
    r = random.Random(11)
    texts = [None if r.random() < 0.1 else "".join(r.choice("ab.A -") for _ in range(r.choice((0, 1, 2, 9)))) for _ in range(120)] + ["...", "", "!", "a"]
    frame = spark.createDataFrame([(k // 3, k % 3, t) for k, t in enumerate(texts)], "g int, h int, text string").repartition(3)
    cut = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    # marks are words but no tokens here, so some texts have words only
    both = frame.select("g", "h", cut(r"[^ ]+").alias("words"), F.transform(cut(r"\w|[.]"), lambda x: F.struct(x.alias("word"))).alias("tokens"))
    both = both.withColumn("tokens", F.transform("tokens", lambda x, k: F.struct(x["word"], F.concat_ws("-", "g", "h", k.cast("string")).alias("tag"))))
    w = both.select("g", "h", F.posexplode("words").alias("at", "word"))
    t = both.select("g", "h", F.posexplode("tokens").alias("at", "x")).select("g", "h", "at", "x.*")
    want = sorted(tuple(x) for x in align.aligned_tags(w, t, ["g", "h", "at"]).select("g", "h", "at", "tag").collect())
    assert sorted(tuple(x) for x in align.aligned_tag_rows(both, ["g", "h"]).collect()) == want and want
    bare = both.withColumn("tokens", F.array().cast("array<struct<word:string,tag:string>>")).where("NOT exists(words, x -> x RLIKE '[a-z]')")
    assert {x.tag for x in align.aligned_tag_rows(bare, ["g", "h"]).collect()} == {None}
    assert align.aligned_tag_rows(both.limit(0), ["g", "h"]).count() == 0
    twice = spark.createDataFrame([(1, 1, "a b"), (1, 1, "c d"), (None, 1, ".")], "g int, h int, text string")
    twice = twice.select("g", "h", cut(r"[^ ]+").alias("words"), F.transform(cut(r"\w"), lambda x: F.struct(x.alias("word"), x.alias("tag"))).alias("tokens"))
    assert sorted((str(x.g), x["at"], x.tag) for x in align.aligned_tag_rows(twice, ["g", "h"]).collect()) == [("1", 0, "a"), ("1", 0, "c"), ("1", 1, "b"), ("1", 1, "d"), ("None", 0, "d")]


def test_line_numbers_of_byte_ranges(spark, tmp_path):
    r = random.Random(8)
    lines = ["﻿first", *("" if r.random() < 0.2 else "é" * r.randrange(1, 30) for _ in range(400)), "# no", "last"]
    ends = [r.choice(["\n", "\r\n"]) for _ in lines]
    (tmp_path / "a.txt").write_bytes("".join(x + e for x, e in zip(lines, ends, strict=True)).encode())
    (tmp_path / "b.txt").write_bytes(b"one\n\n\nfour")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("300", "1000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            plain = readers._lines(spark, f"{tmp_path}/*.txt")
            got = sorted((x.path[-5], x.line_no, x.line) for x in plain.collect())
            want = sorted([("a", k, x.lstrip("﻿")) for k, x in enumerate(lines, 1)] + [("b", 1, "one"), ("b", 2, ""), ("b", 3, ""), ("b", 4, "four")])
            assert got == want
            numbered = [x for x in readers.documents(spark, f"{tmp_path}/a.txt", ordinal=True).orderBy("doc_id").collect()]
            assert [x.text for x in numbered] == [x.lstrip("﻿") for x in lines if x.strip()]
            assert [x.doc_id for x in numbered] == list(range(1, len(numbered) + 1))
            if size == "300":
                assert spark.read.text(f"{tmp_path}/a.txt").rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_automatic_bins_and_density(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.gamma(2, 10, 3000).round(), [400.0]])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    edges = np.histogram_bin_edges(x, bins="auto")
    low, high, bins = stats.automatic_bins(df, "x")
    assert (low, high, bins) == (edges[0], edges[-1], len(edges) - 1)
    counts = np.histogram(x, edges)[0]
    got = {r["bin"]: r.n for r in stats.automatic_histogram(df, "x").collect()}
    assert sum(got.values()) == len(x) and len(got) == np.count_nonzero(counts)
    width = x.std(ddof=1) * len(x) ** -0.2
    rows = stats.automatic_density(df, "x", least=0.0).orderBy("x").collect()
    at = np.array([r.x for r in rows])
    want = np.exp(-0.5 * ((at[:, None] - x[None]) / width) ** 2).sum(axis=1) / (len(x) * width * math.sqrt(2 * math.pi))
    assert len(rows) == 200 and at[0] == max(0.0, x.min() - 3 * width)
    assert np.abs(np.array([r.density for r in rows]) - want).max() < 1e-4 * want.max()
    assert stats.automatic_density(df.where("x < 0"), "x").count() == 0
    assert stats.automatic_bins(df.limit(1).select(F.lit(3.0).alias("x")), "x") == (2.5, 3.5, 1)


def test_mixed_model_against_a_grid(spark):
    """One factor, an intercept and a slope: chains agree with the posterior by brute force."""
    rng = np.random.default_rng(7)
    g = np.repeat(np.arange(5), 12)
    z = rng.normal(size=60)
    y = 0.5 + 0.15 * z + rng.normal(0, 0.6, 5)[g] + rng.normal(0, 0.4, 60)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "z": z, "g": g.astype(str)}))
    draws = mixed.mixed_model(df, "y", [mixed.INTERCEPT, "z"], {"g": [mixed.INTERCEPT]}, draws=800, warm_up=200).cache()
    assert draws.select("chain").distinct().count() == 4
    s = {r.parameter: r for r in mixed.model_summary(draws).collect()}

    # brute force: the density of the data for each pair of deviations, coefficients integrated out
    design = np.column_stack([np.ones(60), z - z.mean()])
    prior = design @ np.diag([25.0, 0.01]) @ design.T
    same = (g[:, None] == g[None]).astype(float)
    sds, sigmas = np.linspace(0.05, 3.0, 60), np.linspace(0.2, 0.8, 40)
    log = np.empty((60, 40))
    slope = np.empty((60, 40))
    for i, sd in enumerate(sds):
        for j, sigma in enumerate(sigmas):
            cov = prior + sd**2 * same + sigma**2 * np.eye(60)
            solved = np.linalg.solve(cov, y)
            log[i, j] = -0.5 * (np.linalg.slogdet(cov)[1] + y @ solved) - sd - sigma
            slope[i, j] = 0.01 * design[:, 1] @ solved
    w = np.exp(log - log.max())
    w /= w.sum()
    assert s["b_z"]["mean"] == pytest.approx((w * slope).sum(), abs=0.01)
    assert s["sd_g__intercept"]["mean"] == pytest.approx((w * sds[:, None]).sum(), rel=0.1)
    assert s["sigma"]["mean"] == pytest.approx((w * sigmas[None]).sum(), rel=0.03)
    assert all(r.rhat < 1.05 for r in s.values())
    assert s["sigma"].direction == "positive"


def test_rhat_tells_chains_apart(spark):
    rows = [(c, k, "p", float(c * 10 + k % 3)) for c in (1, 2) for k in range(100)] + [(c, k, "q", float(k % 7)) for c in (1, 2) for k in range(100)]
    got = {r.parameter: r.rhat for r in mixed.split_rhat(spark.createDataFrame(rows, "chain int, draw long, parameter string, value double")).collect()}
    assert got["p"] > 3 and got["q"] < 1.05


def test_mixed_model_with_slopes_by_group(spark):
    """0 + level terms with slopes of the same levels by another factor."""
    rng = np.random.default_rng(3)
    pos, corpus = rng.integers(0, 2, 400), rng.integers(0, 3, 400)
    y = np.where(pos == 0, 0.1, -0.1) + 0.02 * corpus * (pos == 1) + rng.normal(0, 0.1, 400)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "n": (pos == 0).astype(float), "v": (pos == 1).astype(float), "corpus": corpus.astype(str)}))
    draws = mixed.mixed_model(df, "y", ["n", "v"], {"corpus": ["n", "v"]}, chains=2, draws=300, warm_up=100)
    s = {r.parameter: r for r in mixed.model_summary(draws).collect()}
    assert len(s) == 2 + 6 + 2 + 1
    total = lambda c, t: s[f"b_{t}"]["mean"] + s[f"r_corpus[{c},{t}]"]["mean"]
    for c in "012":
        for t, k in (("n", 0), ("v", 1)):
            assert total(c, t) == pytest.approx(y[(corpus == int(c)) & (pos == k)].mean(), abs=0.02)


@pytest.mark.parametrize("longest", [3, 100, 400])
def test_overlaps_broadcast_no_copies(spark, longest):
    """Copies of intervals in cells are many more than Spark's estimate; short and long ones are found alike."""
    rng = random.Random(longest)
    a, b = ([(k % 3, k, s := rng.randint(-200, 1500), s + rng.randint(1, longest)) for k in range(150)] for _ in range(2))
    frame = lambda rows: spark.createDataFrame(rows, "g long, k long, start long, end long")
    found = align.overlaps(frame(a), frame(b), ["g"])
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    assert sorted((x.k, x.r_k) for x in found.collect()) == want


def test_offset_rows(spark):
    df = spark.createDataFrame([(1, ["ab", "", "cde"]), (2, []), (3, ["x"])], "k long, words array<string>")
    got = sorted(tuple(r) for r in align.offset_rows(df).collect())
    assert got == [(1, 0, "ab", 0, 2), (1, 1, "", 2, 2), (1, 2, "cde", 2, 5), (3, 0, "x", 0, 1)]
