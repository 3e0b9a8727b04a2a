"""From observations to regressions: ``lineitem`` stands in for reading times.

An order is a story, a line number a zone (with gaps), the price the outcome;
quantity, discount and tax are predictors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames, stats
from ..shared import written
from .registry import query, rounded, table

K = 10
OBS = """obs AS (SELECT l_orderkey AS story, l_linenumber AS zone, avg(l_extendedprice) AS rt, avg(l_quantity) AS wlen, avg(l_discount) AS unisurp, avg(l_tax) AS surp
  FROM lineitem GROUP BY 1, 2)"""
LAGGED = f"""{OBS}, lagged AS (SELECT o.*, a.wlen AS wlen_so1, b.wlen AS wlen_so2, a.unisurp AS unisurp_so1, b.unisurp AS unisurp_so2
  FROM obs o JOIN obs a ON a.story = o.story AND a.zone + 1 = o.zone JOIN obs b ON b.story = o.story AND b.zone + 2 = o.zone)"""
FOLDS = f"""folded AS (SELECT *, CAST((row_number() OVER (ORDER BY md5(story || '-' || zone), story || '-' || zone) - 1) % {K} AS INT) AS fold FROM scaled)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("story"), F.col("l_linenumber").alias("zone"))
        .agg(F.avg("l_extendedprice").alias("rt"), F.avg("l_quantity").alias("wlen"), F.avg("l_discount").alias("unisurp"), F.avg("l_tax").alias("surp"))
    )


def key():
    return frames.composite_key("story", "zone")


@query("SELECT l_orderkey AS story, l_linenumber AS zone, round(avg(l_extendedprice), 6) AS mean_rt FROM lineitem GROUP BY 1, 2")
def rt_mean(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "story", "l_linenumber": "zone"})
    return rounded(frames.mean_outcome(df, ["story", "zone"], "l_extendedprice", "mean_rt"))


SPILL = f"""WITH {LAGGED} SELECT story, zone, round(rt, 6) AS rt, round(wlen, 6) AS wlen, round(wlen_so1, 6) AS wlen_so1, round(wlen_so2, 6) AS wlen_so2,
  round(unisurp_so1, 6) AS unisurp_so1, round(unisurp_so2, 6) AS unisurp_so2 FROM lagged"""


def _spill(df):
    return rounded(df.select("story", "zone", "rt", "wlen", "wlen_so1", "wlen_so2", "unisurp_so1", "unisurp_so2"))


@query(SPILL)
def spillover_join(spark, sf_dir):
    return _spill(frames.spillover(observations(spark, sf_dir), "story", "zone", ["wlen", "unisurp"]))


@query(SPILL)
def spillover_range(spark, sf_dir):
    return _spill(frames.spillover_range(observations(spark, sf_dir), "story", "zone", ["wlen", "unisurp"]))


@query(SPILL)
def spillover_left(spark, sf_dir):
    return _spill(frames.spillover(observations(spark, sf_dir), "story", "zone", ["wlen", "unisurp"], how="left").dropna())


@query(f"""WITH {OBS} SELECT story, zone, round((wlen - avg(wlen) OVER ()) / stddev_samp(wlen) OVER (), 6) AS wlen_z,
  round((surp - avg(surp) OVER ()) / stddev_samp(surp) OVER (), 6) AS surp_z FROM obs""")
def zscore(spark, sf_dir):
    scaled = frames.zscore(observations(spark, sf_dir), ["wlen", "surp"], "_z")
    return rounded(scaled.select("story", "zone", "wlen_z", "surp_z"))


@query(f"WITH {OBS}, scaled AS (SELECT story, zone FROM obs), {FOLDS} SELECT story, zone, fold FROM folded")
def balanced_folds(spark, sf_dir):
    return frames.balanced_folds(observations(spark, sf_dir).select("story", "zone"), key(), K)


def _scaled_sql(columns: list[str], source: str) -> str:
    z = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}" for c in columns)
    return f"scaled AS (SELECT story, zone, rt / 10000 AS rt, {z} FROM {source}), {FOLDS}"


def dll_sql(base: list[str], target: list[str], source: str = "lagged", prefix: str = LAGGED) -> str:
    """Held-out gain by fold: Gauss-Jordan elimination on training sums, in steps of SQL."""
    terms = list(dict.fromkeys([*base, *target]))
    full = ["1.0", *terms, "rt"]
    p = len(full)
    sums = ", ".join(f"sum({a} * {b}) AS s_{i}_{j}" for i, a in enumerate(full) for j, b in enumerate(full) if i <= j)
    s = lambda i, j, t: f"{t}_{min(i, j)}_{max(i, j)}"
    whole = ", ".join(f"sum(s_{i}_{j}) OVER () - s_{i}_{j} AS t_{i}_{j}" for i in range(p) for j in range(i, p))
    ctes = [f"sums AS (SELECT fold, {sums} FROM folded GROUP BY fold)", f"train AS (SELECT *, {whole} FROM sums)"]
    for name, formula in (("b", base), ("t", target)):
        use = [0, *[1 + terms.index(c) for c in formula]]
        m, at = len(use), "train"
        first = ", ".join(f"{s(use[i], use[j], 't')} AS {name}0_{i}_{j}" for i in range(m) for j in range(m)) + ", " + ", ".join(f"{s(use[i], p - 1, 't')} AS {name}0_{i}_{m}" for i in range(m))
        ctes.append(f"{name}x0 AS (SELECT fold, {first} FROM {at})")
        for k in range(m):
            a = lambda i, j, k=k: f"{name}{k}_{i}_{j}"
            cells = []
            for i in range(m):
                for j in range(k + 1, m + 1):
                    value = f"{a(k, j)} / {a(k, k)}" if i == k else f"{a(i, j)} - {a(i, k)} * {a(k, j)} / {a(k, k)}"
                    cells.append(f"{value} AS {name}{k + 1}_{i}_{j}")
            ctes.append(f"{name}x{k + 1} AS (SELECT fold, {', '.join(cells)} FROM {name}x{k})")
        beta = lambda i: f"{name}{m}_{i}_{m}"
        rss = lambda t: f"{s(p - 1, p - 1, t)} - " + " - ".join(f"2 * {beta(i)} * {s(use[i], p - 1, t)}" for i in range(m)) + " + " + " + ".join(f"{beta(i)} * {beta(j)} * {s(use[i], use[j], t)}" for i in range(m) for j in range(m))
        ctes.append(f"{name}fit AS (SELECT fold, s_0_0 AS n, ({rss('t')}) / (t_0_0 - {m}) AS v, {rss('s')} AS r FROM train JOIN {name}x{m} USING (fold))")
        ctes.append(f"{name}ll AS (SELECT fold, -0.5 * ln(v) - r / n / (2 * v) AS ll FROM {name}fit)")
    return f"WITH {prefix}, {_scaled_sql(terms, source)}, {', '.join(ctes)} SELECT fold, round(tll.ll - bll.ll, 6) AS dll FROM tll JOIN bll USING (fold)"


def _gain(df: DataFrame, base: list[str], target: list[str]) -> DataFrame:
    terms = list(dict.fromkeys([*base, *target]))
    # statistics, bucket counts, ranks and sums each read the observations: make them once
    df = written(df.select("story", "zone", "rt", *[t for t in terms if t not in ("story", "zone", "rt")]), "observations")
    df = frames.zscore(df, terms).withColumn("rt", F.col("rt") / 10000)
    return stats.cross_validated_gain(frames.balanced_folds(df, key(), K), [], "fold", "rt", base, target)


@query(dll_sql([], ["wlen"], "obs", OBS))
def cv_dll_single(spark, sf_dir):
    return rounded(_gain(observations(spark, sf_dir), [], ["wlen"]))



@query(dll_sql(["wlen", "wlen_so1", "wlen_so2"], ["wlen", "wlen_so1", "wlen_so2", "unisurp", "unisurp_so1", "unisurp_so2"]))
def cv_dll_multi(spark, sf_dir):
    lagged = frames.spillover_range(observations(spark, sf_dir), "story", "zone", ["wlen", "unisurp"])
    base = ["wlen", "wlen_so1", "wlen_so2"]
    return rounded(_gain(lagged, base, [*base, "unisurp", "unisurp_so1", "unisurp_so2"]))


@query(
    dll_sql([], ["wlen"], "obs", OBS).replace("SELECT fold, round(tll.ll - bll.ll, 6) AS dll", "SELECT count(*) AS n_folds, round(avg(tll.ll - bll.ll), 6) AS mean, "
    f"round(avg(tll.ll - bll.ll) - 1.96 * stddev_samp(tll.ll - bll.ll) / sqrt({K}), 6) AS lower, round(avg(tll.ll - bll.ll) + 1.96 * stddev_samp(tll.ll - bll.ll) / sqrt({K}), 6) AS upper")
)
def cv_dll_summary(spark, sf_dir):
    return rounded(stats.fold_summary(_gain(observations(spark, sf_dir), [], ["wlen"]), []))


@query("""SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd,
  round(avg(l_quantity) - 1.96 * stddev_samp(l_quantity) / sqrt(count(*)), 6) AS lower, round(avg(l_quantity) + 1.96 * stddev_samp(l_quantity) / sqrt(count(*)), 6) AS upper,
  round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1""")
def sanity_corr(spark, sf_dir):
    from ..operators.report import sanity

    return rounded(sanity(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"))


@query(f"""WITH {OBS} SELECT a.story, a.zone, round(a.rt, 6) AS rt, round(v.value, 6) AS score FROM
  (SELECT story, zone, rt, row_number() OVER (ORDER BY md5(story || '-' || zone), story || '-' || zone) - 1 AS row_no FROM obs) a
  JOIN (SELECT row_number() OVER (ORDER BY md5(story || '-' || zone), story || '-' || zone) - 1 AS row_no, surp * 2 AS value FROM obs) v USING (row_no)""")
def positional_attach(spark, sf_dir):
    rows = frames.hashed_rank(observations(spark, sf_dir), key(), "row_no")
    vector = rows.select("row_no", (F.col("surp") * 2).alias("value"))
    return rounded(frames.attach_vector(rows.select("story", "zone", "rt", "row_no"), vector, "row_no", "score").drop("row_no"))


@query("""WITH g AS (SELECT l_returnflag AS grp, count(*) AS n, avg(l_quantity) AS estimate, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1),
  p AS (SELECT sum((n - 1) * v) AS rss, sum(n) - count(*) AS df FROM g)
  SELECT grp, n, round(estimate, 6) AS estimate, CAST(df AS BIGINT) AS df, round(sqrt(rss / df) / sqrt(n), 6) AS std_error FROM g, p""")
def group_mean_regression(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), "l_quantity")
    return rounded(stats.group_means(df, "grp", "l_quantity").select("grp", "n", "estimate", "df", "std_error"))


@query(dll_sql([], ["wlen"], "obs", OBS))
def cv_dll_per_row(spark, sf_dir):
    """Gains of single rows; their means by fold are those of the sums."""
    df = frames.zscore(observations(spark, sf_dir), ["wlen"]).withColumn("rt", F.col("rt") / 10000)
    gains = stats.per_row_gain(frames.balanced_folds(df, key(), K), "fold", "rt", [], ["wlen"])
    return rounded(gains.groupBy("fold").agg(F.avg("dll").alias("dll")))


@query("""SELECT l_orderkey AS story, row_number() OVER (ORDER BY first_, l_orderkey) AS rank FROM (SELECT l_orderkey, min(l_partkey) AS first_ FROM lineitem GROUP BY 1)""")
def story_rank(spark, sf_dir):
    ranks = frames.first_appearance(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")
    return ranks.select(F.col("l_orderkey").alias("story"), F.col("rank").cast("long").alias("rank"))


@query("""WITH a AS (SELECT l_orderkey AS story, count(*) AS expected FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS story, count(*) AS found FROM orders GROUP BY 1)
  SELECT story, coalesce(expected, 0) AS expected, coalesce(found, 0) AS found FROM a FULL JOIN b USING (story) WHERE coalesce(expected, 0) <> coalesce(found, 0)""")
def count_validation(spark, sf_dir):
    from ..operators.align import validate_counts

    expected = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("story"))
    return validate_counts(expected, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("story")), ["story"])


@query("""WITH r AS (SELECT l_returnflag, l_linenumber, avg(l_quantity) AS dll FROM lineitem GROUP BY 1, 2), s AS (SELECT l_returnflag, l_linenumber, avg(l_tax) AS mean_surp FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2)
  SELECT l_returnflag, l_linenumber, round(dll, 6) AS dll, round(mean_surp, 6) AS mean_surp FROM r LEFT JOIN s USING (l_returnflag, l_linenumber)""")
def results_with_sanity(spark, sf_dir):
    rows, by = table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber"]
    results = rows.groupBy(*by).agg(F.avg("l_quantity").alias("dll"))
    sanity = rows.where("l_linestatus = 'F'").groupBy(*by).agg(F.avg("l_tax").alias("mean_surp"))
    return rounded(results.join(sanity, by, "left"))


@query("""SELECT l_returnflag, count(*) AS n, round(avg(l_tax - 0.039), 6) AS mean, round(avg(l_tax - 0.039) / (stddev_samp(l_tax - 0.039) / sqrt(count(*))), 4) AS t, count(*) - 1 AS df
  FROM lineitem GROUP BY 1""")
def ttest_stat(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_tax") - 0.039).alias("x"))
    return stats.t_statistic(df, ["l_returnflag"], "x").withColumns({"mean": F.round("mean", 6), "t": F.round("t", 4)})


@query()
def ttest_p(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_tax") - 0.039).alias("x"))
    return stats.t_test(df, ["l_returnflag"], "x")


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity / 1e6), -1) AS slope FROM lineitem GROUP BY 1""")
def stable_regression(spark, sf_dir):
    """A predictor that varies by millionths of itself: triangular factors keep what sums of products lose."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", (F.col("l_quantity") / 1e6 + 1).alias("x"))
    found = stats.stable_coefficients(rows, ["l_returnflag"], ["x"], "l_extendedprice")
    return found.where("term = 'x'").select("l_returnflag", F.round("estimate", -1).alias("slope"))


@query("""SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, l_linestatus FROM lineitem GROUP BY l_linestatus""")
def linear_smoother(spark, sf_dir):
    c = stats.coefficients(table(spark, sf_dir, "lineitem"), ["l_linestatus"], ["l_quantity"], "l_extendedprice")
    return c.groupBy("l_linestatus").agg(
        F.round(F.max(F.when(F.col("term") != "intercept", F.col("estimate"))), 4).alias("slope"),
        F.round(F.max(F.when(F.col("term") == "intercept", F.col("estimate"))), 4).alias("intercept"),
    )


@query(f"""WITH {OBS}, f AS (SELECT *, CAST((row_number() OVER (ORDER BY md5(story || '-' || zone), story || '-' || zone) - 1) % {K} AS INT) AS fold FROM obs),
  v AS (SELECT fold, avg(wlen) AS orig, avg(surp) AS pron, avg(unisurp) AS base FROM f GROUP BY fold)
  SELECT fold, 'orig-pron' AS kind, round(orig - pron, 6) AS dll FROM v UNION ALL SELECT fold, 'base-pron', round(base - pron, 6) FROM v""")
def fold_deltas(spark, sf_dir):
    from ..operators.report import fold_deltas as deltas

    f = frames.balanced_folds(observations(spark, sf_dir), key(), K)
    v = f.groupBy("fold").agg(F.avg("wlen").alias("orig"), F.avg("surp").alias("pron"), F.avg("unisurp").alias("base"))
    long = v.unpivot(["fold"], ["orig", "pron", "base"], "variant", "dll")
    return rounded(deltas(long, [], [("orig-pron", "orig", "pron"), ("base-pron", "base", "pron")]))


@query("""WITH s AS (SELECT l_returnflag, l_linenumber, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
  SELECT a.l_returnflag, round(a.v - b.v, 6) AS delta FROM s a JOIN s b USING (l_returnflag) WHERE a.l_linenumber = 2 AND b.l_linenumber = 7""")
def context_change(spark, sf_dir):
    from ..operators.report import context_change as change

    s = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_quantity").alias("v"))
    return rounded(change(s, ["l_returnflag"], "l_linenumber", 2, 7, "v"))


GRID = (("tax", 1), ("tax", 2), ("part", 1))
PREDICTORS = """preds AS (SELECT l_orderkey AS story, l_linenumber AS zone, avg(l_quantity) AS wlen, avg(l_discount) AS unisurp, avg(l_tax) AS tax_ctx1, avg(l_tax * l_discount) AS tax_ctx2,
  avg(l_partkey % 97) AS part_ctx1, max(CASE WHEN l_linestatus = 'O' AND l_linenumber = 5 THEN 1 ELSE 0 END) AS is_punct, max(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) AS bos,
  max(CASE WHEN l_linenumber = 7 AND l_returnflag = 'A' THEN 1 ELSE 0 END) AS eos FROM lineitem GROUP BY 1, 2)"""
LAG_COLUMNS = ("wlen", "unisurp", *(f"{m}_ctx{c}" for m, c in GRID))
CONTROLS = ["zone", "wlen", "wlen_so1", "wlen_so2"]
UNIGRAM = ["unisurp", "unisurp_so1", "unisurp_so2"]
READING = f"""{PREDICTORS}, rts AS (SELECT l_orderkey AS story, l_linenumber AS zone, avg(l_extendedprice) AS rt FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1, 2),
  spill AS (SELECT o.*, {", ".join(f"{t}.{c} AS {c}_so{k}" for k, t in ((1, "a"), (2, "b")) for c in LAG_COLUMNS)}
    FROM preds o JOIN preds a ON a.story = o.story AND a.zone + 1 = o.zone JOIN preds b ON b.story = o.story AND b.zone + 2 = o.zone),
  reading AS (SELECT s.*, s.zone AS zone_no, rt FROM spill s JOIN rts ON s.story IS NOT DISTINCT FROM rts.story AND s.zone IS NOT DISTINCT FROM rts.zone WHERE is_punct = 0 AND bos = 0 AND eos = 0)"""


def _grid_sql() -> str:
    """Gains of every model and context over both baselines, and their summaries by fold."""
    parts = []
    for m, c in GRID:
        own = [f"{m}_ctx{c}{lag}" for lag in ("", "_so1", "_so2")]
        for kind, base in (("no_unisurp", CONTROLS), ("with_unisurp", [*CONTROLS, *UNIGRAM])):
            named = ["zone_no" if x == "zone" else x for x in base]
            parts.append(f"SELECT '{m}' AS model, {c} AS context, '{kind}' AS baseline, fold, dll FROM ({dll_sql(named, [*named, *own], 'reading', READING)})")
    return f"""WITH g AS ({" UNION ALL ".join(parts)}) SELECT model, context, baseline, count(*) AS n_folds, round(avg(dll), 5) AS mean,
      round(avg(dll) - 1.96 * stddev_samp(dll) / sqrt({K}), 5) AS lower, round(avg(dll) + 1.96 * stddev_samp(dll) / sqrt({K}), 5) AS upper FROM g GROUP BY ALL"""


@query(_grid_sql())
def reading_path(spark, sf_dir):
    """Lags, then the filter of marks and ends, the join with reading times, scaling,
    folds, and the gain of every model and context over two baselines."""
    rows = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "story", "l_linenumber": "zone"})
    flag = lambda test: F.max(F.when(F.expr(test), 1).otherwise(0))
    preds = rows.groupBy("story", "zone").agg(
        F.avg("l_quantity").alias("wlen"),
        F.avg("l_discount").alias("unisurp"),
        F.avg("l_tax").alias("tax_ctx1"),
        F.avg(F.col("l_tax") * F.col("l_discount")).alias("tax_ctx2"),
        F.avg(F.col("l_partkey") % 97).alias("part_ctx1"),
        flag("l_linestatus = 'O' AND zone = 5").alias("is_punct"),
        flag("zone = 1").alias("bos"),
        flag("zone = 7 AND l_returnflag = 'A'").alias("eos"),
    )
    spill = frames.spillover_range(preds, "story", "zone", LAG_COLUMNS)
    spill = spill.where("is_punct = 0 AND bos = 0 AND eos = 0").drop("is_punct", "bos", "eos").dropna()
    times = frames.mean_outcome(rows.where("l_extendedprice > 0"), ["story", "zone"], "l_extendedprice", "rt")
    df = written(frames.join_null_safe(times, spill, ["story", "zone"]).dropna(), "reading")
    scores = [f"{m}_ctx{c}{lag}" for m, c in GRID for lag in ("", "_so1", "_so2")]
    df = frames.balanced_folds(df.withColumn("rt", F.col("rt") / 10000), key(), K)
    df = frames.zscore(df, [*CONTROLS, *UNIGRAM, *scores])
    # one row for each model and context that has its scores
    points = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c).alias("context"), *[F.col(f"{m}_ctx{c}{lag}").alias(f"surp{lag}") for lag in ("", "_so1", "_so2")]) for m, c in GRID])
    long = df.select("fold", "rt", *CONTROLS, *UNIGRAM, F.inline(points))
    gains = None
    for kind, base in (("no_unisurp", CONTROLS), ("with_unisurp", [*CONTROLS, *UNIGRAM])):
        own = stats.cross_validated_gain(long, ["model", "context"], "fold", "rt", base, [*base, "surp", "surp_so1", "surp_so2"])
        own = own.withColumn("baseline", F.lit(kind))
        gains = own if gains is None else gains.unionByName(own)
    return rounded(stats.fold_summary(gains, ["model", "context", "baseline"]), 5)
