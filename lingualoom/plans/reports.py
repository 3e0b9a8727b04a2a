"""Summaries, filters and the tables behind figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames, report, stats
from ..shared import written
from .registry import query, rounded, table


@query("""SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25,
  round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max FROM events GROUP BY 1""")
def describe_quantiles(spark, sf_dir):
    return rounded(stats.describe(table(spark, sf_dir, "events"), ["event_type"], "value"))


@query("""SELECT lang, source, count(*) AS total, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS correct,
  round(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) / count(*), 6) AS accuracy
  FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (source), (lang, source))""")
def accuracy_grouping_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return rounded(stats.accuracy(rows, F.col("quality") == 1, [[], ["lang"], ["source"], ["lang", "source"]]))


@query("""SELECT lang AS condition, CAST(doc_id AS VARCHAR) AS story_index, CASE WHEN toxic = 1 THEN source ELSE lang END AS generated_answer
  FROM labels JOIN documents USING (doc_id) WHERE quality <> 1""")
def missed_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    answers = rows.select(
        F.col("lang").alias("condition"),
        F.col("doc_id").cast("string").alias("story_index"),
        F.lit("0").alias("question_index"),
        F.when(F.col("quality") == 1, " True").otherwise("false ").alias("is_correct"),
        F.when(F.col("toxic") == 1, "A").otherwise("B").alias("generated_label"),
        F.col("source").alias("option_a"),
        F.col("lang").alias("option_b"),
    )
    return report.missed_rows(answers).select("condition", "story_index", "generated_answer")


@query("""SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS group_n FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) >= 12""")
def group_size_filter(spark, sf_dir):
    return frames.large_groups(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], 12)


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM events GROUP BY 1)
  SELECT event_id, event_type, value FROM events JOIN q USING (event_type) WHERE value BETWEEN lo AND hi""")
def quantile_trim(spark, sf_dir):
    return frames.quantile_trim(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], "value")


@query("""SELECT l_returnflag, l_linenumber, count(*) AS n, round(avg(l_quantity), 6) AS mean_base, round(avg(l_quantity - l_tax * 100), 6) AS mean_delta,
  round(avg((l_quantity - l_tax * 100) / l_quantity * 100), 6) AS mean_percent, round(stddev_samp(l_quantity - l_tax * 100), 6) AS sd_delta,
  round(stddev_samp((l_quantity - l_tax * 100) / l_quantity * 100), 6) AS sd_percent FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2""")
def degradation_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", F.col("l_quantity").alias("mean_orig"), (F.col("l_tax") * 100).alias("mean_pron"))
    return rounded(report.degradation(rows, ["l_returnflag", "l_linenumber"]))


WIDE = """w AS (SELECT l_linestatus, avg(l_quantity) AS mean_a, min(l_quantity) AS lower_a, max(l_quantity) AS upper_a, avg(l_tax) AS mean_b, min(l_tax) AS lower_b, max(l_tax) AS upper_b FROM lineitem GROUP BY 1)"""


def _wide(spark, sf_dir):
    agg = [f(c).alias(f"{n}_{k}") for c, k in (("l_quantity", "a"), ("l_tax", "b")) for n, f in (("mean", F.avg), ("lower", F.min), ("upper", F.max))]
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(*agg)


@query(f"""WITH {WIDE} SELECT l_linestatus, 'a' AS kind, round(mean_a, 6) AS mean, lower_a AS lower, upper_a AS upper FROM w UNION ALL SELECT l_linestatus, 'b', round(mean_b, 6), lower_b, upper_b FROM w""")
def unpivot_ci(spark, sf_dir):
    return rounded(frames.long_with_bounds(_wide(spark, sf_dir), ["l_linestatus"], ["a", "b"]))


@query(f"""WITH {WIDE} SELECT l_linestatus, round(-mean_a, 6) AS mean, -upper_a AS lower, -lower_a AS upper FROM w""")
def sign_flip(spark, sf_dir):
    w = _wide(spark, sf_dir).selectExpr("l_linestatus", "mean_a AS mean", "lower_a AS lower", "upper_a AS upper")
    return rounded(frames.flipped(w))


@query("""SELECT o_orderkey AS id, o_orderpriority AS tag, CAST(NULL AS DOUBLE) AS value FROM orders UNION ALL SELECT event_id, event_type, value FROM events""")
def union_by_name(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("tag"))
    b = table(spark, sf_dir, "events").select("value", F.col("event_type").alias("tag"), F.col("event_id").alias("id"))
    return frames.union_frames(a, b).select("id", "tag", "value")


@query("SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_difference(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey")
    return table(spark, sf_dir, "orders").select("o_custkey").subtract(rich)


@query("SELECT n_nationkey FROM nation INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey").intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("""WITH s AS (SELECT l_returnflag, quantile_cont(l_quantity - 25, 0.5) AS median, quantile_cont(l_quantity - 25, 0.025) AS q025, quantile_cont(l_quantity - 25, 0.975) AS q975,
  avg(CASE WHEN l_quantity - 25 > 0 THEN 1.0 ELSE 0.0 END) AS prob_pos FROM lineitem GROUP BY 1)
  SELECT l_returnflag, round(median, 6) AS median, round(q025, 6) AS q025, round(q975, 6) AS q975, round(prob_pos, 6) AS prob_pos, (prob_pos > 0.975 OR prob_pos < 0.025) AS significant,
  CASE WHEN NOT (prob_pos > 0.975 OR prob_pos < 0.025) THEN 'none' WHEN prob_pos > 0.5 THEN 'positive' ELSE 'negative' END AS direction FROM s""")
def posterior_summary(spark, sf_dir):
    draws = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") - 25).alias("draw"))
    return rounded(stats.posterior_summary(draws, ["l_returnflag"], "draw"))


@query("""WITH b AS (SELECT l_linestatus, least(CAST(floor((l_quantity - 0) / 5.0) AS INT), 9) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1, 2)
  SELECT l_linestatus, bin, n, round(n / (sum(n) OVER (PARTITION BY l_linestatus) * 5.0), 6) AS density FROM b""")
def histogram_density(spark, sf_dir):
    return rounded(stats.histogram(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_quantity", 0, 50, 10))


@query()
def mixed_model_summary(spark, sf_dir):
    """l_discount ~ log quantity + (1 | return flag) + (1 | line number): four chains, their summary and R-hat."""
    from ..operators import mixed

    rows = table(spark, sf_dir, "lineitem").select("l_discount", F.ln("l_quantity").alias("log_quantity"), "l_returnflag", "l_linenumber")
    one = [mixed.INTERCEPT]
    draws = mixed.mixed_model(rows, "l_discount", [*one, "log_quantity"], {"l_returnflag": one, "l_linenumber": one}, draws=500, warm_up=200)
    return mixed.model_summary(written(draws, "draws"))


GRID = [0.0, 10.0, 20.0, 30.0, 40.0, 50.0]


@query("""SELECT x, round(avg(exp(-0.5 * ((x - l_quantity) / 4.0) ** 2) / (4.0 * sqrt(2 * pi()))), 6) AS density
  FROM lineitem, (SELECT unnest([0.0::DOUBLE, 10, 20, 30, 40, 50]) AS x) GROUP BY x""")
def kernel_density(spark, sf_dir):
    return rounded(stats.kernel_density(table(spark, sf_dir, "lineitem"), "l_quantity", GRID, 4.0))


@query("""SELECT event_type, min(value) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS high FROM events GROUP BY 1""")
def box_numbers(spark, sf_dir):
    return stats.box_numbers(table(spark, sf_dir, "events"), ["event_type"], "value").withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query("""SELECT n_name, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'other' END AS label FROM nation""")
def map_lookup(spark, sf_dir):
    names = F.create_map(F.lit(0), F.lit("zero"), F.lit(1), F.lit("one"))
    return table(spark, sf_dir, "nation").select("n_name", F.coalesce(F.try_element_at(names, F.col("n_regionkey")), F.lit("other")).alias("label"))


@query("""SELECT event_type, count(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1""")
def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("k"))


@query("""SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem WHERE NOT (l_returnflag IN ('A', 'R') AND l_linenumber > 4) GROUP BY 1, 2""")
def capped_grid(spark, sf_dir):
    rows = report.capped(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linenumber", ["A", "R"], 4)
    return rows.groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events WHERE value > 10 AND value <= 100 GROUP BY 1""")
def time_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value > 10 AND value <= 100")
    return rounded(rows.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")))


@query("""SELECT r_name, o_orderpriority FROM region, (SELECT DISTINCT o_orderpriority FROM orders)""")
def parameter_grid(spark, sf_dir):
    return frames.parameter_grid(table(spark, sf_dir, "region").select("r_name"), table(spark, sf_dir, "orders").select("o_orderpriority").distinct())


@query("""SELECT l_orderkey || '-' || l_linenumber || '-' || l_returnflag AS composite, count(*) AS n FROM lineitem GROUP BY 1""")
def composite_keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(frames.composite_key("l_orderkey", "l_linenumber", "l_returnflag").alias("composite")).agg(F.count("*").alias("n"))


@query("""SELECT lang, CAST(sum(quality) AS BIGINT) AS matched, CAST(sum(toxic) AS BIGINT) AS flagged, count(*) FILTER (WHERE quality = 0) AS missed FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)""")
def outcome_counters(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.rollup("lang").agg(F.sum("quality").alias("matched"), F.sum("toxic").alias("flagged"), F.count_if(F.col("quality") == 0).alias("missed"))


@query("""SELECT p_brand, row_number() OVER (ORDER BY CASE p_brand WHEN 'Brand#13' THEN 0 WHEN 'Brand#12' THEN 1 ELSE 2 END, p_brand) AS level FROM (SELECT DISTINCT p_brand FROM part)""")
def level_order(spark, sf_dir):
    from pyspark.sql import Window

    names = table(spark, sf_dir, "part").select("p_brand").distinct()
    return names.select("p_brand", F.row_number().over(Window.orderBy(frames.level_order(F.col("p_brand"), ["Brand#13", "Brand#12"]))).alias("level").cast("long").alias("level"))


@query("""SELECT CASE WHEN p_type LIKE 'STANDARD%' THEN 'standard' WHEN p_type LIKE 'SMALL%' THEN 'small' ELSE 'other' END AS family, count(*) AS n FROM part GROUP BY 1""")
def family_lookup(spark, sf_dir):
    name = report.family(F.col("p_type"), {"STANDARD": "standard", "SMALL": "small"})
    return table(spark, sf_dir, "part").groupBy(name.alias("family")).agg(F.count("*").alias("n"))


@query("""SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type, count(value) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2""")
def windowed_outcomes(spark, sf_dir):
    from ..streaming.outcomes import windowed_outcomes as windowed

    return rounded(windowed(table(spark, sf_dir, "events")))


@query("""SELECT lang, count(DISTINCT source) AS n_sources, array_to_string(list_sort(list_distinct(list(source))), '|') AS sources FROM documents GROUP BY 1""")
def distinct_levels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("lang")
    return d.agg(F.countDistinct("source").alias("n_sources"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"))


@query("""WITH r AS (SELECT p_size, row_number() OVER (ORDER BY p_size) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT p_size FROM part))
  SELECT p_size FROM r WHERE n <= 16 OR r IN (SELECT CAST(floor(1 + k * (n - 1) / 15.0 + 0.5) AS BIGINT) FROM (SELECT unnest(range(0, 16)) AS k), (SELECT DISTINCT n FROM r))""")
def evenly_spaced(spark, sf_dir):
    return frames.evenly_spaced(table(spark, sf_dir, "part").select("p_size").distinct(), "p_size", 16)


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')""")
def membership(spark, sf_dir):
    big = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return orders.join(big, "o_orderkey", "left_semi").where(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))


@query("""SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")
def dimension_lookup(spark, sf_dir):
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return table(spark, sf_dir, "nation").join(regions, "n_regionkey", "left").select("n_name", "r_name")


@query("""SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_linenumber IN (1, 3, 9)""")
def available_grid(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    numbers = spark.createDataFrame([(k,) for k in (1, 3, 9)], "l_linenumber int")
    names = ("l_returnflag", "l_linestatus", "l_linenumber")
    return frames.parameter_grid(*[rows.select(c).distinct() for c in names[:2]], numbers, available=rows.select(*names)).select(*names)


@query("""SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 11""")
def first_levels(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return report.first_levels(sizes, [F.desc("n"), F.col("p_brand")])


@query("""WITH r AS (SELECT l_orderkey, row_number() OVER (ORDER BY min(l_partkey), l_orderkey) AS rank FROM lineitem GROUP BY 1)
  SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem JOIN r USING (l_orderkey) WHERE rank IN (1, 3, 20) GROUP BY 1, 2
  UNION ALL SELECT l_orderkey, l_linenumber, count(*) FROM lineitem WHERE l_orderkey IN (2, 5) GROUP BY 1, 2""")
def story_selection(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    numbered = frames.chosen_stories(rows, "l_orderkey", "l_partkey", numbers=[1, 3, 20])
    named = frames.chosen_stories(rows, "l_orderkey", "l_partkey", ids=[2, 5])
    each = lambda df: df.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return each(numbered).unionAll(each(named))


@query("""SELECT l_linestatus, parameter, round(value, 6) AS value FROM (SELECT l_linestatus, avg(l_quantity) AS qty, avg(l_tax) AS tax FROM lineitem GROUP BY 1)
  UNPIVOT (value FOR parameter IN (qty, tax))""")
def draws_long(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.avg("l_quantity").alias("b_qty"), F.avg("l_tax").alias("b_tax"), F.count("*").alias("n"))
    return rounded(frames.draws_long(wide.drop("n"), ["l_linestatus"], "b_"))


@query(f"""WITH {WIDE} SELECT l_linestatus, 'quantity' AS kind, round(mean_a, 6) AS mean, lower_a AS lower, upper_a AS upper FROM w UNION ALL SELECT l_linestatus, 'b', round(mean_b, 6), lower_b, upper_b FROM w""")
def recoded_long(spark, sf_dir):
    long = frames.long_with_bounds(_wide(spark, sf_dir), ["l_linestatus"], ["a", "b"])
    return rounded(long.withColumn("kind", frames.recoded(F.col("kind"), {"a": "quantity"})))


@query("""SELECT DISTINCT lower(p_brand) AS family, 'eos' AS pad_token, 'left' AS padding_side, true AS position_ids FROM part UNION ALL SELECT 'opt', 'eos', 'left', false""")
def scorer_setup(spark, sf_dir):
    from ..operators.context import scorer_setup as setup

    names = table(spark, sf_dir, "part").select(F.lower("p_brand").alias("family")).distinct()
    return setup(names.unionAll(spark.createDataFrame([("opt",)], "family string")))


@query("""SELECT coalesce(lang, 'NA') || ': ' || count(*) || ' texts, ' || CAST(sum(quality) AS BIGINT) || ' good, ' || CAST(sum(toxic) AS BIGINT) || ' toxic' AS line
  FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)""")
def printed_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    each = rows.rollup("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))
    return report.summary_lines(each, "%s: %d texts, %d good, %d toxic", ["lang", "n", "good", "toxic"])


@query("""SELECT row_number() OVER (ORDER BY condition, TRY_CAST(story_index AS BIGINT) IS NULL, TRY_CAST(story_index AS BIGINT) NULLS FIRST, story_index, TRY_CAST(question_index AS BIGINT) IS NULL, TRY_CAST(question_index AS BIGINT) NULLS FIRST, question_index) AS row_no,
  condition, story_index, question_index FROM (SELECT lang AS condition, CASE WHEN doc_id % 7 = 0 THEN 'q' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS story_index, CAST(quality AS VARCHAR) AS question_index FROM labels JOIN documents USING (doc_id))""")
def report_order(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    story = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("q"), "doc_id")).otherwise(F.col("doc_id").cast("string"))
    rows = rows.select(F.col("lang").alias("condition"), story.alias("story_index"), F.col("quality").cast("string").alias("question_index"))
    return report.in_report_order(rows).select("row_no", "condition", "story_index", "question_index")


@query("""SELECT n_name AS model, c AS context, greatest(1, CAST(6000 // c AS INT)) AS batch_rows FROM nation, (SELECT unnest([5, 100, 700, 2000, 2047, 4096]) AS c)
  WHERE c <= coalesce(CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey * 200 END, 2048) - CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 0 END""")
def context_plan(spark, sf_dir):
    """Longest contexts of models and rows of a batch."""
    from ..operators import context

    key = F.col("n_nationkey")
    models = table(spark, sf_dir, "nation").select(F.col("n_name").alias("model"), F.when(key % 4 != 0, key * 200).alias("max_positions"), (key % 3 == 0).alias("offset_positions"))
    return context.context_plan(models, [4096, 5, 100, 700, 100, 2000, 0, 2047], 6000)
