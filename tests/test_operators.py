"""Small fixtures for the rules that the large tables don't reach."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lingualoom.functions import text as fn
from lingualoom.operators import align, context, frames, grams, score, spans, stats


def test_spillover_drops_gaps_and_multiplies_repeats(spark):
    df = spark.createDataFrame([(1, z, z * 10.0) for z in (1, 2, 3, 5, 6, 7)], "story int, zone int, w double")
    assert [r.zone for r in frames.spillover(df, "story", "zone", ["w"]).collect()] == [3, 7]
    assert sorted(r.zone for r in frames.spillover_range(df, "story", "zone", ["w"]).collect()) == [3, 7]
    twice = df.unionAll(df.where("zone = 2"))
    assert frames.spillover(twice, "story", "zone", ["w"]).where("zone = 3").count() == 2


def test_lags_come_before_filters(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 0), (1, 2, 2.0, 1), (1, 3, 3.0, 0)], "story int, zone int, w double, punct int")
    out = frames.spillover(df, "story", "zone", ["w"]).where("punct = 0").collect()
    assert [(r.zone, r.w_so1) for r in out] == [(3, 2.0)]


def test_means_leave_out_nan_and_null(spark):
    df = spark.createDataFrame([(1, 1.0), (1, float("nan")), (1, None), (2, None)], "k int, v double")
    assert {r.k: r.m for r in frames.mean_outcome(df, ["k"], "v", "m").collect()} == {1: 1.0, 2: None}


def test_constant_and_single_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("b", 1.0, 1.0)], "g string, x double, y double")
    assert {r.g: r.r for r in stats.correlation(df, ["g"], "x", "y").collect()} == {"a": None, "b": None}
    assert {r.g: r.lower for r in stats.mean_ci(df, ["g"], "x").collect()} == {"a": 1.0, "b": None}
    assert all(r.x_z is None for r in frames.zscore(df, ["x"], "_z").collect())
    assert all(r.t is None for r in stats.t_statistic(df, ["g"], "x").collect())


def test_folds_are_balanced(spark):
    df = spark.range(1003).select(F.col("id"))
    sizes = [r["count"] for r in frames.balanced_folds(df, F.col("id"), 10).groupBy("fold").count().collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 1 and sum(sizes) == 1003
    assert sorted(r.r for r in frames.hashed_rank(df, F.col("id"), "r").collect()) == list(range(1003))


def test_positional_attach_checks_lengths(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "row_no int, w string")
    v = spark.createDataFrame([(0, 1.0), (1, 2.0)], "row_no int, value double")
    assert {r.w: r.s for r in frames.attach_vector(a, v, "row_no", "s").collect()} == {"x": 1.0, "y": 2.0}
    with pytest.raises(Exception, match="rows and values differ"):
        frames.attach_vector(a, v.limit(1), "row_no", "s").collect()


def test_ols_agrees_with_least_squares():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3))
    y = 2 + x @ [1.0, -2.0, 0.5] + rng.normal(size=50)
    full = np.column_stack([np.ones(50), x, y])
    beta, sigma = stats.fit_gram(full.T @ full, [1, 2, 3])
    want, rss, *_ = np.linalg.lstsq(full[:, :4], y, rcond=None)
    assert np.allclose(beta, want) and np.isclose(sigma, math.sqrt(rss[0] / 46))
    aliased = np.column_stack([np.ones(50), x[:, 0], 2 * x[:, 0], y])
    _, s2 = stats.fit_gram(aliased.T @ aliased, [1, 2])
    _, s1 = stats.fit_gram(aliased.T @ aliased, [1])
    assert np.isclose(s1, s2)


def test_student_t():
    assert math.isclose(stats.student_two_sided(2.228138852, 10), 0.05, rel_tol=1e-7)
    assert math.isclose(stats.student_quantile(0.975, 5), 2.570581836, rel_tol=1e-7)
    assert math.isclose(stats.student_two_sided(1.0, 1), 0.5, rel_tol=1e-12)
    assert math.isclose(stats.student_quantile(0.025, 30), -2.042272456, rel_tol=1e-7)


def test_distance_falls_back_to_the_earliest(spark):
    rows = [("c", 0, 1, True), ("c", 5, 6, True), ("c", 9, 11, False), ("c", 20, 21, True), ("d", 3, 4, False)]
    df = spark.createDataFrame(rows, "chain string, start int, end int, lone boolean")
    got = sorted((r.start, r.distance) for r in spans.previous_mention_distance(df, ["chain"], "lone").collect())
    assert got == [(5, 6), (9, 11), (20, 12)]


WORDS = [("the", "DET", ["1"]), ("big", "ADJ", ["1"]), ("cat", "NOUN", ["1", "2"]), ("saw", "VERB", []), ("it", "PRON", ["1"]), (".", "PUNCT", []), ("the", "DET", ["1"]), ("end", "NOUN", [])]


def words_of(spark):
    return spark.createDataFrame([(1, k, *w) for k, w in enumerate(WORDS)], "doc int, pos int, word string, upos string, chains array<string>")


def test_sentences_mentions_and_starts(spark):
    w = words_of(spark)
    s = spans.sentences(w)
    assert s.count() == 6  # the tail has no terminator
    m = sorted((r.chain, r.start, r.end) for r in spans.mentions(s).collect())
    assert m == [("1", 0, 3), ("1", 4, 5), ("2", 2, 3)]
    assert {r.chain: r.n for r in spans.mention_starts(w).collect()} == {"1": 3, "2": 1}
    chosen = spans.select_mentions(spans.mentions(s), spans.mention_starts(w), repeated=True)
    assert sorted((r.start, r.end) for r in chosen.collect()) == [(0, 3), (4, 5)]
    t = spans.masked(spans.targets(s, chosen)).first()
    assert t.phrases == ["the big cat"] and t.masked == "[[TARGET_0]] saw it ."


def test_masking_longest_first_with_gap(spark):
    df = spark.createDataFrame([("the big cat saw a dog", ["the big cat", "cat", "dog"])], "original string, phrases array<string>")
    r = spans.masked(df).first()
    assert r.masked == "[[TARGET_0]] saw a [[TARGET_2]]"
    assert [(x.placeholder, x.phrase) for x in r.target_mapping] == [("[[TARGET_0]]", "the big cat"), ("[[TARGET_2]]", "dog")]


def test_nested_spans(spark):
    df = spark.createDataFrame([(1, 0, 4), (1, 1, 2), (1, 0, 4), (1, 4, 6), (2, 1, 2)], "g int, start int, end int")
    assert sorted(map(tuple, spans.not_nested(df, ["g"]).collect())) == [(1, 0, 4), (1, 0, 4), (1, 4, 6), (2, 1, 2)]


def test_replay_errors(spark):
    kinds = "k int, masked string, target_mapping array<struct<placeholder:string,phrase:string>>"
    p = spark.createDataFrame([(1, "[[TARGET_0]] x", [("[[TARGET_0]]", "a")])], kinds)
    saved = lambda m, mapping: spark.createDataFrame([(1, 0, "old", {}), (1, 1, m, mapping)], "k int, file_pos int, masked string, pronoun_mapping map<string,string>")
    good = saved("[[TARGET_0]] x", {"[[TARGET_0]]": "it"})
    assert spans.replay(p, good, ["k"]).first().pronoun_mapping == {"[[TARGET_0]]": "it"}
    for bad, why in ((saved("y", {"[[TARGET_0]]": "it"}), "mask differs"), (saved("[[TARGET_0]] x", {}), "incomplete"), (good.where("k > 1"), "no saved")):
        with pytest.raises(Exception, match=why):
            spans.replay(p, bad, ["k"]).collect()


def test_rendering_cases_pronouns(spark):
    rows = [("[[TARGET_0]] saw [[TARGET_1]] .", {"[[TARGET_0]]": "they", "[[TARGET_1]]": "it"}), ('" [[TARGET_0]] ran . " [[TARGET_1]]', {"[[TARGET_0]]": "she"})]
    df = spark.createDataFrame(rows, "masked string, pronoun_mapping map<string,string>")
    assert [r.rendered for r in spans.rendered(df).collect()] == ["They saw it.", '"She ran." [[TARGET_1]]']


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("He said \" yes , please \" to us .", 'He said "yes, please" to us.'),
        ("I do n't know ( really ) .", "I don't know (really)."),
        ("the dogs ' tails and ' so ' on", "the dogs' tails and 'so' on"),
        ("It cost $ 5 - 6 % off", "It cost $5-6% off"),
        ("“ Hi ” ‘ x ’", "“Hi” ‘x’"),
        ("", ""),
        (None, None),
    ],
)
def test_detokenize(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(fn.detokenize(F.col("t")).alias("t"))
    assert df.first().t == want
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_text_functions(spark):
    df = spark.createDataFrame([("The Cat9", "can't œuvre won't it's")], "a string, b string")
    r = df.select(fn.letters_only(F.col("a")).alias("l"), fn.normal_tokens(F.col("b")).alias("t")).first()
    assert r.l == "heat9" and r.t == ["ca", "n", "'", "t", "œuvre", "wo", "n", "'", "t", "it", "'", "s"]
    at = spark.createDataFrame([("Hi. “ x", 6), ("Hi, x", 4), ("x", 0), ("a ( x", 4)], "t string, k int")
    assert [r[0] for r in at.select(fn.starts_sentence(F.col("t"), F.col("k"))).collect()] == [True, False, True, False]
    cells = spark.createDataFrame([("",), ("They,|it",), ("US.",), ("...",)], "c string")
    assert [r[0] for r in cells.select(fn.clean_replacement(F.col("c"))).collect()] == ["NA", "they|it", "US", "..."]
    ids = spark.createDataFrame([(["10", "2", "2"],), ([],)], "c array<string>")
    assert [r[0] for r in ids.select(fn.chain_cell(F.col("c"))).collect()] == ["2|10", "_"]


def test_reply_map(spark):
    df = spark.createDataFrame([({"TARGET_0": " They ", "[[TARGET_1]]": "cat", "target_2": "It"}, ["[[TARGET_0]]", "[[TARGET_1]]", "[[TARGET_2]]"])], "m map<string,string>, k array<string>")
    assert df.select(fn.allowed_pronouns(F.col("m"), F.col("k"))).first()[0] == {"[[TARGET_0]]": "they", "[[TARGET_2]]": "it"}


def test_expand_tokens_rejects_bad_counts(spark):
    good = spark.createDataFrame([("s", 1, "2"), ("s", 2, "1")], "story string, row_no int, num_tokens string")
    assert [(r.row_no, r.token_index) for r in align.expand_tokens(good).orderBy("token_index").collect()] == [(1, 0), (1, 1), (2, 2)]
    for bad in ("0", "x", None):
        with pytest.raises(Exception, match="bad num_tokens"):
            align.expand_tokens(spark.createDataFrame([("s", 1, bad)], "story string, row_no int, num_tokens string")).collect()


def test_overlap_and_as_of(spark):
    a = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 100, 100), (1, 2, 100, 130)], "g int, at int, start int, end int")
    b = spark.createDataFrame([(1, 10, 90, "x"), (1, 95, 120, "y")], "g int, start int, end int, tag string")
    got = sorted((r["at"], r.r_tag) for r in align.overlaps(a, b, ["g"]).collect())
    assert got == [(0, "x"), (0, "y"), (2, "y")]
    tagged = {r["at"]: r.tag for r in align.tag_words(a, b, ["g"]).collect()}
    assert tagged == {0: "x", 1: "y", 2: "y"}  # the empty word takes the last one at or before it


def test_global_offsets(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") / 10).cast("int").alias("b"))
    out = align.running_offsets(df, ["id"], F.lit(3), block="b").orderBy("id").collect()
    assert [r.start for r in out] == [3 * k for k in range(100)]


RECORD = "story string, sentence int, original string, target_mapping array<struct<placeholder:string,phrase:string>>, pronoun_mapping map<string,string>"


def annotated(spark, words, records, **options):
    w = spark.createDataFrame([("s", k, *(x if isinstance(x, tuple) else (x,))) for k, x in enumerate(words)], "story string, row_no int, word string" + ", pronoun_replacement string" * isinstance(words[0], tuple))
    r = spark.createDataFrame([("s", k, text, [(f"[[TARGET_{i}]]", phrase) for i, phrase in enumerate(phrases)], mapping) for k, (text, phrases, mapping) in enumerate(records)], RECORD)
    got = align.annotate(w, r, **options).orderBy("row_no").collect()
    return [x.pronoun_replacement for x in got], [got[0].matched, got[0].flagged, got[0].missed]


def test_annotate_cursor_and_policies(spark):
    words = ["The", "cat", "saw", "the", "cat.", "Bye"]
    it = {"[[TARGET_0]]": "it", "[[TARGET_1]]": "it"}
    records = [("not here", ["the cat"], it), ("The cat saw the cat.", ["the cat", "dog"], it), ("Bye", ["bye"], {})]
    assert annotated(spark, words, records) == (["NA", "NA", "NA", "it.", "it.", "NOT_REPLACED"], [1, 1, 2])
    assert annotated(spark, words, records, last_free=False)[0][:2] == ["It", "It"]
    # a second phrase takes the place that the first has left free
    assert annotated(spark, words, [("The cat saw the cat.", ["the cat", "cat"], it)])[0] == ["NA", "it", "NA", "it.", "it.", "NA"]


def test_sentence_places_against_a_plain_search():
    """Short and repeated sentences, empty and missing ones; nothing is looked for before the cursor."""
    rng = random.Random(12)
    for _ in range(300):
        stream = [rng.choice("ab") for _ in range(rng.randrange(12))]
        sentences = [None if rng.random() < 0.1 else [rng.choice("ab") for _ in range(rng.randrange(6))] for _ in range(4)]
        behind, want = 0, []
        for s in sentences:
            want.append(next((k for k in range(behind, len(stream) - len(s) + 1) if stream[k : k + len(s)] == s), None) if s else None)
            behind = behind if want[-1] is None else want[-1] + len(s)
        assert align._sentence_places(stream, sentences) == want


def test_annotate_stories_without_records_or_a_name(spark):
    words = spark.createDataFrame([(1, 1, "Cats"), (None, 1, "Cats"), (None, 2, "ran."), (2, 1, None)], "story int, row_no int, word string")
    records = spark.createDataFrame([(None, 0, "Cats ran.", [("[[TARGET_0]]", "cats")], {"[[TARGET_0]]": "they"}), (3, 0, "x", [], {})], "story int, sentence int, original string, target_mapping array<struct<placeholder:string,phrase:string>>, pronoun_mapping map<string,string>")
    got = sorted(tuple(map(str, r)) for r in align.annotate(words, records).collect())
    assert got == [("1", "1", "Cats", "NA", "0", "0", "0"), ("2", "1", "None", "NA", "0", "0", "0"), ("None", "1", "Cats", "They", "1", "0", "0"), ("None", "2", "ran.", "NA", "1", "0", "0")]


def test_annotate_appends_to_cells(spark):
    words = [("The", ""), ("cat", "NA"), ("ran", "x|y"), ("ran", "he")]
    records = [("The cat ran ran", ["ran", "ran"], {"[[TARGET_0]]": "he", "[[TARGET_1]]": "x"})]
    assert annotated(spark, words, records)[0] == ["NA", "NA", "x|y", "he"]
    assert annotated(spark, words, [("The cat ran ran", ["the cat ran"], {"[[TARGET_0]]": "i"})])[0] == ["I", "I", "x|y|I", "he"]


def test_a_colon_opens_text_but_no_tokens(spark):
    words, it = [":", "Cats", "ran", "“", "dogs", "ran"], {"[[TARGET_0]]": "they"}
    assert annotated(spark, words, [(": Cats ran", ["cats"], it), ("“ dogs ran", ["dogs"], it)])[0] == ["NA", "they", "NA", "NA", "They", "NA"]
    df = spark.createDataFrame([([":", "cats"], ": cats"), (["(", "cats"], "( cats")], "t array<string>, s string")
    got = df.select(fn.starts_sentence_tokens(F.col("t"), F.lit(1)), fn.starts_sentence(F.col("s"), F.lit(2))).collect()
    assert [tuple(r) for r in got] == [(False, True), (True, True)]


def test_detokenize_against_a_plain_loop(spark):
    import random

    from brute import detokenized

    r = random.Random(4)
    marks = ["a", "dogs", "S", "s", '"', "'", "‘", "’", "“", "”", ".", "-", "$", "n't", "(", "‘’", "\x1cb"]
    texts = [r.choice([" ", "  ", "\n"]).join(r.choice(marks) for _ in range(r.randrange(0, 14))) for _ in range(400)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fn.detokenize(F.col("t")).alias("d")).collect()
    assert [x.d for x in got] == [detokenized(t) for t in texts]


def test_larger_spans_starting_anywhere(spark):
    rng = np.random.default_rng(8)
    rows = [(int(g), int(s), int(s + n)) for g, s, n in zip(rng.integers(0, 20, 600), rng.integers(0, 30, 600), rng.integers(1, 8, 600))]
    inside = lambda a, b: a[0] == b[0] and b[1] <= a[1] and b[2] >= a[2] and a != b
    got = spans.not_nested(spark.createDataFrame(rows, "g int, start int, end int"), ["g"]).collect()
    assert sorted(map(tuple, got)) == sorted(a for a in rows if not any(inside(a, b) for b in rows))


def test_rows_without_a_shuffle_are_the_same(spark):
    rng = np.random.default_rng(9)
    texts = [rng.choice(["a", "b", "."], rng.integers(0, 30)).tolist() for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, tokens array<string>")
    words = docs.select("doc", F.posexplode("tokens").alias("pos", "word"))
    columns = ["doc", "sentence", "pos", "at", "word"]
    assert sorted(map(tuple, spans.sentence_rows(docs).select(columns).collect())) == sorted(map(tuple, spans.sentences(words).select(columns).collect()))
    for size in (1, 2, 5):
        wide = context.windows(words, size, at="pos", token="word")
        assert sorted((r.doc, r["at"], r.target, r.window) for r in context.window_rows(docs, size).collect()) == sorted((r.doc, r.pos, r.target, r.window) for r in wide.collect())


def naive_windows(ids, replacements, size, pronoun, extend):
    spans_ = context._spans(replacements)

    def collapse(s, t):
        out, i = [], s
        while i <= t:
            hit = next((x for x in spans_ if x[0] == i and x[1] <= t), None)
            out += list(pronoun(hit[2], i)) if hit else [ids[i]]
            i = hit[1] if hit else i + 1
        return out

    result = []
    for t in range(len(ids)):
        s = max(0, t + 1 - size)
        while extend and s > 0 and len(collapse(s, t)) < size:
            s -= 1
        result.append(collapse(s, t)[-size:])
    return result


@pytest.mark.parametrize("extend", [False, True])
def test_collapsed_windows_against_brute_force(extend):
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 40))
        ids = list(range(n))
        replacements = [[None, None, "a", "b"][k] for k in np.repeat(rng.integers(0, 4, n), rng.integers(1, 5, n))[:n]]
        pronoun = lambda text, start: [1000 + start] * (1 if text == "a" else 2)
        for size in (1, 3, 6, 12):
            assert context.collapsed_windows(ids, replacements, size, pronoun, extend) == naive_windows(ids, replacements, size, pronoun, extend)


def test_distance_counts_agree_with_rows_of_words(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [[None, "the", "cat", "dog", "le"][int(c)] for c in rng.integers(0, 5, n)]) for k, n in enumerate(rng.integers(0, 40, 50))] + [(50, None), (51, ["cat"]), (52, [])]
    docs = spark.createDataFrame(rows, "doc int, chains array<string>").repartition(3)
    words = docs.select("doc", F.posexplode("chains").alias("pos", "chain")).where("chain IS NOT NULL")
    m = spans.islands(words, ["doc", "chain"], "pos").withColumn("lone", F.col("chain").isin("the", "le"))
    each = spans.previous_mention_distance(m, ["doc", "chain"], "lone").select(F.col("distance").cast("long").alias("d"))
    counts = spans.distance_counts(docs.select("chains"), ["the", "le"], rows_at_once=4)
    assert {r.distance: r.n for r in counts.collect()} == {r.d: r["count"] for r in each.groupBy("d").count().collect()}
    # what is made of counts is what is made of rows
    n = counts.withColumnRenamed("distance", "d")
    assert tuple(stats.describe_counts(n, "d", "n").first()) == pytest.approx(tuple(stats.describe(each, [], "d").first()))
    for made in (stats.automatic_histogram, stats.automatic_density):
        a, b = (sorted(map(tuple, x.collect())) for x in (made(n, "d", weight="n"), made(each, "d")))
        assert len(a) == len(b) and all(x == pytest.approx(y) for x, y in zip(a, b, strict=True))
    none = spans.distance_counts(docs.limit(0).select("chains"), ["the"])
    assert none.count() == 0 and tuple(stats.describe_counts(none, "distance", "n").first()) == (0, *[None] * 7)


@pytest.mark.parametrize("extend", [False, True])
def test_pronoun_windows_of_rows_are_the_same(spark, extend):
    rng = np.random.default_rng(5)
    rows = [(k, [(int(i), rng.choice([" a", " .", ' "']), [None, "they", "it"][int(rng.integers(0, 3))]) for i in rng.integers(0, 99, n)]) for k, n in enumerate(rng.integers(0, 30, 40))]
    docs = spark.createDataFrame([*rows, (40, None)], "doc int, tokens array<struct<id:int,piece:string,replacement:string>>").repartition(3)
    ids = {(p, s, d): [1000 + len(p)] * (1 + s + d) for p in ("they", "it") for s in (False, True) for d in (False, True)}
    flat = docs.select("doc", F.posexplode("tokens").alias("at", "t")).select("doc", "at", "t.*")
    want = {(r.doc, r["at"]): r.window for r in context.pronoun_windows(flat, ids, 4, extend).collect()}
    made = context.pronoun_window_rows(docs, ids, 4, extend, rows_at_once=7)
    assert {(r.doc, k): w for r in made.collect() for k, w in enumerate(r.windows)} == want


def test_windows_pad_and_mask(spark):
    df = spark.createDataFrame([(1, k, 10 + k, k == 1) for k in range(4)], "doc int, at int, token int, hid boolean")
    got = [(r.window, r["mask"], r.target) for r in context.windows(df, 3, pad=F.lit(0)).orderBy("at").collect()]
    assert got[0] == ([0, 0, 10], [0, 0, 1], 10) and got[3] == ([11, 12, 13], [1, 1, 1], 13)
    m = [r["mask"] for r in context.masked_windows(df, 3, "hid").orderBy("at").collect()]
    assert m == [[1], [1, 1], [1, 0, 1], [0, 1, 1]]
    p = spark.createDataFrame([([0, 0, 1, 1, 0, 1],)], "m array<int>").select(context.position_ids(F.col("m"))).first()[0]
    assert p == [0, 0, 0, 1, 1, 2]
    assert context.usable_contexts([5, 3, 3, 9], 6) == [3, 5] and context.batch_rows(100, 30) == 3 and context.context_limit(None, True) == 2046


def test_replacement_spans_merge_equal_neighbours(spark):
    df = spark.createDataFrame([(1, k, r) for k, r in enumerate([None, "it", "it", "it", None, "he", "it"])], "doc int, at int, replacement string")
    got = sorted((r.start, r.end, r.replacement) for r in context.replacement_spans(df).collect())
    assert got == [(1, 4, "it"), (5, 6, "he"), (6, 7, "it")]


def test_boundary_surprisal_of_first_word(spark):
    df = spark.createDataFrame([(1, 0, 0, 1.0, 0.5), (1, 1, 1, 2.0, 0.25), (1, 2, 1, 3.0, 0.125)], "doc int, at int, word int, surprisal double, space_bits double")
    assert {r.word: r.surprisal for r in score.boundary_surprisal(df).collect()} == {0: 1.5, 1: 4.625}


def test_ngram_backs_off(spark):
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate("a b a b a c".split())], "doc int, at int, token string")
    got = {r["at"]: r.surprisal for r in score.ngram_surprisal(df, 2).collect()}
    assert math.isclose(got[0], -math.log2(0.4 * 3 / 6)) and math.isclose(got[3], -math.log2(1 / 2)) and math.isclose(got[5], -math.log2(0.4 * 1 / 6))


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_ngrams_of_rows_agree_with_rows_of_tokens(spark, size):
    """Slices of few tokens, so grams are counted over many; documents of no, one and two tokens, and one longer than a slice."""
    rng = random.Random(size)
    rows = [(k, [rng.choice("ab.cé") for _ in range(rng.choice((0, 1, 2, 3, 9, 70)))]) for k in range(60)] + [(60, None), (61, ["x"] * 200)]
    docs = spark.createDataFrame(rows, "doc int, tokens array<string>")
    want = score.ngram_surprisal(docs.select("doc", F.posexplode("tokens").alias("at", "token")), size)
    got = grams.ngram_surprisal_rows(docs.repartition(3), size, slice_tokens=50)
    made = {(r.doc, k): v for r in got.collect() for k, v in enumerate(r.surprisal)}
    assert made == pytest.approx({(r.doc, r["at"]): r.surprisal for r in want.collect()}) and len(made) == sum(len(t or ()) for _, t in rows)
    assert grams.ngram_surprisal_rows(docs.limit(0), size).count() == 0


def test_vectors_of_another_length(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "row_no int, w string")
    v = spark.createDataFrame([(0, 1.0)], "row_no int, value double")
    with pytest.warns(UserWarning, match="2 rows but 1 values"):
        assert frames.attach_vector(a, v, "row_no", "s", "skip").columns == ["row_no", "w"]
    assert [r.s for r in frames.attach_vector(a, v, "row_no", "s", "fill").collect()] == [None, None]


def test_selection_counts_nested_mentions(spark):
    w = words_of(spark)
    got = spans.selection_stats(spans.mentions(spans.sentences(w)), spans.mention_starts(w).withColumn("n", F.lit(2)), repeated=True).first()
    assert (got.chains, got.selected_chains, got.raw, got.selected, got.nested) == (2, 2, 3, 2, 1)


def test_columns_by_pattern(spark):
    assert frames.matching_columns(spark.createDataFrame([], "a_so1 int, a int, b_so2 int"), r"_so\d$") == ["a_so1", "b_so2"]


def test_null_keys_match(spark):
    a = spark.createDataFrame([(None, 1), (2, 2), (3, 3)], "k int, x int")
    b = spark.createDataFrame([(None, 10), (2, 20)], "k int, y int")
    assert sorted((r.x, r.y) for r in frames.join_null_safe(a, b, ["k"]).collect()) == [(1, 10), (2, 20)]


def test_stream_equals_batch(spark, tmp_path):
    from lingualoom.streaming.outcomes import windowed_outcomes

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(f"{tmp_path}/in")
    stream = windowed_outcomes(spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in"), late="3650 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("outcomes").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((str(r.start), r.event_type, r.n, round(r.mean_value, 6)) for r in df.collect())
    assert key(spark.table("outcomes")) == key(windowed_outcomes(src))


def test_few_splits_are_dealt_out(spark):
    from lingualoom.shared import spread

    one = spark.range(1000, numPartitions=1)
    cores = spark.sparkContext.defaultParallelism
    assert spread(one).rdd.getNumPartitions() == cores and spread(one).count() == 1000
    many = spark.range(1000, numPartitions=cores + 3)
    assert spread(many) is many
    behind = one.groupBy("id").count()
    assert spread(behind) is behind


def test_least_squares_of_nearly_equal_lags(spark):
    """Sums of products square the condition number; factors by blocks agree with least squares."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=3000)
    lag = x + 1e-7 * rng.normal(size=3000)
    y = 2 + x - lag + 0.1 * rng.normal(size=3000)
    rows = pd.DataFrame({"g": np.where(np.arange(3000) % 3 == 0, "a", "b"), "x": x, "lag": lag, "y": y})
    df = spark.createDataFrame(rows).repartition(7)
    got = {(r.g, r.term): r.estimate for r in stats.stable_coefficients(df, ["g"], ["x", "lag"], "y", block=100, fan=3).collect()}
    plain = {(r.g, r.term): r.estimate for r in stats.coefficients(df, ["g"], ["x", "lag"], "y").collect()}
    for g, own in rows.groupby("g"):
        design = np.column_stack([np.ones(len(own)), own.x, own.lag])
        want = np.linalg.lstsq(design, own.y, rcond=None)[0]
        assert [got[g, t] for t in ("intercept", "x", "lag")] == pytest.approx(want, rel=1e-5)
        assert abs(plain[g, "x"] - want[1]) > abs(want[1]) * 1e-2  # the sums have lost it


def test_least_squares_of_odd_groups(spark):
    rows = [("one", 1.0, 2.0), ("same", 3.0, 1.0), ("same", 3.0, 5.0), (None, 0.0, 1.0), (None, 1.0, 3.0), ("none", None, 1.0)]
    got = {(r.g, r.term): (r.estimate, r.sigma) for r in stats.stable_coefficients(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], ["x"], "y").collect()}
    assert got[None, "x"][0] == pytest.approx(2) and got[None, "intercept"][0] == pytest.approx(1)
    assert got["same", "x"][0] == 0 and got["same", "intercept"][0] == pytest.approx(3)
    assert got["one", "intercept"] == (pytest.approx(2), None) and ("none", "x") not in got


def _random_chains(spark, n=12):
    import random

    r = random.Random(7)
    docs = []
    for k in range(n):
        words = [{"word": r.choice(["a", "b", "."]), "upos": r.choice(["PRON", "ADV", "NOUN"]), "chains": r.sample(["c", "d", "e"], r.choice([0, 1, 1, 2, 3]))} for _ in range(r.choice([0, 1, 2, 40]))]
        docs.append((k, words))
    docs.append((n, [{"word": "a", "upos": "NOUN", "chains": ["c"]}]))
    return spark.createDataFrame(docs, "doc long, words array<struct<word:string,upos:string,chains:array<string>>>")


@pytest.mark.parametrize("repeated", [True, False])
def test_chain_rows_agree_with_rows_of_words(spark, repeated):
    """Several chains a word, nested mentions; nothing of it shuffles."""
    docs = _random_chains(spark)
    words = docs.select("doc", F.posexplode("words").alias("pos", "x")).select("doc", "pos", "x.*")
    rows, plain = spans.chain_rows(docs), spans.sentences(words)
    found, starts = spans.mentions(plain), spans.mention_starts(words)
    rowed = lambda df, *names: sorted(map(str, (tuple(x) for x in df.select(*names).collect())))
    one = rows.select("doc", F.inline("found"))
    assert rowed(one.where("n > 0"), "doc", "chain", "n") == rowed(starts, "doc", "chain", "n")
    assert rowed(one.select("doc", "chain", F.inline("mentions")), "doc", "sentence", "chain", "start", "end") == rowed(found, "doc", "sentence", "chain", "start", "end")
    names = ("doc", "chains", "selected_chains", "raw", "selected", "nested")
    want = rowed(spans.selection_stats(found, starts, repeated), *names)
    assert rowed(spans.selection_rows(rows, repeated), *names) == want
    assert any(not x.endswith(" 0)") for x in want) or not repeated
    targets = spans.targets(plain, spans.select_mentions(found, starts, repeated))
    assert rowed(spans.target_rows(rows, repeated), "doc", "sentence", "original", "phrases") == rowed(targets, "doc", "sentence", "original", "phrases")
    whole = spans.chain_rows(docs, by_sentence=False)
    islands = spans.islands(words.withColumn("chain", F.explode("chains")), ["doc", "chain"], "pos").withColumn("lone", F.col("start") % 3 == 0)
    far = spans.previous_mention_distance(islands, ["doc", "chain"], "lone")
    assert rowed(spans.distance_rows(whole, "m.start % 3 = 0"), "doc", "chain", "start", "end", "distance") == rowed(far, "doc", "chain", "start", "end", "distance")
    for df in (spans.selection_rows(rows, repeated), spans.target_rows(rows, repeated), spans.distance_rows(whole, "false")):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("repeated", [True, False])
def test_masked_rows_agree_with_chain_rows(spark, repeated):
    """Several chains a word, nested mentions, slices of few words; then one chain a word, pronouns among them."""
    names = ("doc", "sentence", "original", "masked", "target_mapping")
    rowed = lambda df: sorted(str(tuple(x)) for x in df.select(*names).collect())
    docs = _random_chains(spark, 30)
    want = rowed(spans.masked(spans.target_rows(spans.chain_rows(docs), repeated)))
    none = spark.createDataFrame([(77, None)], docs.schema)
    arrays = docs.unionAll(none).select("doc", F.col("words.word").alias("words"), F.col("words.upos").alias("upos"), F.col("words.chains").alias("chains"))
    for most in (1, 50, 500_000):
        got = spans.masked_rows(arrays, repeated, words_at_once=most)
        assert rowed(got) == want and (any("TARGET_1" in x for x in want) or not repeated)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    letters = docs.select("doc", F.transform("words", lambda x: F.struct(x["word"].alias("word"), F.when(x["word"] == "b", "PRON").otherwise("X").alias("upos"), F.array(F.when(x["word"] != ".", x["word"])).alias("chains"))).alias("words"))
    letters = letters.withColumn("words", F.transform("words", lambda x: x.withField("chains", F.filter(x["chains"], lambda c: c.isNotNull()))))
    want = rowed(spans.masked(spans.target_rows(spans.chain_rows(letters), repeated)))
    flat = letters.select("doc", F.col("words.word").alias("words"), F.transform("words", lambda x: F.get(x["chains"], 0)).alias("chains"))
    assert rowed(spans.masked_rows(flat, repeated, upos=None, pronouns=["b"])) == want


def test_masking_of_a_long_document(spark, tmp_path):
    """Different mentions were found by comparing each with all: 53 seconds for this document."""
    import time

    import brute

    from lingualoom import plans

    r, n = random.Random(3), 40_000
    words = [r.choice([".", "the", "One", "one"]) if k % 5 == 0 else f"name{r.randrange(n // 4)}" for k in range(n)]
    texts = [" ".join(words), "", "no end", "Names. names NAMES, name names. the the the. \u0130stanbul \u0130stanbul; and \u0130stanbul.", "TARGET_0 is [[TARGET_1]]. arget target. target [[TARGET_1]] TARGET_0."]
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    query = plans.queries()["targets_masking"]
    began = time.perf_counter()
    got = sorted(map(tuple, query(spark, str(tmp_path)).collect()))
    assert time.perf_counter() - began < 30
    with pytest.MonkeyPatch.context() as m:
        m.setattr(brute, "DATA", str(tmp_path))
        assert got == sorted(brute.targets_masking())


def test_window_arrays_agree_with_window_rows(spark):
    docs = spark.createDataFrame([(1, list("abcdef")), (2, []), (3, ["x"])], "doc long, tokens array<string>")
    got = context.window_arrays(docs, 3).select("doc", F.explode(F.arrays_zip("windows", "sizes")).alias("w")).select("doc", "w.*")
    want = context.window_rows(docs, 3).select("doc", F.array_join("window", " "), F.size("window"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_expand_tokens_sorts_words_not_copies(spark):
    df = spark.createDataFrame([("s", 2, "3"), ("s", 1, "2"), ("t", 1, "1")], "story string, row_no int, num_tokens string")
    got = align.expand_tokens(df)
    assert sorted((r.story, r.row_no, r.piece, r.token_index) for r in got.collect()) == [("s", 1, 1, 0), ("s", 1, 2, 1), ("s", 2, 1, 2), ("s", 2, 2, 3), ("s", 2, 3, 4), ("t", 1, 1, 0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Window")


def test_scorer_over_rows_of_documents(spark):
    docs = spark.createDataFrame([(1, list("abcde")), (2, []), (3, ["x"])], "doc long, tokens array<string>")
    got = score.with_scorer_rows(docs, lambda f: f.assign(surprisal=f.doc * 10.0 + f.pos), rows_at_once=2)
    assert {r.doc: r.surprisal for r in got.collect()} == {1: [10, 11, 12, 13, 14], 2: [], 3: [30]}
    sums = score.word_sums(got, 2)
    assert sorted(map(tuple, sums.collect())) == [(1, 0, 21.0), (1, 1, 25.0), (1, 2, 14.0), (3, 0, 30.0)]
    assert "Exchange" not in sums._jdf.queryExecution().executedPlan().toString()
