"""Quality rules by weak supervision (DataFrame functions only).

A rule votes good (1) or bad (-1) where its condition holds, else abstains (0). Expectation-maximisation
over the counts of vote patterns - at most 2**rules rows whatever the corpus,
counted over all documents - estimates how accurate each rule is; a document
is kept where its posterior probability of being good is at least a half.

Defined results: a null text has no words; a document without words gets only
abstentions and is not used for the estimates; texts of any length are read
whole; repeated rows are judged alike; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import BLANK, WORD, spread, written

#: Bits of a packed window for its place in the text; the rest is of its hash.
PLACE_BITS = 21
#: name: (vote, SQL condition over the counts); a rule whose condition fails abstains.
RULES: dict[str, tuple[int, str]] = {
    "symbols": (-1, "n_symbols > 0.1 * n_words"),
    "repeats": (-1, "n_repeat_words > 0.3 * n_words"),
    "capitals": (-1, "n_capitals > 0.3 * word_chars"),
    "marks": (-1, "n_marks > 0.5 * n_words"),
    "word_length": (-1, "word_chars > 8 * n_words OR word_chars < 2.5 * n_words"),
    "lines": (-1, "n_dup_lines > 0.34 * n_lines"),
    "variety": (-1, "n_distinct_words < 0.1 * n_words"),
    "clean": (1, "n_symbols <= 0.02 * n_words AND n_capitals <= 0.15 * word_chars AND n_marks <= 0.35 * n_words AND 200 * n_marks >= n_words"),
    "vocabulary": (1, "n_distinct_words >= 0.3 * n_words AND n_repeat_words <= 0.2 * n_words AND word_chars >= 3 * n_words AND word_chars <= 7 * n_words"),
}
ITERATIONS = 30
#: Shares of the votes -1, 0 and 1 that every rule starts with.
START_GOOD = (0.05, 0.25, 0.7)
START_BAD = (0.4, 0.3, 0.3)
#: As if so many votes had been seen with these shares.
PRIOR_VOTES = 20.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it in ``body``."""
    return F.transform(F.array(value), body)[0]


def _count(pattern: str) -> Column:
    return F.regexp_count("t", F.lit(pattern)).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more.

    Windows are packed as hash and place into one long and sorted. Neighbours of
    equal hash bits are candidates; these are compared by their words.
    """
    mask = (1 << PLACE_BITS) - 1

    def count(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)

        def packed() -> Column:
            return F.sort_array(
                F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))
            )

        def near(p: Column) -> Column:
            same = lambda x, y: F.coalesce(F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS), F.lit(False))
            found = F.filter(p, lambda x, k: same(x, F.get(p, k + 1)) | same(x, F.get(p, k - 1)))
            return F.transform(found, lambda x: x.bitwiseAND(F.lit(mask)).cast("int"))

        candidates = F.when(F.size(w) <= mask, let(packed(), near)).otherwise(places)

        def equal(found: Column) -> Column:
            windows = F.sort_array(F.transform(found, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i"))))
            twice = lambda s: F.filter(s, lambda x, k: F.coalesce(x["t"] == F.get(s, k + 1)["t"], F.lit(False)) | F.coalesce(x["t"] == F.get(s, k - 1)["t"], F.lit(False)))
            return F.sort_array(F.transform(let(windows, twice), lambda x: x["i"]))

        def covered(at: Column) -> Column:
            steps = F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(candidates, lambda c: F.when(F.size(c) == 0, F.lit(0)).otherwise(let(equal(c), covered)))

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(count(w))).cast("long")


def features(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, counts ...) of every whole text; one narrow pass."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split("t", BLANK), "")
    df = spread(df.select(F.col(id_col).alias("id"), t.alias("t")))
    df = df.select("id", "t", words.alias("words"), F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    long = lambda c, name: c.cast("long").alias(name)
    return df.select(
        "id",
        long(F.size("words"), "n_words"),
        long(F.length(F.array_join("words", "")), "word_chars"),
        _count("[#*$%&|<>]").alias("n_symbols"),
        long(F.size("lines"), "n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines")), "n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        _count("[A-Z]").alias("n_capitals"),
        _count("[.!?]").alias("n_marks"),
        long(F.size(F.array_distinct("words")), "n_distinct_words"),
    )


def vote(rule: tuple[int, str]) -> Column:
    value, condition = rule
    return F.when((F.col("n_words") > 0) & F.expr(condition), value).otherwise(0)


def estimate(patterns: DataFrame, n: int, iterations: int = ITERATIONS) -> DataFrame:
    """(votes, prior, of_good, of_bad, posterior) of a table (votes array<int>, n).

    ``of_good`` and ``of_bad`` hold, for each rule and each of the votes -1, 0
    and 1 in turn, its estimated share among good and among bad documents: what
    a rule's vote is worth, apart for either kind. They start at START_GOOD and
    START_BAD, as if so many votes had been seen. One row holds all patterns, at
    most 2**rules; the steps are array functions.
    """
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("p"))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    at = lambda arr, k: F.get(arr, k if isinstance(k, Column) else F.lit(k))

    def weights(a: Column) -> Column:
        """Log odds of the prior, then of each rule's votes."""
        each = F.transform(F.sequence(F.lit(1), F.lit(3 * n)), lambda k: F.ln(at(a, k) / at(a, k + 3 * n)))
        return F.concat(F.array(F.ln(at(a, 0) / (1 - at(a, 0)))), each)

    def posterior(votes: Column, w: Column) -> Column:
        score = F.aggregate(
            votes,
            F.struct(at(w, 0).alias("s"), F.lit(2).alias("k")),
            lambda s, v: F.struct((s["s"] + at(w, s["k"] + v)).alias("s"), (s["k"] + 3).alias("k")),
        )["s"]
        return 1 / (1 + F.exp(-score))

    def step(a: Column, _: Column) -> Column:
        def update(q: Column) -> Column:
            good = total(F.transform(q, lambda x: x["n"] * x["q"]))
            whole = total(F.transform(q, lambda x: x["n"]))

            def share(k: Column) -> Column:
                """Of vote k % 3 - 1 of rule k div 3 among the good, from 3n on among the bad."""
                bad = k >= 3 * n
                rule = F.floor((k % (3 * n)) / 3).cast("int")
                seen = total(F.transform(q, lambda x: F.when(at(x["votes"], rule) == k % 3 - 1, x["n"] * F.when(bad, 1 - x["q"]).otherwise(x["q"])).otherwise(0.0)))
                start = at(F.array(*[F.lit(x) for x in START_GOOD + START_BAD]), F.when(bad, 3).otherwise(0) + k % 3)
                return (seen + PRIOR_VOTES * start) / (F.when(bad, whole - good).otherwise(good) + PRIOR_VOTES)

            prior = (good + 1) / (whole + 2)
            return F.concat(F.array(prior), F.transform(F.sequence(F.lit(0), F.lit(6 * n - 1)), share))

        of = lambda w: F.transform(F.col("p"), lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), posterior(x["votes"], w).alias("q")))
        return let(let(weights(a), of), update)

    start = F.array(*[F.lit(x) for x in (0.5, *START_GOOD * n, *START_BAD * n)])
    one = one.select("p", F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step).alias("a"))
    one = one.select("a", weights(F.col("a")).alias("w"), F.explode("p").alias("x"))
    return one.select(
        F.col("x.votes").alias("votes"),
        at(F.col("a"), 0).alias("prior"),
        F.slice("a", 2, 3 * n).alias("of_good"),
        F.slice("a", 2 + 3 * n, 3 * n).alias("of_bad"),
        posterior(F.col("x.votes"), F.col("w")).alias("posterior"),
    )


def judge(df: DataFrame, id_col: str = "doc_id", text: str = "text", rules: dict[str, tuple[int, str]] = RULES) -> DataFrame:
    """(id, counts ..., votes, posterior, base_failed, kept) of every document."""
    f = features(df, id_col, text)
    f = f.withColumn("votes", F.array(*[vote(r) for r in rules.values()]))
    f = written(f, "quality")
    patterns = f.where("n_words > 0").groupBy("votes").agg(F.count("*").alias("n"))
    known = estimate(patterns, len(rules)).select("votes", "posterior")
    # at most 2**rules rows: a proven bound
    f = f.join(F.broadcast(known), "votes", "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    f = f.withColumn("base_failed", failed)
    return f.withColumn("kept", ~failed & F.coalesce(F.col("posterior") >= 0.5, F.lit(False)))
