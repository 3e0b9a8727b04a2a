"""Line dedup by a log-template tree (DataFrame functions only).

Lines are parsed by a tree of fixed depth. Its first levels are the token count
and the first tokens, in which every token with a digit is already a variable
field. Within a node, a token that less than half of the different lines share
at its place is a variable field too, so lines which differ in such fields fall
under one template, however many they are. Lines that keep too few constant
tokens go down one of SPLITS further levels, where a node is split by the
tokens that are frequent at one place; those left at the end are templates of
their own. A template found in at least ``min_docs`` different texts is
boilerplate, and a line of ``long_tokens`` tokens or more is if the same tokens
are in another text: such lines are dropped everywhere but at their first place
(least id, then line), so that no group of copies loses its last copy.

First only the leaves' sizes are counted, by a hash; the few leaves that could
hold a recurring template are then treated by their strings. What is known of a
node is joined to its lines by a salted key, so a hot node is dealt to many
tasks, and is aggregated by place and token before anything is gathered.

Defined results: a null text stays null; an empty text stays empty; a text of
which every line is dropped becomes empty; lines without a token, or with
variable fields only, are never dropped; equal texts count once; rows are known
by id and text, so rows that share an id or have none keep their own lines
(those without id come last); repeated rows are treated alike; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import Scratch, written

DEPTH = 3
SPLITS = 3
MIN_DOCS = 5
LONG_TOKENS = 50
#: A template must keep this share of its tokens, else a line is its own template.
SIMILARITY = 0.6
#: A node's split gives a child to each token that one in so many lines has; the others share a child.
BRANCHES = 64
FIELD = "<*>"
SALTS = 16


def _masked(tokens: Column) -> Column:
    """The tokens joined by blanks, those with a digit as variable fields."""
    joined = F.array_join(tokens, " ")
    fields = F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), FIELD).otherwise(t))
    return F.when(joined.rlike("[0-9]"), F.array_join(fields, " ")).otherwise(joined)


def _key(*parts: Column) -> Column:
    """16 bytes in place of strings, for what is shuffled."""
    return F.unhex(F.md5(F.concat_ws("\n", *parts).cast("binary")))


def _place() -> Column:
    return F.struct(F.col("id").isNull().alias("none"), "id", "text_key", "line")


def parsed(df: DataFrame, id_col: str, text: str, depth: int = DEPTH) -> DataFrame:
    """(id, text_key, line, leaf, tokens) of each line with a token; a narrow pass."""
    # one blank for all: to split at a single character is far cheaper than at a pattern
    blanks = F.when(F.col(text).rlike(r"[\x09\x0B-\x0D]"), F.translate(F.col(text), "\t\x0b\x0c\r", "    ")).otherwise(F.col(text))
    own = df.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(text)).alias("text_key"),
        F.posexplode(F.split(blanks, "\n")).alias("line", "content"),
    )
    own = own.withColumn("tokens", F.array_remove(F.split("content", " "), "")).where(F.size("tokens") > 0)
    leaf = F.concat_ws(" ", F.size("tokens").cast("string"), _masked(F.slice("tokens", 1, depth)))
    return own.select("id", "text_key", "line", leaf.alias("leaf"), "tokens")


def _to_lines(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """Join what is known of nodes, one row each, to their lines: by node and salt,
    so that the lines of a hot node are dealt to many tasks."""
    salted = nodes.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("__salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["node", "__salt"]).drop("__salt")


def _level(now: DataFrame, min_docs: int, similarity: float, last: bool, scratch: Scratch) -> DataFrame:
    """(leaf, node, key, content, rows, template) of the lines of nodes that could
    hold a template: the template of lines that keep enough constants; null for
    the others, whose ``node`` is that of the next level."""
    sizes = now.groupBy("node").agg(F.count("*").alias("of"), F.sum("rows").alias("in_all"))
    # of two lines every token is a constant: each is its own template
    sizes = sizes.where((F.col("of") > 2) & (F.col("in_all") >= min_docs)).select("node", "of")
    some = scratch(_to_lines(now, sizes), "node-lines")
    tokens = some.select("node", "of", F.posexplode(F.split("content", " ")).alias("at", "token"))
    counts = tokens.groupBy("node", "of", "at", "token").agg(F.count("*").alias("n"))
    n, of, word = F.col("n"), F.col("of"), F.col("token") != FIELD
    constant = F.when(word & (2 * n >= of), F.col("token"))  # two of a place at most
    places = counts.groupBy("node", "at").agg(
        F.min(constant).alias("a"),
        F.max(constant).alias("b"),
        F.max(F.when(word & (n > 1) & (n < of), n)).alias("most"),
        F.collect_list(F.when((n > 1) & (BRANCHES * n >= of), F.col("token"))).alias("many"),
    )
    order = F.struct("most", (-F.col("at")).alias("back"))
    model = places.groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("at", "a", "b"))).alias("constants"),
        F.max_by(F.struct("most", "at", "many"), order).alias("split"),
    )
    out = _to_lines(some, model).withColumn("tokens", F.split("content", " "))
    out = out.withColumn("t", F.expr(f"transform(tokens, (t, i) -> CASE WHEN t = constants[i].a OR t = constants[i].b THEN t ELSE '{FIELD}' END)"))
    enough = F.size(F.filter("t", lambda t: t != FIELD)) >= similarity * F.size("t") - 1e-9
    template = F.when(enough, _key(F.hex("leaf"), F.array_join("t", " ")))
    # a node without a token to split by is done
    template = F.coalesce(template, F.col("key") if last else F.when(F.col("split.most").isNull(), F.col("key")))
    token = F.element_at("tokens", F.col("split.at") + 1)
    child = _key(F.hex("node"), F.col("split.at").cast("string"), F.when(F.array_contains("split.many", token), token).otherwise(""))
    return out.select("leaf", child.alias("node"), "key", "content", "rows", template.alias("template"))


def templates(each: DataFrame, min_docs: int, similarity: float, splits: int, scratch: Scratch) -> DataFrame:
    """(key, template) of different masked lines (leaf, key, content, rows); both
    are keys of a leaf and a string, equal where the strings are."""
    now, settled = each.withColumn("node", F.col("leaf")), []
    for k in range(splits + 1):
        now = scratch(_level(now, min_docs, similarity, k == splits, scratch), "level")
        settled.append(now.where("template IS NOT NULL").select("key", "template"))
        now = now.where("template IS NULL").drop("template")
        if now.isEmpty():
            break
    made = settled[0]
    for more in settled[1:]:
        made = made.unionAll(more)
    return each.select("key").join(made, "key", "left").select("key", F.coalesce("template", "key").alias("template"))


def _elsewhere(lines: DataFrame, group: str, least: int, scratch: Scratch) -> DataFrame:
    """(id, text_key, line) of lines whose ``group`` is in so many different texts, but the first place of each group."""
    per_text = lines.groupBy(group, "text_key").agg(F.min(_place()).alias("first"))
    repeated = per_text.groupBy(group).agg(F.count("*").alias("texts"), F.min("first").alias("first")).where(F.col("texts") >= least)
    repeated = scratch(repeated.select(group, "first"), "repeated")
    return lines.join(repeated, group).where(_place() != F.col("first")).select("id", "text_key", "line")


def drop_boilerplate(
    df: DataFrame, *, id_col: str = "doc_id", text: str = "text", depth: int = DEPTH, splits: int = SPLITS, min_docs: int = MIN_DOCS,
    similarity: float = SIMILARITY, long_tokens: int = LONG_TOKENS,
) -> DataFrame:
    """The rows of ``df`` with ``text`` cleaned, and ``dropped_lines`` (array<int>, from 0)."""
    scratch = Scratch()
    lines = parsed(df, id_col, text, depth).withColumn("leaf_key", F.xxhash64("leaf"))
    masked = _masked(F.col("tokens"))
    large = lines.groupBy("leaf_key").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf_key", F.lit(True).alias("large"))
    # Spark broadcasts the leaves if their table is below its threshold, else it shuffles
    some = lines.join(scratch(large, "leaves"), "leaf_key", "left").where(F.col("large") | (F.size("tokens") >= long_tokens))
    some = some.select(
        "id", "text_key", "line", F.when(F.col("large"), _key(F.col("leaf"))).alias("leaf"), F.when(F.col("large"), masked).alias("content"),
        F.when(F.size("tokens") >= long_tokens, _key(F.array_join("tokens", " "))).alias("passage"),
    )
    some = scratch(some.withColumn("key", F.when(F.col("leaf").isNotNull(), _key(F.hex("leaf"), F.col("content")))), "lines")
    worded = F.exists(F.split("content", " "), lambda t: t != FIELD)
    each = scratch(some.where(F.col("leaf").isNotNull() & worded).groupBy("leaf", "key", "content").agg(F.count("*").alias("rows")), "contents")
    known = scratch(templates(each, min_docs, similarity, splits, scratch), "templates")
    found = scratch(some.select("id", "text_key", "line", "key").join(known, "key").drop("key"), "found")
    passages = some.where(F.col("passage").isNotNull()).select("id", "text_key", "line", "passage")
    drops = _elsewhere(found, "template", min_docs, scratch).unionAll(_elsewhere(passages, "passage", 2, scratch))
    drops = drops.groupBy(F.col("id").alias("__id"), F.col("text_key").alias("__text_key")).agg(F.sort_array(F.collect_set("line")).alias("__lines"))
    drops = written(drops, "drops")
    scratch.remove()
    # both sides grow with the corpus: never a broadcast, which would only do for small tables
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__text_key"))
    out = df.drop("dropped_lines").join(drops.hint("merge"), same, "left")
    # texts without such a line aren't split
    content = F.when(F.col("__lines").isNotNull(), F.split(F.col(text), "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__split") - 1), F.col("__lines"))
    clean = F.expr("array_join(transform(__kept, i -> element_at(__split, i + 1)), '\n')")
    out = out.withColumn("__split", content).withColumn("__kept", F.when(F.col("__split").isNotNull(), kept))
    out = out.withColumn(text, F.when(F.col("__kept").isNotNull(), clean).otherwise(F.col(text)))
    out = out.withColumn("dropped_lines", F.coalesce("__lines", F.array().cast("array<int>")))
    return out.drop("__id", "__text_key", "__lines", "__split", "__kept")
