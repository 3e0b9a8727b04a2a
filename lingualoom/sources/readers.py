"""Readers: text, annotation tables, records, tables and score vectors.

Line-based readers split files into byte ranges and keep physical line numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = (
    "sentence_index int, original_sentence string, masked_sentence string, target_mapping map<string,string>, "
    "pronoun_mapping map<string,string>, baseline_type string"
)
MISSING = ("", "NA", ".")


def _lines(spark: SparkSession, path: str | Sequence[str], kept: Column | None = None) -> DataFrame:
    """(path, line_no from 1, line) of text files; with ``kept``, only lines of which it
    holds, and ``ordinal``, their number among these.

    Files are read in byte ranges, as many tasks as there are: lines are counted by
    range, the counts of earlier ranges of a file are summed, and a line's number is
    that sum and its place in the range. CR, LF and both end a line; a byte-order
    mark is dropped. Rows come in no order.
    """
    where = ["path", "__block"]
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"), F.col("value").alias("line")
    )
    hit = F.lit(True) if kept is None else kept
    blocks = rows.groupBy(*where).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"), F.count_if(hit).alias("__k"))
    over = Window.partitionBy("path").orderBy("__block")  # a row a range
    blocks = blocks.select(
        *where, (F.sum("__n").over(over) - F.col("__n") - F.col("__first") + 1).alias("__shift"), (F.sum("__k").over(over) - F.col("__k")).alias("__before")
    )
    if kept is not None:
        rows = rows.where(kept).withColumn("__rank", F.row_number().over(Window.partitionBy(*where).orderBy("__id")))
    out = rows.join(blocks, where)
    number = (F.col("__id") + F.col("__shift")).cast("int").alias("line_no")
    line = F.when(F.col("__id") + F.col("__shift") == 1, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line")).alias("line")
    return out.select("path", number, line, *([(F.col("__before") + F.col("__rank")).cast("int").alias("ordinal")] if kept is not None else []))


def number_in_name(path: Column, pattern: str, offset: int = 0) -> Column:
    """The number that the pattern's group finds in a file name; none is an error."""
    found = F.regexp_extract(F.element_at(F.split(path, "/"), -1), pattern, 1).try_cast("int")
    return F.coalesce(found + offset, F.raise_error(F.concat(F.lit("no number in "), path)).cast("int"))


def corpora(spark: SparkSession, folder: str, supported: Sequence[str], suffix: str = ".tsv") -> DataFrame:
    """(corpus, path) of the supported corpora that have a file in a folder; contents aren't read."""
    files = spark.read.format("binaryFile").load(f"{folder}/*{suffix}").select("path")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), f"{suffix.replace('.', '[.]')}$", "")
    return files.select(name.alias("corpus"), "path").where(F.col("corpus").isin(*supported))


def documents(spark: SparkSession, path: str, ordinal: bool = False) -> DataFrame:
    """(path, doc_id, text): a document a non-blank line, numbered by physical line,
    or with ``ordinal`` by its place among the non-blank ones."""
    if ordinal:
        rows = _lines(spark, path, F.trim("line") != "")
        return rows.select("path", F.col("ordinal").alias("doc_id"), F.col("line").alias("text"))
    rows = _lines(spark, path).where(F.trim("line") != "")
    return rows.select("path", F.col("line_no").alias("doc_id"), F.trim("line").alias("text"))


def word_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, id, word, lemma, upos, xpos, head, deprel, chains): tab-separated,
    without header; blank and # lines are passed over, fewer than 8 columns are an error."""
    rows = _lines(spark, path).where((F.trim("line") != "") & ~F.startswith("line", F.lit("#")))
    c = F.split("line", "\t")
    rows = rows.withColumn("c", c)
    ok = F.assert_true(F.size("c") >= 8, F.concat_ws(" ", F.lit("fewer than 8 columns:"), "path", F.col("line_no").cast("string")))
    cell = F.trim(F.col("c")[7])
    names = ("id", "word", "lemma", "upos", "xpos", "head", "deprel")
    return rows.where(ok.isNull()).select(
        "path",
        "line_no",
        *[(F.col("c")[i].try_cast("int") if n in ("id", "head") else F.col("c")[i]).alias(n) for i, n in enumerate(names)],
        F.when(cell.isin("_", ""), F.array().cast("array<string>")).otherwise(F.split(cell, r"\|")).alias("chains"),
    )


def subword_chains(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, id, piece, text, upos, chain) of 6 or 7 columns, a row a chain;
    short rows, # lines and rows without a chain are passed over."""
    rows = _lines(spark, path).where(~F.startswith("line", F.lit("#"))).withColumn("c", F.split("line", "\t"))
    rows = rows.where((F.size("c") >= 5) & (F.get("c", F.lit(4)) != "_"))
    col = lambda i: F.get("c", F.lit(i))
    return rows.select("path", "line_no", col(0).try_cast("int").alias("id"), col(1).alias("piece"), col(2).alias("text"), col(3).alias("upos"), F.explode(F.split(col(4), r"\|")).alias("chain"))


def chain_positions(spark: SparkSession, path: str, pattern: str = r"doc(\d+)") -> DataFrame:
    """(doc, position): positions from 0 of sub-words in any chain."""
    rows = subword_chains(spark, path)
    return rows.select(number_in_name(F.col("path"), pattern).alias("doc"), (F.col("id") - 1).alias("position")).distinct()


def sentence_records(spark: SparkSession, path: str, pattern: str = r"doc(\d+)_pronoun_mappings") -> DataFrame:
    """JSON lines of sentence records; ``doc`` from 0 by the number in the file name."""
    rows = spark.read.schema(RECORD).json(path).select("*", F.col("_metadata.file_path").alias("path"))
    return rows.withColumn("doc", number_in_name(F.col("path"), pattern, -1)).where(F.col("sentence_index").isNotNull())


def tsv(spark: SparkSession, path: str, required: Sequence[str] = (), escape: bool = False) -> DataFrame:
    """Header, tabs, no quoting, all strings; with ``escape``, a backslash escapes.
    A byte-order mark is dropped; a missing required column is an error."""
    df = spark.read.csv(path, sep="\t", header=True, quote="", escape="\\" if escape else "", enforceSchema=False)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    return df


def token_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Token table; NA is null, and token_index must run from 0 in each story."""
    df = tsv(spark, path, ("story", "token_index", "word_index", "token", "pronoun_replacement"), escape=True)
    df = df.withColumns({"token_index": F.col("token_index").cast("int"), "word_index": F.col("word_index").cast("int")})
    df = df.withColumn("pronoun_replacement", F.when(~F.col("pronoun_replacement").isin("NA", ""), F.col("pronoun_replacement")))
    place = F.row_number().over(Window.partitionBy("story").orderBy("token_index")) - 1
    df = df.withColumn("__p", place)
    return df.where(F.assert_true(F.col("__p") == F.col("token_index"), F.lit("token_index has a gap")).isNull()).drop("__p")


def table(spark: SparkSession, path: str, schema: str, missing: Sequence[str] = MISSING, sep: str = ",", quote: str = '"') -> DataFrame:
    """Columns of a delimited table by header name; any of ``missing`` is null."""
    raw = spark.read.csv(path, header=True, sep=sep, quote=quote)
    fields = spark.createDataFrame([], schema).schema
    clean = lambda f: F.when(~F.trim(F.col(f.name)).isin(*missing), F.trim(F.col(f.name)))
    return raw.select(*[clean(f).cast(f.dataType).alias(f.name) for f in fields])


def r_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Columns by name of binary R tables, a file a partition; NA is null, factors are their labels."""
    from .rtables import RTables

    spark.dataSource.register(RTables)
    return spark.read.format("rtable").schema(schema).load(path)


def inferred(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A table with header whose types follow from its values: one pass more over the files."""
    return spark.read.csv(path, header=True, inferSchema=True, sep=sep)


def score_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(model, n_gram, row_no, value) of <model>/context_<n>.txt files, a number a line."""
    rows = _lines(spark, path, F.trim("line") != "")
    parts = F.split("path", "/")
    return rows.select(
        F.element_at(parts, -2).alias("model"),
        number_in_name(F.col("path"), r"context_(\d+)\.txt").alias("n_gram"),
        F.col("ordinal").alias("row_no"),
        F.trim("line").cast("double").alias("value"),
    )


def dependency_parse(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, id, word, upos) of plain words; ranges and empty nodes are left out."""
    rows = _lines(spark, path).where(F.col("line").rlike(r"^[0-9]+\t")).withColumn("c", F.split("line", "\t"))
    return rows.select("path", "line_no", F.col("c")[0].cast("int").alias("id"), F.col("c")[1].alias("word"), F.col("c")[3].alias("upos"))


def natural_order(path: Column) -> Column:
    """Sort key by the first number in a file name, then the name."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.struct(F.regexp_extract(name, r"(\d+)", 1).try_cast("long"), name)
