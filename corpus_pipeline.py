"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared folder and rereads it as the next stage's docs. All
but the last stage return the columns of ``documents``. Counts by stage follow
from the tables written.

Rows are decided upon as rows: those that share an id or have none pass all
stages like others. A null text, and one without a letter, ends at the first
stage; a text of which line dedup leaves nothing ends at the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingualoom.llm.queries import held_out
from lingualoom.llm.support import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that have a language, so those with a letter; a missing ``lang`` is filled in."""
    from lingualoom.llm.langid import UND, identify

    known = identify(docs.select(*COLUMNS), ~held_out())
    known = known.where(F.col("lang_pred") != UND)
    return _columns(known.withColumn("lang", F.coalesce("lang", "lang_pred")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines of recurring templates and repeated long passages, and documents of which nothing else was left."""
    from lingualoom.llm.lines import drop_boilerplate

    clean = drop_boilerplate(docs.select(*COLUMNS))
    return _columns(clean.where((F.size("dropped_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates, that with the least id (none
    comes last): shingles of five words, a similarity of 0.8 or more."""
    from lingualoom.llm.similar import near_documents

    rows = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")
    groups = near_documents(rows, id_col="row").select(F.col("id").alias("row"), "component")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    kept = rows.select("doc_id", "row").join(groups, "row").groupBy("component").agg(F.min(order).alias("first"))
    return _columns(rows.join(kept.select(F.col("first.row").alias("row")), "row", "left_semi"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bring sources to their target weights: a document appears once for each pass of
    its source's stream that the mix takes it in, so not at all, once or twice."""
    from lingualoom.llm.mixing import mix

    rows = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")
    _, pieces = mix(rows, keep=["row"])
    passes = pieces.groupBy("row").agg(F.countDistinct("epoch").alias("passes"))
    return _columns(rows.join(passes, "row").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("passes").cast("int")))))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of ids and of the decoded text."""
    import public_tokenizers

    from lingualoom.llm.bpe import encode_decode

    done = encode_decode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return done.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: BPE and string kernels are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
