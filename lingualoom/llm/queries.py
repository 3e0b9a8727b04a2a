"""The registered queries of this subpackage: thin, each applies one operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import interleave

    placed = interleave(table(spark, sf_dir, "documents"), 16)
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_decode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    pages = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_vectors

    near = near_vectors(table(spark, sf_dir, "embeddings"), least=0.9)
    return near.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept")
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import drop_boilerplate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    clean = drop_boilerplate(docs.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(lines)))
    return clean.select(
        "doc_id",
        "n_lines",
        F.size("dropped_lines").cast("long").alias("n_dropped"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .support import shared_path
    from .warc import ID, read, write

    path = shared_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path, min_bytes=0)
    page = lambda c: F.substring(c, len(ID) + 1, 20).try_cast("long")
    return read(spark, path, payload=False).select(
        page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to")
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, taken

    docs, pieces = mix(table(spark, sf_dir, "documents"))
    return taken(docs, pieces).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def held_out(doc_id: str = "doc_id") -> Column:
    """A fifth of the documents, from which nothing is learned."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, ~held_out()).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import fingerprints, near_duplicates
    from .support import written

    prints = written(fingerprints(table(spark, sf_dir, "documents")), "fingerprints")
    return near_duplicates(prints, reach=4).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import prefix_trie, rebuilt

    nodes = prefix_trie(*rebuilt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return nodes.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def op12_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .names import joined

    return joined(table(spark, sf_dir, "vendors").select("vendor_id", "name"), table(spark, sf_dir, "clients").select("client_id", "name"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_quality_rules, op3_bpe, op4_html_extraction, op5_embedding_dedup, op6_line_dedup, op7_warc, op8_mixing, op9_language_id, op10_simhash, op11_prefix_trie, op12_name_join, op13_suffix_dedup)}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {"op1_sharding": oracles.op1(), "op2_quality_rules": oracles.op2(), "op5_embedding_dedup": oracles.op5(), "op6_line_dedup": oracles.op6(), "op7_warc": oracles.op7(), "op8_mixing": oracles.op8(), "op11_prefix_trie": oracles.op11(), "op12_name_join": oracles.op12()}
