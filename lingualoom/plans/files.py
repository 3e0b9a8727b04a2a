"""Writers and readers of every format: tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import align, ranges
from ..shared import shared_path
from ..sources import readers, writers
from .registry import query, rounded, table
from .texts import EXPAND_SQL, _story_words


def _tabbed(*columns) -> Column:
    return F.concat_ws("\t", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns])


def _documents(df: DataFrame, line, name, order: list[str]) -> str:
    path = shared_path(df.sparkSession, "files")
    writers.document_files(df, line, name, path, order)
    return path


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def tsv_files(spark, sf_dir):
    path = shared_path(spark, "tsv")
    writers.tsv(table(spark, sf_dir, "nation"), path)
    return readers.tsv(spark, path, ["n_nationkey", "n_name"]).select("n_nationkey", "n_name", "n_regionkey")


@query("""SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN round(value, 6) END AS value FROM events""")
def table_with_missing_values(spark, sf_dir):
    """Four spellings of a missing value."""
    missing = F.element_at(F.array(F.lit("NA"), F.lit("."), F.lit(""), F.lit(" NA ")), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value").cast("string")).otherwise(missing).alias("value"))
    path = shared_path(spark, "csv")
    writers.csv(rows, path)
    return rounded(readers.table(spark, path, "event_id long, value double"))


@query("""SELECT c_custkey, c_name, round(c_acctbal, 6) AS c_acctbal, typeof(c_custkey) = 'BIGINT' AS whole FROM customer""")
def inferred_table(spark, sf_dir):
    path = shared_path(spark, "csv")
    writers.csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    got = readers.inferred(spark, path)
    whole = got.schema["c_custkey"].dataType.simpleString() in ("int", "bigint")
    return rounded(got.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_acctbal", F.lit(whole).alias("whole")))


@query("""SELECT CAST(turn AS INT) AS file, row_number() OVER (PARTITION BY turn ORDER BY conv_id) AS doc_id, t AS text
  FROM (SELECT turn, conv_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations) WHERE t <> ''""")
def document_lines(spark, sf_dir):
    """A file a turn, a document a line, blank lines between."""
    c = table(spark, sf_dir, "conversations").withColumn("t", F.trim(F.regexp_replace("text", r"\s+", " ")))
    lines = c.select("turn", "conv_id", F.explode(F.array(F.lit(" "), F.col("t"))).alias("line"), F.lit(1).alias("k"))
    path = _documents(lines, F.col("line"), F.concat(F.lit("raw_turn"), "turn", F.lit(".txt")), ["conv_id", "line"])
    got = readers.documents(spark, f"{path}/*.txt", ordinal=True)
    return got.select(readers.number_in_name(F.col("path"), r"turn(\d+)").alias("file"), F.col("doc_id").cast("long").alias("doc_id"), "text")


@query("""SELECT CAST(p_size AS INT) AS doc, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS INT) AS id, p_name AS word, p_brand AS upos,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type || '|' || p_brand END AS chains FROM part""")
def word_annotation_files(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("id", F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")))
    chains = F.when(F.col("p_partkey") % 3 == 0, F.lit("_")).otherwise(F.concat_ws("|", "p_type", "p_brand"))
    line = _tabbed("id", "p_name", F.lower("p_name"), "p_brand", "p_type", F.col("id") - 1, F.lit("dep"), chains)
    path = _documents(p, line, F.concat(F.lit("part_doc"), "p_size", F.lit(".conllu")), ["id"])
    got = readers.word_annotations(spark, f"{path}/*.conllu")
    doc = readers.number_in_name(F.col("path"), r"doc(\d+)")
    return got.select(doc.alias("doc"), "id", "word", "upos", F.array_join("chains", "|").alias("chains"))


def _subwords(spark: SparkSession, sf_dir: str) -> str:
    p = table(spark, sf_dir, "part").withColumn("id", F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")))
    chains = F.when(F.col("p_partkey") % 3 == 0, F.lit("_")).otherwise(F.concat_ws("|", F.col("p_partkey") % 7, 10 + F.col("p_partkey") % 2))
    line = _tabbed("id", "p_name", "p_name", "p_brand", chains, F.concat(F.lit("GPT2_ID="), F.col("id")))
    return _documents(p, line, F.concat(F.lit("gpt2_doc"), "p_size", F.lit(".conllu")), ["id"])


@query("""SELECT CAST(p_size AS INT) AS doc, chain, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM
  (SELECT p_size, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS id, p_partkey, unnest([p_partkey % 7, 10 + p_partkey % 2])::VARCHAR AS chain FROM part)
  WHERE p_partkey % 3 <> 0 GROUP BY 1, 2""")
def subword_chain_files(spark, sf_dir):
    got = readers.subword_chains(spark, f"{_subwords(spark, sf_dir)}/*.conllu")
    return got.groupBy(readers.number_in_name(F.col("path"), r"doc(\d+)").alias("doc"), "chain").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("""SELECT CAST(p_size AS INT) AS doc, CAST(id - 1 AS INT) AS position FROM
  (SELECT p_size, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS id FROM part) WHERE p_partkey % 3 <> 0""")
def chain_position_files(spark, sf_dir):
    return readers.chain_positions(spark, f"{_subwords(spark, sf_dir)}/*.conllu")


@query("""SELECT CAST(turn AS INT) AS doc, CAST(conv_id AS INT) AS sentence_index, text AS original_sentence, role AS phrase, 'they' AS pronoun FROM conversations WHERE text IS NOT NULL""")
def sentence_record_files(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    mark = F.lit("[[TARGET_0]]")
    record = F.struct(
        F.col("conv_id").cast("int").alias("sentence_index"), F.col("text").alias("original_sentence"), F.col("text").alias("masked_sentence"),
        F.create_map(mark, F.col("role")).alias("target_mapping"), F.create_map(mark, F.lit("they")).alias("pronoun_mapping"),
    )
    path = _documents(c, F.to_json(record), F.concat(F.lit("x_doc"), F.col("turn") + 1, F.lit("_pronoun_mappings.jsonl")), ["conv_id"])
    got = readers.sentence_records(spark, f"{path}/*.jsonl")
    return got.select("doc", "sentence_index", "original_sentence", F.col("target_mapping")["[[TARGET_0]]"].alias("phrase"), F.col("pronoun_mapping")["[[TARGET_0]]"].alias("pronoun"))


@query("""SELECT l_returnflag AS model, CAST(l_linenumber AS INT) AS n_gram, row_number() OVER (PARTITION BY l_returnflag, l_linenumber ORDER BY l_suppkey) AS row_no, round(v, 6) AS value
  FROM (SELECT l_returnflag, l_linenumber, l_suppkey, avg(l_quantity) AS v FROM lineitem GROUP BY ALL)""")
def score_vector_files(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber", "l_suppkey").agg(F.avg("l_quantity").alias("v"))
    name = F.concat("l_returnflag", F.lit("/context_"), "l_linenumber", F.lit(".txt"))
    path = _documents(v, F.format_string("%.8f", "v"), name, ["l_suppkey"])
    got = readers.score_vectors(spark, f"{path}/*/*.txt")
    return rounded(got.withColumn("row_no", F.col("row_no").cast("long")))


@query(f"""WITH {EXPAND_SQL}, i AS (SELECT story, row_no, dense_rank() OVER (PARTITION BY story ORDER BY row_no) - 1 AS word_index FROM w)
  SELECT CAST(story AS VARCHAR) AS story, CAST(row_number() OVER (PARTITION BY story ORDER BY row_no, piece) - 1 AS INT) AS token_index, CAST(word_index AS INT) AS word_index, token,
    CASE WHEN token = 'R' THEN 'R' END AS pronoun_replacement
  FROM x JOIN i USING (story, row_no) JOIN (SELECT l_orderkey AS story, l_linenumber AS row_no, max(l_returnflag) AS token FROM lineitem GROUP BY 1, 2) USING (story, row_no)""")
def token_annotation_files(spark, sf_dir):
    words = _story_words(spark, sf_dir).withColumn("pronoun_replacement", F.when(F.col("word") == "R", F.lit("R,")).otherwise(""))
    path = shared_path(spark, "tokens")
    writers.tsv(align.token_annotations(words), path)
    return readers.token_annotations(spark, path)


@query("""SELECT CAST(p_size AS INT) AS doc, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS INT) AS id, p_name AS word, p_brand AS upos FROM part""")
def dependency_parse_files(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("id", F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")))
    # a range and an empty node beside each word
    cells = F.explode(F.array(F.col("id").cast("string"), F.concat_ws("-", "id", F.col("id") + 1), F.concat(F.col("id"), F.lit(".1"))))
    rows = p.select("*", cells.alias("cell"))
    path = _documents(rows, _tabbed("cell", "p_name", F.lit("_"), "p_brand"), F.concat(F.lit("dep_doc"), "p_size", F.lit(".conllu")), ["id", "cell"])
    got = readers.dependency_parse(spark, f"{path}/*.conllu")
    return got.select(readers.number_in_name(F.col("path"), r"doc(\d+)").alias("doc"), "id", "word", "upos")


@query("""SELECT r_name AS corpus FROM region WHERE r_name IN ('ASIA', 'EUROPE')""")
def corpus_files(spark, sf_dir):
    path = _documents(table(spark, sf_dir, "region"), F.col("r_name"), F.concat("r_name", F.lit(".tsv")), ["r_regionkey"])
    return readers.corpora(spark, path, ["ASIA", "EUROPE", "NOWHERE"]).select("corpus")


@query("""SELECT event_id, CAST(user_id AS INT) AS user_id, event_type, CASE WHEN event_id % 5 <> 0 THEN round(value, 6) END AS value, value > 50 AS large FROM events""")
def r_table_files(spark, sf_dir):
    """Integers, doubles with NA, logicals and a factor through binary R tables."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("int").alias("user_id"), "event_type", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"), (F.col("value") > 50).alias("large"))
    path = shared_path(spark, "rtables")
    writers.r_tables(e.repartition(4, "event_id"), path, ["event_type"])
    return rounded(readers.r_table(spark, path, "event_id long, user_id int, event_type string, value double, large boolean"))


@query("""SELECT conv_id, turn, text FROM conversations""")
def json_line_files(spark, sf_dir):
    path = shared_path(spark, "json")
    writers.json_lines(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lit("x").alias("part")), path, ["conv_id", "turn"], partition="part")
    return spark.read.schema("conv_id long, turn long, text string").json(path).select("conv_id", "turn", "text")


@query("""SELECT row_number() OVER (ORDER BY p_partkey) AS row_no, p_name AS text FROM part""")
def text_line_files(spark, sf_dir):
    """Lines in global order: by file name, then by line."""
    path = shared_path(spark, "lines")
    writers.text_lines(table(spark, sf_dir, "part"), "p_name", path, ["p_partkey"])
    got = readers.documents(spark, path)
    got = got.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return ranges.ranks(got, ["name", "doc_id"], "row_no").select("row_no", "text")


@query("""SELECT row_number() OVER (ORDER BY event_id) AS row_no, round(value, 6) AS value FROM events""")
def score_vector_lines(spark, sf_dir):
    """A number a line in the order of a table, found again by place."""
    path = shared_path(spark, "scores")
    writers.score_vector(table(spark, sf_dir, "events"), "value", path, ["event_id"])
    got = readers.documents(spark, path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return rounded(ranges.ranks(got, ["name", "doc_id"], "row_no").select("row_no", F.col("text").cast("double").alias("value")))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN '"' || c_name END AS name FROM customer""")
def table_without_quotes(spark, sf_dir):
    """Quote marks that quote nothing."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit('"'), "c_name")).otherwise("NA").alias("name"))
    path = shared_path(spark, "tsv")
    writers.tsv(c, path)
    return readers.table(spark, path, "id long, name string", sep="\t", quote="")
