"""Readers and writers on small files."""

import bz2
import gzip
import lzma
import os
import struct

import pytest
from pyspark.sql import functions as F

from lingualoom.sources import readers, rtables, writers


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
        return str(path)

    return write


def lines_of(folder):
    found = sorted(f for f in os.listdir(folder) if f.startswith("part"))
    return "".join(open(os.path.join(folder, f), newline="").read() for f in found).splitlines()


def test_documents_by_line_or_ordinal(spark, put):
    path = put("raw.txt", " one \n\n  \ntwo\r\nthree")
    assert [(r.doc_id, r.text) for r in readers.documents(spark, path).orderBy("doc_id").collect()] == [(1, "one"), (4, "two"), (5, "three")]
    assert [(r.doc_id, r.text) for r in readers.documents(spark, path, ordinal=True).orderBy("doc_id").collect()] == [(1, " one "), (2, "two"), (3, "three")]


def test_word_annotations(spark, put):
    row = "\t".join
    text = "\n".join(["# note", row(["1", "The", "the", "DET", "DT", "2", "det", "_"]), "", row(["2", "cat", "cat", "NOUN", "NN", "0", "root", "3|10"])])
    got = readers.word_annotations(spark, put("x_doc1.conllu", text)).orderBy("line_no").collect()
    assert [(r.id, r.word, r.head, r.chains) for r in got] == [(1, "The", 2, []), (2, "cat", 0, ["3", "10"])]
    with pytest.raises(Exception, match="fewer than 8"):
        readers.word_annotations(spark, put("bad.conllu", "1\tx")).collect()


def test_subword_chains_of_six_and_seven_columns(spark, put):
    row = "\t".join
    path = put("gpt_doc7.conllu", "\n".join([row(["1", "The", "The", "DET", "1|2", "GPT=1"]), row(["2", "x", "x", "NOUN", "_", "E", "GPT=2"]), row(["3", "y", "y", "NOUN", "2", "E", "GPT=3"]), "short\trow"]))
    assert sorted((r.id, r.chain) for r in readers.subword_chains(spark, path).collect()) == [(1, "1"), (1, "2"), (3, "2")]
    assert sorted((r.doc, r.position) for r in readers.chain_positions(spark, path).collect()) == [(7, 0), (7, 2)]


def test_sentence_records(spark, put):
    path = put("p_doc12_pronoun_mappings.jsonl", '{"sentence_index": 0, "original_sentence": "é .", "masked_sentence": "é .", "target_mapping": {}, "pronoun_mapping": {}}\n\n')
    r = readers.sentence_records(spark, path).first()
    assert (r.doc, r.sentence_index, r.original_sentence, r.target_mapping) == (11, 0, "é .", {})
    with pytest.raises(Exception, match="no number in"):
        readers.sentence_records(spark, put("other.jsonl", '{"sentence_index": 0}')).collect()


def test_tables(spark, put):
    assert readers.tsv(spark, put("a.tsv", '﻿story\tword\n1\t"a\n')).first().asDict() == {"story": "1", "word": '"a'}
    with pytest.raises(ValueError, match="lacks zone"):
        readers.tsv(spark, put("b.tsv", "story\n1\n"), ["story", "zone"])
    got = readers.table(spark, put("c.csv", "id,time,extra\n1,.,x\n2,NA,x\n3,4.5,x\n4,,x\n"), "id int, time double").collect()
    assert [(r.id, r.time) for r in got] == [(1, None), (2, None), (3, 4.5), (4, None)]


def test_token_annotations_check_their_index(spark, put):
    head = "story\ttoken_index\tword_index\ttoken\tpronoun_replacement\n"
    got = readers.token_annotations(spark, put("t.tsv", head + "s\t0\t0\ta\tNA\ns\t1\t0\tb\tit\n")).orderBy("token_index").collect()
    assert [(r.token_index, r.pronoun_replacement) for r in got] == [(0, None), (1, "it")]
    with pytest.raises(Exception, match="gap"):
        readers.token_annotations(spark, put("u.tsv", head + "s\t0\t0\ta\tNA\ns\t2\t0\tb\tit\n")).collect()


def test_score_vectors_and_parses(spark, put, tmp_path):
    put("gpt2/context_10.txt", "1.5\n2.5\n")
    put("gpt2/context_3.txt", "0.25\n")
    got = sorted((r.model, r.n_gram, r.row_no, r.value) for r in readers.score_vectors(spark, f"{tmp_path}/gpt2/*.txt").collect())
    assert got == [("gpt2", 3, 1, 0.25), ("gpt2", 10, 1, 1.5), ("gpt2", 10, 2, 2.5)]
    parse = readers.dependency_parse(spark, put("d.conllu", "# c\n1\tI\ti\tPRON\n1-2\tI'm\t_\t_\n2.1\tx\t_\t_\n2\tam\tbe\tAUX\n")).orderBy("line_no").collect()
    assert [(r.id, r.word, r.upos) for r in parse] == [(1, "I", "PRON"), (2, "am", "AUX")]
    names = spark.createDataFrame([("a/doc10_x",), ("a/doc2_x",)], "p string")
    assert [r.p for r in names.orderBy(readers.natural_order(F.col("p"))).collect()] == ["a/doc2_x", "a/doc10_x"]


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, 'a"\tb\\c', None), ("s", 2, "é", "it")], "story string, row_no int, word string, pronoun_replacement string")
    writers.tsv(df.coalesce(1), f"{tmp_path}/t")
    assert lines_of(f"{tmp_path}/t")[1:] == ['s\t1\ta"\\\tb\\\\c\tNA', "s\t2\té\tit"]
    writers.json_lines(df.coalesce(1), f"{tmp_path}/j", ["row_no"])
    assert "é" in lines_of(f"{tmp_path}/j")[1] and '"pronoun_replacement":null' in lines_of(f"{tmp_path}/j")[0]
    writers.text_lines(df, "word", f"{tmp_path}/x", ["row_no"])
    assert lines_of(f"{tmp_path}/x")[-1] == "é"
    v = spark.createDataFrame([(2, 1.0), (1, 0.123456789)], "row_no int, value double")
    writers.score_vector(v, "value", f"{tmp_path}/v", ["row_no"])
    assert lines_of(f"{tmp_path}/v") == ["0.12345679", "1.00000000"]
    writers.csv(df.limit(0), f"{tmp_path}/c")
    assert os.path.exists(f"{tmp_path}/c/_SUCCESS")
    writers.tsv(df, f"{tmp_path}/p", partition="story")
    assert os.path.isdir(f"{tmp_path}/p/story=s")


def test_corpora(spark, put, tmp_path):
    for name in ("ns.tsv", "brown.tsv", "other.tsv", "ns.txt"):
        put(name, "x")
    assert sorted(r.corpus for r in readers.corpora(spark, str(tmp_path), ["ns", "brown", "provo"]).collect()) == ["brown", "ns"]


def test_one_file_a_document(spark, tmp_path):
    df = spark.createDataFrame([("a b", 2, "y"), ("a b", 1, "x"), ("c/d", 1, "z")], "name string, k int, line string")
    writers.document_files(df, F.col("line"), F.concat("name", F.lit(".txt")), f"file://{tmp_path}/out", ["k"])
    assert (tmp_path / "out/a b.txt").read_text() == "x\ny\n" and (tmp_path / "out/c/d.txt").read_text() == "z\n"
    assert not (tmp_path / "out/_parts").exists()


def chars(text):
    return struct.pack(">ii", 0x40009, len(text)) + text.encode()


def test_binary_r_tables_round_trip(spark, tmp_path):
    rows = [(1, 2, 0.5, "a", True, "x"), (2**40, None, None, None, None, None), (3, -7, float("nan"), "é", False, "b"), (4, 0, float("inf"), "", True, "x")]
    schema = "k long, i int, d double, s string, l boolean, f string"
    writers.r_tables(spark.createDataFrame(rows, schema).repartition(3), f"{tmp_path}/r", ["f"])
    assert all(f.startswith("part-") for f in os.listdir(tmp_path / "r"))
    got = sorted(readers.r_table(spark, f"{tmp_path}/r", schema + ", lacking int").collect())
    assert len(got) == 4 and all(r.lacking is None for r in got)
    for r, want in zip(got, sorted(rows), strict=True):
        assert repr(tuple(r)[:6]) == repr(want)
    one = next((tmp_path / "r").iterdir())
    assert readers.r_table(spark, str(one), "k long").count() >= 1


@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress, lzma.compress, bz2.compress])
def test_binary_r_table_of_version_3(spark, tmp_path, pack):
    """A compact sequence, a wrapped factor, NA and NaN; symbols are referred to."""
    name = lambda x: struct.pack(">i", 1) + chars(x)
    pair = lambda x: struct.pack(">i", 0x402) + name(x)
    strings = lambda *x: struct.pack(">ii", 16, len(x)) + b"".join(map(chars, x))
    none = struct.pack(">i", 254)
    of_class = lambda x: struct.pack(">ii", 238, 2) + name(x) + struct.pack(">i", 2) + name("base") + struct.pack(">i", 2) + struct.pack(">iii", 13, 1, 13) + none
    sequence = of_class("compact_intseq") + struct.pack(">ii3d", 14, 3, 3, 5, 1) + none
    factor = struct.pack(">ii3i", 13 | 0x300, 3, 2, -(2**31), 1) + pair("levels") + strings("lo", "hi") + pair("class") + strings("factor") + none
    wrapped = of_class("wrap_integer") + struct.pack(">ii", 19, 2) + factor + struct.pack(">ii2i", 13, 2, 0, 0) + none
    doubles = struct.pack(">ii", 14, 3) + struct.pack(">d", 1.5) + bytes.fromhex("7ff00000000007a2") + bytes.fromhex("7ff8000000000000")
    frame = struct.pack(">ii", 19 | 0x300, 3) + sequence + wrapped + doubles + pair("names") + strings("seq", "f", "d")
    frame += pair("row.names") + struct.pack(">ii2i", 13, 2, -(2**31), -3) + none
    header = b"X\n" + struct.pack(">iii", 3, 0x40300, 0x30500) + struct.pack(">i", 5) + b"UTF-8"
    (tmp_path / "t.rds").write_bytes(pack(header + frame))
    got = readers.r_table(spark, str(tmp_path / "t.rds"), "seq int, f string, d double").collect()
    assert [tuple(r)[:2] for r in got] == [(5, "hi"), (6, None), (7, "lo")]
    assert got[0].d == 1.5 and got[1].d is None and got[2].d != got[2].d
    with pytest.raises(ValueError, match="XDR"):
        rtables.table_of(b"A\n")


def test_binary_r_tables_of_many_rows_are_several_files(spark, tmp_path, monkeypatch):
    """A task holds the rows of a file, not of its partition."""
    from lingualoom.sources import rtables

    held = []
    monkeypatch.setattr(rtables, "ROWS_A_FILE", 3)
    monkeypatch.setattr(rtables.Encoder, "table", lambda self, columns, rows: held.append(rows) or b"")
    w = rtables.Writer(spark.createDataFrame([], "k long").schema, f"{tmp_path}/r", set())
    done = [w.write(iter([(k,) for k in range(n)])) for n in (7, 0, 3)]
    assert held == [3, 3, 1, 0, 3]
    w.commit(done)
    assert len(list((tmp_path / "r").glob("part-*.rds"))) == 5
