"""Sharding, quality rules, BPE, line dedup, mixing and language ID."""

import hashlib
import os
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lingualoom.llm import bpe, langid, lines, mixing, quality, queries, sharding
from lingualoom.llm.support import row_key

DATA = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_shards_hold_each_source_in_proportion(spark, docs):
    rows = [(k, f"t{k}", "en", "ab"[k % 3 == 0] if k % 7 else None) for k in range(1000)]
    placed = sharding.interleave(docs(rows), 16).collect()
    by_shard = defaultdict(list)
    for r in placed:
        by_shard[r.shard].append(r)
    sizes = [len(v) for v in by_shard.values()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by_shard.values())
    for source, n in Counter(r.source_key for r in placed).items():
        counts = [sum(r.source_key == source for r in v) for v in by_shard.values()]
        assert max(counts) - min(counts) <= 2 and abs(counts[0] - n / 16) < 2
    assert sorted(r.position for r in placed) == list(range(1000))


def test_shards_of_odd_rows(odd, docs, clashing):
    for df in (odd, clashing(odd)):
        placed = sharding.interleave(df, 16).collect()
        assert len(placed) == 11 and sorted(r.position for r in placed) == list(range(11))
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert all(r["size"] == len(texts[r.id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.id].encode()) for r in placed)
    assert sharding.interleave(docs([]), 16).count() == 0


def brute_features(text):
    w, text = words(text), text or ""
    kept = [x for x in text.split("\n") if words(x)]
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    marked = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(kept) - len(set(kept)), len(marked)


def test_quality_counts_against_brute_force(spark, docs, odd, clashing):
    rng = np.random.default_rng(1)
    rows = [(100 + k, "".join(rng.choice(list("ab \n#é")) for _ in range(rng.integers(0, 80))), "en", "a") for k in range(200)]
    for df in (docs(rows), odd, clashing(odd)):
        texts = {r.doc_id: r.text for r in df.collect()}
        for r in quality.features(df).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_features(texts[r.id])


def test_quality_separates_junk(spark, docs):
    prose = lambda k: " ".join(f"word{(k * 31 + j * j) % 700}" + "." * (j % 9 == 8) for j in range(90))
    rows = [(k, prose(k) if k % 4 else " ".join(f"w{j * k % 501}###" for j in range(90)), "en", "a") for k in range(1, 201)]
    got = {r.id: r for r in quality.judge(docs(rows)).collect()}
    assert all(r.kept == (k % 4 != 0) for k, r in got.items()) and not any(r.base_failed for r in got.values())
    assert quality.judge(docs([])).count() == 0


def test_quality_of_odd_rows(odd):
    got = quality.judge(odd).collect()
    assert len(got) == 11 and not any(r.kept for r in got if r.id != 6)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_bpe_is_the_library(library):
    own = bpe.WordBpe(VOCABULARY, cache_entries=50)
    rng = np.random.default_rng(2)
    pool = list("ab'sS tréÀ́ΣςσĀ12٣ 　\x1c\x85<|>\n中字🙂ǅ-") + ["<|endoftext|>", "<|startoftext|>", "'re", "n't"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.integers(0, 50))) for _ in range(3000)]
    texts += ["", " ", "x" * 3000, "the " * 2000, "<|ENDOFTEXT|>", "a<|endoftext|>b", "I'll don't 'S"]
    for t in texts:
        ids, decoded = own.encode(t)
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, np.int32).tolist() == want, t
        assert decoded == library.decode(want, skip_special_tokens=False) == own.decode(want), t


def test_bpe_of_every_code_point(library):
    own = bpe.WordBpe(VOCABULARY)
    every = [chr(c) for c in range(1, 0x34000) if not 0xD800 <= c < 0xE000]
    marks = [m for m in every if unicodedata.combining(m)]
    texts = [f"a{c}b {c}1" for c in every] + [t for m in marks for o in "\u0334\u0301\u0327" for t in (f"e{m}{o}", f"e{o}{m}")]
    texts += [unicodedata.normalize("NFD", c) for c in every]
    wrong = [t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if np.frombuffer(own.encode(t)[0], np.int32).tolist() != e.ids]
    assert not wrong


def test_idle_caches_are_emptied(monkeypatch):
    import time

    monkeypatch.setattr(bpe, "IDLE_SECONDS", 0.2)
    own = bpe.WordBpe(VOCABULARY)
    want = own.encode("some words of a text")
    bpe.forget_when_idle(own)
    own.used = None  # in use again
    time.sleep(0.6)
    assert own.chunks
    bpe.forget_when_idle(own)
    time.sleep(0.6)
    assert not own.chunks and own.encode("some words of a text") == want


def test_bpe_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op3_bpe(spark, DATA).collect():
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_of_odd_rows(odd, docs, clashing, library):
    got = bpe.encode_decode(clashing(odd), VOCABULARY).collect()
    assert len(got) == 11 and {r.doc_id: r.ids for r in got}[1] == [] and {r.doc_id: r.decoded for r in got}[2] == ""
    assert bpe.encode_decode(docs([]), VOCABULARY).count() == 0


def prose(seed, n=3):
    rng = np.random.default_rng(seed)
    return "\n".join(" ".join(f"{w}" for w in rng.integers(10**6, 10**7, 8).astype(str) + np.array(list("abcdefgh"))) for _ in range(n)).translate(str.maketrans("0123456789", "qrstuvwxyz"))


def test_recurring_templates_are_dropped_but_once(docs):
    note = lambda k: f"Posted by user{k} on 2020-01-{k:02d} at noon"
    field = lambda k: f"Share this page with {chr(97 + k)}anna today please"
    rows = [(k, "\n".join([prose(k), note(k), field(k)]), "en", "a") for k in range(12)]
    got = {r.doc_id: r for r in lines.drop_boilerplate(docs(rows)).collect()}
    assert got[0].text == rows[0][1] and got[0].dropped_lines == []
    assert all(got[k].text == prose(k) and got[k].dropped_lines == [3, 4] for k in range(1, 12))


def letters(k):
    return "".join(chr(97 + int(d)) for d in f"{k:05d}")


@pytest.mark.parametrize("n", [100, 10_000])
def test_templates_recur_at_any_size(docs, n):
    # two fields of few values each, and a leaf that mixes three templates
    one = lambda k: f"Read more from {letters(k % 41)} about {letters(k % 37)} in our archive"
    mixed = lambda k: f"See also the {('old list of all', 'next page for more', 'short note on every')[k % 3]} {letters(k % 29)} of it"
    rows = [(k, "\n".join([f"{letters(k)} is own", one(k), mixed(k)]), "en", "a") for k in range(n)]
    got = {r.doc_id: r.dropped_lines for r in lines.drop_boilerplate(docs(rows)).collect()}
    assert got[0] == [] and got[1] == got[2] == [1] and all(got[k] == [1, 2] for k in range(3, n))


def test_copies_fields_and_rare_lines_stay(docs):
    same = prose(99)
    rows = [(k, same, "en", "a") for k in range(20)] + [(100 + k, prose(k) + "\n12 40\n\n" + ("Only four of us share" if k < 4 else ""), "en", "a") for k in range(10)]
    for r in lines.drop_boilerplate(docs(rows)).collect():
        assert r.dropped_lines == [] and r.text == dict((x[0], x[1]) for x in rows)[r.doc_id]


def test_short_recurring_lines_go(docs):
    rows = [(k, prose(k) + "\nThe end.", "en", "a") for k in range(10)]
    got = {r.doc_id: r.text for r in lines.drop_boilerplate(docs(rows)).collect()}
    assert got == {k: prose(k) + ("\nThe end." if k == 0 else "") for k in range(10)}


def test_rows_that_share_an_id_keep_their_own_lines(docs):
    note = "Posted by me today at noon"
    own = [(1, prose(1) + "\n" + note), (1, prose(2) + "\nunlike any other"), (None, prose(3) + "\n" + note), (None, prose(4) + "\nof its own too")]
    rows = own + [(k, prose(k) + "\n" + note) for k in range(10, 15)]
    got = Counter((r.doc_id, r.text) for r in lines.drop_boilerplate(docs([(*r, "en", "a") for r in rows])).collect())
    # the first place is that of the least id
    assert got == Counter([*own[:2], (None, prose(3)), own[3], *((k, prose(k)) for k in range(10, 15))])


def test_long_passages_stay_in_one_text(spark, docs):
    import corpus_pipeline

    long, short = " ".join(prose(50, 7).split()), " ".join(prose(51, 6).split())
    rows = [(k, "\n".join([prose(k), long, short]), "en", "a") for k in range(3)] + [(9, rows_text := prose(9) + "\n" + long, "en", "a"), (10, rows_text, "en", "a")]
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs(rows), "").collect()}
    assert got == {0: rows[0][1], 1: prose(1) + "\n" + short, 2: prose(2) + "\n" + short, 9: prose(9), 10: prose(9)}


def test_lines_of_odd_rows(odd, docs, clashing):
    got = lines.drop_boilerplate(clashing(odd)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted((r.doc_id or 0, r.text or "") for r in odd.collect())
    assert {r.doc_id: r.text for r in got}[1] is None and not any(r.dropped_lines for r in got)
    assert lines.drop_boilerplate(docs([])).count() == 0


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    goal, full, left = {}, set(), 1.5 * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if level * weight[s] > 2 * sizes[s]]
        if not over:
            return goal | {s: level * weight[s] for s in rest}
        for s in over:
            goal[s] = 2.0 * sizes[s]
            left -= goal[s]
            full.add(s)


def test_mix_meets_targets(docs):
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 400))), "en", [None, "a", "b", "c", "d", "e"][min(5, k % 9)]) for k in range(400)]
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    goal = brute_targets(sizes)
    documents, pieces = mixing.mix(docs(rows), block=64)
    got = mixing.taken(documents, pieces).collect()
    assert len(got) == 400
    mixed = Counter()
    source = {r[0]: r[3] for r in rows}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and np.isclose(r.target, goal[source[r.id]])
        mixed[source[r.id]] += r.taken
    # within the blocks that the points may stray, of some eight words here
    assert all(abs(mixed[s] - goal[s]) <= 0.02 * goal[s] + 20 for s in goal)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.taken(*mixing.mix(docs(rows), block=64)).collect()))
    # low discrepancy: any stretch of the schedule is near the shares
    slots = sorted({(r.slot, r.source_key) for r in pieces.collect()})[:200]
    assert len({s for s, _ in slots}) == 200
    share = Counter(s for _, s in slots)
    for s, g in goal.items():
        assert abs(share["z" if s is None else "s" + s] - 200 * g / sum(goal.values())) < 6


def test_mix_of_odd_rows(odd, docs, clashing):
    got = mixing.taken(*mixing.mix(clashing(odd))).collect()
    assert len(got) == 11 and all(r.taken <= 2 * r["size"] for r in got)
    assert mixing.taken(*mixing.mix(docs([]))).count() == 0


def test_the_schedule_decides(docs, monkeypatch):
    rows = [(k, "w " * 50, "en", "ab"[k % 2]) for k in range(40)]
    documents, pieces = mixing.mix(docs(rows))
    assert sum(r.taken for r in mixing.taken(documents, pieces).collect()) > 0
    assert not any(r.taken for r in mixing.taken(documents, pieces.where("false")).collect())
    monkeypatch.setattr(mixing, "radical_inverse", lambda k, bits=0: F.lit(0).cast("long"))
    got = mixing.taken(*mixing.mix(docs(rows))).collect()
    assert {r.source_key for r in got if r.taken} == {"sa"}


def test_another_order_of_points_takes_other_words(docs, monkeypatch):
    """The counts follow from the first points of the sequence, not from the shares alone."""
    # every fifth point, from the fourth on
    rng = np.random.default_rng(6)
    rows = [(k, "w " * int(rng.integers(1, 300)), "en", "abcde"[k % 5]) for k in range(300)]
    first = sorted(map(tuple, mixing.taken(*mixing.mix(docs(rows))).collect()))
    own = mixing.radical_inverse
    monkeypatch.setattr(mixing, "radical_inverse", lambda k, bits=0: own(k * 5 + 3))
    other = sorted(map(tuple, mixing.taken(*mixing.mix(docs(rows))).collect()))
    assert first != other


def test_van_der_corput_points(spark):
    for bits in (10, mixing.POINT_BITS):
        got = spark.range(1000).select("id", mixing.radical_inverse(F.col("id"), bits).alias("p")).collect()
        assert all(r.p == int(f"{r.id:0{bits}b}"[::-1], 2) for r in got)
    assert [mixing.slot_count(n) for n in (0, 1, 1000, 20_000, 2_560_000, 2_560_001)] == [0, 1, 1000, 10_000, 10_000, 10_001]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in queries.op9_language_id(spark, sf).collect() if truth[r.doc_id] is not None]
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97


def test_language_of_odd_rows(odd, docs, clashing):
    more = docs([(100 + k, "der die und das ist" if k % 2 else "the of and to in is", "de" if k % 2 else "en", "a") for k in range(40)])
    both = odd.unionByName(more)
    got = {(r.doc_id, r.text): r for r in langid.identify(clashing(both), F.lit(True)).collect()}
    assert all(r.lang_pred in ("en", "de") for (i, _), r in got.items() if i and i >= 100)
    for text, want in ((None, "und"), ("", "und"), (" \n\t ", "und"), ("123 456\n!!!", "und")):
        assert [(r.lang_pred, r.score) for (_, t), r in got.items() if t == text] == [(want, 0.0)]
    alone = langid.identify(docs([(1, "text", None, "a")]), F.lit(True)).first()
    assert alone.lang_pred == "und" and langid.identify(docs([]), F.lit(True)).count() == 0


def test_presence_is_whole():
    a, b = np.zeros(langid.BUCKETS, np.uint8), np.zeros(langid.BUCKETS, np.uint8)
    text = "Größe und Maß " * 50 + "zzqq"
    langid.presence(text, a)
    langid.presence(text, b, block=7)
    assert (a == b).all() and a.sum() > 30


def test_language_against_brute_force(spark):
    """The kernel and the ridge regression written out over sets of n-grams and rows of the sample."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()

    def places(text):
        row = np.zeros(langid.BUCKETS, dtype=np.uint8)
        langid.presence(text, row)
        return set(np.flatnonzero(row).tolist())

    def kernel(a, b):
        return len(a & b) / np.sqrt(len(a) * len(b)) if a and b else 0.0

    key = lambda r: int(hashlib.md5(f"language-1|{r.doc_id}".encode()).hexdigest()[:15], 16)
    taught = [r for r in docs if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
    names = sorted({r.lang for r in taught})
    sample = [(names.index(n), s) for n in names for r in sorted((r for r in taught if r.lang == n), key=key)[: langid.PER_LANGUAGE] if langid.has_letter(r.text) and (s := places(r.text))]
    assert len(sample) <= langid.LANDMARKS  # so that all are landmarks
    y, sets = np.array([k for k, _ in sample]), [s for _, s in sample]
    gram = np.array([[kernel(a, b) for b in sets] for a in sets])
    # the mapped space of all landmarks: weights of the sample's kernel rows
    values, vectors = np.linalg.eigh(gram)
    root = vectors[:, values > 1e-5 * values.max()] / np.sqrt(values[values > 1e-5 * values.max()])
    mapped, weight = gram @ root, 1.0 / np.bincount(y)[y]
    goal = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    w = root @ np.linalg.solve(mapped.T @ (mapped * weight[:, None]) + langid.RIDGE / len(y) * np.eye(mapped.shape[1]), mapped.T @ (goal * weight[:, None]))
    got = {r.doc_id: r for r in queries.op9_language_id(spark, DATA).collect()}
    for r in docs:
        if not langid.has_letter(r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        value = np.array([kernel(places(r.text), s) for s in sets]) @ w
        assert abs(got[r.doc_id].score - min(1.0, max(0.0, (value.max() + 1) / 2))) < 2e-3
        assert got[r.doc_id].lang_pred == names[value.argmax()] or np.sort(value)[-1] - np.sort(value)[-2] < 4e-3


def test_more_languages_than_landmarks(docs, monkeypatch):
    monkeypatch.setattr(langid, "LANDMARKS", 4)
    rows = [(k, f"{chr(97 + k % 6)}{chr(97 + k % 6)} " * 9 + chr(97 + k % 26), chr(65 + k % 6), "s") for k in range(120)]
    got = langid.identify(docs(rows), F.lit(True)).collect()
    assert {r.lang_pred for r in got} <= set("ABCDEF") and sum(r.lang == r.lang_pred for r in got) > 60


def test_many_rows_of_one_key_teach_once(docs):
    rows = [(None, "the same text", "en", "s")] * 500 + [(k, f"der die das {k}", "de", "s") for k in range(30)]
    names, x, y = langid.sampled(docs(rows), "text", "lang", row_key("language-1", F.col("doc_id"), F.col("text")))
    assert names == ["de", "en"] and (y == 1).sum() == 1 and (y == 0).sum() == 30
