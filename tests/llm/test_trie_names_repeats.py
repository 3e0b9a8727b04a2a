"""The prefix trie, the name join and repeated passages against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingualoom.llm import names, repeats, suffixes, trie

TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    """The nodes of rebuilt conversations, by definition."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, said in built.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own_bytes = len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = (len(members[node]) - 1) * own_bytes + sum(saved[k] for k in kids[node])
    out = set()
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(m), len(node), parent, len(m), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def spark_trie(spark, rows, extra=lambda df: df, **how):
    df = extra(spark.createDataFrame(rows, TURNS))
    found = trie.prefix_trie(*trie.rebuilt(df), **how)
    return [tuple(r) for r in found.select("conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends").collect()]


@pytest.fixture(scope="module")
def talk():
    """Shared beginnings, deep copies, turnless results, nulls in every column, ties and repeated rows."""
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "bot"]), r.choice("ab")) for c in range(40) for t in range(r.randrange(1, 9))]
    rows += [(c, t, "user", f"deep {t}") for c in (50, 51, 52, 57) for t in range(40)]
    rows += [(53, t, "user", f"deep {t}" if t < 33 else "other") for t in range(36)]
    rows += [(60, None, None, None), (60, 3, "user", "é"), (60, 3, "user", "é"), (60, 3, "bot", None), (None, 1, "user", "x"), (-3, 1, "user", "a"), (0, None, "user", ""), (7001, 5, "u", "z")]
    return rows


@pytest.mark.parametrize("how", [{}, {"levels": 2, "step": 1024}, {"levels": 1, "step": 3}])
def test_trie_is_that_of_the_definition(spark, talk, how):
    got = spark_trie(spark, talk, **how)
    assert len(got) == len(set(got))
    assert set(got) == plain_trie(talk)


def test_trie_of_ids_in_several_runs(spark, monkeypatch):
    monkeypatch.setattr(trie, "RUN", 4)
    rows = [(c, t, "user", f"same {t}") for c in range(60) for t in range(2)]
    assert set(spark_trie(spark, rows)) == plain_trie(rows)


def test_trie_of_odd_tables(spark, talk, clashing):
    assert spark_trie(spark, []) == []
    assert set(spark_trie(spark, talk[:60], clashing)) == plain_trie(talk[:60])


def near(a, b):
    """Whether one edit at most leads from a to b."""
    edits = {a}
    letters = set(b)
    for i in range(len(a) + 1):
        edits |= {a[:i] + a[i + 1 :], *(a[:i] + c + a[i + 1 :] for c in letters if i < len(a)), *(a[:i] + c + a[i:] for c in letters)}
        if i + 1 < len(a):
            edits.add(a[:i] + a[i + 1] + a[i] + a[i + 2 :])
    return b in edits


def test_automaton_accepts_one_edit_only():
    r, one = random.Random(1), names.Universal()
    for _ in range(3000):
        words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(0, 7))) for _ in range(8)})
        query = "".join(r.choice("abcd") for _ in range(r.randrange(0, 7)))
        got = [words[i] for i in names.search(names.grown(words), query, one)]
        assert sorted(got) == [w for w in words if near(query, w)]
    assert len(one.sets) < 40  # the same for all queries


@pytest.mark.parametrize(("a", "b", "far"), [("", "", 0), ("ab", "ba", 1), ("ca", "abc", 2), ("abcd", "acbd", 1), ("a", "", 1), ("kitten", "sitting", 3)])
def test_unrestricted_distance(a, b, far):
    assert names.distance(a, b) == names.distance(b, a) == far


@pytest.mark.parametrize("room", [names.ROOM, 2])
def test_near_names_are_those_of_all_pairs(spark, room):
    r = random.Random(room)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randrange(0, 8)))
    left, right = [word() for _ in range(150)] + [None], [word() for _ in range(200)] + [None, "abab", "abab"]
    frame = lambda x: spark.createDataFrame([(w,) for w in x], "name string")
    got = [tuple(x) for x in names.near_names(frame(left), frame(right), room=room).collect()]
    want = {(a, b, int(a != b)) for a in left for b in right if a and b and near(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def plain_join(vendors, clients):
    form = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s if c not in " \t\n\x0b\x0c\r")
    out = defaultdict(list)
    for v, name in vendors:
        if name is None:
            continue
        h, n = zlib.crc32(str(v).encode()), len(name)
        if v is not None and h % 2 == 0 and n > 1:
            p = h % (n - 1)
            name = name[:p] + name[p + 1] + name[p] + name[p + 2 :]
        for c, other in clients:
            if form(name) and other and form(other) and near(form(name), form(other)):
                out[v, int(form(name) != form(other))].append(c)
    crc = lambda c: 0 if c is None else zlib.crc32(str(c).encode())
    return {(*k, len(m), min((c for c in m if c is not None), default=None), sum(map(crc, m))) for k, m in out.items()}


def test_name_join_of_odd_tables(spark, clashing):
    r = random.Random(5)
    word = lambda: " ".join("".join(r.choice("ABcdö") for _ in range(r.randrange(1, 4))) for _ in range(2))
    clients = [(k, word()) for k in range(300)] + [(300, None), (301, " \t"), (None, "AB cd"), (302, "ab cd"), (5, "AB cd"), (5, "AB cd")]
    vendors = [(k, word()) for k in range(80)] + [(80, None), (81, ""), (82, "x"), (None, "abcd"), (83, "AB  cd"), (83, "AB  cd"), (84, "İi ıI")]
    v, c = spark.createDataFrame(vendors, "vendor_id long, name string"), spark.createDataFrame(clients, "client_id long, name string")
    cols = ["vendor_id", "distance", "n_clients", "first_client_id", "clients_crc"]
    want = plain_join(vendors, clients)
    assert len(want) > 20
    assert {tuple(x) for x in names.joined(clashing(v), clashing(c)).select(cols).collect()} == want
    assert names.joined(v.limit(0), c).count() == 0
    assert names.joined(v, c.limit(0)).count() == 0


@pytest.mark.parametrize("room", [suffixes.ROOM, 10])
@pytest.mark.parametrize("look", [1, 2, suffixes.LOOK])
def test_suffixes_and_common_prefixes(monkeypatch, room, look):
    monkeypatch.setattr(suffixes._looked_ahead, "__defaults__", (look,))
    r = np.random.default_rng(look)
    for trial in range(150):
        t = r.integers(1, r.integers(2, 6), r.integers(1, 60))
        if trial % 3 == 0:
            t = np.tile(t, 4)
        if trial % 50 == 0:
            t = r.integers(1, 900, 1500)
        t = [*map(int, t), 0]
        order = sorted(range(len(t)), key=lambda i: t[i:])
        prefix = [0]
        for a, b in zip(order, order[1:], strict=False):
            k = 0
            while t[a + k] == t[b + k]:
                k += 1
            prefix.append(min(k, 20))
        got, lcp = suffixes.suffixes(np.array(t), 20, room)
        assert got.tolist() == order and lcp.tolist() == prefix


def plain_repeats(texts, length):
    """(n_bytes, spans, kept) of texts in order."""
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        edges = [i for i in range(len(data) + 1) if (gone[i] if i < len(data) else 0) != (gone[i - 1] if i else 0)]
        out.append((len(data), list(zip(edges[::2], edges[1::2], strict=True)), bytes(c for c, g in zip(data, gone, strict=True) if not g)))
    return out


def spark_repeats(df, length, **how):
    rows = repeats.remove_repeats(df, length=length, **how).collect()
    return [(r.id, (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept))) for r in rows]


@pytest.mark.parametrize("how", [{}, {"block": 150, "shard": 400}])
def test_repeats_are_those_of_all_passages(spark, how):
    r = random.Random(9)
    base = ["".join(r.choice("abcdé ") for _ in range(300)) for _ in range(6)]
    texts = [None, "", "short", "a" * 700, "ab" * 400 + "x", base[0], base[0]]
    for _ in range(60):
        a, b = r.choice(base), r.choice(base)
        i, j = r.randrange(250), r.randrange(250)
        texts.append(a[i : i + r.randrange(200)] + r.choice(["", "-", "0123456789" * 12]) + b[j:] + "".join(r.choice("xyz") for _ in range(r.randrange(60))))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    assert [x[1] for x in sorted(spark_repeats(df, 100, **how))] == plain_repeats(texts, 100)


def test_repeats_of_odd_tables(spark, odd, clashing):
    rows = odd.collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, hashlib.md5((r.text or "").encode()).hexdigest())
    rows.sort(key=key)
    want = plain_repeats([r.text for r in rows], 100)
    got = spark_repeats(clashing(odd), 100)
    none = lambda k: (k is None, k or 0)
    assert sorted((none(k), x) for k, x in got) == sorted((none(r.doc_id), x) for r, x in zip(rows, want, strict=True))
    assert spark_repeats(odd.limit(0), 100) == []


def test_pieces_of_equal_passages_meet(spark):
    """Of every passage that stands twice, both places lie in pieces with one anchor."""
    r = random.Random(2)
    common = "".join(r.choice("abcdef") for _ in range(260))
    texts = [("".join(r.choice("ghi") for _ in range(50 + 7 * k)) + common[k : 200 + k]).encode() for k in range(8)]
    sizes = np.array([len(x) for x in texts])
    starts = np.cumsum(sizes) - sizes
    anchor, _, _, first, n, _ = repeats.Pieces(100).cut(np.frombuffer(b"".join(texts), dtype=np.uint8), starts, sizes)
    data, of = b"".join(texts), {}
    for a, f, m in zip(anchor.tolist(), first.tolist(), n.tolist(), strict=True):
        for i in range(f, f + m):
            assert of.setdefault(data[i : i + 100], a) == a
    assert sum(n) == sum(max(0, s - 99) for s in sizes)
