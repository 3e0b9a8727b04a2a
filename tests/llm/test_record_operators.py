"""HTML extraction, embeddings, WARC, SimHash, components and the pipeline."""

import base64
import glob
import gzip
import hashlib
import io
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from lingualoom.llm import components, embeddings, html, oracles, queries, simhash, similar, warc
from lingualoom.llm.support import shared_path

DATA = "/root/testdata/sf0.001"


def page(k, body, menu="<nav><a>Home</a></nav>", foot="All rights reserved by us"):
    return f"<html><head><title>t</title></head><body>{menu}<div>Welcome to the daily site</div><div><h1>Title {k}</h1>{body}</div><div>{foot}</div></body></html>"


def test_template_of_a_host_is_left_out(spark):
    rows = [(k, f"http://Host.org:80/{k}", page(k, f"<p>Body {k} &amp; more<p>Second {k * k} line")) for k in range(20)]
    rows += [(100 + k, f"http://other{k}.org/", page(k, "<p>x")) for k in range(3)]
    got = {r.page_id: r.main_text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Title {k}\n\nBody {k} & more\n\nSecond {k * k} line" for k in range(20))
    assert got[100] == "Welcome to the daily site\n\nTitle 0\n\nx\n\nAll rights reserved by us"


def test_copies_of_a_page_are_no_template(spark):
    rows = [(k, f"http://a.org/{k}", f"<body><article><p>The same text everywhere {'' if k < 40 else k}</article></body>") for k in range(43)]
    got = [r.main_text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert all(t.startswith("The same text everywhere") for t in got)


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>a <b>b<br>c</b>  d</p>e", "a b c d\n\ne"),
        ("<p>a<p>b<ul><li>c<li>d</ul>", "a\n\nb\n\nc\n\nd"),
        ("<nav>x</nav><main><p>y</p><aside>z</aside></main><p>w", "y"),
        ("<script>if (a<b) '</p>'</script><style>p{}</style><!-- <p>no -->ok", "ok"),
        ("<div class='post comments'>no</div><form>f</form><p hidden>h</p><p>yes", "yes"),
        ("a &lt;b&gt; &eacute; &#8364; &nbsp;x", "a <b> é € x"),
        ("<header>top</header><article><header><h1>T</h1></header>b<footer>f</footer></article>", "T\n\nb"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\n\nc"),
        ("<p title='a > b'>t</p", "t"),
        ("text < 3 and > 2", "text < 3 and > 2"),
        ("<div role=navigation>n</div><textarea>q</textarea><p>k", "k"),
        ("", ""),
        (None, ""),
    ],
)
def test_extraction_rules(source, want):
    assert html.main_text(source, None) == want


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<body class='no-sidebar'><p>a</p><div class='site-footer'>f</div></body>", "a"),
        ("<div class='content with-sidebar'><p>a</div><div id='sidebar_2'>s</div>", "a"),
        ("<article class='post comments-open'><p>a</article><p>b", "a"),
        ("<main id='page-with-ads' class='widget'><p>a</main>", "a"),
        ("<form id='all'><div class='comments'><p>a</div></form>", "a"),
    ],
)
def test_layout_names_lose_no_article(source, want):
    assert html.main_text(source, None) == want


def test_simple_tree_matching():
    leaf = lambda key, *kids: (lambda n: (n.children.extend(kids), n)[1])(html.Node(key))
    a = leaf("r", leaf("a", leaf("x"), leaf("y")), leaf("b"), leaf("c"))
    b = leaf("r", leaf("b"), leaf("a", leaf("y"), leaf("z")), leaf("c"))
    assert html.matching(a, b) == 4 and html.matching(a, a) == 6 and html.matching(leaf("q"), a) == 0
    assert [(x and x.key, y and y.key) for x, y in html.pairs(a, b)].count(("c", "c")) == 1


def test_summaries_keep_frequent_texts():
    n = html.Node("p", 0)
    for k in range(500):
        one = html.Node("p")
        one.texts = {"often": 1} if k % 2 else {f"t{k}": 1}
        n = html.merge(n, one)
    assert n.count == 500 and len(n.texts) <= html.COUNTERS and n.texts["often"] >= 250 - 500 / html.COUNTERS


def test_frequent_texts_among_many_siblings_are_template(spark):
    menu = "".join(f"<li>Entry {j}" for j in range(40))
    body = lambda k: "".join(f"<p>Own {k} {j}" for j in range(16))
    # the notice is on 72 % of the pages, the hint on 68 %
    html_of = lambda k: f"<ul>{menu}</ul><div>{body(k)}{'<p>Subscribe now' * (k % 25 < 18)}{'<p>A hint' * (k % 25 < 17)}</div>"
    rows = [(k, "http://a.org/", html_of(k)) for k in range(300)]
    for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        own = [f"Own {r.page_id} {j}" for j in range(16)] + ["A hint"] * (r.page_id % 25 < 17)
        assert r.main_text.split("\n\n") == own


def test_near_copies_keep_their_marked_article(spark):
    same = "".join(f"<p>Shared paragraph {j}" for j in range(5))
    rows = [(k, f"http://a.org/{k}", f"<div>Site name</div><article>{same}<p>Of day {k}</article>") for k in range(10)]
    for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.main_text.split("\n\n") == [*(f"Shared paragraph {j}" for j in range(5)), f"Of day {r.page_id}"]


def test_wrapper_against_brute_force_on_pages_without_helpful_tags(spark):
    """Nothing but div elements: what 70 % of a host's pages have at a place is template, the rest is content."""
    rng = np.random.default_rng(21)
    rows, want = [], {}
    for h in range(4):
        menu = [f"Menu {h} {j}" for j in range(6)]
        for k in range(12):
            own = [f"Paragraph {h} {k} {j} {rng.integers(10**6)}" for j in range(rng.integers(1, 5))]
            notice = ["Accept our notice"] * bool(rng.random() < 0.9)
            parts = [menu, notice, own, [f"Copyright of host {h}"]]
            rows.append((100 * h + k, f"https://h{h}.org/{k}", "".join("<div>" + "".join(f"<div>{x}</div>" for x in p) + "</div>" for p in parts if p)))
            want[100 * h + k] = parts
    share = {h: Counter(x for k in range(12) for p in want[100 * h + k] for x in p) for h in range(4)}
    got = {r.page_id: r.main_text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for page_id, parts in want.items():
        assert got[page_id].split("\n\n") == [x for p in parts for x in p if share[page_id // 100][x] < 0.7 * 12]


def test_wrapper_decides_inside_marked_articles(spark):
    """Marked and unmarked pages of several hosts against brute force: a text on 70 % of a host's
    pages is template, in an article too; without wrappers, the notices would stay."""
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for h in range(3):
        for k in range(14):
            own = [f"Paragraph {h} {k} {j} {rng.integers(10**6)} of some length" for j in range(rng.integers(2, 6))]
            notice = ["Read on in our app"] * bool(rng.random() < 0.85)
            body = "".join(f"<p>{x}" for x in [*notice, *own, "Share this"])
            tag = ("article", "main", "div")[h]
            rows.append((100 * h + k, f"https://h{h}.org/{k}", f"<div>Site {h}</div><{tag}>{body}</{tag}>"))
            want[100 * h + k] = [[f"Site {h}"] * (tag == "div"), notice, own, ["Share this"]]
    share = {h: Counter(x for k in range(14) for p in want[100 * h + k] for x in p) for h in range(3)}
    got = {r.page_id: r.main_text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for page_id, parts in want.items():
        assert got[page_id].split("\n\n") == [x for p in parts for x in p if share[page_id // 100][x] < 0.7 * 14]
    plain = {k: html.main_text(page, None) for k, _, page in rows}
    assert all(plain[k] != got[k] and "Share this" in plain[k] for k in plain)


def test_wrapper_does_not_depend_on_the_order_of_pages(spark):
    pages = ["<div>Menu<p>Notice<p>own {}", "<div>Notice<p>Menu<p>own {}", "<div>Menu<p>Notice<p>Menu<p>own {}", "<ul><li>Menu</ul><div>own {}<p>Notice"]
    rows = [(k, "http://a.org/", page.format(k)) for k, page in enumerate(pages * 2)]
    seen = set()
    for order in (rows, rows[::-1], rows[3:] + rows[:3], sorted(rows, key=lambda r: r[2])):
        for parts in (1, 5):
            df = spark.createDataFrame(order, "page_id long, url string, html string").repartition(parts)
            seen.add(tuple(sorted((r.page_id, r.main_text) for r in html.extract(df).collect())))
    assert len(seen) == 1


def test_pages_nested_deeply(spark):
    deep = lambda k: "<div>" * 5000 + f"<p>Text {k}" + "</div>" * 2000 + f"<b>{k}"
    rows = [(k, "http://a.org/" if k % 2 else None, deep(k)) for k in range(6)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.main_text for r in got} == {k: f"Text {k}\n\n{k}" for k in range(6)}


def test_wrappers_are_bounded():
    own = html.Node("r", 0)
    for k in range(300):
        tree = html.tree_of("".join(f"<div class=c{k}x{j}>a</div>" for j in range(40)) + "<ul><li>menu</ul>")[0]
        own = html.merge(own, tree) if own.count else tree
    assert len(html.slots_of(own)) <= html.NODES and any(n.key == "li" and n.count == 300 for n in html.slots_of(own))


def test_pages_of_odd_rows(spark):
    rows = [(1, None, "<p>a"), (2, "http://x.org", None), (2, "http://x.org", None), (None, "bad url", ""), (3, "", "<p>" * 3000 + "deep")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, tree string")
    got = sorted((r.page_id or 0, r.main_text) for r in html.extract(df).collect())
    assert got == [(0, ""), (1, "a"), (2, ""), (2, ""), (3, "deep")]
    assert html.extract(df.limit(0)).count() == 0


def brute_links(ids, vectors, least=0.9):
    near = defaultdict(set)
    good = {}
    for k, v in enumerate(vectors):
        if v and None not in v and np.isfinite(v).all() and any(v) and ids[k] is not None:
            good[k] = np.array(v, float) / np.linalg.norm(v)
    for i in good:
        for j in good:
            if i != j and len(good[i]) == len(good[j]) and good[i] @ good[j] >= least:
                near[i].add(j)
    label = {}
    for k in sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0)):
        stack = [k]
        while stack:
            x = stack.pop()
            if x not in label:
                label[x] = ids[k]
                stack += near[x]
    return [(ids[k], len(near[k]), label[k]) for k in range(len(ids))]


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(12, 16))
    vectors = [(centre[k % 12] + 0.28 * rng.normal(size=16)).tolist() for k in range(600)]
    vectors += vectors[:30] + [(2.5 * np.array(v)).tolist() for v in vectors[:5]]
    vectors += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 0.0], [0.9, 0.1], [1e-30] * 16]
    ids = list(range(len(vectors), 0, -1))
    ids[3] = None
    df = spark.createDataFrame(list(zip(ids, vectors, ["x"] * len(ids), strict=True)), "vec_id long, embedding array<double>, rep string")
    want = sorted(brute_links(ids, vectors), key=str)
    for rows in (100, 5000):
        got = sorted(((r.id, r.n_links, r.component) for r in embeddings.near_vectors(df, block_rows=rows).collect()), key=str)
        assert sum(a != b for a, b in zip(got, want, strict=True)) <= len(want) // 200  # calibrated recall, 0.9999 a pair
        assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))
    assert embeddings.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [8, 64])
def test_vectors_around_the_limit(spark, dim):
    """Pairs just above and below a cosine of 0.9, among vectors far from all others, and a dense cluster."""
    rng = np.random.default_rng(dim)
    vectors, want = [], []
    for c in [0.89, 0.8999999, 0.9000001, 0.91, 0.95] * 60:
        a, b = np.linalg.qr(rng.normal(size=(dim, 2)))[0].T
        want.append((len(vectors), c >= 0.9))
        vectors += [a, c * a + np.sqrt(1 - c * c) * b]
    centre = rng.normal(size=dim)
    vectors += [centre + 0.01 * rng.normal(size=dim) for _ in range(500)]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    got = {r.id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=200).collect()}
    brute = {i: (n, c) for i, n, c in brute_links([r[0] for r in rows], [r[1] for r in rows])}
    assert sum((r.n_links, r.component) != brute[k] for k, r in got.items()) <= 2  # calibrated recall, 0.9999 a pair
    if dim == 64:  # chance pairs are far below the limit
        assert sum((got[k].n_links > 0) != linked for k, linked in want) <= 2


def test_windows_are_centred_on_queries():
    rng = np.random.default_rng(5)
    t, q = rng.normal(size=(300, 3)), rng.normal(size=(70, 3))
    place, first, more = embeddings.windows(t, q, 0.1)
    for j in range(3):
        hit = ((place[j][None, :] - first[j][:, None]).astype(np.uint8) <= more[j][:, None]).astype(bool)
        inside = np.abs(q[:, j][:, None] - t[:, j][None, :]) <= 0.1
        assert (hit | ~inside).all() and (hit & ~inside).mean() < 0.02


def test_calibration():
    assert embeddings.least_collisions(10, 100.0, 0.99) == 10
    k, p = embeddings.least_collisions(32, 2.25, 0.9999), 0.97555
    draws = np.random.default_rng(1).binomial(32, p, 200_000)
    assert (draws >= k).mean() > 0.9997 > (draws >= k + 2).mean()


def test_warc_round_trip_at_any_split(spark):
    bodies = ["", "a", "é" * 1000, None, "same", "same", "same", "x" * 300_000, "\x1f\x8b\x08 WARC/1.1\r\n\r\n"]
    rows = [(k, None if k == 1 else f"http://h.org/a b?{k}\n", b) for k, b in enumerate(bodies)] + [(None, "u", "same"), (6, "again", "same")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, sha string, n int").repartition(3)
    path = shared_path(spark, "test")
    warc.write(df, path)
    for split in (11, 500, 1 << 20):
        got = warc.read(spark, path, split_bytes=split).collect()
        assert len(got) == len(rows)
        for r in got:
            k = r.record_id.removeprefix(warc.ID)
            body = ("same" if k in ("none", "6") else bodies[int(k)] or "").encode()
            assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
            refers = {"4": "6", "5": "6", "0": "3"}.get(k)
            assert r.record_type == ("revisit" if refers else "response") and r.refers_to == (warc.ID + refers if refers else None)
            assert r.payload == (None if refers else body)
    found = b"".join(gzip.open(f).read() for f in glob.glob(path.removeprefix("file://") + "/part*"))
    assert found.count(b"WARC/1.1\r\nWARC-Type") == len(rows)  # any gzip reader reads the archive
    empty = shared_path(spark, "test")
    warc.write(df.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


def test_warc_query_of_odd_pages(spark, tmp_path):
    rows = [(1, "u", "same"), (2, "u", "same"), (None, "u", "same"), (None, None, "other"), (3, "u", None), (4, "u", ""), (5, "u", "x"), (5, "u", "x"), (6, "u", "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op7_warc(spark, str(tmp_path)).collect()
    want = [(1, "revisit", 2), (2, "response", None), (None, "response", None), (None, "response", None), (3, "revisit", 4), (4, "response", None), (5, "revisit", 6), (5, "revisit", 6), (6, "response", None)]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        bodies = [(h or "").encode() for p, _, h in rows if p == r.page_id]
        assert (r.payload_bytes, r.payload_digest) in [(len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()) for b in bodies]


def test_warc_reader_uses_all_cores(spark):
    df = spark.range(400).selectExpr("id page_id", "'u' url", "repeat(md5(string(id)), 3000) html").repartition(4)
    path = shared_path(spark, "warc-test")
    warc.write(df, path)
    got = warc.read(spark, path, split_bytes=4096)
    assert got.rdd.getNumPartitions() >= 16 and got.select("record_id").distinct().count() == 400


def test_warc_passes_over_noise():
    one = warc.member(1, "u", b"payload", None)
    noise = b"\x1f\x8b\x08\x00junk" + gzip.compress(b"not a record") + one[:20]
    data = noise + one + warc.EMPTY_MEMBER + one + one[:-3]
    file = io.BytesIO(data)
    file.size = lambda: len(data)
    for step in (1, 7, len(data)):
        found = [at for s in range(0, len(data), step) for at, _ in warc.members(file, s, min(len(data), s + step), chunk=16)]
        assert found == [len(noise), len(noise) + len(one) + len(warc.EMPTY_MEMBER)]
    with pytest.raises(ValueError, match="digest"):
        warc.parse(gzip.decompress(one).replace(b"payload\r", b"paYload\r"))


def brute_fingerprint(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", "  ", "a", "A b", "a b c D", "é A\x0bB\x1cC Ä e f g " * 9, "x " * 500, "one two three four five six"])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text) == simhash.fingerprint(text, block=5)


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [int(b) ^ int(sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 9), replace=False))) for b in np.tile(base, 30)] + [0, 0, 1]
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    ids = rng.permutation(len(fps)).tolist()
    rows = [*zip(ids, signed, strict=True), (None, signed[0])]
    forest = components.Forest(len(fps))
    x, y = np.nonzero(np.bitwise_count(np.array(fps, dtype=np.uint64)[:, None] ^ np.array(fps, dtype=np.uint64)[None, :]) <= 4)
    forest.unite(x, y)
    least = {}
    for k, root in enumerate(forest.label):
        least[root] = min(least.get(root, 10**9), ids[k])
    want = {ids[k]: least[root] for k, root in enumerate(forest.label)}
    df = spark.createDataFrame(rows, "id long, fp long")
    for shard, top in ((50, 1024), (50, 2), (10**6, 1024)):
        got = simhash.near_duplicates(df, 4, shard, top).collect()
        assert {r.id: r.component for r in got} == want | {None: None} and len(got) == len(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_vantage_tree_misses_no_shard():
    rng = np.random.default_rng(3)
    sample = rng.integers(0, 2**63, 500, dtype=np.uint64)
    tree = simhash.VantageTree(sample, 8)
    homes = np.full(500, -1)
    reached = defaultdict(set)
    for shard, rows, home in tree.visit(sample, 4):
        homes[rows[home]] = shard
        for r in rows:
            reached[r].add(shard)
    near = sample ^ np.uint64(0b10110001)
    for shard, rows, home in tree.visit(near, 4):
        for r in rows[home]:
            assert shard in reached[r]
    assert (homes >= 0).all()


def test_simhash_of_odd_rows(odd, docs, clashing):
    got = simhash.near_duplicates(simhash.fingerprints(clashing(odd))).collect()
    group = {r.id: r.component for r in got}
    assert len(got) == 11 and group[1] == group[2] == group[3] == 1 and group[4] == group[5] == 4 and group[None] is None
    assert similar.near_documents(docs([])).count() == 0


def test_similar_documents_are_found(docs):
    rng = np.random.default_rng(11)
    rows, words_ = [], lambda: [f"w{x}" for x in rng.integers(0, 5000, 400)]
    for k in range(30):
        w = words_()
        rows.append((2 * k, " ".join(w), "en", "a"))
        for _ in range(6):  # six changed words of 400 leave a similarity of about 0.86
            w[rng.integers(0, 400)] = "changed"
        rows.append((2 * k + 1, " ".join(w), "en", "a"))
    got = {r.id: r.component for r in similar.near_documents(docs(rows)).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(30)) >= 27 and all(v in (k, k - 1) for k, v in got.items())


def test_documents_below_the_similarity_stay_apart(docs):
    rng = np.random.default_rng(12)
    rows = []
    for k in range(20):
        w = [f"w{x}" for x in rng.integers(0, 5000, 404)]
        for near in range(2):  # five shingles a changed word: a similarity of 350 / 450, and of 365 / 435
            other = list(w)
            for at in range(15, 270, 40) if near else range(5, 200, 20):
                other[at] = "changed"
            rows.append((3 * k + 1 + near, " ".join(other), "en", "a"))
        rows.append((3 * k, " ".join(w), "en", "a"))
    sets = {r[0]: {tuple(r[1].split()[i : i + 5]) for i in range(400)} for r in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    got = {r.id: r.component for r in similar.near_documents(docs(rows)).collect()}
    for k in range(0, 60, 3):
        assert 0.7 < alike(k, k + 1) < 0.8 <= alike(k, k + 2) and alike(k + 1, k + 2) < 0.8
        assert (got[k], got[k + 1], got[k + 2]) == (k, k + 1, k)


def test_repeated_passages_have_no_weight(docs):
    rng = np.random.default_rng(14)
    rows = []
    for k in range(10):
        w = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows += [(3 * k, " ".join(w), "en", "a"), (3 * k + 1, " ".join(w + w), "en", "a"), (3 * k + 2, " ".join(w + w[:100]), "en", "a")]
    assert all(r.component == r.id // 3 * 3 for r in similar.near_documents(docs(rows)).collect())


@pytest.mark.parametrize("block_bytes", [1 << 20, 20_000])
def test_near_documents_against_brute_force(docs, block_bytes):
    """Chains of copies around the limit, copies of copies, and texts that share a passage only."""
    rng = np.random.default_rng(15)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    rows, shared = [], word(60)
    for k in range(12):
        base = word(int(rng.integers(100, 300)))
        for c in range(20):
            w = list(base)
            for at in rng.integers(0, len(w), c % 7 + (c > 14)):
                w[at] = f"c{c}x{at}"
            rows.append(" ".join(w + shared[: 60 * (k % 3 == 0)]))
            base = w if c % 4 == 3 else base
    rows += ["", None, " ", "one two", "one  two", rows[0], rows[0] + " more"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in rows]
    forest = components.Forest(len(rows))
    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both >= 0.8 * (len(sets[x]) + len(sets[y]) - both):
                forest.unite(np.array([x]), np.array([y]))
    got = {r.id: r.component for r in similar.near_documents(docs([(k, t, "en", "a") for k, t in enumerate(rows)]), block_bytes=block_bytes).collect()}
    assert got == {k: int(forest.label[k]) for k in range(len(rows))}


def test_near_documents_of_few_words(docs):
    """Four of five shingles are shared: fingerprints differ most there."""
    rows = []
    for k in range(2000):
        w = [f"w{k}x{j}" for j in range(9)]
        rows += [(2 * k, " ".join(w), "en", "a"), (2 * k + 1, " ".join(w[:8]), "en", "a")]
    got = {r.id: r.component for r in similar.near_documents(docs(rows)).collect()}
    assert got == {k: k // 2 * 2 for k in range(4000)}


@pytest.mark.parametrize("piece_rows", [10**6, 60])
def test_vantage_points_leave_out_no_near_point(spark, piece_rows):
    """Points within reach are linked wherever they lie, whether or not they have a minimal hash in common:
    random ones, pairs and a chain at the limits of distance and of size, and a crowd of one size."""
    rng = np.random.default_rng(16)
    flipped = lambda w, bits: w ^ sum((np.uint64(1) << np.uint64(b) for b in rng.choice(64, bits, replace=False)), np.uint64(0))
    prints = [list(rng.integers(0, 2**64, 4, dtype=np.uint64)) for _ in range(300)]
    sizes = rng.integers(6, 400, 300).tolist()
    for k in range(100):
        prints.append([flipped(w, 22 if at == 0 else 14) for at, w in enumerate(prints[k])])
        sizes.append(-(-4 * sizes[k] // 5) - (k % 5 == 0))
    for k in range(40):
        prints.append([flipped(w, (6, 12, 20, 16)[at] + (k % 10 == 0) * 30 * (at == 3)) for at, w in enumerate(prints[-1])])
        sizes.append(100)
    for _ in range(100):
        prints.append([flipped(w, 3) for w in prints[0]])
        sizes.append(sizes[0])
    fp, n = np.array(prints, dtype=np.uint64), np.array(sizes)
    far = np.bitwise_count(fp[:, None] ^ fp[None])
    near = (far[..., 0] <= 22) & (far.sum(axis=2, dtype=int) <= 64) & (5 * np.minimum(n[:, None], n) >= 4 * np.maximum(n[:, None], n))
    forest = components.Forest(len(n))
    forest.unite(*np.nonzero(near))
    rows = [(k, int(n[k]), *fp[k].view(np.int64).tolist()) for k in range(len(n))]
    df = spark.createDataFrame(rows, "rep long, n long, w0 long, w1 long, w2 long, w3 long")
    got = {r.node: r.component for r in components.components(similar.vantage_links(df, 0.8, piece_rows)).collect()}
    assert got == {k: int(root) for k, root in enumerate(forest.label) if k != root} and len(got) > 200


def test_rows_of_one_id_are_apart(docs):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(50))
    rows = [(5, text(2)), (5, text(3)), (5, text(3)), (4, text(3) + " end"), (9, text(2) + " end"), (None, text(2))]
    got = sorted((r.id or 0, r.component or 0) for r in similar.near_documents(docs([(*r, "en", "a") for r in rows])).collect())
    assert got == [(0, 0), (4, 4), (5, 4), (5, 4), (5, 5), (9, 5)]


def test_rows_without_or_with_repeated_ids(spark, docs):
    import corpus_pipeline

    text = lambda k: " ".join(f"w{k}x{j}" for j in range(50))
    rows = [(None, text(0), "en", "a"), (None, text(0), "en", "a"), (None, text(1), "en", "a"), (7, text(1), "en", "a")]
    rows += [(5, text(2), "en", "a"), (5, text(2), "en", "a"), (5, text(3), "en", "a")]
    got = corpus_pipeline.near_duplicates(spark, docs(rows), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, text(0)), (5, text(2)), (5, text(3)), (7, text(1))]


@pytest.mark.parametrize("hub", [10**6, 5])
def test_components_of_paths_and_stars(spark, monkeypatch, hub):
    monkeypatch.setattr(components, "HUB", hub)
    edges = [(k, k + 1) for k in range(0, 200)] + [(1000, 1000 + k) for k in range(1, 50)] + [(5, 5), (None, 3), (2000, 2001), (2001, 2000)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 201)} | {1000 + k: 1000 for k in range(1, 50)} | {2001: 2000}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    import os

    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    rows = lambda df: sorted(tuple("null" if v is None or v is pd.NA or v != v else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    spark_rows = [r.asDict() for r in queries.queries()[name](spark, DATA).collect()]
    duck = con.sql(queries.oracle_sql()[name])
    columns = sorted(duck.columns)
    own = sorted(tuple("null" if r[c] is None else f"{r[c]:.5f}" if isinstance(r[c], float) else str(r[c]) for c in columns) for r in spark_rows)
    want = sorted(tuple("null" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in con.sql(f"SELECT {', '.join(columns)} FROM duck").fetchall())
    assert own == want


def test_crc_in_sql():
    import zlib

    import duckdb

    for t in ("", "a", "Grüße", "x" * 300):
        assert duckdb.execute(f"SELECT {oracles.crc32_sql('t')} FROM (SELECT ? AS t)", [t]).fetchone()[0] == zlib.crc32(t.encode())


def test_pipeline_against_brute_force(spark, docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = np.random.default_rng(13)
    common = {"en": "the of and to in is that for with was".split(), "de": "der die und das ist nicht mit auf ein zu".split()}
    rows = []
    for k in range(80):
        lang = "ende"[2 * (k % 2) :][:2]
        own = [f"{'th' if lang == 'en' else 'sch'}{''.join(rng.choice(list('abcdeghilmnorstu'), 5))}" for _ in range(60)]
        text = " ".join(x for pair in zip(own, np.tile(common[lang], 6), strict=True) for x in pair)
        rows.append((k, text + "\nAll rights are reserved here by us", lang, "abc"[k % 3]))
    rows += [(200 + k, rows[0][1], "en", "a") for k in range(4)] + [(300, None, "en", "a"), (301, "12 34", "en", "a"), (302, "", None, "b")]
    folder = f"file://{tmp_path}/t"
    docs(rows).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    held = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.language(spark, held, folder).collect()
    assert {r.doc_id for r in kept} == {r[0] for r in rows} - {300, 301, 302}
    clean = corpus_pipeline.lines(spark, docs([tuple(r)[:4] for r in kept]), folder).collect()
    first = [r.doc_id for r in clean if r.text.endswith("by us")]
    assert first == [0] and len(clean) == len(kept)
    alone = corpus_pipeline.near_duplicates(spark, docs([tuple(r)[:4] for r in clean]), folder).collect()
    assert {r.doc_id for r in alone} == set(range(80)) and corpus_pipeline.COLUMNS == list(alone[0].asDict())
    mixed = corpus_pipeline.mixture(spark, docs([tuple(r)[:4] for r in alone]), folder).collect()
    assert max(sum(r.doc_id == k for r in mixed) for k in range(80)) <= 2
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in mixed}
    done = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.doc_id for r in done) == sorted(r.doc_id for r in mixed)
    for r in done:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_pipeline_stages_against_brute_force(spark):
    """Each stage's own input, the documents, and what SQL, the library or all pairs make of it."""
    import math

    import corpus_pipeline
    import duckdb
    import pandas as pd
    import public_tokenizers
    from tokenizers import Tokenizer

    from lingualoom.llm.support import written

    def by_sql(sql, rows):
        con = duckdb.connect()
        documents = pd.DataFrame([r.asDict() for r in rows])  # noqa: F841
        con.execute("CREATE TABLE documents AS SELECT * FROM documents")
        return {r["doc_id"]: r for r in con.sql(sql).df().to_dict("records")}

    raw = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = written(corpus_pipeline.language(spark, raw, DATA), "stage")
    before = docs.collect()
    assert sorted(r.doc_id for r in before) == sorted(r.doc_id for r in raw.collect() if r.text and any(map(str.isalpha, r.text)))

    docs = written(corpus_pipeline.lines(spark, docs, DATA), "stage")
    rows, want = docs.collect(), by_sql(oracles.op6(), before)
    kept = {k: r for k, r in want.items() if r["n_dropped"] == 0 or r["n_chars"] > 0}
    for r in rows:
        assert hashlib.md5(r.text.encode()).hexdigest() == want[r.doc_id]["text_md5"] and r.n_chars == len(r.text)
    assert {r.doc_id for r in rows} <= set(kept) and all(want[k]["n_dropped"] > 0 for k in set(kept) - {r.doc_id for r in rows})

    docs = written(corpus_pipeline.near_duplicates(spark, docs, DATA), "stage")
    words = [[w for w in __import__("re").split(r"[\x20\x09-\x0D]+", r.text.translate({c: c + 32 for c in range(65, 91)})) if w] for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    forest = components.Forest(len(rows))
    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both >= 0.8 * (len(sets[x]) + len(sets[y]) - both):
                forest.unite(np.array([x]), np.array([y]))
    least = {}
    for k, root in enumerate(forest.label.tolist()):
        least[root] = min(least.get(root, math.inf), rows[k].doc_id)
    alone = docs.collect()
    assert sorted(r.doc_id for r in alone) == sorted(least.values())

    docs = written(corpus_pipeline.mixture(spark, docs, DATA), "stage")
    want = by_sql(oracles.op8(), alone)
    mixed = docs.collect()
    assert Counter(r.doc_id for r in mixed) == Counter({k: math.ceil(r["taken"] / r["size"]) for k, r in want.items() if r["taken"]})

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    done = Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.tokens(spark, docs, DATA).collect())
    ids = lambda t: " ".join(map(str, library.encode(t, add_special_tokens=False).ids))
    assert done == Counter((r.doc_id, hashlib.sha256(ids(r.text).encode()).hexdigest()) for r in mixed)


def test_pipeline_of_an_empty_table(spark, docs, tmp_path):
    import corpus_pipeline

    docs([]).coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_last_stages_of_rows_without_id_or_source(spark, docs, odd):
    """Mixing takes rows without id or source as others, repeated ones each; every row gets its tokens."""
    import corpus_pipeline

    rows = [(None, f"lost {k} " * 40, "en", None) for k in range(12)] + [(7, "seven words " * 30, None, "a")] * 3
    mixed = corpus_pipeline.mixture(spark, docs(rows), "").collect()
    assert mixed and {r.source for r in mixed} <= {None, "a"}
    assert max(Counter((r.doc_id, r.text) for r in mixed).values()) <= 6  # three rows, twice at most
    done = corpus_pipeline.tokens(spark, odd, "").collect()
    assert len(done) == odd.count() and all(r.n_tokens == 0 for r in done if r.doc_id in (1, 2, 3))


def test_vectors_beside_clashing_names(spark, clashing):
    rows = [(1, [1.0, 0.0], 3), (2, [2.0, 0.0], 4), (3, [0.0, 1.0], 3), (None, [1.0, 0.0], 1), (4, None, 2)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = {r.id: (r.n_links, r.component) for r in embeddings.near_vectors(df, least=0.9).collect() if r.id is not None}
    assert got == {1: (got[1][0], 1), 2: (got[2][0], 1), 3: (0, 3), 4: (0, 4)} and got[1][0] >= 1
