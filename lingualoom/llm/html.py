"""Main text of web pages by wrapper induction.

Pages of one host are aligned by simple tree matching. The wrapper is the
merged tree: each of its slots counts the pages that have it and, in a bounded
summary (Misra-Gries, so every frequent text is in it), the texts found there.
The frequent texts are then counted exactly, by aligning every page with the
wrapper. A text that most pages of a host share at its slot is template, inside a
marked article too; the varying texts are content. Tags settle what is open then:
elements which never hold an article (menus, forms, scripts, ...) are passed over,
and pages that mark their article keep to it. Trees are merged in an order that
follows from their contents, so a wrapper doesn't depend on how pages arrive.

Runs of equal siblings are merged into one node before matching, so a wrapper
has few nodes however many paragraphs or menu entries the pages have; of more
than NODES, the slots of the fewest pages go. Pages of a host that differ in
nothing but their id count once, so copies of an article don't look like a
template. A host's pages are dealt to many partial wrappers, which are merged in
rounds; no host meets in one task.

Defined results: a null or empty html gives the empty text; pages without URL
get no template, nor do hosts of fewer than LEAST_PAGES different pages, where
tags alone decide; a page whose whole text is template, or in
elements that are passed over, keeps it; broken and
unclosed markup is closed as browsers do, at any depth; repeated rows get equal
results; an empty table gives an empty table. Other columns are kept.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import slices, spread, written

#: A text is template if this share of a slot's pages has it there, of so many pages at least.
CONSTANT_SHARE = 0.7
LEAST_PAGES = 3
#: Counters of a slot's summary for each text that a page may have there: a count is short by less than pages / COUNTERS.
COUNTERS = 32
#: Texts with this share in the summary are counted exactly; below CONSTANT_SHARE by more than a summary is short.
CANDIDATE_SHARE = 0.6
#: Slots of a wrapper at most: of more, those of the fewest pages go.
NODES = 4096
#: Pages of a partial wrapper, and partial wrappers merged at once.
PAGES_AT_ONCE = 64
MERGED_AT_ONCE = 16

# Element names of the HTML standard, by how they are treated here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
SPACE = frozenset("br td th img input wbr".split())
NO_ARTICLE = frozenset("head nav footer aside form button select dialog menu object canvas audio video fieldset search".split())
NO_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
#: Class and id names of what isn't the article: alone, or before or after one of NAME_PARTS.
NO_ARTICLE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead "
    "menu modal nav navbar navigation newsletter notice notices popup promo promos related share sharing sidebar social sponsor sponsored subscribe "
    "toolbar widget".split()
)
NAME_PARTS = frozenset("area bar block box button buttons container form global icons inner item items link links list page section site slot top unit wrap wrapper".split())
#: Elements that hold the article whatever their names say (classes like no-sidebar tell the layout).
NAMED_FREELY = frozenset("html body main article".split())
#: An open element of the first kind is closed by the start of one of the second.
CLOSED_BY = {
    "p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "option": {"option", "optgroup"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
}
#: A start tag doesn't close elements beyond one of these.
SCOPE = frozenset("table ul ol dl td th article section div body html blockquote main nav aside footer header form figure".split())

TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|!--(?:>|->|.*?(?:--!?>|\Z))|[!?/][^>]*+(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""(?i)(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Node:
    """An element with block children; ``texts`` are the blocks of text it holds,
    ``most`` the largest number of them that one of the merged pages has."""

    __slots__ = ("children", "count", "key", "most", "texts")

    def __init__(self, key: str, count: int = 1):
        self.key, self.count = key, count
        self.children: list[Node] = []
        self.texts: dict[str, int] = {}
        self.most = 0


class Block:
    __slots__ = ("article", "node", "skipped", "text")

    def __init__(self, node: Node, text: str, article: bool, skipped: bool):
        self.node, self.text, self.article, self.skipped = node, text, article, skipped


def _names_other(token: str) -> bool:
    parts = [x for x in re.split(r"[-_]+", token) if x]
    return not NO_ARTICLE_NAMES.isdisjoint(parts) and all(x in NO_ARTICLE_NAMES or x in NAME_PARTS or x.isdigit() for x in parts)


def _skips(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NO_ARTICLE or (tag == "header" and not in_article):
        return True
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "role" and value in NO_ARTICLE_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name in ("class", "id") and tag not in NAMED_FREELY and any(_names_other(token) for token in value.split()):
                return True
    return False


def _key(tag: str, attributes: str) -> str:
    if "class" not in attributes.lower():
        return tag
    names = [v for m in ATTRIBUTE.finditer(attributes) if m[1].lower() == "class" for v in (m[2] or m[3] or m[4] or "").split()]
    return ".".join([tag, *sorted(names)])


def parse(page: str) -> tuple[Node, list[Block]]:
    """The tree of block elements, and the blocks of text in page order."""
    root = Node("#root")
    # open elements: tag, node, skipped, in an article
    stack: list[tuple[str, Node, bool, bool]] = [("#root", root, False, False)]
    blocks: list[Block] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                _, node, skipped, article = stack[-1]
                blocks.append(Block(node, text, article, skipped))

    at, end, search = 0, len(page), TAG.search
    while at < end:
        m = search(page, at)
        if not m:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue  # a comment or declaration
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag in SPACE:
                held.append(" ")
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if tag in BLOCK:
                        flush()
                    del stack[k:]
                    break
                if stack[k][0] in SCOPE and tag not in BLOCK:
                    break
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if tag in VOID:
            if tag in BLOCK:
                flush()
            elif tag in SPACE:
                held.append(" ")
            continue
        if tag in SPACE:
            held.append(" ")
        if tag in BLOCK or tag in ("td", "th"):
            if tag in BLOCK:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if tag in CLOSED_BY.get(stack[k][0], ()):
                    del stack[k:]
                    break
                if stack[k][0] in SCOPE:
                    break
        _, parent, skipped, article = stack[-1]
        node = parent
        if tag in BLOCK:
            node = Node(_key(tag, attributes))
            parent.children.append(node)
        article = article or tag in ("article", "main")
        stack.append((tag, node, skipped or _skips(tag, attributes, article), article))
    flush()
    return root, blocks


def text_hash(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


Memo = dict[tuple[int, int], int]


def matching(a: Node, b: Node, memo: Memo | None = None) -> int:
    """Simple tree matching: the size of the largest order-keeping match of two trees.

    Trees may be of any depth: pairs of nodes are matched from the leaves up,
    on a stack, and each pair once.
    """
    memo = {} if memo is None else memo
    stack = [(a, b)]
    while stack:
        x, y = stack[-1]
        if (id(x), id(y)) in memo:
            stack.pop()
        elif x.key != y.key:
            memo[id(x), id(y)] = 0
        else:
            below = [(c, d) for c in x.children for d in y.children if c.key == d.key and (id(c), id(d)) not in memo]
            if below:
                stack += below
            else:
                memo[id(x), id(y)] = 1 + _aligned(x, y, memo)[-1][-1][0]
    return memo[id(a), id(b)]


def _aligned(a: Node, b: Node, memo: Memo) -> list[list[tuple[int, int]]]:
    """The table of the best matches of two nodes' children, whose own matches are known."""
    table = [[(0, 0)] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            up, left = table[i - 1][j][0], table[i][j - 1][0]
            both = memo[id(x), id(y)] if x.key == y.key else 0
            best = (table[i - 1][j - 1][0] + both, 2) if both else (-1, 2)
            table[i][j] = max(best, (up, 1), (left, 0))
    return table


def pairs(a: Node, b: Node, memo: Memo | None = None) -> list[tuple[Node | None, Node | None]]:
    """Children of two matched nodes in merged order, matched ones together."""
    if [x.key for x in a.children] == [y.key for y in b.children]:
        return list(zip(a.children, b.children, strict=True))
    memo = {} if memo is None else memo
    matching(a, b, memo)
    table, i, j, out = _aligned(a, b, memo), len(a.children), len(b.children), []
    while i or j:
        move = 0 if not i else 1 if not j else table[i][j][1]
        if move == 2:
            i, j = i - 1, j - 1
            out.append((a.children[i], b.children[j]))
        elif move == 1:
            i -= 1
            out.append((a.children[i], None))
        else:
            j -= 1
            out.append((None, b.children[j]))
    return out[::-1]


def _trim(texts: dict[str, int], room: int) -> dict[str, int]:
    """Misra-Gries: keep so many texts, take the next one's count off all."""
    if len(texts) <= room:
        return texts
    off = sorted(texts.values(), reverse=True)[room]
    return {k: n - off for k, n in texts.items() if n > off}


def merge(a: Node, b: Node) -> Node:
    """The wrapper of both; counts are added."""
    memo: Memo = {}
    whole = Node(a.key, a.count + b.count)
    stack = [(a, b, whole)]
    while stack:
        x, y, out = stack.pop()
        out.texts = dict(x.texts)
        for k, n in y.texts.items():
            out.texts[k] = out.texts.get(k, 0) + n
        out.most = max(n.most or len(n.texts) for n in (x, y))
        out.texts = _trim(out.texts, COUNTERS * max(1, out.most))
        for c, d in pairs(x, y, memo):
            if c and d:
                out.children.append(Node(c.key, c.count + d.count))
                stack.append((c, d, out.children[-1]))
            else:
                out.children.append(c or d)
    return pruned(whole)


def pruned(n: Node, room: int = NODES) -> Node:
    """Without the slots of the fewest pages, if there are more than ``room``: bounded however pages name their elements."""
    nodes = slots_of(n)
    if len(nodes) > room:
        least = sorted((x.count for x in nodes), reverse=True)[room]
        for x in nodes:
            x.children = [c for c in x.children if c.count > least]
    return n


def compact(node: Node) -> tuple[Node, dict[int, Node]]:
    """Merge runs of equal siblings; also where each node has gone."""
    gone: dict[int, Node] = {}
    out = Node(node.key)
    stack = [(out, node)]
    while stack:
        target, source = stack.pop()
        gone[id(source)] = target
        target.texts |= source.texts
        below = []
        for child in source.children:
            if target.children and target.children[-1].key == child.key:
                own = target.children[-1]
            else:
                # of a further source, children go to their likes
                own = next((c for c in target.children if c.key == child.key), None) if target.count > 1 else None
                if own is None:
                    own = Node(child.key)
                    target.children.append(own)
            below.append((own, child))
        target.count = 2
        stack += below[::-1]
    for n in slots_of(out):
        n.count = 1
    return out, gone


def tree_of(page: str) -> tuple[Node, list[tuple[Node, Block, str]]]:
    """A page's compact tree, its texts counted once, and its blocks with node and hash."""
    root, blocks = parse(page)
    hashed = [(b, text_hash(b.text)) for b in blocks]
    for b, h in hashed:
        b.node.texts[h] = 1
    tree, gone = compact(root)
    return tree, [(gone[id(b.node)], b, h) for b, h in hashed]


def dump(n: Node) -> list:
    """Flat, as trees may be deep: nodes before their children, with the number of these."""
    return [[x.key, x.count, x.texts, len(x.children), x.most] for x in slots_of(n)]


def load(rows: list) -> Node:
    root = Node("")
    stack = [(root, 1)]  # nodes that wait for so many children
    for key, count, texts, below, most in rows:
        parent, missing = stack.pop()
        n = Node(key, count)
        n.texts, n.most = texts, most
        parent.children.append(n)
        if missing > 1:
            stack.append((parent, missing - 1))
        if below:
            stack.append((n, below))
    return root.children[0]


def candidates(n: Node) -> Node:
    """The wrapper, now with the texts only that may be template."""
    for x in slots_of(n):
        x.texts = {k: c for k, c in x.texts.items() if c >= CANDIDATE_SHARE * x.count} if x.count >= LEAST_PAGES else {}
        x.most = 0
    return n


def slots_of(n: Node) -> list[Node]:
    """All nodes, each before its children: their places number the slots."""
    out, stack = [], [n]
    while stack:
        out.append(stack.pop())
        stack += out[-1].children[::-1]
    return out


def aligned(wrapper: Node, tree: Node) -> Iterator[tuple[Node, Node]]:
    """Slots of the wrapper with the nodes of a page's tree that they match."""
    memo: Memo = {}
    stack = [(wrapper, tree)]
    while stack:
        w, n = stack.pop()
        yield w, n
        stack += [(x, y) for x, y in pairs(w, n, memo) if x and y]


def constants(wrapper: Node, counts: dict[tuple[int, str], int]) -> Node:
    """The wrapper with template texts only, by exact (slot, text) counts; the text "" has the slot's pages."""
    for k, n in enumerate(slots_of(wrapper)):
        n.count = counts.get((k, ""), 0)
        found = {t: counts.get((k, t), 0) for t in n.texts} if n.count >= LEAST_PAGES else {}
        n.texts = {t: c for t, c in found.items() if c >= CONSTANT_SHARE * n.count}
    return wrapper


def _kept(blocks: list[tuple[Node, Block, str]]) -> list[tuple[Node, Block, str]]:
    """Blocks that aren't skipped, or all if the page has no other."""
    return [x for x in blocks if not x[1].skipped] or blocks


def main_text(page: str | None, wrapper: Node | None) -> str:
    """What the wrapper knows as template goes, inside a marked article too. Tags
    decide what is left open: varying texts in elements that never hold an article
    aren't content, nor is what lies outside a marked article. A marked article
    that would lose more than half of its characters is a near copy of others and
    stays whole; so does a page of which nothing would be left."""
    if not page:
        return ""
    tree, blocks = tree_of(page)
    template = {} if wrapper is None else {id(n): w.texts for w, n in aligned(wrapper, tree)}
    kept = _kept(blocks)
    marked = [x for x in kept if x[1].article]
    own = [b.text for _, b, _ in marked or kept]
    content = [b.text for n, b, h in marked or kept if h not in template.get(id(n), ())]
    if not content or marked and 2 * sum(map(len, content)) < sum(map(len, own)):
        content = own
    return "\n\n".join(content)


def host(url):
    """Lower-cased host of a URL column; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(found, F.lit(""))


def _joined(last: bool):
    """A function that merges the trees of a group, the largest first and then in the order
    of their contents, however they arrive; the last one keeps texts only that may be template."""

    def join(table: pa.Table) -> pa.Table:
        own = None
        for x in sorted(table["tree"].to_pylist(), key=lambda x: (-len(x), x)):
            tree = load(json.loads(x))
            own = tree if own is None else merge(own, tree)
        own = candidates(own) if last else own
        return pa.table({"host": table["host"][:1], "part": table["part"][:1], "tree": pa.array([json.dumps(dump(own), separators=(",", ":"))])})

    return join


def induce(df: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, wrapper): the template of every host whose pages have one."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 16 << 20):
                made, digests = [], []
                for p in part.column(1).to_pylist():
                    tree, blocks = tree_of(p or "")
                    made.append(json.dumps(dump(tree), separators=(",", ":")))
                    # pages of equal article texts are one
                    own = [h for _, _, h in _kept(blocks)]
                    digests.append(int.from_bytes(hashlib.blake2b("".join(own).encode(), digest_size=8).digest(), "little", signed=True))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.int64()), pa.array(made, pa.string())], names=["host", "digest", "tree"])

    own = df.select(host(F.col(url)).alias("host"), F.col(page).alias("page")).where("host IS NOT NULL AND page IS NOT NULL")
    pages = now = written(spread(own).mapInArrow(trees, "host string, digest long, tree string").groupBy("host", "digest").agg(F.min("tree").alias("tree")), "page-trees")
    most = now.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = 1
    while parts * PAGES_AT_ONCE < most:
        parts *= MERGED_AT_ONCE
    now = now.withColumn("part", F.pmod("digest", F.lit(parts)))
    while True:
        last = parts == 1
        now = written(now.groupBy("host", "part").applyInArrow(_joined(last), "host string, part long, tree string"), "wrappers")
        if last:
            return _counted(pages, now.select("host", F.col("tree").alias("wrapper")))
        parts //= MERGED_AT_ONCE
        now = now.withColumn("part", F.pmod("part", F.lit(parts)))


def _counted(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """The wrappers (host, wrapper) with the texts only that are template by an exact count over all page trees."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 16 << 20):
                known: dict[str, tuple[Node, dict[int, int]]] = {}
                counts: Counter = Counter()
                for own, tree, w in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if own not in known:
                        wrapper = load(json.loads(w))
                        known[own] = wrapper, {id(n): k for k, n in enumerate(slots_of(wrapper))}
                    wrapper, at = known[own]
                    for slot, n in aligned(wrapper, load(json.loads(tree))):
                        k = at[id(slot)]
                        counts[own, k, ""] += 1
                        counts.update((own, k, t) for t in slot.texts.keys() & n.texts.keys())
                columns = zip(*((*k, n) for k, n in counts.items()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["host", "slot", "text", "n"])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for own, w, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wrapper = constants(load(json.loads(w)), {(c["slot"], c["text"]): c["n"] for c in counts or ()})
                if any(n.texts for n in slots_of(wrapper)):  # without any the host has no template
                    made.append({"host": own, "wrapper": json.dumps(dump(wrapper), separators=(",", ":"))})
            yield pa.RecordBatch.from_pylist(made, pa.schema([("host", pa.string()), ("wrapper", pa.string())]))

    found = pages.select("host", "tree").join(wrappers, "host").mapInArrow(count, "host string, slot long, text string, n long")
    # of bounded size a host: the slots of its wrapper and their candidates
    found = found.groupBy("host", "slot", "text").agg(F.sum("n").alias("n")).groupBy("host").agg(F.collect_list(F.struct("slot", "text", "n")).alias("counts"))
    return written(wrappers.join(found, "host", "left").select("host", "wrapper", "counts").mapInArrow(final, "host string, wrapper string"), "templates")


def extract(df: DataFrame, *, url: str = "url", page: str = "html") -> DataFrame:
    """Add ``main_text``; the html is dropped. Wrappers are joined by host."""
    kept = [f for f in df.schema if f.name not in (page, "main_text")]
    rows = spread(df.select(*[f.name for f in kept], F.col(page).alias("__page"), host(F.col(url)).alias("__host")))
    wrappers = induce(df, url, page).select(F.col("host").alias("__of"), F.col("wrapper").alias("__wrapper"))
    rows = rows.join(wrappers, F.col("__host") == F.col("__of"), "left").select(*[f.name for f in kept], "__page", "__wrapper")
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Node | None] = {None: None}
        for batch in batches:
            for part in slices(batch, n, 16 << 20):
                made = []
                for p, w in zip(part.column(n).to_pylist(), part.column(n + 1).to_pylist(), strict=True):
                    if w not in known:
                        if len(known) > 1000:
                            known = {None: None}
                        known[w] = load(json.loads(w))
                    made.append(main_text(p, known[w]))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(made, pa.string())], names=[*part.schema.names[:n], "main_text"])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("main_text", T.StringType())]))
