"""Names within one edit of each other: a universal automaton over sharded tries.

An edit is an insertion, deletion or substitution of one code point or an
exchange of two neighbours. Of names so near, either the first halves agree or
the second halves do (both without the code point in between, so that an
exchange across the middle is no exception). So the trie of distinct names is
cut into subtrees below the first half of each name and, with the names
reversed, below the second half; a query enters the subtrees of its own halves,
for each of the three lengths that a near name can have, and from there the
automaton runs over the rest.

The automaton is universal: its states are sets of positions relative to the
number of code points read, some waiting for the second half of an exchange,
and it reads which of three neighbouring code points of the query equal the
trie's. So its table is the same for all queries. Accepted names are verified
by their unrestricted distance.

Subtrees are dealt to tasks by a hash. Those of more names or queries than
``room`` are split into parts of both, and each pair of parts meets in one cell,
so none is larger than the room; nothing but the number of names goes to the
driver.

Defined results: names that are null or empty take no part; repeated names
count once; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import Scratch, buckets_for, written

#: Names or queries of a subtree that meet in one cell.
ROOM = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def form(name: Column) -> Column:
    """A-Z in lower case, without white space; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.translate(name, UPPER, LOWER), r"[\x20\x09-\x0D]", ""), F.lit(""))


def misspelt(name: Column, id_col: Column) -> Column:
    """Names whose id has an even CRC-32 h get two neighbouring code points exchanged,
    from place h mod (length - 1) on; one code point, or no id, stays as it is."""
    h, n = F.crc32(id_col.cast("string").cast("binary")), F.length(name)
    at = (F.when(n > 1, h % (n - 1))).cast("int")
    part = lambda start, size: F.substr(name, start, F.lit(size))
    swapped = F.concat(F.substr(name, F.lit(1), at), part(at + 2, 1), part(at + 1, 1), F.substr(name, at + 3))
    return F.when((h % 2 == 0) & (n > 1), swapped).otherwise(name)


class Universal:
    """States of the automaton for one edit, found as they are reached.

    A position is (offset to the code points read, edits, whether the second half
    of an exchange is awaited). Bits: whether the query's code points at offset
    -1, 0 and 1 equal the one read.
    """

    def __init__(self):
        self.sets = [frozenset({(0, 0, False)})]
        self.number = {self.sets[0]: 0}
        self.table: dict[tuple[int, int], int] = {}

    def step(self, state: int, bits: int) -> int:
        """The next state; -1 if none is left."""
        found = self.table.get((state, bits))
        if found is None:
            new = frozenset(p for q in self.sets[state] for p in self._from(q, bits))
            if not new:
                found = -1
            else:
                found = self.number.setdefault(new, len(self.sets))
                if found == len(self.sets):
                    self.sets.append(new)
            self.table[state, bits] = found
        return found

    @staticmethod
    def _from(position: tuple[int, int, bool], bits: int) -> Iterator[tuple[int, int, bool]]:
        offset, edits, awaits = position
        if awaits:
            if bits & 1:  # the code point that was passed over
                yield 0, 1, False
        elif bits >> offset + 1 & 1:
            yield offset, edits, False
        elif not edits:
            yield 0, 1, False  # substituted
            yield -1, 1, False  # inserted
            if bits & 4:
                yield 1, 1, False  # one deleted
                yield -1, 1, True  # exchanged, if the other follows

    def accepts(self, state: int, left: int) -> bool:
        """Whether a name ends here; ``left``: code points of the query beyond those read."""
        return any(not awaits and 0 <= left - offset <= 1 - edits for offset, edits, awaits in self.sets[state])


def grown(words: list[str]) -> dict:
    """A trie of nested tables; None holds the places of the words that end."""
    root: dict = {}
    for i, word in enumerate(words):
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node.setdefault(None, []).append(i)
    return root


def search(trie: dict, query: str, automaton: Universal) -> Iterator[int]:
    """Places of the trie's words within one edit of the query."""
    stack, size = [(trie, 0, 0)], len(query)
    while stack:
        node, read, state = stack.pop()
        near = query[max(0, read - 1) : read + 2]
        shift = 1 if read == 0 else 0
        for c, child in node.items():
            if c is None:
                if automaton.accepts(state, size - read):
                    yield from child
                continue
            bits = sum(1 << i + shift for i, x in enumerate(near) if x == c)
            after = automaton.step(state, bits)
            if after >= 0:
                stack.append((child, read + 1, after))


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: exchanged code points may be edited again."""
    far = len(a) + len(b)
    table = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        table[i + 1][1] = i
    for j in range(len(b) + 1):
        table[1][j + 1] = j
    row_of: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        column = 0
        for j, y in enumerate(b, 1):
            k, m = row_of.get(y, 0), column
            if x == y:
                column = j
            table[i + 1][j + 1] = min(
                table[i][j] + (x != y), table[i + 1][j] + 1, table[i][j + 1] + 1, table[k][m] + (i - k - 1) + 1 + (j - m - 1)
            )
        row_of[x] = i
    return table[-1][-1]


def _halves(name: Column, size: Column) -> Column:
    """The subtrees of names of this size: length, direction and half, as one text each."""
    first = F.floor((size - 1) / 2).cast("int")
    second = size - 1 - first
    tag = lambda side, half: F.concat(size.cast("string"), F.lit(side), half)
    last = F.when(second > 0, F.substr(name, F.greatest(F.length(name) - second + 1, F.lit(1)), second)).otherwise("")
    return F.array(tag("f", F.substr(name, F.lit(1), first)), tag("b", last))


def near_names(queries: DataFrame, names: DataFrame, name: str = "name", room: int = ROOM) -> DataFrame:
    """(query, name, distance 0 or 1): all pairs of distinct names within one edit."""
    spark, scratch = names.sparkSession, Scratch()
    some = lambda df: df.where(F.col(name) != "").select(F.col(name).alias("name")).distinct()
    size = F.length("name")
    kept = some(names).select("name", F.explode(_halves(F.col("name"), size)).alias("key"))
    sizes = F.filter(F.array(size - 1, size, size + 1), lambda n: n > 0)
    asked = some(queries).select("name", F.explode(sizes).alias("n")).select("name", F.explode(_halves(F.col("name"), F.col("n"))).alias("key"))
    kept, asked = scratch(kept, "names"), scratch(asked, "queries")
    parts = lambda df, n: df.groupBy("key").agg(F.ceil(F.count("*") / room).cast("int").alias(n)).where(F.col(n) > 1)
    large = scratch(parts(kept, "of").join(parts(asked, "askers"), "key", "full").select("key", *[F.coalesce(c, F.lit(1)).alias(c) for c in ("of", "askers")]), "large")
    if large.isEmpty():
        one = F.array(F.lit(0))
        kept, asked = (df.withColumns({"own": F.lit(0), "other": F.explode(one)}) for df in (kept, asked))
    else:
        def split(df: DataFrame, own: str, other: str) -> DataFrame:
            df = df.join(large.select("key", F.col(own).alias("__own"), F.col(other).alias("__other")), "key", "left")
            part = F.pmod(F.xxhash64("name"), F.coalesce("__own", F.lit(1)))
            return df.select("name", "key", part.cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.coalesce("__other", F.lit(1)) - 1)).alias("other"))

        kept, asked = split(kept, "of", "askers"), split(asked, "askers", "of")
    cells = buckets_for(spark, kept.count())
    cell = lambda own, other: F.concat_ws("\x00", "key", own, other)
    deal = lambda df, own, other: df.select("name", cell(own, other).alias("cell")).withColumn("shard", F.pmod(F.xxhash64("cell"), F.lit(cells)))
    kept, asked = deal(kept, "own", "other"), deal(asked, "other", "own")

    def match(ask: pa.Table, own: pa.Table) -> pa.Table:
        automaton, by, found = Universal(), {}, {"query": [], "name": [], "distance": []}
        wanted = set(ask["cell"].to_pylist())
        for word, key in zip(own["name"].to_pylist(), own["cell"].to_pylist(), strict=True):
            if key in wanted:
                by.setdefault(key, []).append(word)
        tries: dict = {}
        for query, key in zip(ask["name"].to_pylist(), ask["cell"].to_pylist(), strict=True):
            words = by.get(key)
            if not words:
                continue
            at = next(i for i, c in enumerate(key) if c in "fb")  # behind the length
            n, forward = int(key[:at]), key[at] == "f"
            first = (n - 1) // 2
            skip = first if forward else n - 1 - first
            turned = query if forward else query[::-1]
            if key not in tries:
                tries[key] = grown([(w if forward else w[::-1])[skip:] for w in words])
            for i in search(tries[key], turned[skip:], automaton):
                if not forward and words[i][:first] == query[:first]:
                    continue  # the first halves have found it
                if (d := distance(query, words[i])) <= 1:
                    found["query"].append(query)
                    found["name"].append(words[i])
                    found["distance"].append(d)
        return pa.table(found, pa.schema([("query", pa.string()), ("name", pa.string()), ("distance", pa.int32())]))

    pairs = asked.groupBy("shard").cogroup(kept.groupBy("shard")).applyInArrow(match, "query string, name string, distance int")
    out = written(pairs, "pairs")
    scratch.remove()
    return out


def joined(vendors: DataFrame, clients: DataFrame) -> DataFrame:
    """(vendor_id, distance, n_clients, first_client_id, clients_crc) of all pairs of a
    vendor (vendor_id, name) and a client (client_id, name) whose forms are within one
    edit, the vendors' names misspelt first.

    Repeated rows are pairs of their own. A client without id counts, but adds no id and no CRC.
    """
    crc = F.crc32(F.col("client_id").cast("string").cast("binary"))
    own = clients.select(form(F.col("name")).alias("name"), "client_id").where("name IS NOT NULL")
    own = own.groupBy("name").agg(F.count("*").alias("n"), F.min("client_id").alias("first"), F.sum(F.coalesce(crc, F.lit(0))).alias("crc"))
    sellers = vendors.select("vendor_id", form(misspelt(F.col("name"), F.col("vendor_id"))).alias("query")).where("query IS NOT NULL")
    scratch = Scratch()
    own, sellers = scratch(own, "clients"), scratch(sellers, "vendors")
    pairs = near_names(sellers.select(F.col("query").alias("name")), own)
    sums = pairs.join(own, "name").groupBy("query", "distance").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("crc").alias("crc"))
    out = sellers.join(sums, "query").groupBy("vendor_id", "distance").agg(
        F.sum("n").alias("n_clients"), F.min("first").alias("first_client_id"), F.sum("crc").alias("clients_crc")
    )
    return out
