"""BPE encoding and decoding with a public word-end vocabulary.

The merges of a word are applied with a priority queue of merge ranks over a
doubly linked list of symbols; entries whose symbols have changed since they
were queued are skipped. Decoding concatenates vocabulary strings.

Defined results: a null text is taken as empty; an empty text has no tokens and
decodes to the empty string; a text of any length is encoded whole; repeated
rows give repeated results; an empty table gives an empty table. Columns
``ids`` and ``decoded`` that the input already has are replaced.
"""

from __future__ import annotations

import gc
import heapq
import json
import threading
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .support import give_back, spread, texts_to_batches

#: Characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Python's str.split() also splits at these four, which are not White_Space.
SEPARATORS = regex.compile("[\x1c-\x1f]")
# What separates Unicode 16, which the tokenizers library knows, from
# the tables here. Code points that became letters or numbers later, so are neither:
LATER_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A "
    "11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 "
    "1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E "
    "2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
# Lower case of capitals that Python's table may not have yet:
LOWER = (
    {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
    | {c: c + 32 for c in range(0x10D50, 0x10D66)}
    | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}
)
# Marks younger than the library's normaliser (Unicode 9), which neither reorders nor composes them:
LATER_MARKS = (
    "07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 "
    "1133B 1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE "
    "1E2EC-1E2EF 1E4EC-1E4EF"
)


def _set(ranges: str) -> str:
    """A character set of a pattern from ranges of code points."""
    return "[" + "".join("-".join(rf"\U{int(x, 16):08X}" for x in r.split("-")) for r in ranges.split()) + "]"


#: All of those code points lie above this one.
LAST_PLAIN = "\u0557"
_UNKNOWN = regex.compile(f"({_set(LATER_MARKS)}+)")


def composed(text: str) -> str:
    """NFC by the library's tables: what lies between unknown marks is composed by itself."""
    if not _UNKNOWN.search(text):
        return unicodedata.normalize("NFC", text)
    return "".join([part if k % 2 else unicodedata.normalize("NFC", part) for k, part in enumerate(_UNKNOWN.split(text))])


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself if printable, else the next free code point from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder of one vocabulary file (normaliser: NFC, white space, lower case)."""

    def __init__(self, path: str, cache_entries: int = 180_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*vocab.items(), *self.special.items()]}
        #: For a pair of symbols (packed): the rank of its merge and the merged symbol (packed).
        self.merges = {vocab[a] << 20 | vocab[b]: r << 20 | vocab[a + b] for r, (a, b) in enumerate(model["merges"])}
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + end] for c in letters]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace(r"\s", WHITE_SPACE)
        self.words = regex.compile(pattern)
        for name, later in (("L", LATER_LETTERS), ("N", LATER_NUMBERS)):
            pattern = pattern.replace(rf"\p{{{name}}}", rf"[\p{{{name}}}--{_set(later)}]")
        self.pinned_words = regex.compile(pattern, regex.V1)
        self.blank = regex.compile(f"[{WHITE_SPACE}]+")
        self.marks = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        #: Results of runs without white space and of normal words (a word's own run has the
        #: same), in two generations: when the newer is full it becomes the older, so memory is bounded.
        self.chunks: dict[str, tuple[bytes, str]] = {}
        self.older_chunks: dict[str, tuple[bytes, str]] = {}
        self.cache_entries = cache_entries
        self.used: object = None

    def merge(self, word: bytes) -> list[int]:
        """Apply merges lowest rank first, leftmost first among equal ranks."""
        inner = self.inner
        symbols = [inner[b] for b in word]
        symbols[-1] = self.last[word[-1]]
        n = len(symbols)
        if n == 1:
            return symbols
        get = self.merges.get
        queue = []  # entries: rank, then place
        for i in range(n - 1):
            m = get(symbols[i] << 20 | symbols[i + 1])
            if m is not None:
                queue.append(m >> 20 << 32 | i)
        if not queue:
            return symbols
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if symbols[i] < 0 or j == n:
                continue  # stale: merged into its left neighbour, or now the last
            m = get(symbols[i] << 20 | symbols[j])
            if m is None or m >> 20 != entry >> 32:
                continue  # stale: one of the two symbols has changed
            symbols[i] = own = m & 0xFFFFF
            symbols[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                m = get(own << 20 | symbols[k])
                if m is not None:
                    push(queue, m >> 20 << 32 | i)
            h = before[i]
            if h >= 0:
                m = get(symbols[h] << 20 | own)
                if m is not None:
                    push(queue, m >> 20 << 32 | h)
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> tuple[bytes, str]:
        ids = self.merge(word.encode())
        strings = self.strings
        return array("i", ids).tobytes(), " ".join([strings[i] for i in ids])

    def keep(self, text: str, found: tuple[bytes, str]) -> None:
        if len(text) <= 64:
            if len(self.chunks) >= self.cache_entries:
                self.chunks, self.older_chunks = {}, self.chunks
            self.chunks[text] = found

    def chunk(self, raw: str) -> tuple[bytes, str]:
        """Ids (as 32-bit integers) and vocabulary strings of a run without white space."""
        found = self.older_chunks.get(raw)
        if found is None:
            words = self.words
            if raw.isascii():
                text = raw.lower()
            elif max(raw) <= LAST_PLAIN:
                text = "".join(map(str.lower, unicodedata.normalize("NFC", raw)))
            else:
                text, words = "".join(map(str.lower, composed(raw))).translate(LOWER), self.pinned_words
            done = []
            for word in (text,) if text.isascii() and text.isalpha() else words.findall(text):
                own = self.chunks.get(word) or self.older_chunks.get(word)
                if own is None:
                    own = self.word(word)
                    self.keep(word, own)
                done.append(own)
            found = done[0] if len(done) == 1 else (b"".join([i for i, _ in done]), " ".join([s for _, s in done]))
        self.keep(raw, found)
        return found

    def parts(self, text: str) -> list[tuple[bytes, str]]:
        pieces = self.blank.split(text) if SEPARATORS.search(text) else text.split()
        chunk = self.chunk
        return [self.chunks.get(p) or chunk(p) for p in pieces if p]

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Ids as the bytes of 32-bit integers, and the decoded text."""
        if not text:
            return b"", ""
        if self.marks is None or "<|" not in text:
            found = self.parts(text)
        else:
            found, at = [], 0
            for m in self.marks.finditer(text):
                found += self.parts(text[at : m.start()])
                found.append((array("i", [self.special[m[0]]]).tobytes(), m[0]))
                at = m.end()
            found += self.parts(text[at:])
        return b"".join([i for i, _ in found]), " ".join([s for _, s in found if s])

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.strings[i] for i in ids)


#: One encoder and cache for each Python worker, emptied when it has had nothing to do for so many seconds.
_LOADED: dict[str, WordBpe] = {}
IDLE_SECONDS = 3.0


def encoder(path: str) -> WordBpe:
    if path not in _LOADED:
        gc.set_threshold(100_000, 50, 100)  # the caches hold no cycles; scanning them often is slow
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def forget_when_idle(own: WordBpe) -> None:
    """Workers outlive their stage: the caches of one that has become idle would stay."""
    at = own.used = object()

    def check() -> None:
        if own.used is at:
            own.chunks, own.older_chunks = {}, {}
            give_back()

    timer = threading.Timer(IDLE_SECONDS, check)
    timer.daemon = True
    timer.start()


def encode_decode(df: DataFrame, vocab_path: str, text: str = "text") -> DataFrame:
    """Replace ``text`` by ``ids`` (array<int>) and ``decoded``: one narrow pass.

    ``vocab_path`` must be readable on every executor, as an installed package's
    file is.
    """
    df = df.drop(*[c for c in ("ids", "decoded") if c in df.columns and c != text])

    def make(texts: list) -> list[pa.Array]:
        import numpy as np

        own = encoder(vocab_path)
        own.used = None
        done = [own.encode(t) for t in texts]
        ends = np.cumsum([0, *(len(b) // 4 for b, _ in done)])
        ids = np.frombuffer(b"".join([b for b, _ in done]), dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), pa.array([s for _, s in done], pa.string())]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from texts_to_batches(rows, text, make, ["ids", "decoded"], 4 << 20)
        forget_when_idle(encoder(vocab_path))

    fields = [f for f in df.schema if f.name != text]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return spread(df).mapInArrow(run, schema)
