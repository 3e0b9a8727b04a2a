"""Plain Python for the queries that SQL doesn't express, over the smallest tables."""

import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq

DATA = "/root/testdata/sf0.001"
TOKEN = re.compile(r"\[\[TARGET_\d+\]\]|\w+|[^\w\s]")
PRONOUNS = {"the", "der", "la", "el", "le", "it", "he"}


def rows(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def ttest_p():
    groups = defaultdict(list)
    for r in rows("lineitem"):
        groups[r["l_returnflag"]].append(r["l_tax"] - 0.039)
    out = []
    for flag, x in groups.items():
        n, df = len(x), len(x) - 1
        t = np.mean(x) / (np.std(x, ddof=1) / math.sqrt(n))
        # T = sqrt(df) * tan(a): the density of a goes as cos(a)**(df - 1)
        a = np.linspace(math.atan(abs(t) / math.sqrt(df)), math.pi / 2, 400_001)
        scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
        out.append((flag, n, np.mean(x), t, df, 2 * scale * np.trapezoid(np.cos(a) ** (df - 1), a)))
    return out


def targets_masking():
    out = []
    for r in rows("documents"):
        words = TOKEN.findall(r["text"])
        chain = [w.lower() if len(w) >= 3 else None for w in words]
        starts = defaultdict(int)
        for k, c in enumerate(chain):
            if c and (k == 0 or chain[k - 1] != c):
                starts[c] += 1
        ends = [k + 1 for k, w in enumerate(words) if w == "."]
        for number, (a, b) in enumerate(zip([0, *ends], ends)):
            found, k = [], a
            while k < b:
                stop = k + 1
                while stop < b and chain[k] and chain[stop] == chain[k]:
                    stop += 1
                if chain[k] and starts[chain[k]] > 1 and chain[k] not in PRONOUNS:
                    text = " ".join(words[k:stop])
                    found.append((-len(text), k, text))
                k = stop
            masked, n = " ".join(words[a:b]), 0
            for i, phrase in enumerate(dict.fromkeys(t for *_, t in sorted(found))):
                if phrase in masked:
                    masked, n = masked.replace(phrase, f"[[TARGET_{i}]]"), n + 1
            out.append((r["doc_id"], number, masked, n))
    return out


def _runs(values):
    out, k = [], 0
    while k < len(values):
        stop = k + 1
        while stop < len(values) and values[stop] == values[k]:
            stop += 1
        if values[k] is not None:
            out.append((k, stop, values[k]))
        k = stop
    return out


def _windows(extend, size=8):
    out = []
    for r in rows("conversations"):
        words = TOKEN.findall(r["text"] or "")
        if not words:
            continue
        ids = [zlib.crc32(w.encode()) % 50000 for w in words]
        spans = {a: (b, text) for a, b, text in _runs([("they" if len(w) % 2 == 0 else "it") if re.match("[A-Z]", w) else None for w in words])}

        def pronoun(text, start):
            before = "".join(" " + w for w in words[max(0, start - 16) : start]).rstrip()
            while before and before[-1] in "\"'“‘([{:":
                before = before[:-1].rstrip()
            return 100000 + len(text) * 4 + 2 * (not before or before[-1] in ".!?") + (start == 0)

        def collapsed(s, t):
            made, i = [], s
            while i <= t:
                if i in spans and spans[i][0] <= t:
                    made.append(pronoun(spans[i][1], i))
                    i = spans[i][0]
                else:
                    made.append(ids[i])
                    i += 1
            return made

        total = sums = 0
        for t in range(len(words)):
            s = max(0, t + 1 - size)
            while extend and s > 0 and len(collapsed(s, t)) < size:
                s -= 1
            window = collapsed(s, t)[-size:]
            total, sums = total + len(window), sums + sum(window)
        out.append((f"{r['conv_id']}-{r['turn']}", len(words), total, sums))
    return out


def detokenized(text):
    out, glue, open_double, open_single = "", True, False, False
    words = text.split()
    for k, w in enumerate(words):
        left = w in ".,!?;:%)]}…”" or w in ("n't", "'s", "'re", "'ve", "'ll", "'d", "'m") or w in "-/"
        right = w in "([{“$£€¥" or w in "-/"
        if w == '"':
            left, right, open_double = open_double, not open_double, not open_double
        if w == "'":
            opening = not open_single and not (k and words[k - 1].lower().endswith("s"))
            left, right, open_single = not opening, opening, opening
        if w in ("‘", "’"):
            left, right, open_single = w == "’", w == "‘", w == "‘"
        out += ("" if glue or left else " ") + w
        glue = right
    return out


def detokenize():
    return [(r["conv_id"], r["turn"], detokenized(" ".join(TOKEN.findall(r["text"])))) for r in rows("conversations")]


def normal(text):
    text = re.sub("[‘’]", "'", text)
    for pattern, to in ((r"\b[Cc]annot\b", "can not"), (r"\b[Gg]onna\b", "gon na"), (r"\b[Cc]an't\b", "ca n't"), (r"\b[Ww]on't\b", "wo n't"), (r"\b([A-Za-z]+)n't\b", r"\1 n't"), (r"(?i)\b([A-Za-z]+)'(m|re|ve|ll|d|s)\b", r"\1 '\2")):
        text = re.sub(pattern, to, text)
    return [t.lower() for t in TOKEN.findall(text)]


def _stories():
    stories = defaultdict(list)
    for r in sorted(rows("conversations"), key=lambda r: (r["conv_id"], r["turn"])):
        if r["text"] is not None:
            stories[r["conv_id"]].append((r["turn"], r["text"]))
    return stories


def _annotated():
    """By story: (word, values), and the counts."""
    for story, turns in _stories().items():
        words = [w for _, text in turns for w in text.split()]
        values, counts, behind = [[] for _ in words], [0, 0, 0], 0
        stream = [(t, k) for k, w in enumerate(words) for t in normal(w)]
        for _, text in turns:
            own, pieces = normal(text), re.split(r"\s+", text)
            at = next((k for k in range(behind, len(stream) - len(own) + 1) if own and [t for t, _ in stream[k : k + len(own)]] == own), None)
            free = [True] * len(own)
            for phrase, pronoun in ((pieces[0], "they"), (pieces[-1], None)):
                p = normal(phrase)
                fits = [k for k in range(len(own) - len(p) + 1) if p and own[k : k + len(p)] == p and all(free[k : k + len(p)])]
                if at is None or not fits:
                    counts[2] += 1
                    continue
                k = fits[-1]
                free[k : k + len(p)] = [False] * len(p)
                covered = sorted({row for _, row in stream[at + k : at + k + len(p)]})
                value = "NOT_REPLACED"
                if pronoun:
                    first = all(t in ("'", '"', "(", "[", "{", "“", "‘") for t in own[:k])
                    value = re.match(r"[^\w\s]*", words[covered[0]])[0] + (pronoun.capitalize() if first else pronoun) + re.search(r"[^\w\s]*$", words[covered[-1]])[0]
                counts[0 if pronoun else 1] += 1
                for row in covered:
                    if value not in values[row]:
                        values[row].append(value)
            if at is not None:
                behind = at + len(own)
        yield story, words, values, counts


def annotate_story():
    return [(story, k + 1, "|".join(v) or "NA", *counts) for story, words, values, counts in _annotated() for k, v in enumerate(values)]


def annotation_outcomes():
    each = [(story, *counts) for story, words, _, counts in _annotated() if words]
    return [*each, (None, *(sum(x[k] for x in each) for k in (1, 2, 3)))]


def rendered_text():
    out = []
    for story, turns in _stories().items():
        for turn, text in turns:
            pieces, masked = re.split(r"\s+", text), text
            for k, phrase in enumerate(dict.fromkeys([pieces[0], pieces[-1]])):
                if phrase:
                    masked = masked.replace(phrase, f"[[TARGET_{k}]]")

            def pronoun(m, masked=masked):
                before = masked[: m.start()].rstrip()
                while before and before[-1] in "\"'“‘([{:":
                    before = before[:-1].rstrip()
                return "They" if not before or before[-1] in ".!?" else "they"

            out.append((story, turn, detokenized(re.sub(r"\[\[TARGET_0\]\]", pronoun, masked))))
    return out


BRUTE = {
    "ttest_p": ttest_p,
    "targets_masking": targets_masking,
    "pronoun_window_only": lambda: _windows(False),
    "pronoun_additional_context": lambda: _windows(True),
    "detokenize": detokenize,
    "annotate_story": annotate_story,
    "annotation_outcomes": annotation_outcomes,
    "rendered_text": rendered_text,
}
