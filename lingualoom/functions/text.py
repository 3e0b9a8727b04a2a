"""Text functions, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules of the annotation format.
CLOSING = (".", ",", "!", "?", ";", ":", "%", ")", "]", "}", "…")
CONTRACTIONS = ("n't", "'s", "'re", "'ve", "'ll", "'d", "'m")
OPENING = ("(", "[", "{", "“", "‘")
CURRENCY = ("$", "£", "€", "¥")
BOTH_SIDES = ("-", "/")
# Marks that may open a sentence: as tokens of their own, and in running text.
OPENING_TOKENS = ("\"", "'", "“", "‘", "(", "[", "{")
OPENING_MARKS = (*OPENING_TOKENS, ":")
PRONOUNS = tuple(
    "he she it they you we i me us him her them my mine your yours our ours his hers its their theirs "
    "myself yourself ourselves himself herself itself themselves".split()
)
CONTRACTION_SPLITS = (
    (r"\b[Cc]annot\b", "can not"),
    (r"\b[Gg]onna\b", "gon na"),
    (r"\b[Cc]an't\b", "ca n't"),
    (r"\b[Ww]on't\b", "wo n't"),
    (r"\b([A-Za-z]+)n't\b", "$1 n't"),
    (r"(?i)\b([A-Za-z]+)'(m|re|ve|ll|d|s)\b", "$1 '$2"),
)
TOKEN = r"(?U)\[\[TARGET_\d+\]\]|\w+|[^\w\s]"


def tokens(text: Column) -> Column:
    """Placeholders, words and single punctuation marks, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def lowered(array: Column) -> Column:
    return F.transform(array, F.lower)


def split_contractions(text: Column) -> Column:
    out = F.regexp_replace(text, "[‘’]", "'")
    for pattern, to in CONTRACTION_SPLITS:
        out = F.regexp_replace(out, f"(?U){pattern}", to)
    return out


def normal_tokens(text: Column) -> Column:
    return lowered(tokens(split_contractions(text)))


def letters_only(word: Column) -> Column:
    """Drop all outside a-z and 0-9, then lower-case: capitals are dropped too."""
    return F.lower(F.regexp_replace(word, "[^a-z0-9]", ""))


def starts_sentence(text: Column, at: Column) -> Column:
    """Whether position ``at`` (from 0) begins a sentence: before it, past opening
    marks and blanks, comes nothing or one of . ! ?"""
    marks = "".join("\\" + m if m in "([{\"'" else m for m in OPENING_MARKS)
    before = F.regexp_replace(F.substring(text, F.lit(1), at), rf"(?U)[\s{marks}]+$", "")
    return (before == "") | before.rlike("[.!?]$")


def starts_sentence_tokens(array: Column, at: Column) -> Column:
    """Whether only opening marks come before index ``at`` (from 0)."""
    return F.forall(F.slice(array, F.lit(1), at), lambda t: t.isin(*OPENING_TOKENS))


def cased(pronoun: Column, at_start: Column) -> Column:
    first = F.concat(F.upper(F.substring(pronoun, 1, 1)), F.substr(pronoun, F.lit(2)))
    return F.when(pronoun == "i", "I").when(at_start, first).otherwise(pronoun)


def leading_marks(word: Column) -> Column:
    return F.regexp_extract(word, r"(?U)^[^\w\s]+", 0)


def trailing_marks(word: Column) -> Column:
    return F.regexp_extract(word, r"(?U)[^\w\s]+$", 0)


def clean_replacement(cell: Column, normalize: bool = True) -> Column:
    """Empty becomes NA. With ``normalize`` each part loses edge marks (unless
    nothing else is in it) and is lower-cased unless it is all upper case."""
    value = F.trim(F.coalesce(cell, F.lit("")))
    if not normalize:
        return F.when(value == "", "NA").otherwise(value)

    def part(p: Column) -> Column:
        bare = F.regexp_replace(p, r"(?U)^[^\w]+|[^\w]+$", "")
        kept = F.when(bare == "", p).otherwise(bare)
        return F.when((kept == F.upper(kept)) & (kept != F.lower(kept)), kept).otherwise(F.lower(kept))

    return F.when(value.isin("", "NA"), "NA").otherwise(F.array_join(F.transform(F.split(value, r"\|"), part), "|"))


def allowed_pronouns(reply: Column, wanted: Column) -> Column:
    """Map of the wanted keys found in the reply (as they are, without brackets, or
    lower-cased) whose values, trimmed and lower-cased, are pronouns."""
    bare = lambda k: F.regexp_replace(k, r"^\[\[|\]\]$", "")
    found = lambda k: F.lower(F.trim(F.coalesce(F.try_element_at(reply, k), F.try_element_at(reply, bare(k)), F.try_element_at(reply, F.lower(bare(k))))))
    pairs = F.transform(wanted, lambda k: F.struct(k.alias("key"), found(k).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isin(*PRONOUNS)))


def chain_cell(ids: Column) -> Column:
    """Distinct chain ids in numeric order, joined by |; _ if there are none."""
    cell = F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform(ids, lambda x: x.cast("int")))), lambda x: x.cast("string")), "|")
    return F.when(F.coalesce(F.size(ids), F.lit(0)) <= 0, "_").otherwise(cell)


def without_fence(reply: Column) -> Column:
    """The JSON of a reply that may stand in a code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


#: Marks that join what stands left or right of them; quotes do so by turns.
_JOIN_LEFT = (*CLOSING, *CONTRACTIONS, "”", *BOTH_SIDES)
_JOIN_RIGHT = (*OPENING, *CURRENCY, *BOTH_SIDES)
_QUOTES = ('"', "'", "‘", "’")


def detokenize(text: Column) -> Column:
    """Undo the blanks between tokens; quotes open and close in turn.

    The turn is a fold over the quotes alone, so a text costs one step a token.
    """
    words = F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    flags = lambda left, right: F.struct(left.alias("left"), right.alias("right"))

    def turn(state: Column, q: Column) -> Column:
        word = q["word"]
        opens_single = ~state["single"] & ~F.coalesce(q["before"], F.lit("")).rlike("[sS]$")
        opens = F.when(word == '"', ~state["double"]).when(word == "'", opens_single).otherwise(word == "‘")
        double = F.when(word == '"', ~state["double"]).otherwise(state["double"])
        single = F.when(word == '"', state["single"]).otherwise(opens)
        mark = F.struct(q["at"].alias("at"), flags(~opens, opens).alias("joins"))
        return F.struct(double.alias("double"), single.alias("single"), F.concat(state["marks"], F.array(mark)).alias("marks"))

    placed = F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word"), F.get(words, i - 1).alias("before")))
    quotes = F.filter(placed, lambda q: q["word"].isin(*_QUOTES))
    none = F.array().cast("array<struct<at:int,joins:struct<left:boolean,right:boolean>>>")
    start = F.struct(F.lit(False).alias("double"), F.lit(False).alias("single"), none.alias("marks"))
    turns = F.aggregate(quotes, start, turn, lambda s: F.map_from_entries(s["marks"]))
    joins = F.transform(
        words, lambda w, i: F.when(w.isin(*_QUOTES), F.try_element_at(turns, i)).otherwise(flags(w.isin(*_JOIN_LEFT), w.isin(*_JOIN_RIGHT)))
    )
    # each is bound once: a lambda over an array of one
    bound = F.transform(F.array(F.struct(words.alias("words"), joins.alias("joins"))), _spaced)
    return F.when(text.isNotNull(), F.array_join(bound[0], ""))


def _spaced(x: Column) -> Column:
    """Words with a blank before those that nothing joins to the one before."""
    joined = lambda i: F.get(x["joins"], i)["left"] | F.get(x["joins"], i - 1)["right"]
    return F.transform(x["words"], lambda w, i: F.when((i == 0) | joined(i), w).otherwise(F.concat(F.lit(" "), w)))
