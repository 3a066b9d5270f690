"""Column functions over text: cleaning, pieces, skeletons, page fields. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode strips it, and word characters, for regular expressions of Java and RE2.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"a-zA-Z0-9_\p{L}\p{N}"
MARKED = WORD + r"\x{300}-\x{36f}"
TOKEN = rf"[{MARKED}]+|[^{MARKED}{WS}]"
#: A token with the white space before it; pieces tile a text that ends without white space.
PIECE = rf"[{WS}]*(?:{TOKEN})"
IS_WORD = rf"^[{WORD}]"
MIDDLE_DOT = "‧"
INVISIBLE = "­​‌‍﻿"
ODD_SPACES = "      "
QUOTES = "\"“”„«»'‘’"
VOWELS = "aeiouyåäöæøẏ"
#: What a transcription's HTML hides, and its two kinds of notes.
HIDDEN = r'(?s)<span class="hidden"[^>]*>.*?</span></span>'
NOTES = (r'<sup[^>]*class="note"[^>]*>[^<]*</sup>', r'<sup[^>]*data-target="#not-[^"]*"[^>]*>[^<]*</sup>')
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))


def strip(c: Column) -> Column:
    """Without white space (any Unicode kind) at both ends."""
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+$", "")


def clean_text(c: Column) -> Column:
    """Ordinal and degree signs as spaces, runs of U+0020 as one, stripped; other white space stays."""
    return strip(F.regexp_replace(F.translate(c, "º°", "  "), "  +", " "))


def pieces(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(PIECE), 0)


def tokens_in(c: Column) -> Column:
    """The tokens alone, where their places don't matter."""
    return F.regexp_extract_all(c, F.lit(f"(?:{TOKEN})"), 0)


def token_of(piece: Column) -> Column:
    return F.regexp_replace(piece, rf"^[{WS}]+", "")


def starts_between(c: Column, first: str, last: str) -> Column:
    """Whether a string starts with an ASCII character from ``first`` to ``last``: a comparison of bytes."""
    return (c >= first) & (c < chr(ord(last) + 1))


def is_word(token: Column) -> Column:
    plain = starts_between(token, "a", "z") | starts_between(token, "A", "Z") | starts_between(token, "0", "9")
    return F.when(plain, True).otherwise(token.rlike(IS_WORD))


def consonant_skeleton(c: Column) -> Column:
    """Lower-cased letters that aren't vowels."""
    return F.regexp_replace(F.lower(c), rf"[^\p{{L}}]|[{VOWELS}]", "")


def html_clean(c: Column) -> Column:
    """Tags as spaces, entities decoded once in a fixed order (so double-coded ones come out), no quotes, single spaces."""
    c = F.regexp_replace(c, "<[^>]+>", " ")
    for coded, plain in ENTITIES:
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return strip(F.regexp_replace(F.translate(c, QUOTES, ""), f"[{WS}]+", " "))


def _plain(c: Column) -> Column:
    return F.translate(F.translate(c, INVISIBLE, ""), ODD_SPACES, " " * len(ODD_SPACES))


def transcription_clean(c: Column) -> Column:
    """Edition HTML as text: no hidden spans, notes, tags or parentheses; paragraphs stay apart."""
    for pattern in (HIDDEN, *NOTES):
        c = F.regexp_replace(c, pattern, "")
    c = F.replace(F.translate(c, "\r\n", "  "), F.lit("<p>"), F.lit("\n\n"))
    c = F.regexp_replace(F.replace(F.regexp_replace(c, "<[^>]+>", ""), F.lit(" *) "), F.lit(" ")), r"\([^)]*\)", "")
    c = F.translate(c, "[]", "")
    for coded, plain in ENTITIES[:3]:
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return strip(F.regexp_replace(_plain(c), " +", " "))


def corpus_clean(c: Column) -> Column:
    """Exported editions: no parentheses, brackets, ordinal signs, invisible or private characters; single spaces."""
    c = F.translate(F.regexp_replace(c, r"\([^)]*\)", ""), "[]", "")
    c = F.regexp_replace(_plain(F.translate(c, "º°", "  ")), r"[\x{e000}-\x{f8ff}]", "")
    return strip(F.regexp_replace(c, f"[{WS}]+", " "))


def extract_between(c: Column, start: str, end: str) -> Column:
    """What stands between the first ``start`` and the first ``end`` after it, stripped; empty if either is missing."""
    after = F.when(F.contains(c, F.lit(start)), F.substr(c, F.instr(c, start) + F.lit(len(start))))
    return F.coalesce(F.when(F.contains(after, F.lit(end)), strip(F.substr(after, F.lit(1), F.instr(after, end) - F.lit(1)))), F.lit(""))


def page_date(c: Column, start: str, end: str) -> Column:
    """A field whose links and first stray tag end are dropped."""
    c = F.regexp_replace(extract_between(c, start, end), "<a .*</a>", "")
    return html_clean(F.regexp_replace(c, r"^[^\n]*?>", ""))


def split_words(c: Column) -> Column:
    return F.array_remove(F.split(c, f"[{WS}]+"), "")


def lexicon_fraction(c: Column, lexicon: list[str]) -> Column:
    """Share of lower-cased words that are in the lexicon once closing marks are cut; 1 for a text without words."""
    words = split_words(F.lower(c))
    known = F.filter(words, lambda w: F.rtrim(w, F.lit(".,;:")).isin(*lexicon) if lexicon else F.lit(False))
    return F.when(F.size(words) == 0, 1.0).otherwise(F.size(known) / F.size(words))


def strip_bio(c: Column) -> Column:
    return F.when(F.startswith(c, F.lit("B-")) | F.startswith(c, F.lit("I-")), F.substr(c, F.lit(3))).otherwise(c)


def mapped_label(c: Column) -> Column:
    """Model labels: persons, places and organisations by name, others as they are."""
    return F.when(c == "PER", "Person").when(c == "LOC", "Location").when(c == "ORG", "Organization").otherwise(c)


def label_bucket(c: Column) -> Column:
    """Where a mapped label goes: entities, organisations apart, the rest."""
    return F.when(c.isin("Person", "Location"), "entities").when(c == "Organization", "org").otherwise("misc")


def drop_asterisks(c: Column) -> Column:
    """As a model's input: null as empty."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("*"), F.lit(""))


def numeric_order(c: Column) -> list[Column]:
    """To order ids by: numbers first and by size, then the rest as text."""
    return [c.try_cast("bigint").asc_nulls_last(), c]


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]", "_")


def perplexity(loss: Column) -> Column:
    return F.when(loss < 100, F.exp(loss)).otherwise(F.lit(float("inf")))
