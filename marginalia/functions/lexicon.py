"""Predicates over words; word lists are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import starts_between

#: Roman numerals with an optional ordinal, endings of patronymics (two variants), letters of place names.
ROMAN = "(?i)^[ivxlcdm]+(primo|secundo|tercio|quarto|quinto|sexto|septimo|octauo|nono)?$"
PATRONYMIC = "(s?son|s?sons|dotter|dottir|dottor|dottær|dottærs)$"
PATRONYMIC_VOTING = "(?i)(s?son|s?sons|dott[eä]r|dottir|dottor|dottærs?)$"
PLACE_LETTERS = "a-zA-ZåäöæøþðẏÅÄÖÆØ"


def is_roman(word: Column) -> Column:
    return word.rlike(ROMAN)


def is_capitalised(word: Column) -> Column:
    return F.when(starts_between(word, "A", "Z"), True).when(word < "\x80", False).otherwise(word.rlike(r"^\p{IsUppercase}"))


def is_patronymic(word: Column) -> Column:
    return _may_be_patronymic(F.lower(word)) & F.lower(word).rlike(PATRONYMIC)


def _may_be_patronymic(low: Column) -> Column:
    """What every patronymic has in it: cheap to look for in words that are none."""
    return F.contains(low, F.lit("son")) | F.contains(low, F.lit("dott"))


def continues_person(word: Column) -> Column:
    return _may_be_patronymic(F.lower(word)) & word.rlike(PATRONYMIC_VOTING)


def is_place_word(word: Column) -> Column:
    """Fit for a place list: no bracket or dots in front, not only digits and dashes, three letters at least."""
    letters = F.length(F.regexp_replace(word, f"[^{PLACE_LETTERS}]", ""))
    return (word != "") & ~word.rlike(r"^[(\[]|^\.\.\.") & ~word.rlike(r"^[\p{Nd}–:°.-]+$") & (letters >= 3)


def stop_reason(word: Column, first: list[str], second: list[str], names: tuple[str, str]) -> Column:
    """The list that holds the lower-cased word, roman_numeral, or null."""
    low = F.lower(word)
    return F.when(low.isin(*first), names[0]).when(low.isin(*second), names[1]).when(is_roman(word), "roman_numeral")
