"""Sentence splitting by rules, as a chain of native replacements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import D, S, blank, count, strip

# Abbreviations that don't end a sentence.
TITLES = "(?:Mr|St|Mrs|Ms|Dr)"
SITES = "(?:com|net|org|io|gov|edu|me)"
SUFFIXES = "(Inc|Ltd|Jr|Sr|Co)"
STARTERS = rf"(Mr|Mrs|Ms|Dr|Prof|Capt|Cpt|Lt|He{S}|She{S}|It{S}|They{S}|Their{S}|Our{S}|We{S}|But{S}|However{S}|That{S}|This{S}|Wherever)"
ACRONYMS = "([A-Z][.][A-Z][.](?:[A-Z][.])?)"
LATIN, MIXED, MARKERS = "([A-Za-z])", "([A-Za-z가-힣])", "([가나다라마바사])"


def split_sentences(x: Column, korean: bool = False) -> Column:
    """The sentences of a text, stripped; of empty ones only one at the end goes.

    Steps that are about a period look for it first, and behind it only there; texts without signs are replaced as such."""
    letter = MIXED if korean else LATIN
    # A period after one of these signs, which no earlier match of the same step has taken.
    after = lambda what: rf"[.](?<={what}[.])"
    steps: list[tuple[bool, str, str]] = [(True, "\n", " "), (False, rf"[.](?:(?<={TITLES}[.])|(?={SITES})|(?<=[0-9](?!\G)[.])([0-9]))", "<prd>$1")]
    steps += [(False, r"\.{2,}", "$0<stop>"), (False, r"\.(?=\.|<stop>)", "<prd>"), (True, "Ph.D.", "Ph<prd>D<prd>")]
    if not korean:
        steps += [(False, rf"(?=(?s:..)[.] ){S}{LATIN}[.] ", " $1<prd> "), (False, f"{ACRONYMS} {STARTERS}", "$1<stop> $2")]
    steps += [(False, f"{after(letter)}{letter}[.]{letter}[.]", "<prd>$2<prd>$3<prd>"), (False, f"{after(letter)}{letter}[.]", "<prd>$2<prd>")]
    if not korean:
        steps += [(False, f" {SUFFIXES}[.] {STARTERS}", " $1<stop> $2")]
    steps += [(False, after(f" (?:{SUFFIXES}|{LATIN})"), "<prd>")]
    if korean:
        steps += [(False, rf"(?=(?s:..)[.]){S}{LATIN}[.]{S}+(?=[가-힣])", " $1<prd> "), (False, rf"(?=(?s:..)[.]){S}{MARKERS}[.]{S}+", " $1<prd> ")]
    steps += [(True, ".”", "”."), (True, '."', '".'), (True, '!"', '"!'), (True, '?"', '"?'), (False, "[.?!]", "$0<stop>"), (True, "<prd>", ".")]
    text = F.concat(F.lit(" "), x, F.lit("  "))
    for plain, pattern, to in steps:
        text = F.replace(text, F.lit(pattern), F.lit(to)) if plain else F.regexp_replace(text, pattern, to)
    whole = lambda out: F.when(F.element_at(out, -1) == "", F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(out)
    return F.get(F.transform(F.array(F.transform(F.split(text, "<stop>", -1), strip)), whole), F.lit(0))


#: Abbreviations after which a period ends no sentence, and single letters; in any case.
ABBREVIATIONS = "mr mrs ms dr prof st jr sr rev gen col capt lt sgt gov sen rep hon vs etc e.g i.e cf al inc ltd co corp bros dept est fig no vol pp ed eds u.s u.k u.n a.m p.m ph.d jan feb mar apr jun jul aug sep sept oct nov dec".split()
CLOSING = "[\"'\u201d\u2019\u00bb)\\]}]*"


def count_sentences(x: Column) -> Column:
    """Number of sentences of an English text: ends are ?, ! and periods before white space.

    A period after an abbreviation or a single letter is no end; dots in a row are one only before a capital."""
    known = "|".join([*(a.replace(".", r"\.") for a in ABBREVIATIONS), r"\p{L}"])
    # Only at a mark is anything looked at behind it.
    end = rf"(?=[.?!])(?:[?!]{CLOSING}|\.{{2,}}{CLOSING}(?={S}+\p{{Lu}})|(?<!\.)(?<!(?:^|[^\p{{L}}\p{{N}}.])(?i:{known}))\.{CLOSING})(?={S}+[^\x00-\x20])"
    return F.when(blank(x), F.lit(0)).otherwise(count(strip(x), end) + 1).cast("long")


def first_sentence_key(x: Column) -> Column:
    """A sentence in lower case without quotes before it and marks behind it, each class in its turn."""
    out = F.lower(F.regexp_replace(F.regexp_replace(strip(x), r"\A'+", ""), r'\A"+', ""))
    for mark in (r"\.", ",", r"\?", "!", "'", '"'):
        out = F.regexp_replace(out, rf"{mark}+\z", "")
    return out


__all__ = ["D", "count_sentences", "first_sentence_key", "split_sentences"]
