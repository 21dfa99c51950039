"""A deterministic guess of a text's language: its script, and among languages of one script their profiles of letters."""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .samples import SAMPLES

# The codes that instructions may name, with their names; zh is Korean-only.
NAMES = {
    "en": "English", "es": "Spanish", "pt": "Portuguese", "ar": "Arabic", "hi": "Hindi", "fr": "French", "ru": "Russian", "de": "German", "ja": "Japanese", "it": "Italian", "bn": "Bengali", "uk": "Ukrainian", "th": "Thai", "ur": "Urdu", "ta": "Tamil", "te": "Telugu",
    "bg": "Bulgarian", "ko": "Korean", "pl": "Polish", "he": "Hebrew", "fa": "Persian", "vi": "Vietnamese", "ne": "Nepali", "sw": "Swahili", "kn": "Kannada", "mr": "Marathi", "gu": "Gujarati", "pa": "Punjabi", "ml": "Malayalam", "fi": "Finnish", "zh": "Chinese",
}
CODES_KO = list(NAMES)
CODES = CODES_KO[:-1]

#: Letters of each script; a text has the script of most of its letters, the first of several.
SCRIPTS = {
    "ko": "가-힣ㄱ-ㅣ", "ja": "぀-ヿ", "zh": "一-鿿", "th": "฀-๿", "he": "֐-׿", "arabic": "؀-ۿ", "devanagari": "ऀ-ॿ", "bn": "ঀ-৿", "pa": "਀-੿", "gu": "઀-૿",
    "ta": "஀-௿", "te": "ఀ-౿", "kn": "ಀ-೿", "ml": "ഀ-ൿ", "cyrillic": "Ѐ-ӿ", "latin": "A-Za-zÀ-ɏẠ-ỹ",
}
#: Languages that share a script, the first of them for a text without a known run of letters.
SHARED = {"latin": "en es pt fr de it pl vi sw fi".split(), "cyrillic": "ru uk bg".split(), "arabic": "ar ur fa".split(), "devanagari": "hi mr ne".split()}
#: Longest run of letters that is counted, and what is added to each count.
RUN, ADDED = 4, 0.5

NUMBER = {name: k for k, name in enumerate(SCRIPTS)}
_bounds = [(ord(a), ord(b), NUMBER[name]) for name, spec in SCRIPTS.items() for a, b in re.findall("(.)-(.)", spec)]
#: The script of each code point up to U+FFFF, and -1 for the others; none of the letters lies beyond.
SCRIPT_OF = np.full(0x10000, -1, np.int8)
for _a, _b, _k in _bounds:
    SCRIPT_OF[_a : _b + 1] = _k


def _points(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(points < 0x10000, points, 0)


def runs(points: np.ndarray, script: int) -> np.ndarray:
    """All runs of 1 to RUN code points of a text's words, each as one number. A word is a row of letters of the script, with a blank on either side."""
    inside = SCRIPT_OF[points] == script
    out = np.where(inside, points, 32).astype(np.uint64)
    blank = np.concatenate([[True], ~inside])
    padded = np.concatenate([[32], out]).astype(np.uint64)
    # Of blanks in a row one is left.
    padded = padded[~(blank & np.concatenate([[False], blank[:-1]]))]
    if padded[-1] != 32:
        padded = np.append(padded, np.uint64(32))
    made = []
    for n in range(1, RUN + 1):
        if len(padded) < n:
            break
        code = np.zeros(len(padded) - n + 1, np.uint64)
        for k in range(n):
            code = code << np.uint64(16) | padded[k : len(padded) - n + 1 + k]
        # A blank is a word's bound: it can't stand inside, nor alone.
        whole = np.ones(len(code), bool)
        for k in range(1, n - 1):
            whole &= padded[k : len(padded) - n + 1 + k] != 32
        made.append(code[whole & (code != 32)])
    return np.concatenate(made)


@cache
def profile(script: str) -> tuple[np.ndarray, np.ndarray]:
    """The runs that occur in the samples of a script's languages, and for each language its weights: thousandths of the
    logarithm of a run's share, with ADDED to its count."""
    counts = []
    for code in SHARED[script]:
        counts.append(Counter(runs(_points(SAMPLES[code].lower()), NUMBER[script]).tolist()))
    known = np.array(sorted(set().union(*counts)), np.uint64)
    n = np.array([[c[g] for g in known.tolist()] for c in counts], float)
    weights = np.round(1000 * np.log((n + ADDED) / (n.sum(1, keepdims=True) + ADDED * len(known))))
    return known, weights.astype(np.int64)


def guess(text: str | None) -> str | None:
    """A code, or None for a text without letters of a known script. Whole texts are counted; ties go to the first."""
    if not text:
        return None
    points = _points(text.lower())
    found = SCRIPT_OF[points]
    n = np.bincount(found[found >= 0], minlength=len(SCRIPTS))
    if not n.any():
        return None
    script = list(SCRIPTS)[int(n.argmax())]
    if script == "zh" and n[NUMBER["ja"]]:
        return "ja"
    if script not in SHARED:
        return script
    known, weights = profile(script)
    mine = runs(points, NUMBER[script])
    at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
    return SHARED[script][int(weights[:, at[known[at] == mine]].sum(1).argmax())]


def detect_each(texts: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else [guess(t) for t in x] for x in texts])


def detect(variants):
    """The guesses for an array of texts."""
    return F.pandas_udf(detect_each, T.ArrayType(T.StringType()))(variants)
