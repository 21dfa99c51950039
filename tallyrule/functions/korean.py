"""Korean register and rephrasing."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sentences import split_sentences
from .text import S, W, strip

# Endings and words of polite and of plain speech.
FORMAL = {
    "declarative": ["습니다$", "ㅂ니다$", "입니다$", "합니다$", "됩니다$", "있습니다$", "없습니다$", "갑니다$", "옵니다$", "같습니다$", "겠습니다$", "드립니다$", "받습니다$", "하겠습니다$", "이겠습니다$", "아니습니다$"],
    "interrogative": [r"습니까\?$", r"ㅂ니까\?$", r"입니까\?$", r"합니까\?$", r"있습니까\?$", r"없습니까\?$", r"갑니까\?$", r"옵니까\?$", r"같습니까\?$", r"겠습니까\?$", r"드릴까요\?$", r"드립니까\?$", r"하시겠습니까\?$", r"이십니까\?$", r"계십니까\?$"],
    "imperative": ["하세요$", "하십시오$", "해주세요$", "해주십시오$", "가세요$", "가십시오$", "오세요$", "오십시오$", "드세요$", "드십시오$", "받으세요$", "받으십시오$", "보세요$", "보십시오$", "말씀해주세요$", "말씀하세요$", "주무세요$", "주무십시오$"],
    "propositive": ["합시다$", "갑시다$", "가겠습니다$", "하겠습니다$", "드리겠습니다$", "해보겠습니다$"],
    "exclamatory": ["군요!$", "네요!$", "습니다!$", "ㅂ니다!$"],
}
INFORMAL = {
    "declarative": ["한다$", "한다.$", "다$", "다.$", "야$", "이야$", "어$", "아$", "지$", "네$", "거야$", "이거든$", "이지$", "거든$", "거지$", "잖아$", "해$", "가$", "와$", "와.$", "간다$", "온다$", "있어$", "없어$"],
    "interrogative": [r"[니냐]\?$", r"어\?$", r"아\?$", r"지\?$", r"야\?$", r"거야\?$", r"거니\?$", r"나\?$", r"까\?$", r"을까\?$", r"갈까\?$", r"할까\?$", r"뭐야\?$", r"뭐\?$"],
    "imperative": ["해$", "가$", "와$", "봐$", "줘$", "도$", "말아$", "하지마$", "가지마$", "오지마$", "먹어$", "자$"],
    "propositive": ["하자$", "가자$", "자자$", "해보자$"],
}
HONORIFIC = ["께서", "이십니다", "하십니다", "하시는", "하신", "하실", "계십니다", "계시는", "계신", "계실", "주십시오", "주세요", "드립니다", "드리는", "드린", "드릴", "말씀", "여쭤", "여쭙", "모십니다", "모시는", "모신", "모실", "진지", "댁", "따님", "아드님", "영감", "할머님", "할아버님"]

# What confirms a request, how confirmations end, and what is no confirmation.
CONFIRM = {
    "inquiry": [r"문의[를하]?\s*(?:주셨|하셨)", r"질문[을를]?\s*(?:주셨|하셨)", r"궁금[하해]\s*(?:하신|하시는)", r"알고\s*싶[어으]\s*(?:하신|하시는)", r"[을를가]\s*(?:문의|질문)[하해]\s*(?:주셨|셨)", r"(?:에\s*대해서?|관련해서?|대하여)\s*(?:문의|질문|궁금)", r"(?:문의|질문)\s*(?:사항|내용)", r"[이가]\s*궁금[하해]"],
    "request": [r"요청[을를]?\s*(?:주셨|하셨)", r"부탁[을를]?\s*(?:드렸|하셨)", r"[해하]달라고\s*(?:하셨|요청)", r"[을를가]\s*(?:요청|부탁)[하해]\s*(?:주셨|셨)", r"도움[을를]?\s*(?:요청|부탁)", r"[을를가]\s*원[하해]\s*(?:신다|십니다)", r"[을를가]\s*희망[하해]\s*(?:신다|십니다)"],
    "verification": [r"확인[을를]?\s*(?:요청|부탁|원[하해])", r"[을를가]\s*확인[하해]\s*(?:주셨|달라)", r"점검[을를]?\s*(?:요청|부탁)", r"검토[를을]?\s*(?:요청|부탁)", r"체크[를을]?\s*(?:요청|부탁)"],
    "information": [r"정보[를을]?\s*(?:요청|문의)", r"[을를가]\s*알려\s*(?:주셨|달라)", r"설명[을를]?\s*(?:요청|부탁)", r"안내[를을]?\s*(?:요청|부탁)", r"[에대에서]\s*대한?\s*(?:정보|내용|설명)", r"[은는이가]\s*어떤지\s*(?:문의|질문)"],
    "status": [r"상태[를을]?\s*(?:확인|문의)", r"현황[을를]?\s*(?:확인|문의)", r"진행\s*(?:상황|상태)[을를]?\s*(?:확인|문의)", r"[이가]\s*어떻게\s*(?:되는지|진행)", r"언제\s*(?:가능|될지|되는지)\s*(?:문의|질문)"],
}
CONFIRM_ENDINGS = [r"(?:문의|질문)[을를]?\s*(?:주셨습니다|하셨네요|드리셨네요)", r"(?:요청|부탁)[을를]?\s*(?:주셨습니다|하셨네요|드리셨네요)", r"(?:에\s*대해|관련해서?)\s*(?:문의|질문|궁금해)", r"[을를가]\s*(?:말씀|언급)[하해]?\s*(?:주셨|셨)", r"(?:라고|하고)\s*(?:하셨|말씀하셨)", r"(?:인지|는지)\s*(?:문의|질문|궁금)", r"(?:습니다|네요|군요|요)\.?$"]
NO_CONFIRM = [r"^(?:네|예|안녕|감사)", r"^(?:죄송|미안)", r"(?:답변|대답)[을를]?\s*(?:드리|해)", r"(?:설명|안내)[을를]?\s*(?:드리|해)", r"^(?:그렇|맞|틀)"]
PARTICLES = "[은는이가을를에서의와과도로부터까지만]"


def add_patterns(formal: dict[str, list[str]] | None = None, informal: dict[str, list[str]] | None = None, honorific: list[str] | None = None, confirm: dict[str, list[str]] | None = None) -> None:
    """Adds patterns to the sets that the registry's rules read, by kind of sentence or of request; a kind that is new is made."""
    for known, more in ((FORMAL, formal), (INFORMAL, informal), (CONFIRM, confirm)):
        for kind, patterns in (more or {}).items():
            known.setdefault(kind, []).extend(p for p in patterns if p not in known.get(kind, []))
    HONORIFIC.extend(w for w in honorific or [] if w not in HONORIFIC)


def confirmations() -> list[str]:
    """All patterns that confirm a request: those of each kind, then the endings."""
    return [*(p for kind in CONFIRM.values() for p in kind), *CONFIRM_ENDINGS]


def formal_text(x: Column, formal: list[str] | None = None, informal: list[str] | None = None) -> Column:
    """Every sentence of two characters or more is polite or neutral, and at least one is polite.

    formal, informal: patterns in place of the registered sets, which are read when the column is made."""
    formal = [p for kind in FORMAL.values() for p in kind] if formal is None else formal
    informal = [p for kind in INFORMAL.values() for p in kind] if informal is None else informal
    clean = F.regexp_replace(F.regexp_replace(strip(x), f"{S}+", " "), r"[^\p{L}\p{N}_\x20가-힣ㄱ-ㅎㅏ-ㅣ.!?~]", "")
    sentences = F.filter(split_sentences(clean, korean=True), lambda s: F.length(s) >= 2)
    polite = "(?d)" + "|".join([*formal, *HONORIFIC])
    plain = "(?d)" + "|".join(informal)
    return F.exists(sentences, lambda s: s.rlike(polite)) & ~F.exists(sentences, lambda s: ~s.rlike(polite) & s.rlike(plain))


def normalized(text: str) -> str:
    text = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text.lower()))
    return re.sub(r"\s*([.!?,:;])\s*", r"\1 ", text).strip()


def keywords(text: str) -> set[str]:
    """Words between white space, marks included, of two characters or more without a particle at their end; numbers left out."""
    stems = (re.sub(rf"{PARTICLES}\Z", "", w) for w in text.split())
    return {w for w in stems if len(w) >= 2 and not re.fullmatch("[0-9]+", w)}


def keyword_set(x: Column) -> Column:
    """keywords as a column."""
    stems = F.transform(F.split(x, f"{S}+", -1), lambda w: F.regexp_replace(w, rf"{PARTICLES}\z", ""))
    return F.array_distinct(F.filter(stems, lambda w: (F.length(w) >= 2) & ~w.rlike(r"^[0-9]+\z")))


def similarity(a: str, b: str) -> float:
    """1 if the shorter is part of the longer; else 0.7 of the shared keywords and 0.3 of the matching characters."""
    short, long = sorted((a, b), key=len)
    if short in long:
        return 1.0
    x, y = keywords(a), keywords(b)
    if not x or not y:
        return 0.0
    return 0.7 * len(x & y) / min(len(x), len(y)) + 0.3 * difflib.SequenceMatcher(None, a, b).ratio()


#: The least likeness of a rephrasing.
LIKE = 0.4


def confirms(text: str | None, prompt: str | None, least: float = LIKE) -> bool:
    """Whether a text's first line confirms the request in prompt."""
    first = (text or "").strip().split("\n")[0].lower()
    if not first or not prompt:
        return False
    first, prompt = normalized(first), normalized(prompt)
    if any(re.search(p, first) for p in NO_CONFIRM) or not any(re.search(p, first) for p in confirmations()):
        return False
    return similarity(first, prompt) >= least


def normalized_column(x: Column) -> Column:
    """normalized as a column."""
    composed = F.try_reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.lower(x), F.lit(True))
    spaced = F.regexp_replace(F.regexp_replace(composed, f"{S}+", " "), f"{S}*([.?!,:;]){S}*", "$1 ")
    return strip(spaced)


def first_line(x: Column) -> Column:
    return F.lower(F.substring_index(strip(x), "\n", 1))


def may_confirm(line: Column) -> Column:
    """Whether a normalised line reads like the confirmation of some request."""
    any_of = lambda patterns: "|".join(p.replace(r"\s", S) for p in patterns)
    return (line != "") & line.rlike("(?d)" + any_of(confirmations())) & ~line.rlike("(?d)" + any_of(NO_CONFIRM))


def alike_each(lines: pd.Series, prompts: pd.Series) -> pd.Series:
    """For each prompt whether each line is like it; nothing where either is missing."""
    one = lambda ls, p: [bool(x and p) and similarity(x, p) >= LIKE for x in ls]
    return pd.Series([None if ls is None else [one(ls, p) for p in ps] for ls, ps in zip(lines, prompts, strict=True)])


def confirming(texts: Column, prompts: Column) -> Column:
    """For each prompt whether each text's first line confirms it. Patterns are native; Python compares the lines that pass them."""
    lines = F.transform(texts, lambda t: normalized_column(first_line(t)))
    likely = F.transform(lines, lambda x: F.when(may_confirm(x), x))
    asked = F.when(F.exists(likely, lambda x: x.isNotNull()), likely)
    wanted = F.transform(prompts, lambda p: F.when(p != "", normalized_column(p)))
    alike = F.pandas_udf(alike_each, T.ArrayType(T.ArrayType(T.BooleanType())))(asked, wanted)
    return F.coalesce(alike, F.transform(prompts, lambda _: F.transform(texts, lambda _: F.lit(False))))
