"""The registry of verifiable instructions: what each accepts and how it is decided."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import korean, patterns as P, text as X
from ..functions.language import CODES, CODES_KO
from ..functions.sentences import count_sentences, first_sentence_key, split_sentences

TEXT_ARGS = "language relation section_spliter postscript_marker keyword first_word first_sentence prompt_to_repeat prompt_to_rephrase end_phrase letter let_relation capital_relation starter original_message original_paragraph".split()
NUMBER_ARGS = "num_sentences num_placeholders num_bullets num_digit_list num_highlights num_sections num_paragraphs nth_paragraph frequency num_words num_syllables let_frequency capital_frequency low high".split()
LIST_ARGS = "keywords key_sentences forbidden_words choices".split()
ARGS_SCHEMA = ", ".join([*(f"{a} string" for a in TEXT_ARGS), *(f"{a} double" for a in NUMBER_ARGS), *(f"{a} array<string>" for a in LIST_ARGS)])

#: Expected texts that Korean instructions bring into NFC.
NORMALISED = "keyword prompt_to_repeat end_phrase keywords key_sentences forbidden_words".split()

# Options that an instruction falls back on.
ANSWERS = {"en": ["My answer is yes.", "My answer is no.", "My answer is maybe."], "ko": ["제 답변은 예입니다.", "제 답변은 아니요입니다.", "제 답변은 아마도입니다."]}
ENDINGS = {"en": ["Any other questions?", "Is there anything else I can help with?"], "ko": ["다른 질문이 있나요?", "제가 도와드릴 수 있는 다른 것이 있나요?"]}
SPLITTERS = {"en": ["Section", "SECTION"], "ko": ["Section", "SECTION, 섹션"]}
POSTSCRIPTS = ["P.S.", "P.P.S"]
RELATIONS = {"en": ["less than", "at least"], "ko": ["less than", "at least", "equal to"]}
KEYWORDS = ["western", "sentence", "signal", "dump", "spot", "opposite", "bottom", "potato", "administration", "working"]


@dataclass(frozen=True)
class Context:
    """What a rule may use: args (a struct column), lang of the rule, a stable number of the row for defaults, and the
    instruction's patterns as compiled: (java, groups, reach) each."""

    args: Column
    lang: str
    draw: Column
    compiled: Column | None = None

    def __getitem__(self, name: str) -> Column:
        return self.args[name]

    def stripped(self, name: str) -> Column:
        return X.strip(self.args[name])

    def number(self, name: str, low: int, high: int) -> Column:
        """The argument; where it is missing or negative, a number from low to high that the row decides."""
        x = self.args[name]
        return F.when(x >= 0, x).otherwise((F.pmod(self.draw, F.lit(high - low + 1)) + low).cast("double"))

    def choice(self, options: list[str]) -> Column:
        return F.get(F.array(*map(F.lit, options)), F.pmod(self.draw, F.lit(len(options))).cast("int"))

    def related(self, name: str) -> Column:
        return F.coalesce(self.args[name], self.choice(RELATIONS[self.lang]))

    def relation(self, name: str, value: Column, least: Column) -> Column:
        r = self.related(name)
        out = F.when(r == "less than", value < least).when(r == "at least", value >= least)
        return out.when(r == "equal to", value == least) if self.lang == "ko" else out

    def relation_bad(self, name: str) -> Column:
        return self.args[name].isNotNull() & ~self.args[name].isin(RELATIONS[self.lang])


Rule = Callable[[Column, Column, Context], Column]


def nfc(x: Column) -> Column:
    """x in NFC; below U+0300 a text is that already."""
    composed = F.try_reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(False))
    return F.when(x.rlike(r"[^\x00-\x{2FF}]"), composed).otherwise(x)


@dataclass(frozen=True)
class Instruction:
    """rule(text, language, context) is true if the text complies; bad(context) if the arguments can't be used.

    patterns(context): the sources (see functions.patterns) that the rule finds in context.compiled; the instruction is
    fatal where one can't be compiled. parts(part, context): false if a part of
    a text, cut at white space, can't comply unless the whole text does. whole(text, context): true if no such part of the
    text, made of lines, can."""

    accepts: tuple[str, ...]
    rule: Rule
    bad: Callable[[Context], Column] | None = None
    fatal: Callable[[Context], Column] | None = None
    needs: str = "text"  # text, language or rephrase
    patterns: Callable[[Context], Column] | None = None
    parts: Callable[[Column, Context], Column] | None = None
    whole: Callable[[Column, Context], Column] | None = None


def _missing(*names: str):
    return lambda c: F.lit(False) if c.lang == "en" else _any(X.blank(c[n]) for n in names)


def _any(conditions) -> Column:
    out = F.lit(False)
    for x in conditions:
        out = out | F.coalesce(x, F.lit(False))
    return out


def _empty(name: str):
    return lambda c: F.lit(False) if c.lang == "en" else F.coalesce(F.size(c[name]) < 1, F.lit(True))


def _required(name: str):
    return lambda c: F.coalesce(c[name] == "", F.lit(True))


def _words_or_drawn(c: Context, name: str) -> Column:
    return F.when(F.size(c[name]) > 0, c[name]).otherwise(F.array(c.choice(KEYWORDS), c.choice(KEYWORDS[1:] + KEYWORDS[:1])))


def _counted(measure, arg: str, low: int, high: int, relation: str = "relation"):
    return lambda x, _, c: c.relation(relation, measure(x), c.number(arg, low, high))


def _fewer(count, least, relation: str = "relation"):
    """whole, for a number (count and least of a text and a context) of which a part has no more than the whole text."""
    return lambda x, c: (c.related(relation) == "at least") | ((c.related(relation) == "equal to") & (count(x, c) < least(c)))


def _worded(korean: bool) -> Rule:
    """A number of words; it is read no further than to the number asked for, unless that is to be met or beyond MOST."""
    measure, enough = (X.tokens, X.tokens_reach) if korean else (X.words, X.words_reach)

    def rule(x: Column, _: Column, c: Context) -> Column:
        least, r = c.number("num_words", 100, 500), c.related("relation")
        counted = c.relation("relation", measure(x), least)
        reached = enough(x, F.ceil(least))
        return F.when((r == "equal to") | (least > MOST) | F.isnan(least), counted).when(r == "less than", ~reached).when(r == "at least", reached)

    return rule


#: The largest number that a pattern counts to.
MOST = 1_000_000


def _always(x: Column, c: Context) -> Column:
    return F.lit(True)


def _letter(c: Context) -> Column:
    x = F.lower(X.strip(c["letter"]))
    return F.when(x.rlike("^[a-z]$"), x).otherwise(F.chr(F.pmod(c.draw, F.lit(26)) + 97))


def _letter_frequency(x: Column, _: Column, c: Context) -> Column:
    n, least = X.bind(_letter(c), lambda a: X.letters(x, a)), c.number("let_frequency", 1, 10)
    return c.relation("let_relation", n, least)


def _mark(c: Context) -> Column:
    return F.coalesce(c.stripped("postscript_marker"), c.choice(POSTSCRIPTS))


def _marks(c: Context) -> Column:
    """The marker's pattern, unless it is one of the fixed ones."""
    return F.when(_mark(c).isin(POSTSCRIPTS), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit(r"m:\s*"), F.lower(_mark(c)), F.lit(".*$"))))


def _postscript(x: Column, _: Column, c: Context) -> Column:
    mark, dot = _mark(c), F.contains(x, F.lit("."))
    return F.when(mark == "P.P.S", dot & x.rlike(rf"[Pp]\.{X.S}?[Pp]\.{X.S}?[Ss]")).when(mark == "P.S.", dot & x.rlike(rf"[Pp]\.{X.S}?[Ss]\.")).otherwise(F.regexp(F.lower(x), _java(c)))


def _java(c: Context) -> Column:
    """The only pattern of an instruction."""
    return F.get(c.compiled, F.lit(0))["java"]


def _found(x: Column, c: Context, every: bool) -> Column:
    where = lambda p: F.when(p["reach"] == "tail", F.substring_index(x, " ", -1)).otherwise(x)
    return (F.forall if every else F.exists)(c.compiled, lambda p: F.regexp(where(p), p["java"]))


def _found_at_ends(x: Column, c: Context) -> Column:
    """Whether a pattern may be found in the first or last word, or reaches anywhere."""
    ends = lambda p: F.regexp(F.substring_index(x, " ", 1), p["java"]) | F.regexp(F.substring_index(x, " ", -1), p["java"])
    return F.exists(c.compiled, lambda p: p["reach"].isNull()) | F.exists(c.compiled, lambda p: (p["reach"] != "local") & ends(p))


def _sources(before: str, behind: str, of: Callable[[Context], Column]):
    """Each text of a list between two pieces of pattern; the first begins with the flags."""
    return lambda c: F.transform(of(c), lambda x: F.concat(F.lit(before), x, F.lit(behind)))


def _keyword(c: Context) -> Column:
    return F.coalesce(c.stripped("keyword"), c.choice(KEYWORDS))


def _frequency(x: Column, c: Context) -> Column:
    return X.count(x, _java(c))


def _frequent(x: Column, c: Context) -> Column:
    """Of a word's places, a part has no more than the whole text; other patterns may find more."""
    return P.plain(F.concat(F.lit("i:"), _keyword(c))) & _fewer(_frequency, lambda c: c.number("frequency", 1, 3))(x, c)


def _nth(c: Context) -> tuple[Column, Column]:
    n = c.number("num_paragraphs", 1, 5)
    nth = F.when((c["nth_paragraph"] > 0) & (c["nth_paragraph"] <= n), c["nth_paragraph"]).otherwise(F.pmod(c.draw, (n + 1).cast("long")) + 1)
    return n, nth.cast("int")


def _nth_paragraph(x: Column, c: Context) -> tuple[Column, Column]:
    """The paragraph, and whether the number of paragraphs is right. The nth is taken of all pieces, blank ones too."""
    n, nth = _nth(c)
    pieces, full = X.double_line_paragraphs(x)
    return X.strip(F.get(pieces, nth - 1)), (full == n) & (nth <= n)


def _first_word(x: Column, _: Column, c: Context) -> Column:
    paragraph, fits = _nth_paragraph(x, c)
    token = F.regexp_extract(paragraph, f"({X.NOT_S}+)", 1)
    found = F.lower(F.regexp_extract(token, r"""^'*"*([^.,?!'"]*)""", 1))
    return F.coalesce(fits & (paragraph != "") & (found == F.lower(F.coalesce(c["first_word"], c.choice(KEYWORDS)))), F.lit(False))


def _first_sentence(x: Column, lang: Column, c: Context) -> Column:
    paragraph, fits = _nth_paragraph(x, c)
    sentences = F.when(lang == "ko", split_sentences(paragraph, korean=True)).otherwise(split_sentences(paragraph))
    return F.coalesce(fits & (paragraph != "") & (first_sentence_key(F.get(sentences, F.lit(0))) == first_sentence_key(c["first_sentence"])), F.lit(False))


def _key_sentences(x: Column, _: Column, c: Context) -> Column:
    n = F.when(c["num_sentences"] > 0, c["num_sentences"]).otherwise(F.pmod(c.draw, F.greatest(F.size(c["key_sentences"]), F.lit(1))) + 1)
    return key_sentences(x, c["key_sentences"], n, korean=c.lang == "ko")


def _splitter(c: Context) -> Column:
    return F.coalesce(c.stripped("section_spliter"), c.choice(SPLITTERS[c.lang]))


def _word(splitter: Column) -> Column:
    """Whether a splitter is words without digits: it has a place wherever it stands before one."""
    return splitter.rlike(r"\A[\p{L}_](?:[\p{L}_ ]*[\p{L}_])?\z")


def _splitters(c: Context) -> Column:
    """The splitter's pattern, unless it is words."""
    return F.when(_word(_splitter(c)), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit(r":\s?"), _splitter(c), F.lit(r"\s?\d+\s?"))))


def _sections(x: Column, _: Column, c: Context) -> Column:
    """Pieces after the first; a split at a pattern with groups also gives the groups' texts."""
    places = X.count(x, F.concat(F.regexp_replace(_splitter(c), r"\A(.)", "[$1]"), F.lit(f"{X.S}?{X.D}")))
    n = F.when(_word(_splitter(c)), F.when(F.contains(x, _splitter(c)), places).otherwise(0)).otherwise(X.count(x, _java(c)) * (1 + F.get(c.compiled, F.lit(0))["groups"]))
    return n >= c.number("num_sections", 1, 5)


def _choices(c: Context) -> Column:
    return F.when(F.size(c["choices"]) > 0, c["choices"]).otherwise(F.array(*map(F.lit, ANSWERS["ko"])))


def _plain_choices(c: Context) -> Column:
    return F.forall(_choices(c), lambda k: F.coalesce(P.plain(F.concat(F.lit("m:"), k)), F.lit(False)))


def _chosen(x: Column, _: Column, c: Context) -> Column:
    """A line begins with a choice; what is words has to stand somewhere."""
    some = F.exists(_choices(c), lambda k: F.coalesce(F.contains(x, k), F.lit(False))) | ~_plain_choices(c)
    return some & _found(X.strip_long(x), c, every=False)


#: A letter whose lower case depends on what stands around it.
SIGMA = "\u03a3"


def _low(x: Column, piece: Column) -> Column:
    """x in lower case, as far as its first or last signs go that piece has."""
    return X.bind(piece, lambda p: F.when(F.contains(p, F.lit(SIGMA)), F.lower(x)).otherwise(F.lower(p)))


def _begin(x: Column, _: Column, c: Context) -> Column:
    """Of the text only as many signs are lower-cased as the prompt has: in lower case they are no fewer."""
    whole = F.ltrim(x, F.lit(X.SPACES))
    return X.bind(F.lower(c.stripped("prompt_to_repeat")), lambda p: F.startswith(_low(whole, F.left(whole, F.length(p))), p))


def _end(x: Column, _: Column, c: Context) -> Column:
    end, mark = F.lower(F.coalesce(c.stripped("end_phrase"), c.choice(ENDINGS[c.lang]))), F.lit('"')
    bare = lambda s: F.when(F.startswith(s, mark) | F.endswith(s, mark), F.regexp_replace(s, r'\A"+|"+\z', "")).otherwise(s)
    # A sign has four bytes at most.
    last = lambda s, n: F.right(F.substring(s.cast("binary"), -4 * n - 4, 4 * n + 4).cast("string"), n)
    ends = lambda s: X.bind(end, lambda e: F.endswith(_low(s, last(s, F.length(e))), e))
    return X.bind(X.bind(X.strip_long(x), bare), ends)


def _quoted(mark: str) -> Rule:
    def rule(x, _, c):
        fits = lambda s: (F.length(s) > 1) & F.endswith(s, F.lit(mark))
        return F.startswith(F.ltrim(x, F.lit(X.SPACES)), F.lit(mark)) & X.bind(X.strip_long(x), fits)

    return rule


def _code_unknown(c: Context) -> Column:
    return F.coalesce(~c["language"].isin(CODES_KO if c.lang == "ko" else CODES), F.lit(False))


def _rel(name: str = "relation"):
    return lambda c: c.relation_bad(name)


def _either(*tests):
    return lambda c: _any(t(c) for t in tests)


def rules(lang: str) -> dict[str, Instruction]:
    """The instructions of a language by group:name."""
    ko = lang == "ko"
    n_words = X.tokens if ko else X.words  # of which _worded tells whether there are enough
    out = {
        "keywords:existence": Instruction(("keywords",), lambda x, _, c: _found(x, c, every=True), _empty("keywords"), patterns=_sources("i:", "", lambda c: _words_or_drawn(c, "keywords")), parts=_found_at_ends),
        "keywords:frequency": Instruction(("keyword", "frequency", "relation"), lambda x, _, c: c.relation("relation", _frequency(x, c), c.number("frequency", 1, 3)), _either(_missing("keyword"), _rel()), patterns=_sources("i:", "", lambda c: F.array(_keyword(c))), whole=_frequent),
        "keywords:forbidden_words": Instruction(("forbidden_words",), lambda x, _, c: ~_found(x, c, every=False), _empty("forbidden_words"), patterns=_sources(r"i:\b", r"\b", lambda c: _words_or_drawn(c, "forbidden_words"))),
        "keywords:letter_frequency": Instruction(("letter", "let_frequency", "let_relation"), _letter_frequency, _rel("let_relation"), whole=_fewer(lambda x, c: X.letters(x, _letter(c)), lambda c: c.number("let_frequency", 1, 10), "let_relation")),
        "language:response_language": Instruction(("language",), lambda x, l, c: F.coalesce(l == F.coalesce(c["language"], c.choice(CODES)), F.lit(True)), fatal=_code_unknown, needs="language"),
        "length_constraints:number_sentences": Instruction(("num_sentences", "relation"), _counted(lambda x: F.size(split_sentences(x, korean=True)).cast("long") if ko else count_sentences(x), "num_sentences", 1, 20), _rel()),
        "length_constraints:number_paragraphs": Instruction(("num_paragraphs",), lambda x, _, c: X.star_paragraphs(x) == c.number("num_paragraphs", 1, 5)),
        "length_constraints:number_words": Instruction(("num_words", "relation"), _worded(ko), _rel(), whole=_fewer(lambda x, _: n_words(x), lambda c: c.number("num_words", 100, 500))),
        "length_constraints:nth_paragraph_first_word": Instruction(("num_paragraphs", "nth_paragraph", "first_word"), _first_word, _missing("first_word")),
        "detectable_content:number_placeholders": Instruction(("num_placeholders",), lambda x, _, c: X.placeholders(x) >= c.number("num_placeholders", 1, 4), whole=_always),
        "detectable_content:postscript": Instruction(("postscript_marker",), _postscript, patterns=_marks, whole=lambda x, c: _mark(c).isin(POSTSCRIPTS)),
        "detectable_format:number_bullet_lists": Instruction(("num_bullets",), lambda x, _, c: X.bullets(x) == c.number("num_bullets", 1, 5), whole=lambda x, c: X.bullets(x) < c.number("num_bullets", 1, 5)),
        "detectable_format:constrained_response": Instruction((), lambda x, _, c: _any(F.contains(x, F.lit(o)) for o in ANSWERS[c.lang]), whole=_always),
        "detectable_format:number_highlighted_sections": Instruction(("num_highlights",), lambda x, _, c: X.highlights(x) >= c.number("num_highlights", 1, 4), whole=_always),
        "detectable_format:multiple_sections": Instruction(("section_spliter", "num_sections"), _sections, patterns=_splitters, whole=lambda x, c: _word(_splitter(c))),
        "detectable_format:json_format": Instruction((), lambda x, _, c: X.is_json(X.unfenced(x))),
        "detectable_format:title": Instruction((), lambda x, _, c: X.title(x), whole=_always),
        "combination:two_responses": Instruction((), lambda x, _, c: X.two_responses(x)),
        "combination:repeat_prompt": Instruction(("prompt_to_repeat",), _begin, _required("prompt_to_repeat")),
        "startend:end_checker": Instruction(("end_phrase",), _end),
        "change_case:capital_word_frequency": Instruction(("capital_frequency", "capital_relation"), lambda x, _, c: c.relation("capital_relation", X.capital_words(x), F.coalesce(c["capital_frequency"], c.number("capital_frequency", 1, 20))), _rel("capital_relation"), whole=_fewer(lambda x, _: X.capital_words(x), lambda c: F.coalesce(c["capital_frequency"], c.number("capital_frequency", 1, 20)), "capital_relation")),
        "change_case:english_capital": Instruction((), lambda x, l, c: X.has_upper_only(x) & F.coalesce(l == "en", F.lit(True)), needs="language"),
        "change_case:english_lowercase": Instruction((), lambda x, l, c: X.has_lower_only(x) & F.coalesce(l == "en", F.lit(True)), needs="language"),
        "punctuation:no_comma": Instruction((), lambda x, _, c: ~F.contains(x, F.lit(","))),
        "startend:quotation": Instruction((), _quoted('"')),
    }
    if ko:
        out |= {
            "keywords:key_sentences": Instruction(("key_sentences", "num_sentences"), _key_sentences, _empty("key_sentences")),
            "language:formal_text": Instruction((), lambda x, l, c: F.coalesce(l == "ko", F.lit(False)) & korean.formal_text(x), needs="language"),
            "length_constraints:number_syllables": Instruction(("num_syllables", "relation"), _counted(X.syllables, "num_syllables", 100, 500), _rel(), whole=_fewer(lambda x, _: X.syllables(x), lambda c: c.number("num_syllables", 100, 500))),
            "length_constraints:nth_paragraph_first_sentence": Instruction(("num_paragraphs", "nth_paragraph", "first_sentence"), _first_sentence, _missing("first_sentence"), needs="language"),
            "detectable_format:number_digit_lists": Instruction(("num_digit_list",), lambda x, _, c: X.digit_items(x) == c.number("num_digit_list", 1, 5), whole=lambda x, c: X.digit_items(x) < c.number("num_digit_list", 1, 5)),
            "detectable_format:constrained_custom_response": Instruction(("choices",), _chosen, whole=lambda x, c: _plain_choices(c), patterns=_sources(r"m:^\s*", ".*$", _choices)),
            "detectable_format:markdown_format": Instruction((), lambda x, _, c: ~X.blank(X.unfenced(x))),
            "combination:rephrasing_prompt": Instruction(("prompt_to_rephrase",), lambda x, l, c: l == "yes", _required("prompt_to_rephrase"), needs="rephrase"),
            "punctuation:no_period": Instruction((), lambda x, _, c: ~F.contains(x, F.lit("."))),
            "startend:single_quote": Instruction((), _quoted("'")),
        }
    return out


#: Rules that are the same in both languages where all arguments are there.
NEUTRAL = [
    "keywords:existence", "keywords:frequency", "keywords:forbidden_words", "length_constraints:number_paragraphs", "detectable_content:number_placeholders", "detectable_content:postscript", "detectable_format:number_bullet_lists", "detectable_format:number_highlighted_sections",
    "detectable_format:multiple_sections", "detectable_format:json_format", "detectable_format:title", "combination:two_responses", "combination:repeat_prompt", "startend:end_checker", "change_case:capital_word_frequency", "punctuation:no_comma", "startend:quotation",
]


REGISTRY: dict[str, Instruction] = {f"{lang}:{name}": i for lang in ("en", "ko") for name, i in rules(lang).items()}


#: The registry's own instructions, by identity: one that is replaced is no twin.
OWN = dict(REGISTRY)


def twins(ids) -> list[str]:
    """The neutral rules of which ids hold both languages' instructions."""
    return [n for n in NEUTRAL if all(i in ids and REGISTRY[i] is OWN[i] for i in (f"en:{n}", f"ko:{n}"))]


def register_instruction(instruction_id: str, instruction: Instruction) -> None:
    """Add or replace an instruction; its id begins with the language."""
    if instruction_id.split(":")[0] not in RELATIONS:
        raise ValueError("an id begins with en: or ko:")
    REGISTRY[instruction_id] = instruction


def registry_table(spark: SparkSession) -> DataFrame:
    """instruction_id, lang, name, accepts, needs: a row for each instruction."""
    rows = [(i, i.split(":")[0], i.split(":", 1)[1], list(x.accepts), x.needs) for i, x in REGISTRY.items()]
    return spark.createDataFrame(rows, "instruction_id string, lang string, name string, accepts array<string>, needs string")


# Rules that no instruction id stands for.


def constrained_start(x: Column, starter: Column) -> Column:
    """Whether a line begins with a pattern; null if it can't be compiled."""
    source = F.concat(F.lit(r"m:^\s*"), X.strip(starter), F.lit(".*$"))
    return F.regexp(x, F.get(F.get(P.compiled(F.array(F.array(source))), F.lit(0)), F.lit(0))["java"])


def key_sentences(x: Column, expected: Column, n: Column, korean: bool = False) -> Column:
    """Whether exactly n of the expected sentences are sentences of the text."""
    s = split_sentences(x, korean=korean)
    return F.size(F.filter(expected, lambda k: F.array_contains(s, k))) == n


def rephrase_marked(x: Column, original: Column) -> Column:
    """Both are equal but for what stands between stars; null unless both have such a part."""
    marked = r"(?d)\*.*\*"
    return F.when(x.rlike(marked) & original.rlike(marked), F.regexp_replace(x, marked, "") == F.regexp_replace(original, marked, ""))


def shared_words(pairs: DataFrame, id_col: str, x: str, original: str) -> DataFrame:
    """id_col and value: the size of the overlap of the two texts' bags of words, for each id of pairs; 0 if one has no words.

    The words of both texts are counted once each, so the work grows with the words."""
    both = pairs.select(id_col, F.explode(F.array(*(F.struct(F.lit(i).alias("second"), F.col(c).alias("text")) for i, c in enumerate((x, original))))).alias("s"))
    words = both.select(id_col, "s.second", F.explode_outer(F.regexp_extract_all(F.lower("s.text"), F.lit(f"({X.W}+)"), 1)).alias("word"))
    counts = words.groupBy(id_col, "word").agg(F.sum(1 - F.col("second")).alias("a"), F.sum("second").alias("b"))
    return counts.groupBy(id_col).agg(F.sum(F.when(F.col("word").isNotNull(), F.least("a", "b")).otherwise(0)).alias("value"))


def rephrased(pairs: DataFrame, id_col: str, x: str, original: str, low: int, high: int) -> DataFrame:
    """id_col, value and follows: whether the number of shared words is from low to high."""
    return shared_words(pairs, id_col, x, original).withColumn("follows", F.col("value").between(low, high))
