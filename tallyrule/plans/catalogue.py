"""Queries over the test tables, each with the same result in DuckDB's SQL."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boundaries, text as X
from ..functions.korean import NO_CONFIRM, confirmations, first_line, formal_text, keyword_set, may_confirm, normalized_column
from ..functions.language import ADDED, RUN, SCRIPTS, SHARED, detect
from ..functions.patterns import compiled
from ..functions.samples import SAMPLES
from ..functions.sentences import ABBREVIATIONS, count_sentences, split_sentences
from ..operators import ingest, instructions as I
from ..operators.evaluate import evaluate_specs, evaluate_turns, explode_specs, exploded
from ..sources.files import read_spread, stored_size
from ..streaming import dialogue
from ..streaming.sinks import kept
from . import report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
S, NS, W, D = X.S, X.NOT_S, X.W, X.D

#: Texts with markup, made of documents in SQL that Spark and DuckDB share.
TEXTS = {
    "plain": "text",
    "bullets": "replace(text, chr(10), concat(chr(10), '- '))",
    "digits": "concat('1. ', replace(text, chr(10), concat(chr(10), '2) ')))",
    "brackets": "replace(replace(text, ' the ', ' [the] '), ' la ', ' [la] ')",
    "stars": "replace(text, chr(10), ' *** ')",
    "bold": "replace(replace(text, ' of ', ' *of* '), ' de ', ' **de** ')",
    "sections": "concat('SECTION 1 ', replace(text, chr(10), ' SECTION 2 '))",
    "paragraphs": "replace(text, chr(10), concat(chr(10), chr(10)))",
    "twice": "concat(text, '******', CASE WHEN doc_id % 2 = 0 THEN text ELSE concat(text, '!') END)",
    "title": "CASE WHEN doc_id % 3 = 0 THEN concat('<<', substr(text, 1, 20), '>>', text) ELSE concat('<< >>', text) END",
    "quoted": "CASE WHEN doc_id % 2 = 0 THEN concat('\"', text, '\"') ELSE concat(chr(39), text, chr(39)) END",
    "upper": "CASE WHEN doc_id % 2 = 0 THEN upper(text) ELSE lower(text) END",
    "post": "CASE WHEN doc_id % 2 = 0 THEN concat(text, chr(10), 'P.S. end') ELSE text END",
    "json": "CASE WHEN doc_id % 3 = 0 THEN '{\"a\": [1, 2]}' WHEN doc_id % 3 = 1 THEN concat('{a:', text) ELSE concat('[', CAST(doc_id AS STRING), ']') END",
    "answer": "CASE WHEN doc_id % 2 = 0 THEN concat('My answer is yes. ', text) ELSE text END",
    "register": "concat('안녕 세상 ', CASE WHEN doc_id % 2 = 0 THEN '감사드립니다.' ELSE '먹었어' END)",
    "korean": "translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '가나다라마바사아자차카타파하습니요했어먹갑오합입세를')",
    "prose": "regexp_replace(replace(text, chr(10), '. '), '[.]+', '.')",
    "fenced": "CASE WHEN doc_id % 3 = 0 THEN concat('```json', chr(10), '```') WHEN doc_id % 3 = 1 THEN concat('```', text, '```') ELSE text END",
}
#: Where the two engines spell a call differently.
DUCK = {"STRING": "VARCHAR", "'[.]+', '.')": "'[.]+', '.', 'g')"}
TEXTS["mixed"] = "CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN {TEXTS[b]}" for k, b in enumerate(("bullets", "digits", "stars", "bold", "sections", "quoted"))) + f" ELSE {TEXTS['title']} END"


def _duck(base: str) -> str:
    out = TEXTS[base]
    for spark_sql, duck_sql in DUCK.items():
        out = out.replace(spark_sql, duck_sql)
    return out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_spread(spark, f"{sf_dir}/documents.parquet")


def _texts(spark: SparkSession, sf_dir: str, base: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.expr(TEXTS[base]).alias("text"))


def _from(base: str) -> str:
    return f"(SELECT doc_id, {_duck(base)} AS text FROM documents)"


def measure(name: str, base: str, column: Callable[[Column], Column], sql: str | None) -> None:
    """A query that returns doc_id and the value of a column of texts."""
    QUERIES[name] = lambda spark, sf_dir: _texts(spark, sf_dir, base).select("doc_id", column(F.col("text")).alias("value"))
    if sql:
        ORACLES[name] = f"SELECT doc_id, {sql} AS value FROM {_from(base)}"


def n(pattern: str, x: str = "text") -> str:
    return f"CAST(len(regexp_extract_all({x}, '{pattern}')) AS BIGINT)"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '\A{S}+|{S}+\z', '', 'g')"


def args(**kw) -> I.Context:
    """Arguments of a rule as literals."""
    kinds = {a.split(" ", 1)[0]: a.split(" ", 1)[1] for a in I.ARGS_SCHEMA.split(", ")}
    lit = lambda a, kind: (F.array(*map(F.lit, kw[a])) if isinstance(kw[a], list) else F.lit(kw[a])).cast(kind) if a in kw else F.lit(None).cast(kind)
    return I.Context(F.struct(*(lit(a, kind).alias(a) for a, kind in kinds.items())), kw.pop("lang", "en"), F.lit(0))


#: Instructions with their arguments and SQL, for the evaluation of all of them at once.
RULES: list[tuple[str, dict, str]] = []


def rule(name: str, instruction: str, base: str, sql: str | None, hint: Callable[[Column], Column] | None = None, **kw) -> None:
    """A query that returns doc_id and whether an instruction is followed. hint: a language for each text."""
    lang = instruction.split(":")[0]
    if sql and not hint:
        RULES.append((instruction, kw, sql))

    def column(x: Column) -> Column:
        i, c = I.REGISTRY[instruction], args(lang=lang, **kw)
        if i.patterns:
            c = replace(c, compiled=F.get(compiled(F.array(i.patterns(c))), F.lit(0)))
        return ~X.blank(x) & F.coalesce(i.rule(x, hint(x) if hint else F.lit(None).cast("string"), c), F.lit(False))

    measure(name, base, column, sql and rf"coalesce(regexp_matches(text, '{NS}') AND ({sql}), false)")


def sentences_sql(x: str, korean: bool = False) -> str:
    """The number of sentences of a text without runs of dots, rule by rule."""
    letter = "([A-Za-z가-힣])" if korean else "([A-Za-z])"
    starters = rf"(Mr|Mrs|Ms|Dr|Prof|Capt|Cpt|Lt|He{S}|She{S}|It{S}|They{S}|Their{S}|Our{S}|We{S}|But{S}|However{S}|That{S}|This{S}|Wherever)"
    steps = [(r"\n", " "), ("(Mr|St|Mrs|Ms|Dr)[.]", r"\1<prd>"), ("[.](com|net|org|io|gov|edu|me)", r"<prd>\1"), ("([0-9])[.]([0-9])", r"\1<prd>\2"), (r"Ph\.D\.", "Ph<prd>D<prd>")]
    if not korean:
        steps += [(rf"{S}([A-Za-z])[.] ", r" \1<prd> "), (f"([A-Z][.][A-Z][.](?:[A-Z][.])?) {starters}", r"\1<stop> \2")]
    steps += [(f"{letter}[.]{letter}[.]{letter}[.]", r"\1<prd>\2<prd>\3<prd>"), (f"{letter}[.]{letter}[.]", r"\1<prd>\2<prd>")]
    if not korean:
        steps += [(f" (Inc|Ltd|Jr|Sr|Co)[.] {starters}", r" \1<stop> \2")]
    steps += [(" (Inc|Ltd|Jr|Sr|Co)[.]", r" \1<prd>"), (" ([A-Za-z])[.]", r" \1<prd>")]
    if korean:
        steps += [(rf"{S}([A-Za-z])[.]{S}+([가-힣])", r" \1<prd> \2"), (rf"{S}([가나다라마바사])[.]{S}+", r" \1<prd> ")]
    steps += [(r"\.”", "”."), (r'\."', '".'), ('!"', '"!'), (r'\?"', '"?'), ("([.?!])", r"\1<stop>"), ("<prd>", ".")]
    out = f"concat(' ', {x}, '  ')"
    for pattern, to in steps:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"(SELECT CAST(len(p) - CASE WHEN regexp_matches(p[len(p)], '{NS}') THEN 0 ELSE 1 END AS BIGINT) FROM (SELECT string_split({out}, '<stop>') AS p))"


# Measurements.
measure("number_words", "plain", X.words, n(W + "+"))
measure("number_words_ws", "plain", X.tokens, n(NS + "+"))
measure("letter_frequency", "plain", lambda x: X.letters(x, F.lit("e")), "CAST(length(lower(text)) - length(replace(lower(text), 'e', '')) AS BIGINT)")
measure("syllables_ko", "korean", X.syllables, n("[가-힣]"))
measure("bullets", "bullets", X.bullets, n(rf"(?m)^{S}*\*[^*].*$") + " + " + n(rf"(?m)^{S}*-.*$"))
measure("digit_lists", "digits", X.digit_items, n(rf"(?m)^{S}*{D}+\).*$") + " + " + n(rf"(?m)^{S}*{D}+\..*$"))
measure("placeholders", "brackets", X.placeholders, n(r"\[.*?\]"))
measure("highlights", "bold", X.highlights, rf"CAST(len(list_filter(regexp_extract_all(text, '\*[^\n\*]*\*'), lambda h: regexp_matches(regexp_replace(h, '\A\*+|\*+\z', '', 'g'), '{NS}'))) + len(list_filter(regexp_extract_all(text, '\*\*[^\n\*]*\*\*'), lambda h: regexp_matches(regexp_replace(h, '\A\*\*|\*\*\z', '', 'g'), '{NS}'))) AS BIGINT)")
measure("sections", "sections", lambda x: X.sections(x, F.lit("SECTION")), n(rf"{S}?SECTION{S}?{D}+{S}?"))
#: Tokens in SQL: marks that stand alone become blanks, contractions are cut off, then white space separates.
MARKS = r"regexp_replace(regexp_replace(text, '[?!;@#$%&()\[\]{}<>\"\x{201c}\x{201d}\x{ab}\x{bb}`]|--|\.{2,}', ' ', 'g'), '[:,](\P{Nd}|$)', ' \1', 'g')"
TOKENS = rf"regexp_split_to_array(regexp_replace({MARKS}, '(?i)([^''])(n''t|''(?:ll|re|ve|s|m|d))({S}|$)', '\1 \2\3', 'g'), '{S}+')"
CAPITALS = rf"len(list_filter({TOKENS}, lambda w: regexp_matches(w, '\p{{Lu}}') AND NOT regexp_matches(w, '[\p{{Ll}}\p{{Lt}}]')))"
measure("capital_words", "upper", X.capital_words, f"CAST({CAPITALS} AS BIGINT)")
measure("blank_filter", "plain", X.blank, f"NOT regexp_matches(text, '{NS}')")
measure("number_sentences_rule", "prose", lambda x: F.size(split_sentences(x)).cast("long"), sentences_sql("text"))
measure("number_sentences_rule_ko", "korean", lambda x: F.size(split_sentences(F.regexp_replace(x, r"\.+", "."), korean=True)).cast("long"), sentences_sql(r"regexp_replace(text, '[.]+', '.', 'g')", korean=True))
LINES = "string_split(text, chr(10))"
CUTS = ["text", strip_sql(f"array_to_string({LINES}[2:len({LINES})], chr(10))"), strip_sql(f"array_to_string({LINES}[1:len({LINES}) - 1], chr(10))"), strip_sql(f"array_to_string({LINES}[2:len({LINES}) - 1], chr(10))")]
VARIANTS = ", ".join([*(f"coalesce({c}, '')" for c in CUTS), *(f"replace(coalesce({c}, ''), '*', '')" for c in CUTS)])
measure("loose_variants", "mixed", lambda x: F.size(X.loose_variants(x)).cast("long"), f"CAST(len(list_distinct([{VARIANTS}])) AS BIGINT)")
measure("formal_text_ko", "register", formal_text, "doc_id % 2 = 0")


def guessed_sql(base: str) -> str:
    """(doc_id, value): the guess for each text, with profiles that SQL counts in the samples by itself."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    names, shared = list(SCRIPTS), [k for k, v in SHARED.items() for _ in v]
    samples = ", ".join(f"({quote(script)}, {quote(code)}, {SHARED[script].index(code)}, lower({quote(SAMPLES[code])}))" for script, code in zip(shared, [c for v in SHARED.values() for c in v], strict=True))
    letters = "CASE script " + " ".join(f"WHEN '{k}' THEN regexp_extract_all(text, '[{v}]+')" for k, v in SCRIPTS.items() if k in SHARED) + " END"
    n_of = {k: f"len(regexp_extract_all(text, '[{v}]'))" for k, v in SCRIPTS.items()}
    first = "CASE most " + " ".join(f"WHEN n_{k} THEN '{k}'" for k in names) + " END"
    pieces = lambda table, key: f"""(SELECT {key}, script, substr(w, CAST(i AS INT), CAST(n AS INT)) AS g, n FROM (SELECT {key}, script, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM
      (SELECT {key}, script, ' ' || unnest({letters}) || ' ' AS w FROM {table}), (SELECT unnest(range(1, {RUN + 1})) AS n)))"""  # noqa: E731
    return f"""(WITH s(script, code, place, text) AS (VALUES {samples}),
      sg AS (SELECT script, code, place, g, count(*) AS n FROM {pieces("s", "code, place")} WHERE g <> ' ' GROUP BY ALL),
      known AS (SELECT script, g, count(*) OVER (PARTITION BY script) AS v FROM (SELECT DISTINCT script, g FROM sg)),
      total AS (SELECT script, code, place, sum(n) AS total FROM sg GROUP BY ALL),
      weight AS (SELECT k.script, t.code, t.place, k.g, CAST(round(1000 * ln((coalesce(sg.n, 0) + {ADDED}::DOUBLE) / (t.total + {ADDED}::DOUBLE * v))) AS BIGINT) AS w
        FROM known AS k JOIN total AS t ON t.script = k.script LEFT JOIN sg ON sg.script = k.script AND sg.code = t.code AND sg.g = k.g),
      d AS (SELECT doc_id, lower(text) AS text FROM {_from(base)}),
      c AS (SELECT doc_id, text, {", ".join(f"{v} AS n_{k}" for k, v in n_of.items())} FROM d),
      m AS (SELECT *, greatest({", ".join(f"n_{k}" for k in names)}) AS most FROM c),
      t AS (SELECT doc_id, text, n_ja, CASE WHEN most > 0 THEN {first} END AS script FROM m),
      dg AS (SELECT doc_id, script, g, count(*) AS n FROM {pieces("t", "doc_id")} WHERE g <> ' ' GROUP BY ALL),
      r AS (SELECT doc_id, code, row_number() OVER (PARTITION BY doc_id ORDER BY sum(n * w) DESC, any_value(place)) AS rank FROM dg JOIN weight USING (script, g) GROUP BY doc_id, code)
      SELECT t.doc_id, CASE WHEN script = 'zh' AND n_ja > 0 THEN 'ja' {" ".join(f"WHEN script = '{k}' THEN coalesce(code, '{v[0]}')" for k, v in SHARED.items())} ELSE script END AS value FROM t LEFT JOIN r ON r.doc_id = t.doc_id AND r.rank = 1)"""


measure("language_guess", "plain", lambda x: F.get(detect(F.array(x)), F.lit(0)), None)
ORACLES["language_guess"] = f"SELECT doc_id, value FROM {guessed_sql('plain')}"
#: Whether at least 95 of 100 documents of a language are told to be in it; the table says which they are in.
QUERIES["language_accuracy"] = lambda s, d: _documents(s, d).withColumn("guess", F.get(detect(F.array("text")), F.lit(0))).groupBy("lang").agg(F.count("*").alias("documents"), (F.avg((F.coalesce("guess", F.lit("")) == F.col("lang")).cast("int")) >= 0.95).alias("told"))
ORACLES["language_accuracy"] = "SELECT lang, count(*) AS documents, true AS told FROM documents GROUP BY lang"

# Instructions.
ee, mid = "lambda y: NOT regexp_matches(y, '%s')" % NS, rf"regexp_split_to_array(text, '{S}?\*\*\*{S}?')"
rule("keywords_existence", "en:keywords:existence", "plain", "regexp_matches(text, '(?i)the') AND regexp_matches(text, '(?i)an')", keywords=["the", "an"])
rule("keyword_frequency", "en:keywords:frequency", "plain", n("(?i)the") + " >= 3", keyword="the", frequency=3, relation="at least")
rule("forbidden_words", "en:keywords:forbidden_words", "plain", f"NOT regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(the|der)($|[^\\p{{L}}\\p{{N}}_])')", forbidden_words=["the", "der"])
rule("words_at_least", "en:length_constraints:number_words", "plain", n(W + "+") + " >= 300", num_words=300, relation="at least")
rule("letter_less_than", "en:keywords:letter_frequency", "plain", "length(lower(text)) - length(replace(lower(text), 'z', '')) < 5", letter="z", let_frequency=5, let_relation="less than")
rule("paragraphs_stars", "en:length_constraints:number_paragraphs", "stars", f"len(list_filter({mid}[2:len({mid}) - 1], {ee})) = 0 AND len({mid}) - CAST(NOT regexp_matches({mid}[1], '{NS}') AS INT) - CASE WHEN len({mid}) > 1 AND NOT regexp_matches({mid}[len({mid})], '{NS}') THEN 1 ELSE 0 END = 3", num_paragraphs=3)
two = "string_split(text, '******')"
rule("two_responses", "en:combination:two_responses", "twice", f"len(list_filter({two}[2:len({two}) - 1], {ee})) = 0 AND len(list_filter({two}, lambda y: regexp_matches(y, '{NS}'))) = 2 AND {strip_sql(two + '[1]')} <> {strip_sql(two + '[2]')}")
par = "string_split(text, chr(10) || chr(10))"
word = rf"lower(regexp_extract(regexp_extract({strip_sql(par + '[2]')}, '{NS}+'), '^''*\"*([^.,?!''\"]*)', 1))"
rule("nth_paragraph_first_word", "en:length_constraints:nth_paragraph_first_word", "paragraphs", f"len(list_filter({par}, lambda y: regexp_matches(y, '{NS}'))) = 2 AND {word} = 'the'", num_paragraphs=2, nth_paragraph=2, first_word="the")
rule("nth_paragraph_first_sentence", "ko:length_constraints:nth_paragraph_first_sentence", "register", "doc_id % 2 = 1", lambda x: F.lit("ko"), num_paragraphs=1, nth_paragraph=1, first_sentence="안녕 세상 먹었어")
rule("postscript", "en:detectable_content:postscript", "post", rf"regexp_matches(lower(text), 'p\.{S}?s\.')", postscript_marker="P.S.")
rule("constrained_response", "en:detectable_format:constrained_response", "answer", "contains(text, 'My answer is yes.') OR contains(text, 'My answer is no.') OR contains(text, 'My answer is maybe.')")
rule("constrained_custom", "ko:detectable_format:constrained_custom_response", "answer", f"regexp_matches(text, '(?m)^{S}*My answer')", choices=["My answer"])
rule("title", "en:detectable_format:title", "title", rf"len(list_filter(regexp_extract_all(text, '<<[^\n]+>>'), lambda t: regexp_matches(regexp_replace(t, '\A<+|>+\z', '', 'g'), '{NS}'))) > 0")
rule("json_format", "en:detectable_format:json_format", "json", "json_valid(text)")
rule("markdown_format", "ko:detectable_format:markdown_format", "fenced", rf"regexp_matches(regexp_replace(regexp_replace({strip_sql('text')}, '\A```(json|Json|JSON)?', ''), '```\z', ''), '{NS}')")
rule("end_checker", "en:startend:end_checker", "quoted", rf"ends_with(lower(regexp_replace({strip_sql('text')}, '\A\"+|\"+\z', '', 'g')), 'the.')", end_phrase="the.")
rule("quotation", "en:startend:quotation", "quoted", f"length({strip_sql('text')}) > 1 AND starts_with({strip_sql('text')}, '\"') AND ends_with({strip_sql('text')}, '\"')")
rule("single_quote", "ko:startend:single_quote", "quoted", f"length({strip_sql('text')}) > 1 AND starts_with({strip_sql('text')}, chr(39)) AND ends_with({strip_sql('text')}, chr(39))")
rule("repeat_prompt", "en:combination:repeat_prompt", "plain", f"starts_with(lower({strip_sql('text')}), 'the')", prompt_to_repeat=" The ")
rule("no_comma", "en:punctuation:no_comma", "plain", "NOT contains(text, ',')")
rule("no_period", "ko:punctuation:no_period", "plain", "NOT contains(text, '.')")
#: A language that the number of words decides: German, English or not known.
english = lambda x: F.when(X.tokens(x) % 3 == 0, "de").when(X.tokens(x) % 3 == 1, "en")
rule("all_upper", "en:change_case:english_capital", "upper", r"regexp_matches(text, '\p{Lu}') AND NOT regexp_matches(text, '[\p{Ll}\p{Lt}]') AND " + n(NS + "+") + " % 3 > 0", english)
rule("all_lower", "en:change_case:english_lowercase", "upper", r"regexp_matches(text, '\p{Ll}') AND NOT regexp_matches(text, '[\p{Lu}\p{Lt}]') AND " + n(NS + "+") + " % 3 > 0", english)
for _name, _id, _sql in (("upper_in_english", "en:change_case:english_capital", r"regexp_matches(text, '\p{Lu}') AND NOT regexp_matches(text, '[\p{Ll}\p{Lt}]')"), ("lower_in_english", "ko:change_case:english_lowercase", r"regexp_matches(text, '\p{Ll}') AND NOT regexp_matches(text, '[\p{Lu}\p{Lt}]')")):
    rule(_name, _id, "upper", None, lambda x: F.get(detect(F.array(x)), F.lit(0)))
    ORACLES[_name] = f"SELECT t.doc_id, coalesce(regexp_matches(text, '{NS}') AND {_sql} AND coalesce(g.value = 'en', true), false) AS value FROM {_from('upper')} AS t JOIN {guessed_sql('upper')} AS g ON g.doc_id = t.doc_id"
rule("response_in_french", "en:language:response_language", "plain", None, lambda x: F.get(detect(F.array(x)), F.lit(0)), language="fr")
ORACLES["response_in_french"] = f"SELECT t.doc_id, coalesce(regexp_matches(text, '{NS}') AND coalesce(g.value = 'fr', true), false) AS value FROM {_from('plain')} AS t JOIN {guessed_sql('plain')} AS g ON g.doc_id = t.doc_id"
rule("bullets_equal", "en:detectable_format:number_bullet_lists", "bullets", f"({n(rf'(?m)^{S}*-.*$')} + {n(rf'(?m)^{S}*\*[^*].*$')}) = 2", num_bullets=2)
rule("digits_equal", "ko:detectable_format:number_digit_lists", "digits", f"({n(rf'(?m)^{S}*{D}+\).*$')} + {n(rf'(?m)^{S}*{D}+\..*$')}) = 3", num_digit_list=3)
rule("syllables_equal", "ko:length_constraints:number_syllables", "korean", n("[가-힣]") + " >= 800", num_syllables=800, relation="at least")
rule("key_sentences", "ko:keywords:key_sentences", "register", "text = '안녕 세상 먹었어'", key_sentences=["안녕 세상 먹었어"], num_sentences=1)
measure("constrained_start", "plain", lambda x: I.constrained_start(x, F.lit("The")), f"regexp_matches(text, '(?m)^{S}*The')")
other = lambda x: F.when(F.length(x) % 2 == 0, F.concat(x, F.lit(" end"))).otherwise(F.replace(x, F.lit("*o"), F.lit("*u")))
OTHER = "CASE WHEN length(text) % 2 = 0 THEN concat(text, ' end') ELSE replace(text, '*o', '*u') END"
measure("rephrase_marked", "bold", lambda x: F.coalesce(I.rephrase_marked(x, other(x)), F.lit(False)), rf"regexp_matches(text, '\*.*\*') AND regexp_replace(text, '\*.*\*', '', 'g') = regexp_replace({OTHER}, '\*.*\*', '', 'g')")

# The rest of what both languages have, for the evaluation of all rules.
rule("placeholders_at_least", "en:detectable_content:number_placeholders", "brackets", n(r"\[.*?\]") + " >= 2", num_placeholders=2)
rule("sections_at_least", "en:detectable_format:multiple_sections", "sections", n(rf"{S}?SECTION{S}?{D}+{S}?") + " >= 2", section_spliter="SECTION", num_sections=2)
rule("capital_words_at_least", "en:change_case:capital_word_frequency", "upper", CAPITALS + " >= 5", capital_frequency=5, capital_relation="at least")
rule("highlights_at_least", "en:detectable_format:number_highlighted_sections", "bold", ORACLES["highlights"].partition("SELECT doc_id, ")[2].partition(" AS value")[0] + " >= 2", num_highlights=2)
rule("sentences_at_least", "ko:length_constraints:number_sentences", "prose", sentences_sql("text", korean=True) + " >= 12", num_sentences=12, relation="at least")
#: English ends of sentences, in prose without runs of dots: marks before white space but for known abbreviations, blanked first.
KNOWN = "|".join([*(a.replace(".", r"\.") for a in ABBREVIATIONS), r"\p{L}"])
ENDS = rf"len(regexp_extract_all(concat(regexp_replace(regexp_replace({strip_sql('text')}, '(?i)(^|[^\p{{L}}\p{{N}}.])({KNOWN})\.', '\1\2', 'g'), '{S}+', ' ', 'g'), ''), '[.?!][\"''\x{{201d}}\x{{2019}}\x{{bb}})\]}}]* '))"
measure("number_sentences_en", "prose", count_sentences, f"CAST(CASE WHEN regexp_matches(text, '{NS}') THEN {ENDS} + 1 ELSE 0 END AS BIGINT)")


def _learnt(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, boundaries.Boundaries]:
    docs = read_spread(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs, boundaries.train(docs, keep=kept)


def _term(k: str, m: str, q: str) -> str:
    return f"CASE WHEN {k} > 0 THEN {k} * ln({q}) ELSE 0.0 END + CASE WHEN {m} > {k} THEN ({m} - {k}) * ln(1 - {q}) ELSE 0.0 END"


def _log_ratio(both: str, first: str, second: str, n: str = "every") -> str:
    """The likelihood ratio of first and second standing together, of counts as doubles."""
    both, first, second, n = (f"CAST({c} AS DOUBLE)" for c in (both, first, second, n))
    rest, others = f"({second} - {both})", f"({n} - {first})"
    alone = f"({second} / {n})"
    return f"2 * ({_term(both, first, f'({both} / {first})')} + {_term(rest, others, f'({rest} / {others})')} - ({_term(both, first, alone)}) - ({_term(rest, others, alone)}))"


def _type(word: str) -> str:
    bare = rf"lower(regexp_replace({word}, '[.,;:!?]+\z', ''))"
    return rf"CASE WHEN regexp_matches({bare}, '^[0-9][0-9.,:/-]*\z') THEN '##' ELSE {bare} END"


#: Words with their neighbours, counts by type, what follows a period, and the model of boundaries.
LEARNT = rf"""WITH bare AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: regexp_replace(regexp_replace(w, '^["''(\[{{“‘«]+', ''), '["'')\]}}”’»]+\z', '')), lambda w: w != '') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM bare),
words AS (SELECT doc_id, w[i] AS word, w[i + 1] AS next, CASE WHEN i > 1 THEN w[i - 1] END AS before FROM places),
near AS (SELECT *, {_type('word')} AS type, CASE WHEN next IS NOT NULL THEN {_type('next')} END AS next_type, regexp_matches(word, '(^|[^.])\.\z') AS dot FROM words),
total AS (SELECT count(*) AS every, sum(dot::BIGINT) AS dots FROM near),
counts AS (SELECT type, count(*) AS n, sum(dot::BIGINT) AS n_dot, sum(regexp_matches(word, '^\p{{Ll}}')::BIGINT) AS n_lower, sum(regexp_matches(word, '^\p{{Lu}}')::BIGINT) AS n_upper, sum((regexp_matches(word, '^\p{{Lu}}') AND before IS NOT NULL AND NOT regexp_matches(before, '[.!?:]\z'))::BIGINT) AS n_inside FROM near GROUP BY type),
sized AS (SELECT *, CAST(length(replace(type, '.', '')) AS DOUBLE) AS size, n - n_dot AS plain FROM counts, total),
judged AS (SELECT *, n_lower > 0 AND n_upper > 0 AND n_inside = 0 AS opens, CASE WHEN regexp_matches(type, '^\p{{L}}') AND n_dot > 0 AND dots < every THEN 2 * (n_dot * (ln(0.99::DOUBLE) - ln(dots / every)) + plain * (ln(1 - 0.99::DOUBLE) - ln(1 - dots / every))) * exp(-size) * (length(type) - size + 1) * pow(size, -plain::DOUBLE) >= 0.3 ELSE false END AS abbreviation FROM sized),
follows AS (SELECT type, next_type, count(*) AS n_both, bool_or(type IN (SELECT type FROM judged WHERE abbreviation) OR type = '##' OR regexp_matches(type, '^\p{{L}}\z')) AS held FROM near WHERE dot AND next_type IS NOT NULL GROUP BY ALL),
after AS (SELECT next_type AS type, sum(n_both) AS n_after FROM follows WHERE NOT held GROUP BY next_type),
breaks AS (SELECT sum(n_both) AS n_breaks FROM follows WHERE NOT held),
model AS (SELECT type, abbreviation, opens, coalesce(CASE WHEN n_after / n_breaks > n / every AND regexp_matches(type, '^\p{{L}}') AND n_breaks < every THEN {_log_ratio('n_after', 'n_breaks', 'n')} >= 30 ELSE false END, false) AS starter FROM judged LEFT JOIN after USING (type), breaks),
pairs AS (SELECT f.type, f.next_type FROM follows f JOIN counts a ON a.type = f.type JOIN counts b ON b.type = f.next_type, total WHERE held AND f.next_type != '##' AND n_both > 1 AND a.n_dot < every AND f.next_type NOT IN (SELECT type FROM model WHERE starter) AND CASE WHEN n_both / a.n_dot > b.n / every THEN {_log_ratio('n_both', 'a.n_dot', 'b.n')} >= 7.88 ELSE false END)
"""
QUERIES["sentence_model"] = lambda s, d: _learnt(s, d)[1].types
ORACLES["sentence_model"] = LEARNT + "SELECT type, abbreviation, starter, opens FROM model WHERE abbreviation OR starter OR opens"
QUERIES["sentence_pairs"] = lambda s, d: _learnt(s, d)[1].pairs
ORACLES["sentence_pairs"] = LEARNT + "SELECT type, next_type FROM pairs"
QUERIES["sentences_learnt"] = lambda s, d: boundaries.sentence_counts(*_learnt(s, d), "doc_id")
ORACLES["sentences_learnt"] = LEARNT + r"""SELECT b.doc_id, CAST(sum(CASE WHEN len(b.w) > 0 THEN 1 ELSE 0 END) + coalesce(any_value(cuts), 0) AS BIGINT) AS n_sentences FROM bare b LEFT JOIN (
SELECT n.doc_id, count(*) AS cuts FROM near n LEFT JOIN model m ON m.type = n.type LEFT JOIN model o ON o.type = n.next_type LEFT JOIN pairs p ON p.type = n.type AND p.next_type = n.next_type
WHERE n.next IS NOT NULL AND regexp_matches(word, '[.!?]\z') AND CASE WHEN regexp_matches(word, '[!?]\z') THEN true WHEN NOT dot THEN regexp_matches(next, '^\p{Lu}') WHEN p.type IS NOT NULL THEN false
WHEN coalesce(m.abbreviation, false) OR regexp_matches(n.type, '^\p{L}\z') THEN regexp_matches(next, '^\p{Lu}') AND coalesce(o.starter OR o.opens, false) WHEN n.type = '##' THEN NOT regexp_matches(next, '^\p{Ll}') ELSE true END GROUP BY n.doc_id) USING (doc_id) GROUP BY b.doc_id"""


#: Bytes of documents, as stored, whose words are counted by one task.
PART = 1 << 20


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the text of the next id, if there is one."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    # A part's words are counted in memory, so the parts grow in number with the input, not in size.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), stored_size(docs) // PART + 1)
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("original"))
    return docs.repartition(parts, "doc_id").join(after.repartition(parts, "doc_id"), "doc_id", "left")


BAGS = f"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{W}+')) AS word FROM documents) GROUP BY doc_id, word"
QUERIES["rephrase_overlap"] = lambda s, d: I.shared_words(_pairs(s, d), "doc_id", "text", "original")
ORACLES["rephrase_overlap"] = f"WITH bags AS ({BAGS}) SELECT doc_id, CAST(coalesce(value, 0) AS BIGINT) AS value FROM documents LEFT JOIN (SELECT a.doc_id, sum(least(a.n, b.n)) AS value FROM bags a JOIN bags b ON b.doc_id = a.doc_id + 1 AND b.word = a.word GROUP BY a.doc_id) USING (doc_id)"

#: Distinct words between white space without a particle at their ends, of documents whose letters are Korean.
ENDS = "은|는|이|가|을|를|에|서|의|와|과|도|로|부|터|까|지|만"
STEMS = f"list_distinct(list_filter(list_transform(regexp_extract_all(text, '{NS}+'), lambda w: regexp_replace(w, '({ENDS})$', '')), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^[0-9]+$')))"
measure("keywords_ko", "korean", lambda x: F.size(keyword_set(x)).cast("long"), f"CAST(len({STEMS}) AS BIGINT)")
QUERIES["keyword_overlap"] = lambda s, d: _texts(s, d, "korean").select("doc_id", F.size(F.array_intersect(keyword_set(F.col("text")), keyword_set(F.substring_index("text", "\n", 1)))).cast("long").alias("value"))
ORACLES["keyword_overlap"] = f"SELECT doc_id, CAST(len(list_intersect({STEMS}, {STEMS.replace('(text,', '(string_split(text, chr(10))[1],', 1)})) AS BIGINT) AS value FROM {_from('korean')}"

#: Requests and answers by turns, made of documents: which first lines read like a confirmation.
TEXTS["requests"] = "concat(CASE doc_id % 4 WHEN 0 THEN '배송 상태 확인을  요청하셨네요 .' WHEN 1 THEN '네, 알려 주셨군요.' WHEN 2 THEN 'DOC 에 대해 문의' ELSE substr(text, 1, 30) END, chr(10), text)"
LINE = rf"regexp_replace(regexp_replace(lower(string_split({strip_sql('text')}, chr(10))[1]), '{S}+', ' ', 'g'), '{S}*([.?!,:;]){S}*', '\1 ', 'g')"
LIKELY = " OR ".join(f"regexp_matches({strip_sql(LINE)}, '{p.replace(chr(92) + 's', S)}')" for p in confirmations())
UNLIKELY = " OR ".join(f"regexp_matches({strip_sql(LINE)}, '{p.replace(chr(92) + 's', S)}')" for p in NO_CONFIRM)
measure("confirmation_patterns", "requests", lambda x: may_confirm(normalized_column(first_line(x))), f"({LIKELY}) AND NOT ({UNLIKELY})")

# Evaluation of documents against three instructions.
SPECS = [("en:punctuation:no_comma", {}), ("en:length_constraints:number_words", {"num_words": 300, "relation": "at least"}), ("en:keywords:existence", {"keywords": ["the"]}), ("xx:no:such", {}), ("keywords", {}), ("ko:length_constraints:number_words", {"num_words": "7"})]
IDS = [i for i, _ in SPECS if i in I.REGISTRY]


def _turns(spark: SparkSession, sf_dir: str, specs=SPECS) -> DataFrame:
    ids, kwargs = F.array(*(F.lit(i) for i, _ in specs)), F.array(*(F.lit(json.dumps(k)) for _, k in specs))
    return _documents(spark, sf_dir).select("doc_id", F.col("text").alias("response"), ids.alias("instruction_id_list"), kwargs.alias("kwargs"))


#: Patterns in Python's dialect, and what they come to in that of the SQL; None can't be compiled.
PATTERNS = [
    (r"\bdes\b", rf"(?i)(^|[^{W[1:-1]}])des($|[^{W[1:-1]}])"), (r"\w+ción\W", rf"(?i){W}+ción[^{W[1:-1]}]"), (r"é\s\S", f"(?i)é{S}{NS}"), (r"\d{3}", rf"{D}{{3}}"), (r"[[(]", r"[\[(]"), (r"\w\Z", rf"{W}\z"),
    (r"(?-i:[A-Z]\w+)$", rf"[A-Z]{W}+\n?\z"), (r"(?m:^the\b)", rf"(?i)(^|\n)the($|[^{W[1:-1]}])"), (r"(?#note)[a&&b]{2}", "(?i)[ab&]{2}"), (r"(the )?(?(1)cat|dog)", "(?i)(the cat|dog)"), (r"(?x) of \s the # two", f"(?i)of{S}the"), ("(", None), (r"(?P<x>[^\W\d_])ation(?!s)", None),
]
#: What RE2 has no syntax for is found by hand.
BY_HAND = {12: rf"regexp_matches(text, '(?i)[\p{{L}}]ation($|[^sSſ])')", 11: "false"}
PATTERN_SPECS = [("en:keywords:existence", {"keywords": [p]}) for p, _ in PATTERNS]
QUERIES["pattern_rules"] = lambda s, d: evaluate_turns(_turns(s, d, PATTERN_SPECS), ["doc_id"], ["en:keywords:existence"]).select("doc_id", *(F.array_join(F.transform(c, lambda v: v.cast("int").cast("string")), "").alias(n) for c, n in (("strict_list", "followed"), ("is_evaluated_list", "evaluated"))))
FOUND = [BY_HAND.get(k) or f"regexp_matches(text, '{q}')" for k, (_, q) in enumerate(PATTERNS)]
ORACLES["pattern_rules"] = f"SELECT doc_id, {' || '.join(f'CAST(CAST(coalesce({x}, false) AND NOT blank AS INT) AS VARCHAR)' for x in FOUND)} AS followed, '{''.join(str(int(p != '(')) for p, _ in PATTERNS)}' AS evaluated FROM (SELECT doc_id, text, NOT coalesce(regexp_matches(text, '{NS}'), false) AS blank FROM documents)"


def _done(spark: SparkSession, sf_dir: str, specs=SPECS) -> DataFrame:
    t = explode_specs(_turns(spark, sf_dir, specs), ["doc_id", "response"])
    return evaluate_specs(t, ["doc_id"], IDS).drop("response", "kwargs", "args_defaulted")


FOLLOW = [("en:punctuation:no_comma", "NOT contains(v, ',')"), ("en:length_constraints:number_words", n(W + "+", "v") + " >= 300"), ("en:keywords:existence", "regexp_matches(v, '(?i)the')")]
DONE = " UNION ALL ".join(
    f"SELECT doc_id, CAST({p} AS INTEGER) AS pos, '{i}' AS instruction_id, '{i}' AS resolved_id, 'ok' AS status, true AS evaluated, len(list_filter([text], lambda v: regexp_matches(v, '{NS}') AND {sql})) > 0 AS strict, len(list_filter([{VARIANTS}], lambda v: regexp_matches(v, '{NS}') AND {sql})) > 0 AS loose FROM documents"
    for p, (i, sql) in enumerate(FOLLOW)
) + "".join(f" UNION ALL SELECT doc_id, {p}, '{i}', {r}, '{st}', false, false, false FROM documents" for p, i, r, st in [(3, "xx:no:such", "NULL", "unsupported"), (4, "keywords", "NULL", "malformed_id"), (5, "ko:length_constraints:number_words", "'ko:length_constraints:number_words'", "bad_args")])
GOOD = SPECS[:3]
DONE3 = f"SELECT * FROM ({DONE}) WHERE pos < 3"

#: Rules that mean the same in both languages are evaluated in both; sentences of texts with runs of dots aren't in SQL.
ALL = [(i, kw, sql) for i, kw, sql in RULES if "number_sentences" not in i and "key_sentences" not in i]
ALL += [(f"ko:{i[3:]}", kw, sql) for i, kw, sql in ALL if i.startswith("en:") and not any(x in i for x in ("number_words", "constrained_response"))]
ALL += [("ko:length_constraints:number_words", {"num_words": 300, "relation": "at least"}, n(NS + "+") + " >= 300"), ("ko:keywords:frequency", {"keyword": "the", "frequency": 3, "relation": "equal to"}, n("(?i)the") + " = 3")]


def _all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with markup, against all these rules in one pass: what is followed in either mode, rule by rule."""
    ids, kwargs = F.array(*(F.lit(i) for i, _, _ in ALL)), F.array(*(F.lit(json.dumps(k)) for _, k, _ in ALL))
    turns = _texts(spark, sf_dir, "mixed").select("doc_id", F.col("text").alias("response"), ids.alias("instruction_id_list"), kwargs.alias("kwargs"))
    return exploded(evaluate_turns(turns, ["doc_id"], sorted({i for i, _, _ in ALL})), ["doc_id"])


QUERIES["eval_all_rules"] = _all_rules
MIXED = f"WITH m AS (SELECT doc_id, {_duck('mixed')} AS text FROM documents), v AS (SELECT doc_id, unnest([{VARIANTS}]) AS text, generate_subscripts([{VARIANTS}], 1) AS k FROM m)"
FLAGS = ", ".join(rf"coalesce(regexp_matches(text, '{NS}') AND ({sql}), false) AS r{p}" for p, (_, _, sql) in enumerate(ALL))
BOTH = ", ".join(f"{{'pos': {p}, 'instruction_id': '{i}', 'strict': bool_or(k = 1 AND r{p}), 'loose': bool_or(r{p})}}" for p, (i, _, _) in enumerate(ALL))
ORACLES["eval_all_rules"] = f"{MIXED} SELECT doc_id, CAST(o.pos AS INTEGER) AS pos, o.instruction_id, 'ok' AS status, true AS evaluated, o.strict, o.loose FROM (SELECT doc_id, unnest([{BOTH}]) AS o FROM (SELECT doc_id, k, {FLAGS} FROM v) GROUP BY doc_id)"

QUERIES["eval_specs"] = _done
ORACLES["eval_specs"] = DONE


def _outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate_turns(_turns(spark, sf_dir, GOOD), ["doc_id"], IDS)


QUERIES["eval_turns"] = lambda s, d: _outcome(s, d).select("doc_id", "strict_all", "loose_all", F.size(F.filter("strict_list", lambda x: x)).cast("long").alias("n_strict"), F.size("loose_list").cast("long").alias("n"))
ORACLES["eval_turns"] = f"SELECT doc_id, bool_and(strict) AS strict_all, bool_and(loose) AS loose_all, CAST(count(*) FILTER (WHERE strict) AS BIGINT) AS n_strict, CAST(count(*) AS BIGINT) AS n FROM ({DONE3}) GROUP BY doc_id"
for mode in ("strict", "loose"):
    QUERIES[f"report_tiers_{mode}"] = lambda s, d, m=mode: report.tier_report(evaluate_turns(_turns(s, d), ["doc_id"], IDS), m)
    ORACLES[f"report_tiers_{mode}"] = f"SELECT CASE WHEN grouping(t0) = 1 THEN 'total' WHEN grouping(t1) = 1 THEN 'tier0' ELSE 'tier1' END AS tier, coalesce(t1, t0, 'all') AS name, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE {mode}) AS BIGINT) AS correct, CAST(count(*) FILTER (WHERE {mode}) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS accuracy FROM (SELECT split_part(instruction_id, ':', 1) AS t0, instruction_id AS t1, {mode} FROM ({DONE}) WHERE evaluated) GROUP BY GROUPING SETS ((t0), (t0, t1), ())"
QUERIES["eval_strict_report"] = lambda s, d: report.prompt_report(_outcome(s, d))
ORACLES["eval_strict_report"] = f"SELECT CAST(count(*) AS BIGINT) AS total_prompts, CAST(count(*) FILTER (WHERE f) AS BIGINT) AS correct_prompts, CAST(count(*) FILTER (WHERE f) AS DOUBLE) / count(*) AS prompt_level_accuracy, 1.0::DOUBLE AS evaluated_prompts_ratio FROM (SELECT doc_id, bool_and(strict) AS f FROM ({DONE3}) GROUP BY doc_id)"
SCORED = f"SELECT doc_id, CAST(bool_and(strict) AS INT)::DOUBLE AS strict_prompt_score, count(*) FILTER (WHERE strict) / 3.0::DOUBLE AS strict_inst_score, CAST(bool_and(loose) AS INT)::DOUBLE AS loose_prompt_score, count(*) FILTER (WHERE loose) / 3.0::DOUBLE AS loose_inst_score FROM ({DONE3}) GROUP BY doc_id"
OVERALL = "(strict_prompt_score + strict_inst_score + loose_prompt_score + loose_inst_score) / 4 AS overall_score"
ROUND = ", ".join(f"round({c}, 9) AS {c}" for c in report.SCORES)
QUERIES["turn_scores"] = lambda s, d: report.turn_scores(_outcome(s, d)).select("doc_id", *(F.round(c, 9).alias(c) for c in report.SCORES))
ORACLES["turn_scores"] = f"SELECT doc_id, {ROUND} FROM (SELECT *, {OVERALL} FROM ({SCORED}))"
MEANS = ", ".join(f"round(avg({c}), 9) AS {c}" for c in report.SCORES)
QUERIES["item_scores"] = lambda s, d: report.item_scores(report.turn_scores(_outcome(s, d)).withColumn("item", F.col("doc_id") % 50), "item").select("item", *(F.round(c, 9).alias(c) for c in report.SCORES))
ORACLES["item_scores"] = f"SELECT doc_id % 50 AS item, {MEANS} FROM (SELECT *, {OVERALL} FROM ({SCORED})) GROUP BY 1"
ANALYSIS = f"SELECT CAST(doc_id % 4 AS INTEGER) AS turn_index, avg(strict_prompt_score) AS prompt_level_strict_accuracy, avg(loose_prompt_score) AS prompt_level_loose_accuracy, avg(strict_inst_score) AS instruction_level_strict_accuracy, avg(loose_inst_score) AS instruction_level_loose_accuracy FROM ({SCORED}) WHERE doc_id % 4 > 0 GROUP BY 1"
FIVE = ("prompt_level_strict_accuracy", "prompt_level_loose_accuracy", "instruction_level_strict_accuracy", "instruction_level_loose_accuracy")
ANALYSIS = f"SELECT *, ({' + '.join(FIVE)}) / 4 AS overall_accuracy FROM ({ANALYSIS})"


def _analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.turn_analysis(_outcome(spark, sf_dir).withColumn("turn_index", (F.col("doc_id") % 4).cast("int")))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


FIVE = (*FIVE, "overall_accuracy")
QUERIES["turn_analysis"] = lambda s, d: _rounded(_analysis(s, d))
ORACLES["turn_analysis"] = f"SELECT turn_index, {', '.join(f'round({c}, 9) AS {c}' for c in FIVE)} FROM ({ANALYSIS})"
QUERIES["overall_analysis"] = lambda s, d: _rounded(report.overall_analysis(_analysis(s, d)))
ORACLES["overall_analysis"] = f"SELECT {', '.join(f'round(avg({c}), 9) AS {c}' for c in FIVE)} FROM ({ANALYSIS})"


def _leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = report.leaderboard(_outcome(spark, sf_dir), "m", "c", "t", "d")
    return board.select("model_name", "dataset_category", "dataset_task", "dataset_name", *(F.round(f"metrics.{m}", 9).alias(m) for m in ("prompt_level_strict_acc", "inst_level_strict_acc", "prompt_level_loose_acc", "inst_level_loose_acc")))


QUERIES["leaderboard_row"] = _leaderboard
ORACLES["leaderboard_row"] = f"SELECT 'm' AS model_name, 'c' AS dataset_category, 't' AS dataset_task, 'd' AS dataset_name, round(avg(strict_prompt_score), 9) AS prompt_level_strict_acc, round(avg(strict_inst_score), 9) AS inst_level_strict_acc, round(avg(loose_prompt_score), 9) AS prompt_level_loose_acc, round(avg(loose_inst_score), 9) AS inst_level_loose_acc FROM ({SCORED})"

# Ingest.
WIDE = "SELECT CAST(doc_id AS STRING) AS key, lang AS language, text AS turn_1_prompt, '[\"a\"]' AS turn_1_instruction_id_list, '' AS turn_1_kwargs, '' AS turn_2_prompt, '' AS turn_2_instruction_id_list, '' AS turn_2_kwargs, source AS turn_3_prompt FROM documents"


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(WIDE.replace("FROM documents", "FROM {d}"), d=_table(spark, sf_dir, "documents"))


QUERIES["unpivot_turns"] = lambda s, d: ingest.unpivot_turns(_wide(s, d))
ORACLES["unpivot_turns"] = "SELECT CAST(doc_id AS VARCHAR) AS key, lang AS language, t.i AS turn_index, CASE WHEN t.i = 1 THEN nullif(text, '') ELSE nullif(source, '') END AS prompt, CASE WHEN t.i = 1 THEN '[\"a\"]' END AS instruction_id_list, CAST(NULL AS VARCHAR) AS kwargs FROM documents, (VALUES (1), (3)) AS t(i)"
QUERIES["json_cell_clean"] = lambda s, d: _table(s, d, "events").select("event_id", ingest.canonical_json(F.col("props")).alias("props"))
ORACLES["json_cell_clean"] = "SELECT event_id, CASE WHEN json_valid(props) THEN CAST(json(props) AS VARCHAR) ELSE props END AS props FROM events"
QUERIES["safe_model_name"] = lambda s, d: _table(s, d, "pages").select("page_id", ingest.safe_name(F.col("url")).alias("name"))
ORACLES["safe_model_name"] = "SELECT page_id, replace(replace(url, '/', '__'), ':', '_') AS name FROM pages"
QUERIES["dedup_keep_first"] = lambda s, d: ingest.dedup_first(_table(s, d, "documents"), "text", "doc_id").select("doc_id", "source")
ORACLES["dedup_keep_first"] = "SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text"
QUERIES["id_prefixing"] = lambda s, d: _table(s, d, "documents").select("doc_id", F.array_join(ingest.prefixed_ids(F.array(F.lit("a:b"), F.lit("c:d")), F.when(F.col("lang") == "en", "English").otherwise("Korean"), F.col("source")), ",").alias("ids"))
ORACLES["id_prefixing"] = "SELECT doc_id, CASE WHEN lang = 'en' THEN 'en:a:b,en:c:d' ELSE 'ko:a:b,ko:c:d' END AS ids FROM documents"
QUERIES["turn_discovery"] = lambda s, d: ingest.max_turn(_table(s, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.concat(F.lit("turn_"), F.col("turn").cast("string"))).alias("names"))).select("conv_id", "max_turn")
ORACLES["turn_discovery"] = "SELECT conv_id, CAST(max(turn) AS INTEGER) AS max_turn FROM conversations GROUP BY conv_id"
QUERIES["kwargs_parse"] = lambda s, d: _table(s, d, "events").select("event_id", F.array_join(ingest.kwargs_of(F.concat(F.lit("["), "props", F.lit(", 3]"))), "|").alias("kwargs"))
ORACLES["kwargs_parse"] = "SELECT event_id, CASE WHEN json_valid(props) THEN concat(CAST(json(props) AS VARCHAR), '|{}') ELSE '{}' END AS kwargs FROM events"
QUERIES["prompt_extract"] = lambda s, d: _table(s, d, "events").select("event_id", ingest.prompt_of(F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.col("event_type"))).alias("prompt"))
ORACLES["prompt_extract"] = "SELECT event_id, CASE WHEN event_id % 2 = 0 AND json_valid(props) THEN '' ELSE coalesce(CASE WHEN event_id % 2 = 0 THEN props ELSE event_type END, '') END AS prompt FROM events"
QUERIES["dataset_stats"] = lambda s, d: ingest.dataset_stats(_table(s, d, "events"), "props", "props").select("n", F.array_join("metadata_keys", ",").alias("metadata_keys"), F.col("input_types")["dict"].alias("dicts"), F.coalesce(F.col("input_types")["string"], F.lit(0)).cast("long").alias("strings"))
ORACLES["dataset_stats"] = "SELECT CAST(count(*) AS BIGINT) AS n, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT DISTINCT unnest(json_keys(props)) AS k FROM events WHERE json_valid(props))) AS metadata_keys, CAST(count(*) FILTER (WHERE json_valid(props)) AS BIGINT) AS dicts, CAST(count(*) FILTER (WHERE NOT json_valid(props)) AS BIGINT) AS strings FROM events"
QUERIES["clean_cells"] = lambda s, d: ingest.clean_cells(_table(s, d, "events").select("event_id", F.col("props").alias("turn_1_kwargs"), F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value")))
ORACLES["clean_cells"] = "SELECT event_id, CASE WHEN json_valid(props) THEN CAST(json(props) AS VARCHAR) ELSE props END AS turn_1_kwargs, CASE WHEN event_id % 3 > 0 THEN value END AS value FROM events"
QUERIES["item_labels"] = lambda s, d: ingest.item_labels(_table(s, d, "documents"), "source", "lang", "doc_id").select("doc_id", "label")
ORACLES["item_labels"] = "SELECT doc_id, concat(coalesce(source, concat('item_', doc_id)), ' (', coalesce(lang, 'Unknown'), ')') AS label FROM documents"
QUERIES["raw_accuracy"] = lambda s, d: report.raw_accuracy(_outcome(s, d)).select(F.round("accuracy", 9).alias("accuracy"))
ORACLES["raw_accuracy"] = f"SELECT round(avg(strict_prompt_score), 9) AS accuracy FROM ({SCORED})"
QUERIES["success_counts"] = lambda s, d: report.success_counts(_exchanges(s, d).withColumn("error", F.when(F.col("response").isNull(), F.lit("no response"))), "conv_id", "error")
QUERIES["nested_results"] = lambda s, d: report.nested_results(report.flat_results(report.turn_scores(_outcome(s, d)).withColumns({"item": F.col("doc_id") % 50, "turn_index": (F.col("doc_id") / 50).cast("int")}), "item")).select("item_index", F.size("results").cast("long").alias("n"), F.element_at("results", 1)["turn_index"].alias("first_turn"))
ORACLES["nested_results"] = "SELECT doc_id % 50 AS item_index, CAST(count(*) AS BIGINT) AS n, CAST(min(doc_id // 50) AS INTEGER) AS first_turn FROM documents GROUP BY 1"
QUERIES["kwargs_validation"] = lambda s, d: ingest.invalid_arguments(_table(s, d, "events").select("event_id", F.lit("en:punctuation:no_comma").alias("instruction_id"), F.col("props").alias("kwargs")), I.registry_table(s)).select("event_id", "problem")
ORACLES["kwargs_validation"] = "SELECT event_id, CASE WHEN json_valid(props) AND len(json_keys(props)) > 0 THEN concat('Invalid parameter: ', json_keys(props)[1]) END AS problem FROM events"
QUERIES["dataset_upsert"] = lambda s, d: ingest.upsert(_table(s, d, "labels"), _table(s, d, "labels").where("doc_id % 2 = 0").withColumn("toxic", F.lit(1).cast("int")), "doc_id").select("doc_id", "quality", F.col("toxic").cast("int").alias("toxic"))
ORACLES["dataset_upsert"] = "SELECT doc_id, quality, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE toxic END::INTEGER AS toxic FROM labels"

QUERIES["upsert_null_keys"] = lambda s, d: ingest.upsert(_table(s, d, "labels").select(F.expr("CASE WHEN doc_id % 3 > 0 THEN doc_id END").alias("key"), "quality"), _table(s, d, "labels").where("doc_id % 6 IN (0, 1)").select(F.expr("CASE WHEN doc_id % 6 = 1 THEN doc_id END").alias("key"), (F.col("quality") + 10).alias("quality")), "key").select("key", F.col("quality").cast("int").alias("quality"))
ORACLES["upsert_null_keys"] = "SELECT CASE WHEN doc_id % 3 > 0 THEN doc_id END AS key, CAST(quality + CASE WHEN doc_id % 6 IN (0, 1) THEN 10 ELSE 0 END AS INTEGER) AS quality FROM labels WHERE doc_id % 3 > 0 OR doc_id % 6 = 0"

# Joins and dialogues.
PAIRS = "(SELECT conv_id, turn, text AS prompt, CASE WHEN nr = 'assistant' THEN nt END AS response FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user')"


def _exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.exchanges(_table(spark, sf_dir, "conversations"))


QUERIES["user_assistant_pairs"] = _exchanges
ORACLES["user_assistant_pairs"] = f"SELECT * FROM {PAIRS}"
ORACLES["success_counts"] = f"SELECT CAST(count(*) FILTER (WHERE e = 0) AS BIGINT) AS successful, CAST(count(*) FILTER (WHERE e > 0) AS BIGINT) AS failed FROM (SELECT conv_id, count(*) FILTER (WHERE response IS NULL) AS e FROM {PAIRS} GROUP BY conv_id)"
QUERIES["prompt_response_join"] = lambda s, d: ingest.joined_by_text(_exchanges(s, d).select("conv_id", "turn", "prompt"), ingest.last_wins(_exchanges(s, d).where("response IS NOT NULL").withColumn("at", F.struct("conv_id", "turn")), "prompt", "response", "at"), "prompt").select("conv_id", "turn", "response")
ORACLES["prompt_response_join"] = f"SELECT p.conv_id, p.turn, r.response FROM {PAIRS} p JOIN (SELECT prompt, arg_max(response, conv_id * 1000000 + turn) AS response FROM {PAIRS} WHERE response IS NOT NULL GROUP BY prompt) r ON p.prompt = r.prompt"
for kind, how in (("answered_semi", "left_semi"), ("missing_responses_anti", "left_anti")):
    QUERIES[kind] = lambda s, d, h=how: _exchanges(s, d).join(_exchanges(s, d).where("response IS NOT NULL").select(F.col("conv_id").alias("c"), F.col("turn").alias("t")), (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), h).select("conv_id", "turn")
    ORACLES[kind] = f"SELECT conv_id, turn FROM {PAIRS} WHERE response IS {'NOT ' if how == 'left_semi' else ''}NULL"


def _lengths(histories: DataFrame) -> DataFrame:
    """Each history by its number of messages, their roles and the length of their texts."""
    return histories.select("conv_id", "turn", F.size("history").cast("long").alias("n"), F.array_join(F.transform("history", lambda h: h["role"]), ",").alias("roles"), F.length(F.array_join(F.transform("history", lambda h: h["text"]), "|")).cast("long").alias("chars"))


QUERIES["dialogue_history"] = lambda s, d: _lengths(dialogue.history(_table(s, d, "conversations")))
ORACLES["dialogue_history"] = "SELECT conv_id, turn, CAST(count(*) OVER w AS BIGINT) AS n, string_agg(role, ',') OVER w AS roles, CAST(sum(length(text)) OVER w + count(*) OVER w - 1 AS BIGINT) AS chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
QUERIES["stop_after_error"] = lambda s, d: dialogue.until_error(_exchanges(s, d).withColumn("error", F.when(F.length("prompt") < 100, F.lit("short"))), "conv_id", "turn", "error").select("conv_id", "turn", "error")
ORACLES["stop_after_error"] = f"SELECT conv_id, turn, error FROM (SELECT *, coalesce(sum(CASE WHEN error IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT *, CASE WHEN length(prompt) < 100 THEN 'short' END AS error FROM {PAIRS})) WHERE b = 0"


def _fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.sinks import collected, stream_folder

    return collected(dialogue.fold_stream(spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(f"{sf_dir}/conversations.parquet*")), stream_folder(spark))


QUERIES["dialogue_stream_fold"] = _fold
ORACLES["dialogue_stream_fold"] = "SELECT conv_id, turn, CAST(count(*) OVER w AS BIGINT) AS n_messages, CAST(sum(length(text)) OVER w AS BIGINT) AS n_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"


def _stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.sinks import collected, stream_folder

    said = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(f"{sf_dir}/conversations.parquet*")
    return _lengths(collected(dialogue.history_stream(said), stream_folder(spark)))


QUERIES["dialogue_stream_history"] = _stream_history
ORACLES["dialogue_stream_history"] = ORACLES["dialogue_history"]
