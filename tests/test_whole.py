"""what spares a response's variants, a rule's twin in the other language or the rest of a text leaves the verdicts as they are."""

import json
import random
import time

from pyspark.sql import functions as F

from tallyrule.functions import text as X
from tallyrule.functions.patterns import compiled
from tallyrule.operators.evaluate import evaluate_specs, evaluate_turns

SIGNS = ["a", "B", "AB", "z", "Z", "İ", "K", "Σ", "ß", "É", "é", "가", "1", "12", "1)", "2.", "the", "THE", "SECTION", "SECTION 1", "P.", "S.", "don't", "CAN'T", "'", '"', ",", ":", "...", "--", "[x]", "<<", ">>", "```", "*", "*", "**", "***", "******", "-", " ", " ", " ", "\n", "\n", "\n", "\n\n", "\n- ", "\n* ", "\t", "　", " ", "\x1c"]
RULES = [
    ("keywords:existence", {"keywords": ["the", "a"]}), ("keywords:forbidden_words", {"forbidden_words": ["a", "the"]}), ("keywords:letter_frequency", {"letter": "Z", "let_frequency": 2, "let_relation": "at least"}),
    *(("keywords:frequency", {"keyword": k, "frequency": 2, "relation": r}) for k in ("a", "a b", "a+", r"x?a\s?a|a", " ") for r in ("at least", "less than", "equal to")), ("keywords:frequency", {"keyword": "a"}), ("keywords:frequency", {"keyword": "the", "frequency": -1, "relation": "at least"}),
    *(("length_constraints:number_words", {"num_words": n, "relation": r}) for n in (0, 2.5, 4, 2_000_000) for r in ("at least", "less than", "equal to")), ("length_constraints:number_words", {}),
    *(("change_case:capital_word_frequency", {"capital_frequency": 2, "capital_relation": r}) for r in ("at least", "less than", "equal to")), ("length_constraints:number_syllables", {"num_syllables": 1, "relation": "at least"}),
    *(("detectable_format:number_bullet_lists", {"num_bullets": n}) for n in (1, 2)), ("detectable_format:number_digit_lists", {"num_digit_list": 1}), ("detectable_format:number_highlighted_sections", {"num_highlights": 1}), ("detectable_content:number_placeholders", {"num_placeholders": 1}),
    *(("detectable_format:multiple_sections", {"section_spliter": s, "num_sections": n}) for s in ("SECTION", "a", "1", "(a)", "A B") for n in (1, 2)), *(("detectable_content:postscript", {"postscript_marker": m}) for m in ("P.S.", "P.P.S", "z", "$")),
    ("detectable_format:constrained_custom_response", {"choices": ["the", "a B"]}), ("detectable_format:constrained_custom_response", {"choices": ["the$"]}), ("detectable_format:title", {}), ("combination:two_responses", {}), ("length_constraints:number_paragraphs", {"num_paragraphs": 1}),
    ("startend:end_checker", {"end_phrase": "AΣ"}), ("startend:end_checker", {"end_phrase": "i̇"}), ("combination:repeat_prompt", {"prompt_to_repeat": "AΣ"}), ("startend:quotation", {}), ("startend:single_quote", {}), ("length_constraints:nth_paragraph_first_word", {"num_paragraphs": 1, "nth_paragraph": 1, "first_word": "the"}),
    ("punctuation:no_comma", {}), ("keywords:existence", {"keywords": []}), ("keywords:frequency", {"keyword": 3}),
]
SPECS = [(f"{lang}:{n}", json.dumps(k)) for lang in ("en", "ko") for n, k in RULES]


def texts(n: int, most: int) -> list[str | None]:
    r = random.Random(7)
    return [None, "", " \n", *("".join(r.choice(SIGNS) for _ in range(r.randint(1, most))) for _ in range(n))]


def test_both_modes_of_random_texts(spark):
    """Loose is strict of any variant, and a turn's verdicts are those of its instructions by themselves."""
    ids = sorted({i for i, _ in SPECS})
    df = spark.createDataFrame(list(enumerate(texts(250, 14))), "k int, response string").repartition(8)
    turns = df.withColumn("instruction_id_list", F.array(*(F.lit(i) for i, _ in SPECS))).withColumn("kwargs", F.array(*(F.lit(k) for _, k in SPECS)))
    out = evaluate_turns(turns, ["k"], ids)
    assert "__first" in str(out._jdf.queryExecution().analyzed())
    got = {r.k: (r.status_list, r.strict_list, r.loose_list, r.args_defaulted_list) for r in out.collect()}
    parts = df.select("k", F.explode(F.coalesce(X.loose_variants(df.response), F.array(df.response))).alias("response"))
    one = F.posexplode(F.array(*(F.struct(F.lit(i).alias("instruction_id"), F.lit(k).alias("kwargs")) for i, k in SPECS))).alias("pos", "spec")
    alone = evaluate_specs(parts.select("k", "response", one).select("k", "response", "pos", "spec.*"), ["k"], ids)
    want = alone.groupBy("k", "pos").agg(F.first("status").alias("status"), F.max("strict").alias("loose"), F.first("args_defaulted").alias("defaulted")).collect()
    first = evaluate_specs(df.select("k", "response", one).select("k", "response", "pos", "spec.*"), ["k"], ids).collect()
    assert [(SPECS[r.pos], r, got[r.k][0][r.pos], got[r.k][2][r.pos]) for r in want if (got[r.k][0][r.pos], got[r.k][2][r.pos], got[r.k][3][r.pos]) != (r.status, r.loose, r.defaulted)] == []
    assert [(SPECS[r.pos], r.response) for r in first if (got[r.k][1][r.pos], got[r.k][2][r.pos]) != (r.strict, r.loose)] == []
    assert sum(r.loose and not r.strict for r in first) > 500


def test_short_cuts_measure_what_the_long_way_does(spark):
    x, low = F.col("x"), F.lower("x")
    short = spark.createDataFrame([(t,) for t in texts(6000, 16)], "x string").repartition(8)
    old = lambda a: F.length(low) - F.length(F.replace(low, F.lower(a), F.lit("")))
    capitals = F.size(F.filter(F.split(X.cut_words(x), " +", -1), lambda w: (w != "") & X.has_upper_only(w)))
    fence = X.strip(x)
    for f in ("```json", "```Json", "```JSON", "```"):
        fence = F.regexp_replace(fence, rf"\A{f}", "")
    splitter = compiled(F.array(F.array(F.lit(r":\s?SECTION\s?\d+\s?"))))
    pairs = [
        (X.capital_words(x), capitals), (X.unfenced(x), X.strip(F.regexp_replace(fence, r"```\z", ""))), (X.strip_long(x), X.strip(x)), (X.tokens(x), X.count(x, X.NOT_S + "+")), (X.words(x), X.count(x, X.W + "+")),
        *((X.letters(x, F.lit(a)), old(F.lit(a))) for a in ("z", "Z", "i", "k", "K", "é", "the")), *((reach(x, F.lit(n)), measure(x) >= n) for n in range(5) for reach, measure in ((X.words_reach, X.words), (X.tokens_reach, X.tokens))),
        (X.count(x, F.lit(rf"[S]ECTION{X.S}?{X.D}")), X.count(x, F.get(F.get(splitter, F.lit(0)), F.lit(0))["java"])),
    ]
    assert short.select(*(F.sum((~a.eqNullSafe(b)).cast("int")).alias(f"d{k}") for k, (a, b) in enumerate(pairs))).first().asDict() == {f"d{k}": 0 for k in range(len(pairs))}


def test_words_are_read_no_further_than_asked_for(spark):
    """8 texts of 3 million code points, in both modes."""
    df = spark.range(8).select("id", F.lit(0).alias("pos"), F.lit("ko:length_constraints:number_words").alias("instruction_id"), F.lit('{"num_words": 5, "relation": "less than"}').alias("kwargs"), F.repeat(F.lit("가나\n다 "), 600_000).alias("response"))
    ready = lambda d: {(r.strict, r.loose) for r in evaluate_specs(d, ["id"], ["ko:length_constraints:number_words"]).select("strict", "loose").collect()}
    assert ready(df.withColumn("response", F.lit("가"))) == {(True, True)}
    start = time.time()
    assert ready(df) == {(False, False)}
    assert time.time() - start < 8
