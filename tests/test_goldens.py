"""Six golden rows or more for each registered instruction: arguments, text, and whether it is followed.

None: the arguments can't be used (bad_args); "fatal": a pattern or a code that can't be."""

import json
import unicodedata

import pytest

from tallyrule.operators.evaluate import evaluate_specs, evaluate_turns
from tallyrule.operators.instructions import REGISTRY

BOTH, EN, KO = ("en", "ko"), ("en",), ("ko",)
NFD = unicodedata.normalize("NFD", "한국")
YES = "My answer is yes."

#: name: [(languages, arguments, text, wanted)]
GOLDENS = {
    "keywords:existence": [
        (BOTH, {"keywords": ["cat", "dog"]}, "A Cat and a dog", True), (BOTH, {"keywords": ["cat", "dog"]}, "a cat", False), (BOTH, {"keywords": ["c.t"]}, "cut", True),
        (BOTH, {"keywords": ["("]}, "(", "fatal"), (BOTH, {"keywords": "cat"}, "cat", None), (BOTH, {"keywords": ["a{"]}, "xa{y", True), (KO, {"keywords": [NFD]}, "한국 사람", True), (EN, {"keywords": [NFD]}, "한국 사람", False), (KO, {"keywords": []}, "x", None),
    ],
    "keywords:frequency": [
        (BOTH, {"keyword": "an", "frequency": 3, "relation": "at least"}, "Banana AN", True), (BOTH, {"keyword": "an", "frequency": 3, "relation": "less than"}, "Banana AN", False), (BOTH, {"keyword": " an ", "frequency": 4, "relation": "at least"}, "Banana AN", False),
        (BOTH, {"keyword": "*", "frequency": 1, "relation": "at least"}, "*", "fatal"), (BOTH, {"keyword": "an", "frequency": "3", "relation": "at least"}, "x", None), (BOTH, {"keyword": "an", "frequency": 3, "relation": "more than"}, "x", None), (KO, {"keyword": "an", "frequency": 3, "relation": "equal to"}, "Banana AN", True),
    ],
    "keywords:key_sentences": [
        (KO, {"key_sentences": ["하나다.", "둘이다."], "num_sentences": 1}, "하나다. 셋이다.", True), (KO, {"key_sentences": ["하나다.", "둘이다."], "num_sentences": 2}, "하나다. 셋이다.", False), (KO, {"key_sentences": ["하나다.", "둘이다."], "num_sentences": 2}, "하나다. 둘이다.", True),
        (KO, {"key_sentences": ["하나"], "num_sentences": 1}, "하나다.", False), (KO, {"key_sentences": []}, "하나다.", None), (KO, {"key_sentences": [unicodedata.normalize("NFD", "둘이다.")], "num_sentences": 1}, "둘이다.", True),
    ],
    "keywords:forbidden_words": [
        (BOTH, {"forbidden_words": ["cat"]}, "concatenate Cat.", False), (BOTH, {"forbidden_words": ["cat"]}, "concatenate", True), (BOTH, {"forbidden_words": ["cat", "dog"]}, "a dog", False),
        (BOTH, {"forbidden_words": ["["]}, "x", "fatal"), (BOTH, {"forbidden_words": ["고양이"]}, "고양이가", True), (BOTH, {"forbidden_words": 3}, "x", None),
    ],
    "keywords:letter_frequency": [
        (BOTH, {"letter": "a", "let_frequency": 3, "let_relation": "at least"}, "Banana", True), (BOTH, {"letter": "A", "let_frequency": 4, "let_relation": "at least"}, "bAnAna", False), (BOTH, {"letter": "z", "let_frequency": 1, "let_relation": "less than"}, "abc", True),
        (BOTH, {"letter": "a", "let_frequency": 3, "let_relation": "about"}, "x", None), (BOTH, {"letter": "a", "let_frequency": "3", "let_relation": "at least"}, "x", None), (KO, {"letter": "a", "let_frequency": 3, "let_relation": "equal to"}, "Banana", True), (EN, {"letter": "a", "let_frequency": 3, "let_relation": "equal to"}, "Banana", None),
    ],
    "language:response_language": [
        (BOTH, {"language": "en"}, "The cat is in the hat and it is not on the mat", True), (BOTH, {"language": "de"}, "The cat is in the hat and it is not on the mat", False), (BOTH, {"language": "de"}, "Der Hund ist nicht auf der Straße und die Katze auch", True),
        (BOTH, {"language": "ko"}, "한국어로 씁니다", True), (BOTH, {"language": "xx"}, "x", "fatal"), (BOTH, {"language": "en"}, "12345", True), (EN, {"language": "zh"}, "中文", "fatal"), (KO, {"language": "zh"}, "中文", True),
    ],
    "language:formal_text": [
        (KO, {}, "선생님께서 말씀하셨습니다. 감사드립니다.", True), (KO, {}, "나는 밥을 먹었어", False), (KO, {}, "The cat is in the hat", False), (KO, {}, "안녕하세요", True), (KO, {}, "감사드립니다. 나는 간다", False), (KO, {}, "말씀 감사합니다", True),
    ],
    "length_constraints:number_sentences": [
        (BOTH, {"num_sentences": 2, "relation": "at least"}, "One is here. Two is there.", True), (BOTH, {"num_sentences": 3, "relation": "at least"}, "One is here. Two is there.", False), (BOTH, {"num_sentences": 2, "relation": "less than"}, "Dr. Smith went home.", True),
        (BOTH, {"num_sentences": "2", "relation": "at least"}, "a. b.", None), (BOTH, {"num_sentences": 2, "relation": "exactly"}, "a. b.", None), (BOTH, {"num_sentences": 2, "relation": "at least"}, "Is it? It is!", True), (EN, {"num_sentences": 3, "relation": "less than"}, 'He said "no." She, e.g. Ann, left at 3.15 p.m. today.no', True), (EN, {"num_sentences": 2, "relation": "less than"}, "Wait... what is it", True), (EN, {"num_sentences": 2, "relation": "at least"}, "Wait... What is it", True), (KO, {"num_sentences": 2, "relation": "equal to"}, "하나입니다. 둘입니다.", True),
    ],
    "length_constraints:number_paragraphs": [
        (BOTH, {"num_paragraphs": 2}, "a***b", True), (BOTH, {"num_paragraphs": 2}, "***a *** b***", True), (BOTH, {"num_paragraphs": 2}, "a******b", False), (BOTH, {"num_paragraphs": 2}, "a*** ***b", False), (BOTH, {"num_paragraphs": 1}, "a", True), (BOTH, {"num_paragraphs": 3}, "a***b", False), (BOTH, {"num_paragraphs": "2"}, "a***b", None),
    ],
    "length_constraints:number_words": [
        (BOTH, {"num_words": 3, "relation": "at least"}, "one two three", True), (BOTH, {"num_words": 4, "relation": "at least"}, "one two three", False), (BOTH, {"num_words": 4, "relation": "less than"}, "one two three", True),
        (BOTH, {"num_words": "100", "relation": "at least"}, "x", None), (EN, {"num_words": 5, "relation": "at least"}, "don't re-do it", True), (KO, {"num_words": 5, "relation": "at least"}, "don't re-do it", False), (KO, {"num_words": 3, "relation": "equal to"}, "don't re-do it", True), (EN, {"num_words": 3, "relation": "equal to"}, "a b c", None),
    ],
    "length_constraints:number_syllables": [
        (KO, {"num_syllables": 4, "relation": "equal to"}, "안녕 세상 ab", True), (KO, {"num_syllables": 5, "relation": "at least"}, "안녕 세상 ab", False), (KO, {"num_syllables": 5, "relation": "less than"}, "안녕 세상 ab", True), (KO, {"num_syllables": 1, "relation": "at least"}, "abc ㅋㅋ", False), (KO, {"num_syllables": "4", "relation": "at least"}, "안녕", None), (KO, {"num_syllables": 4, "relation": "about"}, "안녕", None),
    ],
    "length_constraints:nth_paragraph_first_word": [
        (BOTH, {"num_paragraphs": 2, "nth_paragraph": 2, "first_word": "world"}, 'Hello, you\n\n"World" is', True), (BOTH, {"num_paragraphs": 2, "nth_paragraph": 1, "first_word": "hello"}, "Hello, you\n\nWorld", True), (BOTH, {"num_paragraphs": 3, "nth_paragraph": 1, "first_word": "hello"}, "Hello, you\n\nWorld", False),
        (BOTH, {"num_paragraphs": 2, "nth_paragraph": 2, "first_word": "b"}, "a\n\n\n\nb", False), (BOTH, {"num_paragraphs": 2, "nth_paragraph": 1, "first_word": "you"}, "Hello, you\n\nWorld", False), (BOTH, {"num_paragraphs": "2", "nth_paragraph": 1, "first_word": "a"}, "a\n\nb", None), (KO, {"num_paragraphs": 1, "nth_paragraph": 1}, "a", None),
    ],
    "length_constraints:nth_paragraph_first_sentence": [
        (KO, {"num_paragraphs": 2, "nth_paragraph": 2, "first_sentence": "둘이다"}, "하나다. 또\n\n둘이다. 셋이다.", True), (KO, {"num_paragraphs": 2, "nth_paragraph": 1, "first_sentence": "하나다."}, "하나다. 또\n\n둘이다.", True), (KO, {"num_paragraphs": 3, "nth_paragraph": 1, "first_sentence": "하나다."}, "하나다. 또\n\n둘이다.", False),
        (KO, {"num_paragraphs": 2, "nth_paragraph": 2, "first_sentence": "하나다"}, "하나다.\n\n둘이다.", False), (KO, {"num_paragraphs": 1, "nth_paragraph": 1, "first_sentence": "hello there"}, "Hello there! You.", True), (KO, {"num_paragraphs": 1, "nth_paragraph": 1}, "하나다.", None),
    ],
    "detectable_content:number_placeholders": [
        (BOTH, {"num_placeholders": 2}, "[a] and [b]", True), (BOTH, {"num_placeholders": 3}, "[a] and [b]", False), (BOTH, {"num_placeholders": 2}, "[a][b\n] [c]", True), (BOTH, {"num_placeholders": 1}, "a]b[", False), (BOTH, {"num_placeholders": 1}, "[]", True), (BOTH, {"num_placeholders": "1"}, "[a]", None),
    ],
    "detectable_content:postscript": [
        (BOTH, {"postscript_marker": "P.S."}, "x P. S. y", True), (BOTH, {"postscript_marker": "P.S."}, "ps. y", False), (BOTH, {"postscript_marker": "P.P.S"}, "x\nP.P.S y", True), (BOTH, {"postscript_marker": "P.P.S"}, "P.S. y", False), (BOTH, {"postscript_marker": "NB"}, "a\nnb: x", True), (BOTH, {"postscript_marker": "("}, "(", "fatal"),
    ],
    "detectable_format:number_bullet_lists": [
        (BOTH, {"num_bullets": 3}, "- a\n* b\n**bold** x\n---", True), (BOTH, {"num_bullets": 2}, "- a\n- b", True), (BOTH, {"num_bullets": 1}, "- a\n- b", False), (BOTH, {"num_bullets": 1}, "a - b", False), (BOTH, {"num_bullets": 1}, "  * a", True), (BOTH, {"num_bullets": "1"}, "* a", None),
    ],
    "detectable_format:number_digit_lists": [
        (KO, {"num_digit_list": 3}, "1. a\n2) b\n3.c\nx 4. d", True), (KO, {"num_digit_list": 2}, "1. a\n2. b", True), (KO, {"num_digit_list": 1}, "a 1. b", False), (KO, {"num_digit_list": 1}, " 10) x", True), (KO, {"num_digit_list": 2}, "1. a", False), (KO, {"num_digit_list": "1"}, "1. a", None),
    ],
    "detectable_format:constrained_response": [
        (EN, {}, YES, True), (EN, {}, "Well. My answer is no. Bye", True), (EN, {}, "My answer is yes", False), (EN, {}, "my answer is yes.", False), (EN, {}, "제 답변은 예입니다.", False), (EN, {}, "My answer is maybe.", True),
        (KO, {}, "제 답변은 예입니다.", True), (KO, {}, "제 답변은 아니요입니다. 끝", True), (KO, {}, "제 답변은 아마도입니다.", True), (KO, {}, YES, False), (KO, {}, "제 답변은 예", False), (KO, {}, " ", False),
    ],
    "detectable_format:constrained_custom_response": [
        (KO, {"choices": ["가", "나"]}, "가 입니다", True), (KO, {"choices": ["가", "나"]}, "다 가", False), (KO, {"choices": ["가", "나"]}, "다\n  나", True), (KO, {"choices": ["가|나"]}, "나", True), (KO, {"choices": ["("]}, "(", "fatal"), (KO, {"choices": "가"}, "가", None),
    ],
    "detectable_format:number_highlighted_sections": [
        (BOTH, {"num_highlights": 1}, "**a**", True), (BOTH, {"num_highlights": 2}, "**a**", False), (BOTH, {"num_highlights": 1}, "*a*", True), (BOTH, {"num_highlights": 1}, "* x\n* y", False), (BOTH, {"num_highlights": 1}, "****", False), (BOTH, {"num_highlights": "1"}, "*a*", None),
    ],
    "detectable_format:multiple_sections": [
        (BOTH, {"section_spliter": "SECTION", "num_sections": 2}, "SECTION 1 a SECTION 2 b", True), (BOTH, {"section_spliter": "SECTION", "num_sections": 3}, "SECTION 1 a SECTION 2 b", False), (BOTH, {"section_spliter": "Part", "num_sections": 1}, "part 1", False),
        (BOTH, {"section_spliter": "(SEC|PART)", "num_sections": 4}, "SEC 1 a PART 2 b", True), (BOTH, {"section_spliter": "(", "num_sections": 1}, "( 1", "fatal"), (BOTH, {"section_spliter": "S", "num_sections": "1"}, "S 1", None),
    ],
    "detectable_format:json_format": [
        (BOTH, {}, '```json\n{"a":1}\n```', True), (BOTH, {}, "3", True), (BOTH, {}, "NaN", True), (BOTH, {}, "{a:1}", False), (BOTH, {}, '{"a":1,"a":2}', True), (BOTH, {}, "[1, 2", False), (BOTH, {}, '"x"', True),
    ],
    "detectable_format:markdown_format": [
        (KO, {}, "# a", True), (KO, {}, "plain", True), (KO, {}, "```\n```", False), (KO, {}, "```json\nx\n```", True), (KO, {}, "- a\n- b", True), (KO, {}, "   ", False),
    ],
    "detectable_format:title": [
        (BOTH, {}, "<<x>>", True), (BOTH, {}, "<< >>", False), (BOTH, {}, "<<a\nb>>", False), (BOTH, {}, "a <<b>> c", True), (BOTH, {}, "<x>", False), (BOTH, {}, "<<<y>>>", True),
    ],
    "combination:two_responses": [
        (BOTH, {}, "a******b", True), (BOTH, {}, "a******a", False), (BOTH, {}, "a************b", False), (BOTH, {}, "******a******b******", True), (BOTH, {}, "a", False), (BOTH, {}, "a******b******c", False),
    ],
    "combination:repeat_prompt": [
        (BOTH, {"prompt_to_repeat": " The Cat "}, "the cat sat", True), (BOTH, {"prompt_to_repeat": "cat"}, "the cat", False), (BOTH, {"prompt_to_repeat": "cat"}, "  CAT", True), (BOTH, {}, "x", None), (BOTH, {"prompt_to_repeat": 3}, "3", None), (KO, {"prompt_to_repeat": NFD}, "한국은", True), (EN, {"prompt_to_repeat": NFD}, "한국은", False),
    ],
    "combination:rephrasing_prompt": [
        (KO, {"prompt_to_rephrase": "배송 상태 확인"}, "배송 상태 확인을 요청하셨네요.\n답", True), (KO, {"prompt_to_rephrase": "배송 상태 확인"}, "네, 배송 상태 확인을 요청하셨네요.", False), (KO, {"prompt_to_rephrase": "배송 상태 확인"}, "오늘 날씨가 좋습니다.", False),
        (KO, {"prompt_to_rephrase": "배송 상태 확인"}, "답\n배송 상태 확인을 요청하셨네요.", False), (KO, {}, "배송", None), (KO, {"prompt_to_rephrase": ""}, "배송", None),
    ],
    "startend:end_checker": [
        (BOTH, {"end_phrase": "Any other questions?"}, '"Bye. Any other questions?"', True), (BOTH, {"end_phrase": "the end"}, "This is THE END", True), (BOTH, {"end_phrase": "the end"}, "the end.", False), (BOTH, {"end_phrase": " bye "}, "bye\n", True), (BOTH, {"end_phrase": 1}, "1", None), (KO, {"end_phrase": NFD}, "대한민국 한국", True), (EN, {"end_phrase": NFD}, "대한민국 한국", False),
    ],
    "startend:quotation": [(BOTH, {}, '"a"', True), (BOTH, {}, '"', False), (BOTH, {}, ' "a b" \n', True), (BOTH, {}, '"a', False), (BOTH, {}, "'a'", False), (BOTH, {}, '""', True)],
    "startend:single_quote": [(KO, {}, "'a'", True), (KO, {}, "'", False), (KO, {}, " 'a b' ", True), (KO, {}, "'a", False), (KO, {}, '"a"', False), (KO, {}, "''", True)],
    "change_case:capital_word_frequency": [
        (BOTH, {"capital_frequency": 2, "capital_relation": "at least"}, "AB cd EF", True), (BOTH, {"capital_frequency": 3, "capital_relation": "at least"}, "AB cd EF", False), (BOTH, {"capital_frequency": 1, "capital_relation": "less than"}, "Ab cd", True),
        (BOTH, {"capital_frequency": "2", "capital_relation": "at least"}, "AB", None), (BOTH, {"capital_frequency": 2, "capital_relation": "exactly"}, "AB", None), (BOTH, {"capital_frequency": 1, "capital_relation": "at least"}, "A1 b", True), (BOTH, {"capital_frequency": 3, "capital_relation": "at least"}, "DON'T go, U.S.A.", True), (BOTH, {"capital_frequency": 2, "capital_relation": "at least"}, "A/B-C (x)", False),
    ],
    "change_case:english_capital": [
        (BOTH, {}, "THE CAT IS IN THE HAT", True), (BOTH, {}, "THE CAT is IN THE HAT", False), (BOTH, {}, "DER HUND IST NICHT AUF DER STRASSE UND DIE KATZE AUCH", False), (BOTH, {}, "123", False), (BOTH, {}, "THE CAT, IT IS 3!", True), (BOTH, {}, "the cat", False),
    ],
    "change_case:english_lowercase": [
        (BOTH, {}, "the cat is in the hat", True), (BOTH, {}, "The cat is in the hat", False), (BOTH, {}, "der hund ist nicht auf der straße und die katze auch", False), (BOTH, {}, "123", False), (BOTH, {}, "the cat, it is 3!", True), (BOTH, {}, "THE CAT", False),
    ],
    "punctuation:no_comma": [(BOTH, {}, "a,b", False), (BOTH, {}, "a b", True), (BOTH, {}, "a، b", True), (BOTH, {}, "1,000", False), (BOTH, {}, "a; b.", True), (BOTH, {}, "  ", False)],
    "punctuation:no_period": [(KO, {}, "a.b", False), (KO, {}, "a b", True), (KO, {}, "a。b", True), (KO, {}, "3.5", False), (KO, {}, "a, b!", True), (KO, {}, "", False)],
}


@pytest.fixture(scope="module")
def cases():
    return [(f"{lang}:{name}", kwargs, text, want) for name, rows in GOLDENS.items() for langs, kwargs, text, want in rows for lang in langs]


def test_every_instruction_has_six(cases):
    assert {i: sum(c[0] == i for c in cases) for i in REGISTRY if sum(c[0] == i for c in cases) < 6} == {}


def test_goldens(spark, cases):
    df = spark.createDataFrame([(k, 0, i, json.dumps(a, ensure_ascii=False), t) for k, (i, a, t, _) in enumerate(cases)], "item int, pos int, instruction_id string, kwargs string, response string")
    got = {r.item: r for r in evaluate_specs(df, ["item"]).collect()}
    wrong = []
    for k, (i, a, t, want) in enumerate(cases):
        r = got[k]
        is_ = "fatal" if r.status == "fatal" else None if r.status == "bad_args" else r.strict
        if is_ != want or r.evaluated != isinstance(want, bool) or r.strict and not r.loose:
            wrong.append((i, a, t, want, is_, r.status))
    assert wrong == []


def test_one_bad_pattern_spares_the_others(spark):
    rows = [(1, ["en:keywords:existence", "en:punctuation:no_comma"], ['{"keywords": ["("]}', None], "a b"), (2, ["en:keywords:existence"], ['{"keywords": ["a"]}'], "a b"), (3, ["keywords:existence"], ['{"keywords": ["a"]}'], "a b")]
    df = spark.createDataFrame(rows, "k int, instruction_id_list array<string>, kwargs array<string>, response string")
    got = {r.k: r for r in evaluate_turns(df, ["k"]).collect()}
    assert got[1].status_list == ["fatal", "ok"] and got[1].strict_list == [False, True] and not got[1].strict_all
    assert got[2].strict_all and got[3].status_list == ["unsupported"]
    named = {r.k: r for r in evaluate_turns(df, ["k"], assume_lang="en").collect()}
    assert named[3].strict_all and named[3].status_list == ["ok"]


def test_defaults_are_told(spark):
    rows = [(1, 0, "en:keywords:frequency", '{"keyword": "a", "frequency": -1, "relation": "at least"}', "a"), (2, 0, "en:keywords:frequency", '{"keyword": "a", "frequency": 1, "relation": "at least"}', "a"), (3, 0, "en:punctuation:no_comma", "{}", "a"), (4, 0, "en:length_constraints:number_words", None, "a")]
    got = {r.item: r.args_defaulted for r in evaluate_specs(spark.createDataFrame(rows, "item int, pos int, instruction_id string, kwargs string, response string"), ["item"]).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}


def test_one_scan_without_shuffle(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "text AS response", "array('en:punctuation:no_comma') AS instruction_id_list", "array('{}') AS kwargs")
    plan = evaluate_turns(df, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan
