"""Golden rows of instructions: id, arguments, text, and whether it is followed (None: not evaluated)."""

import json

from tallyrule.operators.evaluate import evaluate_specs, evaluate_turns
from tallyrule.operators.instructions import REGISTRY, registry_table

CASES = [
    ('en:combination:two_responses', {}, 'a******b', True),
    ('en:combination:two_responses', {}, 'a******a', False),
    ('en:combination:two_responses', {}, 'a************b', False),
    ('en:detectable_format:json_format', {}, '```json\n{"a":1}\n```', True),
    ('en:detectable_format:json_format', {}, '3', True),
    ('en:detectable_format:json_format', {}, 'NaN', True),
    ('en:detectable_format:json_format', {}, '{a:1}', False),
    ('en:detectable_format:title', {}, '<<x>>', True),
    ('en:detectable_format:title', {}, '<< >>', False),
    ('en:keywords:forbidden_words', {'forbidden_words': ['cat']}, 'concatenate Cat.', False),
    ('en:keywords:forbidden_words', {'forbidden_words': ['cat']}, 'concatenate', True),
    ('en:startend:end_checker', {'end_phrase': 'Any other questions?'}, '"Bye. Any other questions?"', True),
    ('en:detectable_content:postscript', {'postscript_marker': 'P.S.'}, 'x P. S. y', True),
    ('en:detectable_content:postscript', {'postscript_marker': 'P.S.'}, 'ps. y', False),
    ('en:punctuation:no_comma', {}, 'a,b', False),
    ('en:startend:quotation', {}, '"a"', True),
    ('en:startend:quotation', {}, '"', False),
    ('en:keywords:frequency', {'keyword': 'an', 'frequency': 3, 'relation': 'equal to'}, 'x', None),
    ('ko:keywords:frequency', {'keyword': 'an', 'frequency': 3, 'relation': 'equal to'}, 'Banana AN', True),
    ('en:length_constraints:number_words', {'num_words': '100'}, 'x', None),
    ('ko:keywords:existence', {'keywords': []}, 'x', None),
    ('keywords:existence', {'keywords': ['a']}, 'a', None),
    ('en:language:response_language', {'language': 'zh'}, 'a', None),
    ('ko:language:formal_text', {}, '선생님께서 말씀하셨습니다. 감사드립니다.', True),
    ('ko:language:formal_text', {}, '나는 밥을 먹었어', False),
    ('fr:punctuation:no_comma', {}, 'a b', True),
    ('en:length_constraints:nth_paragraph_first_word', {'num_paragraphs': 2, 'nth_paragraph': 2, 'first_word': 'world'}, 'Hello, you\n\n"World" is', True),
    ('ko:combination:rephrasing_prompt', {'prompt_to_rephrase': '배송 상태 확인'}, '배송 상태 확인을 요청하셨네요.\n답', True),
    ('en:punctuation:no_comma', {}, '  ', False),
    ('en:change_case:english_capital', {}, 'THE CAT IS IN THE HAT', True),
    ('en:language:response_language', {'language': 'en'}, 'The cat is in the hat', True),
    ('ko:length_constraints:number_syllables', {'num_syllables': 4, 'relation': 'equal to'}, '안녕 세상 ab', True),
]


def test_goldens(spark):
    rows = [(i, 0, c, json.dumps(k), t) for i, (c, k, t, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "item int, pos int, instruction_id string, kwargs string, response string")
    got = {r.item: r for r in evaluate_specs(df, ["item"]).collect()}
    assert len(got) == len(CASES)
    for i, (name, kwargs, text, want) in enumerate(CASES):
        assert (got[i].strict if got[i].evaluated else None) == want, (name, kwargs, text, got[i])
        assert got[i].loose or not got[i].strict


def test_registry(spark):
    assert len(REGISTRY) == 60
    assert registry_table(spark).where("lang = 'en'").count() == 25


def test_turns(spark):
    rows = [(1, ["en:punctuation:no_comma", "xx:no:such"], ["{}", "{}"], "a b"), (2, ["en:punctuation:no_comma", "en:detectable_format:title"], ["{}", "{}"], "no, comma\n<<x>>"), (3, [], [], "x"), (4, ["en:punctuation:no_comma"], ["{}"], None)]
    df = spark.createDataFrame(rows, "k int, instruction_id_list array<string>, kwargs array<string>, response string")
    got = {r.k: r for r in evaluate_turns(df, ["k"], ["en:punctuation:no_comma", "en:detectable_format:title"]).collect()}
    assert (got[1].is_evaluated_list, got[1].strict_list, got[1].strict_all) == ([True, False], [True, False], False)
    assert (got[2].strict_list, got[2].loose_list, got[2].strict_all) == ([False, True], [True, True], False) and got[2].loose_all
    assert got[3].strict_all and got[3].strict_list == []
    assert (got[4].is_evaluated_list, got[4].strict_list) == ([True], [False])
