"""Steps whose cost has to grow with the input alone."""

import time

import pytest
from pyspark.sql import functions as F

from tallyrule.functions import text as X
from tallyrule.functions.sentences import count_sentences, split_sentences
from tallyrule.operators.evaluate import evaluate_specs
from tallyrule.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_long_texts_without_marks_have_their_sentences_counted_fast(spark):
    """Abbreviations are looked for only before a period (F8): 8 million code points."""
    x = spark.range(2).select(F.repeat(F.lit("abcdefg "), 500_000).alias("x"))
    x.limit(1).select(count_sentences(F.lit("A b. C"))).collect()
    start = time.time()
    assert {r.n for r in x.select(count_sentences(x.x).alias("n")).collect()} == {1}
    assert time.time() - start < 5


def test_texts_are_cut_once(spark):
    """pieces that are mentioned several times are made once."""
    df = spark.createDataFrame([("a. b *** c.",)], "x string")
    assert str(df.select(X.star_paragraphs(df.x).alias("v"))._jdf.queryExecution().analyzed()).count("split(") == 1


def test_parts_of_pairs_grow_in_number(spark, monkeypatch):
    """twice the input, twice the parts."""
    for part in (20_000, 10_000):
        monkeypatch.setattr(catalogue, "PART", part, raising=False)
        df = catalogue._pairs(spark, SF)
        assert df.rdd.getNumPartitions() >= 100_000 // part


def test_variants_are_made_for_what_needs_them(spark):
    """one instruction of a row makes the response's variants only where it tries them; lines are cut off by bytes."""
    df = spark.createDataFrame([(1, 0, "en:punctuation:no_comma", None, "a,\n b, c  \n\nd"), (2, 0, "xx:no:such", None, "é　\n"), (3, 0, "en:punctuation:no_comma", None, " \n a*b 　\t\nc,")], "k int, pos int, instruction_id string, kwargs string, response string")
    out = evaluate_specs(df, ["k"], ["en:punctuation:no_comma"])
    made = [x for x in str(out._jdf.queryExecution().analyzed()).split("\n") if " AS __texts" in x]
    assert len(made) == 1 and "array_distinct" not in made[0]
    assert {r.k: (r.status, r.strict, r.loose) for r in out.collect()} == {1: ("ok", False, False), 2: ("unsupported", False, False), 3: ("ok", False, True)}
    assert df.select("k", X.loose_variants(df.response).alias("v")).collect() == [
        (1, ["a,\n b, c  \n\nd", "b, c  \n\nd", "a,\n b, c", "b, c"]), (2, ["é　\n", "", "é"]), (3, [" \n a*b 　\t\nc,", "a*b 　\t\nc,", "a*b", " \n ab 　\t\nc,", "ab 　\t\nc,", "ab"]),
    ]


@pytest.mark.parametrize("korean", [True, False])
def test_long_texts_without_periods_are_split_fast(spark, korean):
    """what stands around a period is looked for only at one: 12 million code points of Hangul."""
    x = spark.range(8).select(F.repeat(F.lit("가나다라 하하 "), 166_000).alias("x"))
    x.limit(1).select(split_sentences(F.lit("A b. C"), korean)).collect()
    start = time.time()
    assert {r.n for r in x.select(F.size(split_sentences(x.x, korean)).alias("n")).collect()} == {1}
    assert time.time() - start < 12
    one = str(x.select(F.element_at(split_sentences(x.x, korean), 1).alias("v"))._jdf.queryExecution().analyzed())
    assert one.count("regexp_replace(") / one.count("split(") <= 10 and one.count("split(") == 1
    text = '1.2.3 Mr. Kim x.com 가. 나다. a.b.c.d. Ph.D. x... "안녕." 12.34.56 Inc. But U.S. He!'
    want = ["1.2.", "3 Mr. Kim x.com 가. 나다.", "a.b.c.d.", "Ph.D. x...", '"안녕".', "12.34.56 Inc. But U.S. He!"]
    if not korean:
        want = [want[0], "3 Mr. Kim x.com 가.", "나다.", *want[2:5], "12.34.56 Inc", "But U.S. He!"]
    assert spark.range(1).select(split_sentences(F.lit(text), korean).alias("v")).first().v == want
