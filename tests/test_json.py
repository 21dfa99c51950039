"""JSON is a whole text, not what a text begins with."""

from tallyrule.functions.text import is_json

NO = ["4763047826333361 Of the", '"a" b "c"', "1, 2", "1], [2", '1, "a"], ', "[1] [2]", "{} x", "1,", '1, "', "true false", "NaN 1", "{", "", "a", '1 "a\\"']
YES = ["1", ' "a b" ', "[1, 2]\n", '{"a": [1], "b": "], ["}', "null", "NaN", '[-Infinity, "NaN"]', "-0.5e3", '"\\""']


def test_nothing_may_follow_the_value(spark):
    rows = spark.createDataFrame([(x,) for x in NO + YES], "x string")
    got = {r.x: r.v for r in rows.select("x", is_json(rows.x).alias("v")).collect()}
    assert [x for x in NO if got[x] is not False] == []
    assert [x for x in YES if got[x] is not True] == []
