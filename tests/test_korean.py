"""Keywords between white space, and kinds of confirmations that can be added to."""

from pyspark.sql import functions as F

from tallyrule.functions import korean

TEXTS = ["상태, 확인", "e-mail 주소를", "배송을 빨리 12 확인은 a", "３4 12", "은 는이", "가을에서의", " 　배송 상태\n", "", "것이다. 것이", "12.5 (주문)"]
WANT = [{"상태,", "확인"}, {"e-mail", "주소"}, {"배송", "빨리", "확인"}, {"３4"}, set(), {"가을에서"}, {"배송", "상태"}, set(), {"것이다."}, {"12.5", "(주문)"}]


def test_keywords(spark):
    assert [korean.keywords(t) for t in TEXTS] == WANT
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "k int, x string").select("k", korean.keyword_set(F.col("x")).alias("w")).collect()
    assert {r.k: set(r.w) for r in rows} == dict(enumerate(WANT)) and all(len(r.w) == len(set(r.w)) for r in rows)


def test_kinds_of_confirmations(spark, monkeypatch):
    assert list(korean.CONFIRM) == ["inquiry", "request", "verification", "information", "status"] and len(korean.confirmations()) == sum(map(len, korean.CONFIRM.values())) + len(korean.CONFIRM_ENDINGS)
    monkeypatch.setattr(korean, "CONFIRM", {k: list(v) for k, v in korean.CONFIRM.items()})
    line = "배송 상태 접수 완료"
    assert not korean.confirms(line, "배송 상태")
    korean.add_patterns(confirm={"status": ["접수 완료"], "receipt": ["접수됨"]})
    korean.add_patterns(confirm={"receipt": ["접수됨"]})
    assert korean.confirms(line, "배송 상태") and korean.CONFIRM["receipt"] == ["접수됨"]
    assert spark.range(1).select(korean.may_confirm(F.lit(line))).first()[0]
