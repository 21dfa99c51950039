"""Every query of the catalogue gives what its SQL gives, on the smallest tables."""

import re
from collections import Counter

import duckdb
import pytest

from tallyrule.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "conversations", "events", "labels", "pages")


def rows(frame, columns):
    frame = frame[columns].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name not in catalogue.ORACLES:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_rephrase_overlap_reads_whole_texts(spark, tmp_path):
    """Shared words far behind the first 300 code points count, as often as the rarer side has them."""
    texts = ["a " * 400 + "End end x_1", "b " * 5000 + "END x_1 end end", None, "", "ÄB äb", "äb, äb; äB"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["rephrase_overlap"](spark, str(tmp_path)).collect()
    bags = [Counter(re.findall(r"\w+", (t or "").lower())) for t in texts]
    assert {r.doc_id: r.value for r in got} == {i: (b & bags[i + 1]).total() if i < 5 else 0 for i, b in enumerate(bags)}
    assert len(got) == 6 and max(r.value for r in got) == 3
