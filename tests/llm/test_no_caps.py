"""What holds however long a piece and however many buckets there are."""

import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_operators import model_of

from tallyrule.llm import pieces, sharding


@pytest.mark.parametrize("size", [63, 64, 65, 80, 200])
def test_long_user_pieces_equal_the_library(size):
    """A user-defined piece of any length is found before other text as well as at the end."""
    long = "q" * (size - 1) + "z"
    model = model_of([("a", -3.0, pieces.NORMAL), ("q", -4.0, pieces.NORMAL), ("z", -4.0, pieces.NORMAL), ("▁", -2.0, pieces.NORMAL), (long, 0.0, pieces.USER)], 1, squeeze=True, charsmap=b"")
    ours, library = pieces.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in [long, long + "a" * 100, "a" * 100 + long, f"a {long} a {long}", long[1:] + "a", long[:-1] + "a", long * 3]:
        assert ours.encode(text).tolist() == library.encode(text)
    assert pieces.longest(pieces.trie_of([long, "q"]), "x" + long + "a", 1) == long
    assert pieces.longest(pieces.trie_of([long, "q"]), "x" + long[:-1], 1) == "q"
    assert pieces.longest({}, "abc", 3) is None


def test_buckets_grow_with_the_rows(spark, monkeypatch):
    """More than 4096 buckets in a shard, found by a join that may be shuffled: slots have no gaps, the order is that of a broadcast."""
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit(8).cast("long").alias("size"))
    counts = []
    keep = sharding.stored
    monkeypatch.setattr(sharding, "stored", lambda df, label: counts.append(keep(df, label)) or counts[-1])
    once = {r.doc_id: (r[sharding.SHARD], r[sharding.SLOT]) for r in sharding.shuffle_shards(rows, shards=1, bucket_bytes=4).collect()}
    assert counts[0].count() > 4096 and sorted(s for _, s in once.values()) == list(range(6000))
    monkeypatch.setattr(sharding, "small", lambda df: df)
    assert once == {r.doc_id: (r[sharding.SHARD], r[sharding.SLOT]) for r in sharding.shuffle_shards(rows, shards=1, bucket_bytes=4).collect()}
