"""Histories of a stream, stopped and started again, against those of a batch."""

import random

from pyspark.sql import functions as F

from tallyrule.streaming.dialogue import history, history_stream, until_error

KINDS = "conv_id long, turn int, role string, text string, error string"


def run(spark, source, to, error=None):
    """All that is new in source, by a query that starts, takes a file in each batch, and ends."""
    stream = spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = history_stream(stream, error).writeStream.outputMode("append").format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/state")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{to}/out")


def plain(rows):
    return sorted((repr((r.conv_id, r.turn, r.role, r.text, [tuple(h) for h in r.history])) for r in rows))


def test_restarts_give_the_batch(spark, tmp_path):
    r = random.Random(2)
    said = [(c, t, "user" if t % 2 else "assistant", r.choice(["a", "b\n", "", None, "긴 글 " * 500]), "lost" if (c or 1) % 3 == 0 and t >= 3 else None) for c in [*range(12), None] for t in range(1, r.randint(2, 8))]
    every = spark.createDataFrame(said, KINDS)
    for low, high in ((1, 2), (3, 3), (4, 9)):  # each start sees turns that go on from the ones before
        every.where(F.col("turn").between(low, high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        whole = run(spark, f"{tmp_path}/in", f"{tmp_path}/whole")
        ended = run(spark, f"{tmp_path}/in", f"{tmp_path}/ended", "error")
    assert not whole.where("late").count() and plain(whole.collect()) == plain(history(every).collect())
    assert plain(ended.collect()) == plain(history(until_error(every, "conv_id", "turn", "error")).collect()) and ended.count() < whole.count()


def test_late_turns(spark, tmp_path):
    for rows in ([(1, 3, "user", "c", None), (1, 1, "user", "a", None)], [(1, 2, "user", "b", None), (1, 4, "user", "d", None), (1, None, "user", "x", None)]):
        spark.createDataFrame(rows, KINDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = run(spark, f"{tmp_path}/in", f"{tmp_path}/to").collect()
    assert {r.turn: r.late for r in got} == {1: False, 2: True, 3: False, 4: False, None: True}
    assert {r.turn: r.history and "".join(h.text for h in r.history) for r in got} == {1: "a", 2: None, 3: "ac", 4: "acd", None: None}
