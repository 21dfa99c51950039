"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import OWN, read_table, small, stored, word_count

SIZE, HASH, AT, TAKEN, COPIES, SOURCE, SHARD, ID, ROWS, RANK = (OWN + x for x in ("size", "hash", "at", "taken", "copies", "source", "shard", "id", "rows", "rank"))


def _hash(id_col: str, seed: int) -> Column:
    """A seeded hash of the id; rows without one are told apart by their sizes."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null|"), F.col(SIZE).cast("string")))))


def source_targets(rows: DataFrame, weights: tuple[int, ...], share: float, repeat: int) -> DataFrame:
    """source, rank, size, target: weights repeat over the sources by code point, null last; a target above repeat
    times its source's size is cut to it and the excess goes to the others by weight, until none is above.

    The sources that are cut are a prefix in order of size / weight, so running sums find them at once. The tables
    have a row for each source, as a list of mixing weights has."""
    sizes = rows.groupBy(SOURCE).agg(F.sum(SIZE).alias("size"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col(SOURCE).isNull(), F.col(SOURCE).cast("binary"))) - 1)
    ranked = ranked.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("rank") % len(weights)).cast("double"))
    ranked = ranked.withColumn("cap", (F.col("size") * repeat).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({
        "budget": F.sum("size").over(every).cast("double") * share,
        "cut_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "rest": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    ranked = ranked.withColumn("is_cut", F.col("cap") / F.col("weight") * F.col("rest") + F.col("cut_before") <= F.col("budget"))
    cut = F.coalesce(F.sum(F.when(F.col("is_cut"), F.col("cap"))).over(every), F.lit(0.0))
    free = F.sum(F.when(~F.col("is_cut"), F.col("weight"))).over(every)
    target = F.when(F.col("is_cut"), F.col("cap")).otherwise(F.col("weight") * ((F.col("budget") - cut) / free))
    return ranked.select(SOURCE, "rank", "size", target.alias("target"), "budget")


def apportion(parties: DataFrame, by: list[str], weight: str, seats: Column, order: str) -> DataFrame:
    """parties with a column quota: seats of each group `by`, dealt by the highest quotients weight / (2 quota + 1).

    Rounding weight * seats / total gives each party its seats but for about half the number of parties in all;
    only the quotients near there are listed and ranked, a handful for each party however many seats there are."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    p = parties.withColumns({"__n": F.count("*").over(group), "__total": F.sum(weight).over(group), "__seats": seats})
    fair = F.when(F.col("__total") > 0, F.col(weight) * F.col("__seats") / F.col("__total")).otherwise(F.lit(0.0))
    p = p.withColumn("__round", F.floor(fair + 0.5)).withColumn("__slack", F.when(F.col("__total") > 0, F.ceil(F.col("__n") * F.col(weight) / F.col("__total") / 2)).otherwise(F.lit(0)) + 2)
    p = p.withColumn("__sure", F.greatest(F.lit(0), F.col("__round") - F.col("__slack")))
    p = p.withColumn("__open", F.col("__seats") - F.sum("__sure").over(group))
    near = p.select(*by, order, "__open", "__sure", F.col(weight).alias("__w"), F.explode(F.sequence("__sure", F.col("__round") + F.col("__slack"))).alias("__k"))
    best = Window.partitionBy(*by, *([] if by else [F.lit(1)])).orderBy(F.desc(F.col("__w") / (2 * F.col("__k") + 1)), order, "__k")
    won = near.where("__w > 0").withColumn("__rank", F.row_number().over(best)).where("__rank <= __open").groupBy(*by, order).agg(F.count("*").alias("__won"))
    if by:
        same = F.lit(True)
        for c in (*by, order):
            same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"w.{c}"))
        p = p.alias("p").join(won.alias("w"), same, "left").select("p.*", "w.__won")
    else:
        p = p.join(won, order, "left")
    return p.withColumn("quota", (F.col("__sure") + F.coalesce("__won", F.lit(0))).cast("long")).select(*parties.columns, "quota")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeat: int = 2, block: int = 32, shard_words: int = 65_536, seed: int = 7) -> DataFrame:
    """docs with __tr_size, __tr_source_size, __tr_target, __tr_taken and __tr_copies.

    Sources get blocks of `block` words by Sainte-Lague over their targets, then each source's blocks go to its shards
    by Sainte-Lague over their words: integer quotas. A shard lays its documents end to end in seeded order, `repeat`
    times, and takes the blocks of its quota from the start of that line. taken counts a document's words in them,
    repeats included, and is at most repeat * size; copies counts the times that its middle word is in them, for use of
    whole documents. A source has as many shards as its words ask for, however many that are.

    Null texts and texts without words have size 0 and take nothing. Null sources are a source of their own, the last.
    Rows that repeat an id, a source and a size lie side by side and share evenly what they take, rounded down; so reruns
    take the same numbers. An empty table gives no rows. size_col: a column that already holds the size.

    Ids and sizes alone go through the shuffles of the mix; texts are counted once, and meet the result at the end."""
    size = F.col(size_col) if size_col else word_count(F.col(text_col))
    rows = stored(docs.select(F.col(id_col).alias(ID), F.col(source_col).alias(SOURCE), size.alias(SIZE)), "mix-sizes")
    d = rows.withColumn(HASH, _hash(ID, seed))
    sources = source_targets(rows, weights, share, repeat)
    sources = apportion(sources, [], "target", F.round(F.col("budget") / block).cast("long"), "rank")
    # A power of two, so that a source that grows splits its shards.
    wanted = F.ceil(F.col("size") / shard_words)
    shards = F.when(wanted <= 1, F.lit(1).cast("long")).otherwise(F.expr(f"shiftleft(1L, length(bin(CAST(ceil(size / {shard_words}) AS BIGINT) - 1)))"))
    sources = stored(sources.withColumn("shards", shards), "mix-sources")
    known = small(sources).select(F.col(SOURCE).alias(OWN + "key"), F.col("rank").alias(RANK), F.col("size").alias(OWN + "source_size"), F.col("target").alias(OWN + "target"), F.col("shards").alias(OWN + "shards"), F.col("quota").alias(OWN + "quota"))
    d = d.join(known, F.col(SOURCE).eqNullSafe(F.col(OWN + "key"))).withColumn(SHARD, F.conv(F.substring(HASH, 1, 12), 16, 10).cast("long") % F.col(OWN + "shards"))
    stacks = stored(d.groupBy(RANK, SHARD, HASH, ID, SOURCE, SIZE).agg(F.count("*").alias(ROWS), *(F.first(OWN + c).alias(OWN + c) for c in ("source_size", "target", "quota"))), "mix-stacks")
    parts = stacks.groupBy(RANK, SHARD).agg(F.sum(F.col(SIZE) * F.col(ROWS)).alias("words"), F.first(OWN + "quota").alias("blocks"))
    parts = apportion(parts, [RANK], "words", F.col("blocks"), SHARD)
    parts = stored(parts.select(RANK, SHARD, (F.col("quota") * block).alias(OWN + "take"), F.col("words").alias(OWN + "words")), "mix-shards")

    line = Window.partitionBy(RANK, SHARD).orderBy(HASH, ID, SIZE).rowsBetween(Window.unboundedPreceding, -1)
    long = F.col(SIZE) * F.col(ROWS)
    mixed = stacks.withColumn(AT, F.coalesce(F.sum(long).over(line), F.lit(0))).join(small(parts), [RANK, SHARD])
    taken, copies = F.lit(0), F.lit(0)
    for n in range(repeat):  # the n-th time that the line is laid
        left = F.col(OWN + "take") - n * F.col(OWN + "words")
        taken = taken + F.least(F.greatest(left - F.col(AT), F.lit(0)), long)
        copies = copies + F.when((long > 0) & (F.col(AT) + F.floor(long / 2) < left), 1).otherwise(0)
    mixed = mixed.select(*(F.col(c).alias(c + "_") for c in (ID, SOURCE, SIZE)), OWN + "source_size", OWN + "target", F.floor(taken / F.col(ROWS)).cast("long").alias(TAKEN), copies.alias(COPIES))
    mixed = stored(mixed, "mix-taken")
    keys = dict(zip((ID, SOURCE, SIZE), (F.col(id_col), F.col(source_col), size), strict=True))
    same = F.col(ID).eqNullSafe(F.col(ID + "_")) & F.col(SOURCE).eqNullSafe(F.col(SOURCE + "_")) & (F.col(SIZE) == F.col(SIZE + "_"))
    # Merged by key at any size, so that a small table's plan is a large one's.
    return docs.withColumns(keys).join(mixed.hint("merge"), same).select(*docs.columns, SIZE, OWN + "source_size", OWN + "target", TAKEN, COPIES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    # Only what the mix needs is carried: sizes are counted once, and no text is joined.
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-counted")
    out = mix_sources(sized, size_col="size")
    return out.select("doc_id", "size", F.col(OWN + "source_size").alias("source_size"), F.col(OWN + "target").alias("target"), F.col(TAKEN).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents: a row for each time that the mix takes it."""
    return mix_sources(docs).where(F.col(COPIES) > 0).withColumn(OWN + "copy", F.explode(F.sequence(F.lit(1), F.col(COPIES)))).select(docs.columns)


SQL = r"""
WITH d0 AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
d AS (SELECT *, md5('7|' || coalesce(CAST(doc_id AS VARCHAR), 'null|' || CAST(size AS VARCHAR))) AS h FROM d0),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rnk FROM s0),
s2 AS (SELECT *, CAST([5, 2, 1][CAST(rnk % 3 AS INTEGER) + 1] AS DOUBLE) AS w, CAST(source_size * 2 AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget FROM s1),
s3 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut_before, sum(w) OVER (ORDER BY cap / w, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s2),
s4 AS (SELECT *, cap / w * rest + cut_before <= budget AS is_cut FROM s3),
s5 AS (SELECT *, CASE WHEN is_cut THEN cap ELSE w * ((budget - coalesce(sum(CASE WHEN is_cut THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT is_cut THEN w END) OVER ()) END AS target FROM s4),
q AS (SELECT rnk, target / (2 * k + 1) AS quotient, k, budget FROM s5, LATERAL (SELECT unnest(range(0, CAST(target / 32 AS BIGINT) + 50)) AS k) WHERE target > 0),
qr AS (SELECT *, row_number() OVER (ORDER BY quotient DESC, rnk, k) AS r FROM q),
blocks AS (SELECT rnk, count(*) AS blocks FROM qr WHERE r <= round(budget / 32) GROUP BY rnk),
s6 AS (SELECT s5.*, coalesce(blocks, 0) AS blocks, CASE WHEN ceil(source_size / 65536.0) <= 1 THEN 1 ELSE 1 << length(bin(CAST(ceil(source_size / 65536.0) AS BIGINT) - 1)) END AS shards FROM s5 LEFT JOIN blocks ON s5.rnk = blocks.rnk),
e AS (SELECT d.*, s6.rnk, s6.source_size, s6.target, s6.blocks, CAST('0x' || substr(h, 1, 12) AS BIGINT) % shards AS shard FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
p AS (SELECT rnk, shard, any_value(blocks) AS blocks, sum(size) AS words FROM e GROUP BY rnk, shard),
pq AS (SELECT rnk, shard, words / (2 * k + 1) AS quotient, k, blocks FROM p, LATERAL (SELECT unnest(range(0, CAST(words * 2 / 32 AS BIGINT) + 50)) AS k) WHERE words > 0),
pr AS (SELECT *, row_number() OVER (PARTITION BY rnk ORDER BY quotient DESC, shard, k) AS r FROM pq),
quotas AS (SELECT rnk, shard, count(*) * 32 AS take FROM pr WHERE r <= blocks GROUP BY rnk, shard),
f AS (SELECT e.*, p.words, coalesce(take, 0) AS take, coalesce(sum(size) OVER (PARTITION BY e.rnk, e.shard ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM e JOIN p ON e.rnk = p.rnk AND e.shard = p.shard LEFT JOIN quotas ON e.rnk = quotas.rnk AND e.shard = quotas.shard)
SELECT doc_id, size, source_size, target, CAST(least(greatest(take - pos, 0), size) + least(greatest(take - words - pos, 0), size) AS BIGINT) AS taken FROM f
"""
