"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import OWN, read_table, shared_dir, small, stored

SHARD, BUCKET, PAGE, SLOT, SIZE = (OWN + x for x in ("shard", "bucket", "page", "slot", "size"))


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard whose seeded hash with the key is the highest: one more shard takes keys only into itself."""
    draws = F.array(*(F.xxhash64(key, F.lit(k), F.lit(seed)) for k in range(shards)))
    return (F.array_position(draws, F.array_max(draws)) - 1).cast("int")


def fisher_yates(n: Column, draw) -> Column:
    """A permutation of 0 to n - 1: for i from n - 1 down to 1, place i changes with place draw(i) % (i + 1)."""

    def step(order: Column, i: Column) -> Column:
        j = F.pmod(draw(i), i + 1).cast("int")
        at = lambda k: F.get(order, k)
        return F.transform(order, lambda x, k: F.when(k == i, at(j)).when(k == j, at(i)).otherwise(x))

    return F.aggregate(F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>")), F.sequence(F.lit(0), n - 1), step)


def shuffle_shards(rows: DataFrame, id_col: str = "doc_id", size_col: str = "size", shards: int = 24, bucket_bytes: int = 32 << 20, bucket_rows: int = 128, seed: int = 11) -> DataFrame:
    """rows with __tr_shard and __tr_slot; the slots of a shard are 0, 1, ... in a random order of its rows.

    Pass one scatters the rows evenly by seeded hashes into buckets of about bucket_bytes of size_col, each of one
    shard, and within these into pages of about bucket_rows. Pass two takes the pages of a bucket in turn, sorts the rows
    of one so that a rerun starts from the same order, shuffles them with Fisher-Yates, whose draws are hashes of the
    seed and the page, and lays page behind page and bucket behind bucket. So the rows and the seed alone decide the order,
    however many partitions there are.

    The id and the number of shards decide a row's shard (null ids: as a key of their own); the row's columns decide the
    page. Rows alike in all columns share a page and get slots of their own. An empty table gives no rows. Null sizes
    count as 0."""
    held = rows.agg(F.sum(size_col).alias("total"), F.count("*").alias("n")).first()
    per_shard = max(1, -(-int(held.total or 0) // (shards * bucket_bytes)))
    pages = max(1, -(-held.n // (shards * per_shard * bucket_rows)))
    # A map can't be hashed or sorted; such columns travel along.
    plain = [c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    whole = F.struct(*(F.col(c) for c in [*plain, *(c for c in rows.columns if c not in plain)]))
    place = F.pmod(F.xxhash64(*plain, F.lit(seed + 1)), F.lit(per_shard * pages))
    d = rows.select(shard_of(F.col(id_col), shards, seed).alias(SHARD), F.floor(place / pages).cast("int").alias(BUCKET), (place % pages).cast("int").alias(PAGE), whole.alias("row"))
    counts = stored(d.groupBy(SHARD, BUCKET).agg(F.count("*").alias("n")), "shard-counts")
    first = Window.partitionBy(SHARD).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.select(SHARD, BUCKET, F.coalesce(F.sum("n").over(first), F.lit(0)).alias("start")), "shard-starts")

    # By ranges, so that the partitions hold the shards' slots in order and need no second exchange.
    held = d.repartitionByRange(SHARD, BUCKET).groupBy(SHARD, BUCKET, PAGE).agg(F.collect_list("row").alias("rows"))
    held = held.withColumn("rows", F.array_sort("rows") if len(plain) == len(rows.columns) else F.col("rows"))
    before = Window.partitionBy(SHARD, BUCKET).orderBy(PAGE).rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("at", F.coalesce(F.sum(F.size("rows")).over(before), F.lit(0)))
    order = fisher_yates(F.size("rows"), lambda i: F.xxhash64(F.lit(seed), SHARD, BUCKET, PAGE, i))
    held = held.withColumn("rows", F.transform(order, lambda k: F.get("rows", k)))
    out = held.join(small(starts), [SHARD, BUCKET]).select(SHARD, (F.col("start") + F.col("at")).alias("start"), F.posexplode("rows").alias("pos", "row"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in rows.columns), SHARD, (F.col("start") + F.col("pos")).alias(SLOT))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard", slot_col: str = "slot", **options) -> None:
    """Whole records as Parquet, a folder for each shard (column shard), its rows in order of column slot, file by file.

    Where docs has columns of these names, the new ones get an underscore more; shard_col and slot_col name them otherwise."""
    sized = docs.withColumn(SIZE, record_size(F.col(text_col)))
    out = shuffle_shards(sized, id_col, SIZE, **options).drop(SIZE)
    have = {c.lower() for c in docs.columns}
    while shard_col.lower() in have:
        shard_col += "_"
    while slot_col.lower() in have | {shard_col.lower()}:
        slot_col += "_"
    out.withColumnsRenamed({SHARD: shard_col, SLOT: slot_col}).sortWithinPartitions(shard_col, slot_col).write.partitionBy(shard_col).parquet(path)


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards of whole documents to the shared folder; each row tells of a record as read back from there."""
    docs = read_table(spark, sf_dir, "documents")
    path = f"{shared_dir(spark)}/tables/shards-{uuid.uuid4().hex}"
    write_shards(docs, path)
    out = spark.read.schema(docs.withColumns({"slot": F.lit(0).cast("long"), "shard": F.lit(0)}).schema).parquet(path)
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    return out.select("doc_id", record_size(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", shard_of(F.col("doc_id"), 25, 11).alias("grown_shard"))
