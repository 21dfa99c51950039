"""Exact dedup over an extendible-hash index in shared files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, ascii_lower, read_table, small, stored

#: What tells texts apart before their bytes are compared: a 64-bit key and SHA-256 of the normalised text.
KEY, SHA = OWN + "key", OWN + "sha"


def _slot(bits: int) -> Column:
    """The leading bits of a key."""
    return F.expr(f"shiftrightunsigned(`{KEY}`, {64 - bits})")


def directory(entries: DataFrame, capacity: int, bits: int) -> DataFrame:
    """(slot, bucket, depth) of the extendible hash: the bucket that each of the 2**bits slots points to.

    A bucket of local depth d holds the keys that share d leading bits, and is named by its first slot. While a bucket
    holds more than capacity entries it is split in two and the slots are dealt anew; at depth `bits` a bucket overflows.
    Held are sums of slots; a prefix that holds too many is split, and what its halves aren't split again are buckets."""
    slots = entries.groupBy(_slot(bits).alias("slot")).agg(F.count("*").alias("n"))
    prefixes = slots.select("n", F.posexplode(F.array(*(F.shiftright("slot", bits - d) for d in range(bits + 1)))).alias("depth", "prefix"))
    full = prefixes.groupBy("depth", "prefix").agg(F.sum("n").alias("held")).where((F.col("held") > capacity) & (F.col("depth") < bits)).select("depth", "prefix")
    halves = full.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    root = entries.sparkSession.range(1).select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"))
    buckets = root.unionByName(halves).join(full, ["depth", "prefix"], "left_anti")
    wide = F.expr(f"shiftleft(1L, {bits} - depth)")
    return buckets.select((F.col("prefix") * wide).alias("bucket"), "depth", wide.alias("wide")).select(F.explode(F.sequence("bucket", F.col("bucket") + F.col("wide") - 1)).alias("slot"), "bucket", "depth")


def build_index(rows: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame, int]:
    """The directory and the index of rows (doc_id, key, sha) in shared files, and the directory's bits.

    The index has a row for each key: its bucket, and the chain of the texts that the key stands for as (sha, last, n).
    Each bucket is written by one owner task, which holds a range of keys. There are as many bits as entries need at
    this capacity and some more, so that no bucket overflows unless a key itself does; a chain then grows."""
    entries = rows.groupBy(KEY, SHA).agg(F.max("doc_id").alias("last"), F.count("*").alias("n"))
    entries = stored(entries, "exact-entries")
    bits = max(1, (-(-entries.count() // capacity)).bit_length() + 2)
    slots = stored(directory(entries, capacity, bits), "exact-directory")
    owned = entries.withColumn("slot", _slot(bits)).join(small(slots), "slot").drop("slot").repartitionByRange("bucket")
    chain = F.array_sort(F.collect_list(F.struct(SHA, "last", "n"))).alias("chain")
    index = owned.groupBy("bucket", KEY).agg(chain, F.sum("n").alias("held"), F.first("depth").alias("depth")).sortWithinPartitions("bucket", KEY)
    return slots, stored(index, "exact-index"), bits


def _classes(docs: DataFrame, id_col: str, text_col: str, capacity: int) -> DataFrame:
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    digest = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"))
    rows = stored(digest.select("doc_id", F.xxhash64("norm").alias(KEY), F.unhex(F.sha2("norm", 256)).alias(SHA)), "exact-digest")
    slots, index, bits = build_index(rows, capacity)
    find = lambda df: df.withColumn("slot", _slot(bits)).join(small(slots.drop("depth")), "slot").drop("slot")

    chained = stored(index.where("held > 1").select("bucket", KEY), "exact-chains")
    compared = digest.withColumn(KEY, F.xxhash64("norm")).join(small(chained), KEY)
    classes = compared.groupBy("bucket", KEY, "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    classes = stored(classes.select("bucket", KEY, F.unhex(F.sha2("norm", 256)).alias(SHA), "keep_id", "group_size"), "exact-classes")

    out = find(rows).join(small(classes).withColumn("found", F.lit(True)), ["bucket", KEY, SHA], "left")
    keep_id = F.when(F.col("found"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", KEY, SHA, keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"))


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, a row for each input row.

    Texts are equal when their bytes are, after lower-casing A-Z; the row with the largest id stays. Null texts count
    as empty. Rows without an id lose against any id; if no row of a group has one, keep_id is null and all stay.
    Rows that repeat an id and its text are one document and stay or go together, each counted in group_size; rows that
    repeat an id with another text are another document. An empty table gives no rows; other columns of docs are not
    looked at.

    1. A digest of each row (64-bit key, SHA-256) goes to shared files. 2. Copies collapse into index entries before
    they are shuffled. 3. The directory splits overfull buckets by doubling; the index is written in ranges of buckets,
    each owned by one task, which chains what shares a key. 4. Where a key stands for several rows, the texts alone are
    fetched again and compared by bytes, copies of one text collapsing before they move. 5. Each row finds its bucket
    through the directory, and there its class."""
    return _classes(docs, id_col, text_col, capacity).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex(SHA)).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096) -> DataFrame:
    """The rows of docs that stay, with all their columns. A row goes only if it has both the id and the text of one that goes."""
    gone = _classes(docs, id_col, text_col, capacity).where("NOT kept").select(F.col("doc_id").alias(OWN + "id"), F.col(KEY).alias(OWN + "k"), F.col(SHA).alias(OWN + "s"))
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    marked = docs.withColumns({KEY: F.xxhash64(norm), SHA: F.unhex(F.sha2(norm, 256))})
    same = (F.col(KEY) == F.col(OWN + "k")) & (F.col(SHA) == F.col(OWN + "s")) & F.col(id_col).eqNullSafe(F.col(OWN + "id"))
    return marked.join(gone, same, "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
"""
