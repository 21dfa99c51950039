"""Importance resampling: draws documents whose word features look like those of a target corpus."""

from __future__ import annotations

import zlib
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, OWN, read_table, small, stored, trimmed
from .spelling import CRC_SQL, crc_sql

BUCKETS = 10_000
#: What a text is known by once it was grouped: SHA-256 of its UTF-8 bytes.
KEY, COPIES, WORDS, WEIGHT, ROW = (OWN + x for x in ("key", "copies", "words", "weight", "row"))
#: A text with more than one in so many of all rows is a frequent one; there are fewer than this many.
FREQUENT = 1000

#: Bytes of words once A-Z are lower-cased: 0-9, a-z and all of other scripts.
IN_WORD = np.zeros(256, bool)
IN_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
IN_WORD[128:] = True
#: Longer words are hashed one by one, shorter ones all at once.
LONG = 48


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC = _crc_table()


@cache
def _shifted(length: int) -> np.ndarray:
    """4 x 256: what each byte of a crc32 becomes when `length` more bytes follow; crc32(a + b) is their xor, with crc32(b)."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(length):
        bits = CRC[bits & 255] ^ (bits >> 8)
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for bit in range(8):
            out[k] ^= np.where(np.arange(256) >> bit & 1, bits[8 * k + bit], np.uint32(0))
    return out


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes with A-Z lower-cased, the start and length of each word in them, and the number of words before each text and at the end."""
    low = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    at = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    raw = np.frombuffer(low.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = IN_WORD[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = at[:-1][np.diff(at) > 0]
    first[cuts] = inside[cuts]  # a word ends with its text
    start = np.flatnonzero(first)
    stop = np.zeros(len(raw) + 1, bool)
    stop[1:][inside] = True
    stop[:-1] &= ~inside | first
    stop[0] = False
    end = np.flatnonzero(stop)
    return raw, start, end - start, np.searchsorted(start, at)


def word_crcs(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of each word, byte by byte for all words that are long enough."""
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    short = np.flatnonzero(length <= LONG)
    for j in range(LONG):
        short = short[length[short] > j]
        if not len(short):
            break
        c = out[short]
        out[short] = CRC[(c ^ raw[start[short] + j]) & 255] ^ (c >> 8)
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > LONG):
        out[i] = zlib.crc32(raw[start[i] : start[i] + length[i]])
    return out


def pair_crcs(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of each word, a space and the next word, from those of the words."""
    c = crc[:-1] ^ np.uint32(0xFFFFFFFF)
    c = (CRC[(c ^ 32) & 255] ^ (c >> 8)) ^ np.uint32(0xFFFFFFFF)
    out, following = np.zeros(len(c), np.uint32), length[1:]
    order = np.argsort(following, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(following[order])) + 1):
        if len(part):
            shift, x = _shifted(int(following[part[0]])) if following[part[0]] <= LONG else _shifted.__wrapped__(int(following[part[0]])), c[part]
            out[part] = shift[0][x & 255] ^ shift[1][x >> 8 & 255] ^ shift[2][x >> 16 & 255] ^ shift[3][x >> 24]
    return out ^ crc[1:]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of all features of the texts, words before pairs of neighbours, and the number of words of each text."""
    raw, start, length, before = words_of(texts)
    crc = word_crcs(raw, start, length)
    text = np.repeat(np.arange(len(texts)), np.diff(before))
    if not len(crc):
        return np.zeros(0, np.int64), text, np.diff(before)
    same = text[1:] == text[:-1]
    buckets = np.concatenate([crc, pair_crcs(crc, length)[same]]) % np.uint32(BUCKETS)
    return buckets.astype(np.int64), np.concatenate([text, text[1:][same]]), np.diff(before)


def _tally(batches):
    """(bucket, n) over all of a task's rows (text, copies)."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        bucket, text, _ = features(batch.column("text"))
        copies = batch.column("copies").to_numpy(zero_copy_only=False)
        for m in np.unique(copies):
            total += m * np.bincount(bucket[(copies == m)[text]], minlength=BUCKETS)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(held, pa.int64()), "n": pa.array(total[held], pa.int64())})


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """The number of features in each bucket, over (text, copies). A vector of BUCKETS numbers, whatever the input."""
    rows = texts.mapInArrow(trimmed(_tally, texts.sparkSession), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 * log of each bucket's share in the target over that in the corpus), both smoothed by one."""
    up = (target + 1).astype(float) * float(corpus.sum() + BUCKETS)
    down = (corpus + 1).astype(float) * float(target.sum() + BUCKETS)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def _weigh(gain: np.ndarray, batches):
    """(key, copies, words, weight) of rows (key, text, copies): the floored mean of a text's gains."""
    for batch in batches:
        bucket, text, words = features(batch.column("text"))
        total = np.zeros(batch.num_rows, np.int64)
        np.add.at(total, text, gain[bucket])
        n = np.maximum(2 * words - 1, 1)
        cols = {KEY: batch.column("key"), COPIES: batch.column("copies"), WORDS: pa.array(words, pa.int64()), WEIGHT: pa.array(total // n, pa.int64())}
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def weights(docs: DataFrame, target: DataFrame, text_col: str, target_col: str) -> DataFrame:
    """(key, copies, words, weight) of each distinct text of docs, stored.

    Copies collapse by their full text, within a task first; features are made once for each text and count as often as
    it occurs. Null texts count as empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("text")
    once = lambda df, c: df.select(text(c)).groupBy("text").agg(F.count("*").alias("copies"))
    keyed = stored(once(docs, text_col).withColumn("key", F.unhex(F.sha2("text", 256))), "resample-texts")
    gain = gains(bucket_counts(once(target, target_col)), bucket_counts(keyed.select("text", "copies")))
    out = keyed.mapInArrow(trimmed(partial(_weigh, gain), docs.sparkSession), f"`{KEY}` binary, `{COPIES}` long, `{WORDS}` long, `{WEIGHT}` long")
    return stored(out, "resample-weights")


def joined_back(rows: DataFrame, weighed: DataFrame, n: int) -> DataFrame:
    """rows (key, ...) of n with words and weight. Rows of frequent texts meet a broadcast of fewer than FREQUENT rows, so that no key is hot."""
    found = weighed.drop(COPIES)
    if weighed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(found), KEY)
    frequent = F.col(COPIES) * FREQUENT > n
    often = F.broadcast(weighed.where(frequent).drop(COPIES))
    rest = rows.join(often.select(KEY), KEY, "left_anti").join(weighed.where(~frequent).drop(COPIES), KEY)
    return rows.join(often, KEY).unionByName(rest)


def ranked(rows: DataFrame, order: list, drawn: int) -> DataFrame:
    """rows with rank 1, 2, ... in this order, null beyond `drawn`.

    The rows are sorted by ranges and stored; a row's rank is its place in its range and the number of rows before the range."""
    at = F.monotonically_increasing_id()
    rows = stored(rows.orderBy(*order).withColumn(OWN + "at", at), "resample-sorted")
    part = F.shiftright(OWN + "at", 33)
    sizes = sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    before = np.concatenate([[0], np.cumsum([r.n for r in sizes])])
    starts = rows.sparkSession.createDataFrame([(r.part, int(b)) for r, b in zip(sizes, before, strict=False)], f"`{OWN}part` long, `{OWN}before` long")
    rank = F.col(OWN + "before") + F.col(OWN + "at").bitwiseAND(2**33 - 1) + 1
    out = rows.withColumn(OWN + "part", part).join(F.broadcast(starts), OWN + "part")
    return out.withColumn("rank", F.when(rank <= drawn, rank)).drop(OWN + "part", OWN + "before", OWN + "at")


def importance_sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = 25, min_words: int = 20, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score, rank: a row for each row of docs; rank is null for those not drawn.

    Words are runs of 0-9, a-z and code points from U+0080 on, after lower-casing A-Z; features are all words and pairs
    of neighbouring words, hashed into 10,000 buckets. A text's weight is the floored mean of its features' gains, that
    is of the log-ratio of a bucket's share in target to that in docs. score adds Gumbel noise that the seed and the id
    decide; of the rows with at least min_words words, percent % with the highest scores are drawn, without replacement.

    Texts without words (null, empty) have weight 0. A null id counts as an empty text in the noise and comes last among
    equals; rows that repeat an id and text have equal scores and follow each other in any order. An empty docs gives no
    rows; with an empty target, gains only tell how common a bucket is. Other columns aren't looked at."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias(KEY)), "resample-rows")
    weighed = weights(docs, target, text_col, target_col)
    held = weighed.agg(F.sum(COPIES).alias("n"), F.sum(F.when(F.col(WORDS) >= min_words, F.col(COPIES))).alias("able")).first()
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = joined_back(rows, weighed, held.n or 0).withColumn("score", F.col(WEIGHT) + noise)
    scored = scored.select("doc_id", F.greatest(2 * F.col(WORDS) - 1, F.lit(0)).cast("long").alias("n_features"), F.col(WEIGHT).alias("weight"), "score", (F.col(WORDS) >= min_words).alias("able"))
    able = ranked(scored.where("able"), [F.desc("score"), F.asc_nulls_last("doc_id")], percent * (held.able or 0) // 100)
    return able.unionByName(scored.where("NOT able").withColumn("rank", F.lit(None).cast("long"))).drop("able")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark").select("text"))


def _features_sql(table: str, row: str) -> str:
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""(SELECT {row} AS row_id, unnest(w || list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) AS f FROM (SELECT *, {words} AS w FROM {table}))"""


SQL = rf"""
WITH {CRC_SQL},
a AS (SELECT row_id, f FROM {_features_sql("documents", "doc_id")}),
z AS (SELECT f FROM {_features_sql("benchmark", "item_id")}),
k AS (SELECT f, {crc_sql("f")} % 10000 AS b FROM (SELECT f FROM a UNION SELECT f FROM z), crc_table),
s AS (SELECT b, count(*) AS s FROM a JOIN k ON a.f = k.f GROUP BY b),
t AS (SELECT b, count(*) AS t FROM z JOIN k ON z.f = k.f GROUP BY b),
g AS (SELECT i AS b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM a) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM z) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT unnest(range(10000)) AS i) LEFT JOIN s ON s.b = i LEFT JOIN t ON t.b = i),
w AS (SELECT row_id, count(*) AS n, sum(gain)::BIGINT AS total FROM a JOIN k ON a.f = k.f JOIN g ON g.b = k.b GROUP BY row_id),
d AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END::BIGINT AS weight,
  CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h FROM documents LEFT JOIN w ON row_id = doc_id),
e AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score, (n_features + 1) // 2 >= 20 AS able FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE able) OVER () AS held FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * held // 100 THEN place END AS rank FROM r
"""
