"""Exact top-k inner-product search with norm buckets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, small, stored

#: Ratio of the longest to the shortest length in a bucket.
RATIO = 1.1
#: From this local cosine threshold on, coordinates prune better than lengths.
COORDINATE_FROM = 0.7
LONG = 2**63 - 1
#: The bucket of vectors of length 0.
LOWEST = -(2**40)


def _packed(keys: list[str]):
    """Vectors of a group as one row: ids, and a matrix with the longest vector first."""

    def pack(table: pa.Table) -> pa.Table:
        v = np.stack(table.column("v").to_pylist()).astype(np.int64)
        ids = table.column("vec_id").to_numpy()
        order = np.lexsort((ids, -_lengths(v)))
        row = {k: [table.column(k)[0].as_py()] for k in keys} | {"ids": [ids[order].tobytes()], "m": [v[order].tobytes()]}
        return pa.Table.from_pydict(row, schema=pa.schema([*((k, pa.int64()) for k in keys), ("ids", pa.binary()), ("m", pa.binary())]))

    return pack


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype(np.float64) ** 2).sum(1))


def _products(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products; in floating point only where that is exact. Beyond 64 bits they stop at the limits."""
    most = max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))) * max(abs(int(q.max(initial=0))), abs(int(q.min(initial=0)))) * max(1, m.shape[1])
    if most < 2**53:
        return (m.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return np.array([min(LONG, max(-LONG - 1, int(x))) for x in m.astype(object) @ q.astype(object)], dtype=np.int64)


class Bucket:
    """A chunk of vectors of about one length, the longest first."""

    def __init__(self, ids: bytes, m: bytes, dim: int):
        self.ids, self.m = np.frombuffer(ids, np.int64), np.frombuffer(m, np.int64).reshape(-1, dim)
        self.length = _lengths(self.m)
        self.exact = self.m.astype(np.float64) if np.abs(self.m).max(initial=0) < 2**20 else None
        self.by_coordinate: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        """The chunk's unit vectors' coordinate c in order, and their places."""
        if c not in self.by_coordinate:
            unit = self.m[:, c] / np.maximum(self.length, 1e-300)
            order = np.argsort(unit, kind="stable")
            self.by_coordinate[c] = unit[order], order
        return self.by_coordinate[c]

    def top(self, qid: int, q: np.ndarray, least: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and products of the k best, of those that can reach `least`; ties to the smaller id.

        The local threshold is the cosine that a vector as long as the chunk's longest needs to reach `least`. Above 1,
        the chunk is skipped. If it is high, vectors are candidates whose coordinate, where the query is strongest, is
        near enough; else those that are long enough. Bounds have some slack for rounding; products are exact."""
        chosen: slice | np.ndarray = slice(None)
        size = float(_lengths(q[None])[0])
        if least is not None and least > 0:
            if not len(self.length) or (t := least / max(size * self.length[0], 1e-300)) > 1 + 1e-9:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            t = min(t, 1.0)
            if t >= COORDINATE_FROM:
                c = int(np.argmax(np.abs(q)))
                x = q[c] / size
                width = math.sqrt(max(0.0, 1 - x * x) * max(0.0, 1 - t * t))
                values, order = self.coordinate(c)
                # above the local threshold every cosine is feasible up to 1
                low = -1.0 if x <= -t else x * t - width
                high = 1.0 if x >= t else x * t + width
                chosen = order[np.searchsorted(values, low - 1e-9) : np.searchsorted(values, high + 1e-9, "right")]
            else:
                chosen = slice(int(np.searchsorted(-self.length, -(least / size) * (1 - 1e-9), "right")))
        ids = self.ids[chosen]
        small_q = np.abs(q).max(initial=0) < 2**20
        score = (self.exact[chosen] @ q.astype(np.float64)).astype(np.int64) if self.exact is not None and small_q and self.m.shape[1] < 2**12 else _products(self.m[chosen], q)
        keep = ids != qid
        if least is not None:
            keep &= score >= least
        ids, score = ids[keep], score[keep]
        if len(ids) > k:
            near = score >= np.partition(score, len(score) - k)[len(score) - k]
            ids, score = ids[near], score[near]
        best = np.lexsort((ids, -score))[:k]
        return ids[best], score[best]


def _search(k: int):
    def run(batches):
        buckets: dict[int, Bucket] = {}
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                if row["chunk"] not in buckets:
                    buckets = {row["chunk"]: Bucket(row["ids"], row["m"], dim)}
                bucket = buckets[row["chunk"]]
                qids, q = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_m"], np.int64).reshape(-1, dim)
                least = row["least"] or [None] * len(qids)
                found = [bucket.top(int(i), v, b, k) for i, v, b in zip(qids, q, least, strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "query_id": np.repeat(qids, [len(x) for x, _ in found]),
                    "vec_id": np.concatenate([x for x, _ in found]),
                    "score": np.concatenate([x for _, x in found]),
                })

    return run


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v) of the rows that take part: v holds floor(scale * x), x as double."""
    x = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(good).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def _bucket(length: Column) -> Column:
    """The number of a length's bucket; null lengths have none, 0 is below all."""
    return F.when(length > 0, F.floor(F.log(length) / math.log(RATIO))).when(length.isNotNull(), F.lit(LOWEST)).cast("long")


def reachable(asked: DataFrame, reached: DataFrame, buckets: DataFrame, block_of) -> DataFrame:
    """(dim, block, chunks): so many first chunks a block's queries have to meet.

    A query meets the buckets whose vectors may be long enough to reach its least score, one bucket more for rounding;
    without such a score, or with one that isn't above 0, all. buckets has some hundred rows for each size of vectors."""
    need = F.when((F.col("least") > 0) & (F.col("length") > 0), _bucket(F.col("least") / F.col("length")) - 1).otherwise(F.lit(LOWEST))
    of = block_of(asked.join(small(reached), asked.vec_id == F.col("query_id"), "left").withColumn("need", need))
    least = of.groupBy("dim", "block").agg(F.min("need").alias("need"))
    met = least.join(F.broadcast(buckets.withColumnRenamed("dim", "d")), (F.col("dim") == F.col("d")) & (F.col("bucket") >= F.col("need")))
    return met.groupBy("dim", "block").agg(F.max(F.col("first") + F.col("salts")).alias("chunks"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, chunk_rows: int = 4096, block_rows: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer products of each query with the other vectors of its size.

    is_query: a condition on vec_id. Ties go to the smaller vec_id; fewer than k others give fewer rows. Vectors that
    are null, empty or hold null or non-finite components, and rows without an id, take no part. A query never finds its
    own id. Rows that repeat an id are candidates each for itself; as queries they are one, which finds what any of its
    rows finds, as often as they find it. Empty tables give no rows; other columns are not looked at.

    Vectors are grouped by size and length (buckets of RATIO), large buckets are dealt into chunks of about chunk_rows.
    Queries come in blocks of about block_rows. A first pass over the chunk of the longest vectors gives each query a
    score that it reaches at least. A block's vectors then go only to chunks long enough for one of its queries to reach
    that score: chunks are numbered from the longest bucket down, so these are the first ones, and no vector is shipped
    to be turned down. Within a chunk the second pass prunes query by query."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e))
    v = scaled(vectors, id_col, vector_col, scale).withColumns({"dim": F.size("v").cast("long"), "length": length, "bucket": _bucket(length)})
    v = stored(v, "vectors")
    buckets = v.groupBy("dim", "bucket").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / chunk_rows).cast("long"))
    order = Window.partitionBy("dim").orderBy(F.desc("bucket"))
    buckets = stored(buckets.withColumn("first", F.sum("salts").over(order) - F.col("salts")), "buckets")
    keyed = v.join(small(buckets), ["dim", "bucket"]).withColumn("chunk", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("salts")))
    packed = "dim long, %s long, ids binary, m binary"
    chunks = stored(keyed.select("dim", "chunk", "vec_id", "v").groupBy("dim", "chunk").applyInArrow(_packed(["dim", "chunk"]), packed % "chunk"), "chunks")

    asked = v.where(is_query)
    blocks = stored(asked.groupBy("dim").agg(F.ceil(F.count("*") / block_rows).cast("long").alias("blocks")), "query-sizes")
    block_of = lambda q: q.join(small(blocks), "dim").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")))
    asked = block_of(asked)
    asked = asked.select("dim", "block", "vec_id", "v").groupBy("dim", "block").applyInArrow(_packed(["dim", "block"]), packed % "block")
    asked = stored(asked.select("dim", "block", F.col("ids").alias("q_ids"), F.col("m").alias("q_m")), "queries")

    schema = "query_id long, vec_id long, score long"
    lists = F.lit(None).cast("array<long>")
    first = asked.withColumns({"chunk": F.lit(0).cast("long"), "least": lists}).join(chunks, ["dim", "chunk"]).mapInArrow(_search(k), schema)
    reached = stored(first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least")), "reached")
    wanted = stored(reachable(v.where(is_query), reached, buckets, block_of), "wanted")

    by_block = asked.select("dim", "block", F.posexplode(_ids("q_ids")).alias("pos", "query_id")).join(small(reached), "query_id", "left")
    by_block = by_block.groupBy("dim", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "least"))), lambda s: s["least"]).alias("least"))
    pairs = asked.join(by_block, ["dim", "block"]).join(small(wanted), ["dim", "block"]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    found = pairs.join(chunks, ["dim", "chunk"]).mapInArrow(_search(k), schema)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _ids(raw):
    return raw.map(lambda b: np.frombuffer(b, np.int64))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
