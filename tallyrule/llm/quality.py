"""Quality classifier by positive-unlabelled learning."""

from __future__ import annotations

from functools import partial
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import OWN, read_table, stored, trimmed

#: Classes of a byte of UTF-8, in this order; any other byte is the last class.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", bytes(range(128, 256)), b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",;:", b"!?", b"|", b"#$%&*@", b"()[]'\"", b"-_", b"/\\", b"<>{}=+", b"")
K = len(CLASSES)
CLASS_OF = np.full(256, K - 1, dtype=np.int64)
for _i, _c in enumerate(CLASSES):
    CLASS_OF[list(_c)] = _i
#: Hashed places of three neighbouring bytes: what a text is made of, whatever its script.
GRAMS = 128
SIZE = K * K + GRAMS + 8
THRESHOLD = 0.3
#: Documents that are fitted on at once, about.
CHUNK = 8192
#: Bins of scores for the class prior.
BINS = 1000


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of neighbouring byte classes and of hashed byte triples, and eight measures of length and
    repetition, all from 0 to 1, in 255 steps.

    Whole text; null counts as empty, for which all are 0."""
    out = np.zeros(SIZE)
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    if not len(raw):
        return out.astype(np.uint8)
    kinds = CLASS_OF[raw]
    if len(raw) > 1:
        out[: K * K] = np.sqrt(np.bincount(kinds[:-1] * K + kinds[1:], minlength=K * K) / (len(raw) - 1))
    if len(raw) > 2:
        wide = raw.astype(np.uint32)
        place = (wide[:-2] * np.uint32(0x9E3779B1) ^ wide[1:-1] * np.uint32(0x85EBCA77) ^ wide[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(25)
        out[K * K : K * K + GRAMS] = np.sqrt(np.bincount(place, minlength=GRAMS) / len(place))
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    out[-8:] = (
        np.log1p(len(raw)) / 20, len(words) / len(raw), len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
        len(set(lines)) / len(lines), sum(w.isupper() for w in words) / n, sum(not w[-1].isalpha() for w in words) / n, sum(len(w) == 1 for w in words) / n,
    )
    return np.rint(255 * np.minimum(out, 1)).astype(np.uint8)


def matrix(rows) -> np.ndarray:
    """Stored features, one above the other, from 0 to 1."""
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, SIZE).astype(np.float32) / np.float32(255)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def centred(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.concatenate([(x - mean.astype(np.float32)) / scale.astype(np.float32), np.ones((len(x), 1), np.float32)], 1)


def risk_parts(p: np.ndarray, u: np.ndarray, w: np.ndarray, prior: float) -> tuple[float, float]:
    """prior * E_p[loss(+)] and E_u[loss(-)] - prior * E_p[loss(-)] with the logistic loss."""
    zp, zu = p @ w, u @ w
    loss = lambda z: np.logaddexp(0, -z).mean()
    return prior * loss(zp), loss(-zu) - prior * loss(-zp)


def descend(p: np.ndarray, u: np.ndarray, w: np.ndarray, prior: float | None, steps: int, rate: float, l2: float = 1e-4) -> np.ndarray:
    """Weights, the bias last, of a logistic model after full-batch Adam from w: the same input gives the same weights.

    With a prior, on the non-negative PU risk  prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]): where
    the second part is negative, the step is taken against it, so that the model doesn't fit the unlabelled rows that it
    has seen. Without one, on  (E_p[loss(+)] + E_u[loss(-)]) / 2, which tells positives from unlabelled rows."""
    w, m, v = w.astype(np.float32), np.zeros(len(w), np.float32), np.zeros(len(w), np.float32)
    for step in range(1, steps + 1):
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        if prior is None:
            g = (p.T @ (sp - 1) / len(p) + u.T @ su / len(u)) / 2
        else:
            plus = prior * (p.T @ (sp - 1)) / len(p)
            minus = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
            negative = -np.log(np.maximum(1 - su, 1e-9)).mean() + prior * np.log(np.maximum(1 - sp, 1e-9)).mean() < 0
            g = -minus if negative else plus + minus
        g = g + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - np.float32(rate) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from histograms of a score (bins of rising score) in either.

    As unlabelled = prior * positive + the rest, the prior is at most u(A) / p(A) for any set A of rows, and near that
    where the rest is rare. A is the rows above a score; the one is taken whose upper confidence bound is least (best bin
    estimation). No label of a negative is used."""
    n_p, n_u = max(1, positive.sum()), max(1, unlabelled.sum())
    p, u = np.cumsum(positive[::-1]) / n_p, np.cumsum(unlabelled[::-1]) / n_u
    slack = np.sqrt(np.log(40) / 2 / n_p) + np.sqrt(np.log(40) / 2 / n_u)
    seen = p > 0
    if not seen.any():
        return 0.5
    best = np.argmin((u[seen] + slack) / p[seen])
    return float(np.clip(u[seen][best] / p[seen][best], 0.01, 0.99))


def held_out(id_col: str) -> Column:
    """crc32 of the id as text is divisible by 5; rows without an id are held out."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 5 == 0, F.lit(True))


def featured(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """(id, x) for each row (id, text) of docs: its features, one byte each."""

    def run(batches):
        for batch in batches:
            x = [features(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["id", "x"])

    return docs.mapInArrow(trimmed(run, spark), f"id {docs.schema['id'].dataType.simpleString()}, x binary")


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """The distinct rows (id, x), of which there are about n, as one row x: array<binary> for each CHUNK of them.

    A hash of the row picks its chunk and rows are sorted in it, so that chunks are the same however rows are split over
    files and tasks. Repeats go before the shuffle; no chunk is large, as distinct rows spread evenly."""
    chunk = F.pmod(F.xxhash64("id", "x", F.lit(11)), F.lit(max(1, round(n / CHUNK))))
    return rows.groupBy(chunk.alias("chunk")).agg(F.array_sort(F.collect_set(F.struct("id", "x"))).alias("rows")).select(F.col("rows.x").alias("x"))


def _chunks(batches):
    """The rows of a task, CHUNK at a time, or as they are dealt."""
    held = []
    for batch in batches:
        if pa.types.is_list(batch.schema.field(0).type):
            for rows in batch.column(0):
                yield matrix(rows.as_py())
            continue
        held += batch.column(0).to_pylist()
        while len(held) >= CHUNK:
            yield matrix(held[:CHUNK])
            held = held[CHUNK:]
    if held:
        yield matrix(held)


def _sums(rows: DataFrame, make, size: int) -> np.ndarray:
    """The sum of the vectors (of size numbers) that make gives for the chunks of rows (x): added up by place in the cluster,
    so that the driver gets size rows however many chunks there are."""

    def run(batches):
        total = np.zeros(size)
        for x in _chunks(batches):
            total += make(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["place", "value"])

    found = rows.select("x").mapInArrow(trimmed(run, rows.sparkSession), "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[found["place"].to_numpy()] = found["value"].to_numpy()
    return out


def _moments(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]])


def _fitted(x, p, mean, scale, w, prior, steps, rate) -> np.ndarray:
    """The chunk's weights, times its rows, and its rows."""
    return np.append(len(x) * descend(p, centred(x, mean, scale), w, prior, steps, rate).astype(np.float64), len(x))


def _binned(x, mean, scale, w) -> np.ndarray:
    return np.bincount(np.minimum((sigmoid(centred(x, mean, scale) @ w) * BINS).astype(np.int64), BINS - 1), minlength=BINS)


def fit(feats: DataFrame, labels: DataFrame, max_rows: int = 2000, seed: int = 3):
    """A model from all rows (id, x) of feats that aren't held out, as unlabelled ones, and trusted positives.

    Trusted positives are documents that all their labels call 1; the model is fitted on at most max_rows of them, those of
    the lowest seeded hashes of ids and features: the bound that is documented for labelled rows. Everything else covers
    all rows: mean and scale of the features, the class prior, and the risk on unlabelled rows. Chunks of distinct rows,
    dealt by hash, are fitted side by side from the same weights and averaged (iterative parameter mixing, which suits a
    convex risk), a few rounds. What is summed over chunks is rounded, so that the order of sums doesn't show in a score.

    The prior is estimated from one half of the trusted rows, all of them, against all unlabelled rows, by a model that was
    fitted on the other half: first one that tells positives from unlabelled rows, then one of the risk with that prior.
    Labels of negatives decide nothing but which documents aren't trusted. Without positives in both halves, or without
    documents, there is no model: None."""
    judged = labels.where(F.col("quality").isin(0, 1) & ~held_out("doc_id")).groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("q"))
    fitted_on = feats.where(~held_out("id"))
    unlabelled = stored(dealt(fitted_on, fitted_on.count()), "unlabelled")
    draw = F.xxhash64("id", "x", F.lit(seed))
    trusted = stored(fitted_on.join(judged.where("q = 1"), "id", "left_semi").select("id", "x").distinct().withColumn("half", F.pmod(draw, F.lit(2))), "trusted")
    sample = trusted.orderBy(draw, "id", "x").limit(max_rows).select("x", "half").toArrow()
    first = sample["half"].to_numpy() == 0
    sums = _sums(unlabelled, _moments, 2 * SIZE + 1)
    n = sums[-1]
    if not n or first.all() or not first.any():
        return None
    mean = np.round(sums[:SIZE] / n, 6)
    scale = np.round(np.sqrt(np.maximum(sums[SIZE:-1] / n - mean**2, 0)) + 0.02, 6)
    p = centred(matrix(sample["x"].to_pylist()), mean, scale)

    def mixed(w, part, prior, steps, rate):
        total = _sums(unlabelled, partial(_fitted, p=part, mean=mean, scale=scale, w=w, prior=prior, steps=steps, rate=rate), SIZE + 2)
        return np.round(total[:-1] / total[-1], 5)

    def prior_by(w):
        binned = partial(_binned, mean=mean, scale=scale, w=w)
        return estimated_prior(_sums(trusted.where("half = 1"), binned, BINS), _sums(unlabelled, binned, BINS))

    prior = prior_by(mixed(np.zeros(SIZE + 1), p[first], None, 60, 0.05))
    w = np.append(np.zeros(SIZE), np.log(prior / (1 - prior)))
    w = mixed(w, p[first], prior, 80, 0.05)
    prior = prior_by(w)
    for steps, rate in ((100, 0.05), (50, 0.02)):
        w = mixed(w, p, prior, steps, rate)
    return mean, scale, w, prior


def scores(x: np.ndarray, model) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    mean, scale, w, _ = model
    return sigmoid((centred(x, mean, scale) @ w).astype(np.float64)) if len(x) else np.zeros(0)


def scorer(model, of_text: bool):
    """A function of a text column, or of one of features: the chance of quality, from 0 to 1. Without a model, 0.5."""

    def score(values: pd.Series) -> pd.Series:
        return pd.Series(scores(matrix([features(t).tobytes() for t in values] if of_text else list(values)), model))

    return F.pandas_udf(score, T.DoubleType())


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 2000) -> DataFrame:
    """docs with __tr_score. Texts alone are scored, whole; null counts as empty and is scored like any text.

    Rows that repeat are scored alike. Empty docs stay empty; with empty labels every score is 0.5. Other columns of
    docs (doc_id, text, ...) pass through. A null id or label is no label; a text without an id is held out."""
    spark = docs.sparkSession
    feats = stored(featured(docs.select(F.col("doc_id").alias("id"), "text"), spark), "features")
    return docs.withColumn(OWN + "score", scorer(fit(feats, labels.select("doc_id", "quality"), max_rows), True)("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    feats = stored(featured(docs, spark), "features")
    score = scorer(fit(feats, read_table(spark, sf_dir, "labels")), False)
    out = feats.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), score("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts."""
    return score_quality(docs, read_table(spark, sf_dir, "labels")).where(F.col(OWN + "score") >= THRESHOLD).select(docs.columns)
