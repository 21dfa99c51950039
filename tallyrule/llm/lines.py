"""Line dedup: lines that several documents share go from all but the last of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, OWN, ascii_lower, read_table, small, stored

ID, ROW, POS, H1, H2, KEEP, DROP, LINES, TEXT, CUT = (OWN + x for x in ("id", "row", "pos", "h1", "h2", "keep", "drop", "lines", "text", "cut"))


def _lines(text_col: str) -> Column:
    return F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)


def shared_lines(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """All long lines as (id, row, position, 96-bit hash), and those in at least min_docs documents with the id that keeps them."""
    lines = docs.select(F.col(id_col).alias(ID), F.xxhash64(text_col).alias(ROW), F.posexplode(_lines(text_col)).alias(POS, "line")).withColumn("line", ascii_lower(F.btrim("line", F.lit(BLANKS))))
    lines = lines.where(F.char_length("line") >= min_chars).select(ID, ROW, POS, F.xxhash64("line").alias(H1), F.hash("line").alias(H2))
    lines = stored(lines, "lines")  # texts are cut and hashed once
    # Rows without an id are one document more.
    documents = F.count_distinct(ID) + F.max(F.col(ID).isNull().cast("long"))
    found = lines.groupBy(H1, H2).agg(documents.alias("n"), F.max(ID).alias(KEEP)).where(F.col("n") >= min_docs).drop("n")
    return lines, stored(found, "lines-shared")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """docs with text_col cut to the lines that stay, and two columns __tr_lines and __tr_drop: lines before, lines dropped.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of at least min_chars code points in at
    least min_docs documents lose all their lines except in the document with the largest id. Null and empty texts are
    one empty line, which is too short to go; the text is then empty. Rows with the same id count as one document,
    and so do all rows without an id, which come before all ids; each row is cut for itself. Empty tables stay empty.

    Only hashes are shuffled to count; the positions to drop go back to the documents, whose line arrays are cut in
    place and joined again in order. A line in a third of all documents is counted by partial sums."""
    lines, found = shared_lines(docs, id_col, text_col, min_docs, min_chars)
    gone = lines.join(small(found), [H1, H2]).where(~F.col(ID).eqNullSafe(F.col(KEEP))).groupBy(ID, ROW).agg(F.collect_set(POS).alias(DROP))
    gone = gone.select(F.col(ID).alias(ID + "_"), F.col(ROW).alias(ROW + "_"), DROP)
    same = F.col(id_col).eqNullSafe(F.col(ID + "_")) & (F.xxhash64(text_col) == F.col(ROW + "_"))
    out = docs.join(gone, same, "left").drop(ID + "_", ROW + "_").withColumn(CUT, _lines(text_col))
    at = F.array_except(F.sequence(F.lit(0), F.size(CUT) - 1), F.col(DROP))
    kept = F.when(F.col(DROP).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(F.transform(at, lambda i: F.get(F.col(CUT), i)), "\n"))
    dropped = F.when(F.col(DROP).isNull(), F.lit(0)).otherwise(F.size(CUT) - F.size(at))
    out = out.withColumns({TEXT: kept, DROP: dropped.cast("long"), LINES: F.size(CUT).cast("long")})
    return out.withColumn(text_col, F.col(TEXT)).drop(TEXT, CUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col(LINES).alias("n_lines"), F.col(DROP).alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that many share; one that loses all its lines stays, empty."""
    return line_dedup(docs).select(docs.columns)


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.pos, k.line, f.keep IS NOT NULL AND f.keep <> k.doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
