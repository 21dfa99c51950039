"""The training-data pipeline: documents in, token ids out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyrule.llm import bagminhash, lines, mixing, pieces, quality
from tallyrule.llm.common import stored

#: Each takes (spark, docs, sf_dir). All but the last return the columns of documents.
STAGES = [
    ("quality_classifier", quality.stage),
    ("line_dedup", lines.stage),
    ("near_dedup", bagminhash.stage),
    ("mix_sources", mixing.stage),
    ("sentencepiece", pieces.stage),
]

#: SQL has no learnt classifier, no signatures and no SentencePiece.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded_equal of the documents that are left, a row for each time that the mix takes one.

    sf_dir holds documents.parquet (doc_id, text, lang, source, n_chars) and labels.parquet (doc_id, quality, ...). Each
    stage's output is written as Parquet to the shared folder and read again by the next. n_chars stays what it was in the
    input. Null texts count as empty throughout and become empty in line_dedup; rows that repeat are one after near_dedup;
    a null source is a source of its own. Without labels nothing is rejected; empty documents give no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
