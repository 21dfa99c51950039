"""Readers and writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import last_wins

PROMPTS = "key string, prompt string, instruction_id_list array<string>, kwargs array<string>"
RESPONSES = "prompt string, response string"


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with key, prompt, instruction_id_list and kwargs, all required; and language, a file's name up to _.

    A line that lacks one fails the job, whatever columns are asked for."""
    df = spark.read.schema(PROMPTS).option("mode", "FAILFAST").json(path)
    df = df.withColumn("language", F.regexp_extract(F.col("_metadata.file_name"), "^([^_]*)", 1))
    lacking = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in ("key", "prompt", "instruction_id_list", "kwargs"))))
    # A condition on rows, which no projection leaves out.
    return df.where(F.when(F.size(lacking) == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("missing: "), F.array_join(lacking, ", "))).cast("boolean")))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """prompt, response: of lines with the same prompt the last one counts.

    The order is that of files and of bytes in them; lines of one split keep theirs."""
    df = spark.read.schema(RESPONSES).json(path)
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return last_wins(df.withColumn("at", at), "prompt", "response", "at")


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, or JSON lines of which malformed ones are skipped; by extension."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if not path.endswith(".jsonl"):
        raise ValueError(f"neither .csv nor .jsonl: {path}")
    # Lines are read as text and parsed with the fields of those that are JSON objects: nothing is kept for it.
    lines = spark.read.text(path).where(F.startswith(F.coalesce(F.schema_of_variant(F.try_parse_json("value")), F.lit("")), F.lit("OBJECT")))
    df = _objects(lines)
    if not df.limit(1).count():
        raise ValueError(f"no valid row: {path}")
    return df


def _objects(lines: DataFrame) -> DataFrame:
    """JSON objects, one in each value, as columns: texts as they are, anything else as JSON."""
    names = sorted(r.k for r in lines.select(F.explode(F.json_object_keys("value")).alias("k")).distinct().collect())  # the columns of a wide table
    v = F.try_parse_json("value")
    quoted = lambda n: "$['" + n.replace("\\", "\\\\").replace("'", "\\'") + "']"
    return lines.select(*(F.try_variant_get(v, quoted(n), "string").alias(n) for n in names)) if names else lines.select().limit(0)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of results, flat or with results nested in items, as flat rows."""
    df = spark.read.option("multiLine", True).json(path)
    if "results" in df.columns:
        df = df.select("item_index", F.explode_outer("results").alias("result")).withColumn("turn_index", F.col("result.turn_index"))
    return df


def read_dataset(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def list_datasets(spark: SparkSession, exclude: tuple[str, ...] = ()) -> list[tuple[str, int, str]]:
    """(name, number of items, id) of the tables of the current database, by name; id is the full name."""
    tables = sorted((t for t in spark.catalog.listTables() if t.name not in exclude and not t.isTemporary), key=lambda t: t.name)
    return [(t.name, spark.table(t.name).count(), ".".join([t.catalog or "", *(t.namespace or []), t.name]).strip(".")) for t in tables]


def read_params(path: str) -> dict:
    """A JSON file of settings; fails if there is none or it isn't JSON."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_document(df: DataFrame, path: str) -> None:
    """The one row of df as an indented JSON file, its columns as they come: for reports and boards, not for data."""
    write_text(df.sparkSession, path, json.dumps(json.loads(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]), indent=2, ensure_ascii=False))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as a file of any store that Spark writes to, in place of what was there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines with the columns in alphabetical order, nulls written out."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_dataset(df: DataFrame, name: str, valid: dict[str, str] | None = None) -> DataFrame:
    """Saves the rows that meet all conditions as a table that must not exist; returns the others with reason.

    valid: what a row must meet, by the reason to give where it doesn't; the first one that fails counts."""
    if not valid:
        df.write.mode("errorifexists").saveAsTable(name)
        return df.withColumn("reason", F.lit(None).cast("string")).limit(0)
    reason = F.coalesce(*(F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(r)) for r, c in valid.items()))
    marked = df.withColumn("reason", reason)
    marked.where("reason IS NULL").drop("reason").write.mode("errorifexists").saveAsTable(name)
    return marked.where("reason IS NOT NULL")


#: A row group of Parquet, which one task reads, holds about so many bytes at most.
ROW_GROUP = 128 << 20


def stored_size(df: DataFrame) -> int:
    """Bytes of the files that df reads, as Spark estimates them for its columns."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table for work that is heavy by row: dealt out evenly if it has too few row groups to occupy all cores.

    That is so for small files, whatever splits they are cut into; large tables are read as they are, without a shuffle."""
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if cores > 1 and stored_size(df) < cores * ROW_GROUP else df


def drop_dataset(spark: SparkSession, name: str, yes: bool = False) -> None:
    if not yes:
        raise ValueError("pass yes=True to drop a table")
    spark.sql(f"DROP TABLE {name}")
