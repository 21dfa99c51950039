"""From wide rows of prompts to turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSED = ("turns", "responses", "language", "key", "turn_index")
FIELDS = ("prompt", "instruction_id_list", "kwargs")


def canonical_json(c: Column) -> Column:
    """The cell in canonical JSON if it is JSON, else as it is; null stays null."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), c)


def clean_cells(wide: DataFrame) -> DataFrame:
    """Canonical JSON in the columns turn_0_* to turn_9_* of prompts, ids and arguments; NaN becomes null."""
    cells = {f"turn_{i}_{f}" for i in range(10) for f in FIELDS}
    kinds = dict(wide.dtypes)
    return wide.select(*(canonical_json(F.col(c)).alias(c) if c in cells and kinds[c] == "string" else F.nanvl(c, F.lit(None)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in wide.columns))


def unpivot_turns(wide: DataFrame, turns: int = 3) -> DataFrame:
    """key, language, turn_index, prompt, instruction_id_list, kwargs: a row for each turn with any field that isn't ''."""
    have = set(wide.columns)
    field = lambda i, f: F.when(F.col(n) != "", F.col(n)) if (n := f"turn_{i}_{f}") in have else F.lit(None).cast("string")
    filled = lambda i: F.array_compact(F.array(*(F.when(~F.coalesce(F.col(n) == "", F.lit(False)), F.lit(1)) for f in FIELDS if (n := f"turn_{i}_{f}") in have)))
    one = [F.struct(F.lit(i).alias("turn_index"), *(field(i, f).alias(f) for f in FIELDS), (F.size(filled(i)) > 0).alias("any")) for i in range(1, turns + 1)]
    keep = [c for c in ("key", "language") if c in have]
    return wide.select(*keep, F.explode(F.array(*one)).alias("t")).select(*keep, "t.*").where("any").drop("any")


def max_turn(items: DataFrame, names: str = "names") -> DataFrame:
    """items with max_turn: the largest n of the names turn_<n>."""
    number = F.transform(names, lambda k: F.try_element_at(F.regexp_extract_all(k, F.lit(r"^turn_(\d+)$"), 1), F.lit(1)).cast("int"))
    return items.withColumn("max_turn", F.array_max(number))


def prompt_of(cell: Column) -> Column:
    """A JSON string's text, an object's content, '' for other JSON, and anything else as it is."""
    v = F.try_parse_json(cell)
    kind = F.schema_of_variant(v)
    out = F.when(v.isNull(), cell).when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(F.startswith(kind, F.lit("OBJECT")), F.try_variant_get(v, "$.content", "string")).otherwise("")
    return F.coalesce(out, F.lit(""))


def prefixed_ids(ids: Column, language: Column, key: Column) -> Column:
    """Ids with ko: before them if the language is Korean or the key ends with ko, else en:."""
    prefix = F.when((language == "Korean") | F.endswith(key, F.lit("ko")), "ko:").otherwise("en:")
    return F.transform(ids, lambda i: F.concat(prefix, i))


def kwargs_of(cell: Column) -> Column:
    """An array of JSON objects: objects and strings that hold them stay, anything else becomes {}; a scalar is wrapped."""
    v = F.try_parse_json(cell)
    many = F.from_json(cell, "array<string>")
    items = F.when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), many).when(v.isNotNull(), F.array(cell)).otherwise(F.array(F.lit("{}")))
    good = lambda x: F.startswith(F.coalesce(F.schema_of_variant(F.try_parse_json(x)), F.lit("")), F.lit("OBJECT"))
    return F.transform(items, lambda x: F.when(good(x), x).otherwise("{}"))


def marked(text: str) -> list[Column]:
    """128 bits that stand before a text in a key: rows are sorted by numbers, and texts compared only where both numbers meet."""
    return [F.xxhash64(text).alias("__mark"), F.xxhash64(F.lit(1), text).alias("__mark2")]


def dedup_first(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The first row of each key, nulls being one key; of rows at one position, and of those without any, which come last, any one.

    An aggregate, so that rows of a key that is everywhere collapse before they are shuffled."""
    others = [c for c in rows.columns if c != key]
    first = rows.groupBy(*marked(key), key).agg(F.min_by(F.struct(*others), F.struct(F.col(position).isNull(), position)).alias("__first"))
    return first.select(*(F.col(c) if c == key else F.col("__first").getField(c).alias(c) for c in rows.columns))


def last_wins(rows: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """key and the value at the last position of each key, copies collapsing before they are shuffled."""
    return rows.groupBy(*marked(key), key).agg(F.max_by(value, position).alias(value)).select(key, value)


def joined_by_text(rows: DataFrame, others: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with others, both by a text; rows whose text is everywhere are split by AQE, as others has each text once."""
    mine, theirs = rows.withColumns(_marks(key)), others.withColumns(_marks(key))
    return mine.join(theirs, ["__mark", "__mark2", key], how).drop("__mark", "__mark2").select(key, *(c for c in rows.columns if c != key), *([] if how in ("left_semi", "left_anti") else [c for c in others.columns if c != key]))


def _marks(key: str) -> dict[str, Column]:
    return dict(zip(("__mark", "__mark2"), marked(key), strict=True))


def safe_name(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("/"), F.lit("__")), F.lit(":"), F.lit("_"))


def invalid_arguments(specs: DataFrame, registry: DataFrame) -> DataFrame:
    """specs (instruction_id, kwargs) with problem: the first unknown id or argument, null if there is none."""
    out = specs.join(F.broadcast(registry.select("instruction_id", "accepts")), "instruction_id", "left")
    extra = F.array_except(F.json_object_keys("kwargs"), "accepts")
    problem = F.when(F.col("accepts").isNull(), F.concat(F.lit("Unknown instruction: "), "instruction_id")).when(F.size(extra) > 0, F.concat(F.lit("Invalid parameter: "), F.get(extra, F.lit(0))))
    return out.withColumn("problem", problem).drop("accepts")


def first_problem(edits: DataFrame, registry: DataFrame, language: str) -> DataFrame:
    """One row with problem: that of the first bad instruction of an edit (turn, pos, instruction_id, kwargs), null if all are good.

    Ids are taken with the language's first two letters before them."""
    named = edits.withColumn("instruction_id", F.concat(F.lit(language[:2].lower() + ":"), "instruction_id"))
    bad = invalid_arguments(named, registry).where(F.col("problem").isNotNull())
    return bad.agg(F.min_by("problem", F.struct("turn", "pos")).alias("problem"))


def item_labels(items: DataFrame, key: str = "key", language: str = "language", position: str = "position") -> DataFrame:
    """items with label: key (language); a missing key is item_<position>, a missing language Unknown."""
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("item_"), F.col(position).cast("string")))
    return items.withColumn("label", F.concat(name, F.lit(" ("), F.coalesce(F.col(language), F.lit("Unknown")), F.lit(")")))


def item_by_label(items: DataFrame, label: str, position: str = "position") -> DataFrame:
    """The first item with a label; the first of all if none has it."""
    return items.orderBy(F.coalesce(F.col("label") != label, F.lit(True)), position).limit(1)


def turn_fields(items: DataFrame, turns: int = 3, of: str = "input") -> DataFrame:
    """items with turn_<i>_prompt, turn_<i>_instruction_id_list and turn_<i>_kwargs of a map of turns: the prompt's text, the
    others as indented JSON; '', [] and {} where they are missing."""
    pretty = lambda c: F.to_json(F.try_parse_json(c), {"pretty": "true"})
    fields = {}
    for i in range(1, turns + 1):
        t = F.try_element_at(of, F.lit(f"turn_{i}"))
        fields[f"turn_{i}_prompt"] = F.coalesce(t["prompt"], F.lit(""))
        fields[f"turn_{i}_instruction_id_list"] = F.coalesce(pretty(t["instruction_id_list"]), t["instruction_id_list"], F.lit("[]"))
        fields[f"turn_{i}_kwargs"] = F.coalesce(pretty(t["kwargs"]), t["kwargs"], F.lit("{}"))
    return items.withColumns(fields)


def limited(rows: DataFrame, position: str, n: int | None) -> DataFrame:
    """The first n rows; all of them without n, or with one that isn't positive."""
    return rows.orderBy(position).limit(n) if n and n > 0 else rows


def dataset_stats(items: DataFrame, input_col: str = "input", metadata_col: str = "metadata") -> DataFrame:
    """One row: n, metadata_keys (in order) and input_types (name and count) of items whose input and metadata are JSON.

    An object is dict, an array list, anything else that is text string, null unknown. No items give 0 and nothing."""
    kind = F.schema_of_variant(F.try_parse_json(input_col))
    name = F.when(F.col(input_col).isNull(), "unknown").when(F.startswith(kind, F.lit("OBJECT")), "dict").when(F.startswith(kind, F.lit("ARRAY")), "list").otherwise("string")
    rows = items.select(name.alias("kind"), F.coalesce(F.json_object_keys(metadata_col), F.array().cast("array<string>")).alias("keys"))
    by_kind = rows.groupBy("kind").agg(F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_set("keys"))).alias("keys"))
    entry = F.array_sort(F.collect_list(F.struct("kind", "n")))
    return by_kind.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("metadata_keys"), F.map_from_entries(entry).alias("input_types"))


def samples(items: DataFrame, position: str, n: int = 2, chars: int = 200) -> DataFrame:
    """The first n items, their input cut at so many characters for a look."""
    return limited(items, position, n).withColumn("input", F.when(F.length("input") > chars, F.concat(F.left("input", F.lit(chars)), F.lit("..."))).otherwise(F.col("input")))


def upsert(table: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """table with the rows of changed in place of those with the same key; a row without a key takes the place of those without one."""
    gone = changed.select(F.col(key).alias("__key")).distinct()
    return table.join(gone, F.col(key).eqNullSafe(F.col("__key")), "left_anti").unionByName(changed)
