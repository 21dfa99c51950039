"""Accuracy reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(hits: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(hits.cast("double"), of.cast("double")), F.lit(0.0))


def prompt_report(outputs: DataFrame, mode: str = "strict") -> DataFrame:
    """One row: counts and accuracy over the prompts whose instructions are all evaluated."""
    whole = F.forall("is_evaluated_list", lambda x: x)
    right = F.count_if(whole & F.col(f"{mode}_all"))
    n = F.count_if(whole)
    return outputs.agg(n.alias("total_prompts"), right.alias("correct_prompts"), _share(right, n).alias("prompt_level_accuracy"), _share(n, F.count("*")).alias("evaluated_prompts_ratio"))


def raw_accuracy(outputs: DataFrame, mode: str = "strict") -> DataFrame:
    """One row: the share of all prompts, evaluated in full or not, of which every instruction is followed; 0 of none."""
    return outputs.agg(_share(F.count_if(f"{mode}_all"), F.count("*")).alias("accuracy"))


def success_counts(results: DataFrame, item: str, error: str) -> DataFrame:
    """One row: items whose turns are all without an error, and the others."""
    items = results.groupBy(item).agg(F.count(error).alias("errors"))
    return items.agg(F.count_if(F.col("errors") == 0).alias("successful"), F.count_if(F.col("errors") > 0).alias("failed"))


def _tiers(outputs: DataFrame, mode: str, legacy: bool) -> DataFrame:
    """Counts by tier0, tier1 and in all, and with the last the prompts' counts: one pass over the outputs."""
    evaluated = F.transform("is_evaluated_list", lambda _: F.lit(True)) if legacy else F.col("is_evaluated_list")
    right = F.forall(f"{mode}_list", lambda x: x) if legacy else F.col(f"{mode}_all")
    rows = outputs.select(F.forall(evaluated, lambda x: x).alias("whole"), right.alias("right"), F.posexplode_outer(F.arrays_zip(F.col("instruction_id_list").alias("id"), evaluated.alias("evaluated"), F.col(f"{mode}_list").alias("hit"))).alias("pos", "s"))
    first = F.coalesce("pos", F.lit(0)) == 0
    d = rows.select(F.substring_index("s.id", ":", 1).alias("t0"), F.col("s.id").alias("t1"), F.coalesce("s.evaluated", F.lit(False)).alias("counts"), F.col("s.hit").alias("hit"), first.alias("first"), "whole", "right")
    return d.groupingSets([["t0"], ["t0", "t1"], []], "t0", "t1").agg(
        F.grouping_id().alias("g"), F.count_if("counts").alias("total"), F.count_if(F.col("counts") & F.col("hit")).alias("correct"),
        F.count_if("first").alias("prompts"), F.count_if(F.col("first") & F.col("whole")).alias("total_prompts"), F.count_if(F.col("first") & F.col("whole") & F.col("right")).alias("correct_prompts"),
    )


def tier_report(outputs: DataFrame, mode: str = "strict", legacy: bool = False) -> DataFrame:
    """tier (total, tier0, tier1), name, total, correct, accuracy over evaluated instructions, in one pass.

    legacy: over all instructions, whether they could be evaluated or not."""
    g = _tiers(outputs, mode, legacy).where("g > 1 OR total > 0")
    tier = F.when(F.col("g") == 0, "tier1").when(F.col("g") == 1, "tier0").otherwise("total")
    return g.select(tier.alias("tier"), F.coalesce("t1", "t0", F.lit("all")).alias("name"), "total", "correct", _share(F.col("correct"), F.col("total")).alias("accuracy"))


def full_report(outputs: DataFrame, mode: str = "strict", legacy: bool = False) -> DataFrame:
    """The report document: one row with counters, accuracies and a map for each tier, its names in order.

    Prompts count if all their instructions are evaluated, instructions if they are themselves; legacy: all count.
    Without outputs all is 0 and the maps are empty."""
    t = _tiers(outputs, mode, legacy)
    entry = lambda tier, name: F.map_from_entries(F.array_sort(F.collect_list(F.when((F.col("g") == tier) & (F.col("total") > 0), F.struct(name, _share(F.col("correct"), F.col("total")).alias("accuracy"))))))
    of = lambda c: F.coalesce(F.max(F.when(F.col("g") > 1, F.col(c))), F.lit(0).cast("long"))
    counted = {"total_prompts": "total_prompts", "correct_prompts": "correct_prompts", "total_instructions": "total", "correct_instructions": "correct", "prompts": "prompts"}
    one = t.agg(entry(1, "t0").alias("tier0_accuracy"), entry(0, "t1").alias("tier1_accuracy"), *(of(c).alias(n) for n, c in counted.items()))
    return one.select(
        _share(F.col("correct_prompts"), F.col("total_prompts")).alias("prompt_level_accuracy"), _share(F.col("correct_instructions"), F.col("total_instructions")).alias("instruction_level_accuracy"),
        "tier0_accuracy", "tier1_accuracy", "total_prompts", "correct_prompts", "total_instructions", "correct_instructions", _share(F.col("total_prompts"), F.col("prompts")).alias("evaluated_prompts_ratio"),
    )


def printed(report: DataFrame) -> str:
    """The lines of a report for a console: both accuracies, then the tiers in order of their names."""
    r = report.first()
    tiers = ["\n".join(f"{k} {v}" for k, v in sorted(r[t].items())) for t in ("tier0_accuracy", "tier1_accuracy")]
    return "\n\n".join([f"prompt-level: {r.prompt_level_accuracy}\ninstruction-level: {r.instruction_level_accuracy}", *tiers]) + "\n"


def turn_scores(outputs: DataFrame) -> DataFrame:
    """outputs with five scores of a turn; instructions that aren't evaluated count as not followed."""
    mean = lambda c: F.when(F.size(c) > 0, F.size(F.filter(c, lambda x: x)) / F.size(c)).otherwise(0.0)
    one = {"strict_prompt_score": F.col("strict_all").cast("double"), "strict_inst_score": mean("strict_list"), "loose_prompt_score": F.col("loose_all").cast("double"), "loose_inst_score": mean("loose_list")}
    out = outputs.withColumns(one)
    return out.withColumn("overall_score", (F.col("strict_prompt_score") + F.col("strict_inst_score") + F.col("loose_prompt_score") + F.col("loose_inst_score")) / 4)


SCORES = ("strict_prompt_score", "strict_inst_score", "loose_prompt_score", "loose_inst_score", "overall_score")


def item_scores(scored: DataFrame, item: str, error: str | None = None) -> DataFrame:
    """The mean scores of an item's turns; with error, of those where that column is null."""
    rows = scored.where(F.col(error).isNull()) if error else scored
    return rows.groupBy(item).agg(*(F.avg(c).alias(c) for c in SCORES))


def turn_analysis(outputs: DataFrame, turn: str = "turn_index") -> DataFrame:
    """Accuracies of turns 1 to 3; those of instructions over all of them at once."""
    hits = lambda c: F.sum(F.size(F.filter(c, lambda x: x)))
    out = outputs.where(F.col(turn).isin(1, 2, 3)).groupBy(turn).agg(
        F.avg(F.col("strict_all").cast("double")).alias("prompt_level_strict_accuracy"), F.avg(F.col("loose_all").cast("double")).alias("prompt_level_loose_accuracy"),
        _share(hits("strict_list"), F.sum(F.size("strict_list"))).alias("instruction_level_strict_accuracy"), _share(hits("loose_list"), F.sum(F.size("loose_list"))).alias("instruction_level_loose_accuracy"),
    )
    parts = [c for c in out.columns if c != turn]
    return out.withColumn("overall_accuracy", (F.col(parts[0]) + F.col(parts[1]) + F.col(parts[2]) + F.col(parts[3])) / 4)


def overall_analysis(analysis: DataFrame, turn: str = "turn_index") -> DataFrame:
    """The unweighted means over turns."""
    return analysis.agg(*(F.avg(c).alias(c) for c in analysis.columns if c != turn))


def leaderboard(outputs: DataFrame, model: str, category: str, task: str, dataset: str) -> DataFrame:
    """The leaderboard document: both accuracies of full_report in both modes, in one pass over the outputs."""
    whole, n = F.forall("is_evaluated_list", lambda x: x), F.sum(F.size(F.filter("is_evaluated_list", lambda x: x)))
    both = lambda m: F.sum(F.size(F.filter(F.zip_with("is_evaluated_list", f"{m}_list", lambda a, b: a & b), lambda x: x)))
    metrics = []
    for m in ("strict", "loose"):
        metrics += [_share(F.count_if(whole & F.col(f"{m}_all")), F.count_if(whole)).alias(f"prompt_level_{m}_acc"), _share(both(m), n).alias(f"inst_level_{m}_acc")]
    named = {"model_name": model, "dataset_category": category, "dataset_task": task, "dataset_name": dataset}
    one = outputs.agg(*metrics)
    return one.select(*(F.lit(v).alias(k) for k, v in named.items()), F.struct(*one.columns).alias("metrics"))


def score_rows(scored: DataFrame, key: list[str]) -> DataFrame:
    """Long form for a score sink: key..., name, value."""
    return scored.unpivot(key, list(SCORES), "name", "value")


def flat_results(scored: DataFrame, item: str, turn: str = "turn_index") -> DataFrame:
    """item_index, turn_index and result of each scored turn: its texts, its scores, and the verdicts of both modes.

    Turns without a verdict (error set) have null scores and verdicts."""
    have = set(scored.columns)
    text = lambda c: (F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c)
    fine = F.col("error").isNull() if "error" in have else F.lit(True)
    verdict = lambda m: F.when(fine, F.struct(F.col(f"{m}_all").alias("follow_all_instructions"), F.col(f"{m}_list").alias("follow_instruction_list"), "is_evaluated_list")).alias(f"result_{m}")
    result = F.struct(F.col(item).cast("string").alias("item_id"), text("key"), F.col(turn).cast("int").alias("turn_index"), text("input"), text("output"), text("trace_id"), text("error"), F.when(fine, F.struct(*SCORES)).alias("score"), verdict("strict"), verdict("loose"))
    return scored.select(F.col(item).alias("item_index"), F.col(turn).cast("int").alias("turn_index"), result.alias("result"))


def nested_results(flat: DataFrame) -> DataFrame:
    """item_index, error (the first of a turn) and results, the results of an item's turns in order."""
    rows = F.array_sort(F.collect_list(F.struct("turn_index", "result")))
    out = flat.groupBy("item_index").agg(rows.alias("rows"))
    results = F.transform("rows", lambda r: r["result"])
    return out.select("item_index", F.get(F.filter(F.transform(results, lambda r: r["error"]), lambda e: e.isNotNull()), F.lit(0)).alias("error"), results.alias("results"))


def analysis_document(analysis: DataFrame, turn: str = "turn_index") -> DataFrame:
    """name (turn_1, ..., overall) and the five accuracies, turns in order and the overall means last."""
    names = [c for c in analysis.columns if c != turn]
    turns = analysis.select(F.concat(F.lit("turn_"), F.col(turn).cast("string")).alias("name"), *names)
    return turns.unionByName(overall_analysis(analysis, turn).select(F.lit("overall").alias("name"), *names)).orderBy(F.col("name") == "overall", "name")
