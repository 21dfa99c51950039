"""Jobs for spark-submit or python -m tallyrule.jobs: evaluate, dataset, run, analyse."""

from __future__ import annotations

import argparse
import shutil
import tempfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import ingest
from .operators.evaluate import evaluate_turns, occurring
from .plans import report
from .sources import files



def ship(spark: SparkSession) -> None:
    """Gives the package to the Python workers, for where it isn't installed on them: Spark serves it from the driver."""
    package = Path(__file__).parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='tallyrule-')}/{package.name}", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)


DETAIL = {"follow_all_instructions": "{m}_all", "follow_instruction_list": "{m}_list", "instruction_id_list": "instruction_id_list", "is_evaluated_list": "is_evaluated_list", "prompt": "prompt", "response": "response"}


def answered(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """Prompts with their responses by prompt text; prompts without one go."""
    return ingest.joined_by_text(prompts, responses, "prompt")


def evaluate_files(spark: SparkSession, input_data: str, responses: str, output_dir: str, model: str, results: str | None = None, legacy: bool = False, assume_lang: str | None = None) -> str:
    """Evaluates JSON lines of prompts against those of responses, and writes to output_dir: for both modes the details
    (JSON lines) and the report, and the leaderboard row (also to results). Returns the reports for a console."""
    prompts = files.read_prompts(spark, input_data)
    language = prompts.select("language").first()
    language, safe = (language.language if language else ""), spark.range(1).select(ingest.safe_name(F.lit(model))).first()[0]
    done = evaluate_turns(answered(prompts, files.read_responses(spark, responses)), ["key"], occurring(prompts, assume_lang), assume_lang)
    path = f"{output_dir}/{language}_{safe}"
    details = done.select(*sorted({"prompt", "response", "instruction_id_list", "is_evaluated_list", "strict_all", "strict_list", "loose_all", "loose_list"}))
    details.write.mode("overwrite").parquet(f"{path}_outcome")  # evaluated once; the reports and details read it again
    details = spark.read.parquet(f"{path}_outcome")
    said = []
    for mode in ("strict", "loose"):
        files.write_lines(details.select(*(F.col(c.format(m=mode)).alias(n) for n, c in DETAIL.items())), f"{path}_eval_results_{mode}")
        made = report.full_report(details, mode, legacy)
        files.write_document(made, f"{path}_score_results_{mode}.json")
        raw = report.raw_accuracy(details, mode).first().accuracy
        said.append(f"{mode}\naccuracy: {raw}\n{report.printed(made)}")
    board = report.leaderboard(details, model, "IFEval", "mifeval/train", f"{language}_input_data")
    for to in [f"{path}_results.json", *([results] if results else [])]:
        files.write_text(spark, to, "[" + board.select(F.to_json(F.struct("*"))).first()[0] + "]")
    return "\n".join(said)


def load_items(spark: SparkSession, path: str, name: str, language: str, unique: bool = False) -> DataFrame:
    """A wide file of prompts as a table of turns (position, key, language, turn_index, prompt, instruction_id_list, kwargs).

    Returns the rejected rows with the reason. unique: of items with the same prompt in turn 1 the first stays."""
    wide = ingest.clean_cells(files.read_wide(spark, path)).withColumn("position", F.monotonically_increasing_id())
    have = set(wide.columns)
    wide = wide.withColumns({"key": F.coalesce(F.col("key") if "key" in have else F.lit(None).cast("string"), F.concat(F.lit("item_"), F.col("position"))), "language": F.coalesce(F.col("language") if "language" in have else F.lit(None).cast("string"), F.lit(language))})
    if unique and "turn_1_prompt" in have:
        wide = ingest.dedup_first(wide, "turn_1_prompt", "position")
    turns = ingest.unpivot_turns(wide)
    turns = turns.withColumns({"prompt": ingest.prompt_of(F.col("prompt")), "kwargs": ingest.kwargs_of(F.col("kwargs")), "instruction_id_list": ingest.prefixed_ids(F.coalesce(F.from_json("instruction_id_list", "array<string>"), F.array().cast("array<string>")), F.col("language"), F.col("key"))})
    return files.write_dataset(turns, name, {"empty prompt": "prompt != ''", "no instructions": "size(instruction_id_list) > 0"})


def run_items(spark: SparkSession, name: str, responses: DataFrame, out: str, limit: int | None = None) -> DataFrame:
    """Evaluates a table of turns with responses (key, turn_index, response), and writes flat results, those by item, the
    scores in long form and by item. Turns without a response are errors. Returns how many items succeeded and failed."""
    turns = files.read_dataset(spark, name)
    if limit and limit > 0:
        turns = turns.join(F.broadcast(ingest.limited(turns.select("key").distinct(), "key", limit)), "key", "left_semi")  # limit rows
    rows = turns.join(responses.select("key", "turn_index", "response"), ["key", "turn_index"], "left")
    rows = rows.withColumn("error", F.when(F.col("response").isNull(), F.lit("no response")))
    scored = report.turn_scores(evaluate_turns(rows, ["key", "turn_index"], occurring(turns)))
    scored.write.mode("overwrite").parquet(f"{out}/scored")
    scored = spark.read.parquet(f"{out}/scored")
    flat = report.flat_results(scored.withColumnsRenamed({"prompt": "input", "response": "output"}), "key")
    files.write_lines(flat, f"{out}/results")
    files.write_lines(report.nested_results(flat), f"{out}/results_by_item")
    files.write_lines(report.score_rows(scored.where("error IS NULL"), ["key", "turn_index"]), f"{out}/scores")
    files.write_lines(report.item_scores(scored, "key", "error"), f"{out}/item_scores")
    return report.success_counts(scored, "key", "error")


def analyse(spark: SparkSession, results: str, out: str) -> DataFrame:
    """The accuracies of turns 1 to 3 and their means, from a file of results, as a JSON document by turn."""
    r = files.read_results(spark, results).where("result.error IS NULL")
    lists = {f"{m}_{k}": F.col(f"result.result_{m}.{c}") for m in ("strict", "loose") for k, c in (("all", "follow_all_instructions"), ("list", "follow_instruction_list"))}
    document = report.analysis_document(report.turn_analysis(r.select("turn_index", *(c.alias(n) for n, c in lists.items()))))
    rows = [row.asDict() for row in document.collect()]  # four rows at most
    files.write_text(spark, out, files.json.dumps({row.pop("name"): row for row in rows}, indent=2))
    return document


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tallyrule")
    jobs = parser.add_subparsers(dest="job", required=True)
    e = jobs.add_parser("evaluate", help="prompts against responses, both JSON lines")
    for a in ("input-data", "input-response-data", "output-dir", "model-name"):
        e.add_argument(f"--{a}", required=True)
    e.add_argument("--results-fname")
    e.add_argument("--legacy-report", action="store_true", help="count instructions that could not be evaluated as well")
    e.add_argument("--assume-lang", choices=("en", "ko"), help="language of ids without one")
    d = jobs.add_parser("dataset", help="load a file as a table, or show, list or delete tables")
    d.add_argument("--file", "-f")
    d.add_argument("--name", "-n")
    d.add_argument("--language", "-l", default="Korean")
    d.add_argument("--remove-duplicates", "-r", action="store_true")
    for a in ("delete", "show", "list"):
        d.add_argument(f"--{a}", action="store_true")
    r = jobs.add_parser("run", help="a table of turns against a table of responses")
    for a in ("name", "responses", "out"):
        r.add_argument(f"--{a}", required=True)
    r.add_argument("--limit", type=int)
    a = jobs.add_parser("analyse", help="accuracies by turn of a file of results")
    a.add_argument("--input", required=True)
    a.add_argument("--output", required=True)
    return parser


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tallyrule").config("spark.sql.variant.allowDuplicateKeys", "true").getOrCreate()
    ship(spark)
    if args.job == "evaluate":
        print(evaluate_files(spark, args.input_data, args.input_response_data, args.output_dir, args.model_name, args.results_fname, args.legacy_report, args.assume_lang))
    elif args.job == "run":
        run_items(spark, args.name, files.read_dataset(spark, args.responses), args.out, args.limit).show()
    elif args.job == "analyse":
        analyse(spark, args.input, args.output).show()
    elif args.list:
        for row in files.list_datasets(spark):
            print(*row)
    elif not args.name:
        raise SystemExit("--name is needed")
    elif args.delete:
        files.drop_dataset(spark, args.name, yes=True)
    elif args.show:
        t = files.read_dataset(spark, args.name)
        items = t.select(F.to_json(F.struct("turn_index", "prompt")).alias("input"), F.to_json(F.struct("key", "language")).alias("metadata"), "key")
        ingest.dataset_stats(items).show(truncate=False)
        ingest.samples(items, "key").show(truncate=False)
    elif not args.file:
        raise SystemExit("--file is needed")
    else:
        load_items(spark, args.file, args.name, args.language, args.remove_duplicates).show(truncate=False)


if __name__ == "__main__":
    main()
