"""Files in, reports out: the jobs from end to end, readers, writers and ingest."""

import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyrule import jobs
from tallyrule.functions import korean
from tallyrule.functions import text as X
from tallyrule.operators import ingest, instructions
from tallyrule.operators.instructions import registry_table
from tallyrule.plans import report
from tallyrule.sources import files
from tallyrule.streaming import dialogue
from tallyrule.streaming.sinks import append_scores


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    return str(path)


@pytest.fixture
def inputs(tmp_path):
    comma, title = "en:punctuation:no_comma", "en:detectable_format:title"
    prompts = [("1", "P1", [comma, title]), ("2", "P2", [comma]), ("3", "P3", ["xx:no:such"]), ("4", "P4", [comma])]
    p = lines(tmp_path / "en_x.jsonl", [{"key": k, "prompt": t, "instruction_id_list": i, "kwargs": [{}] * len(i)} for k, t, i in prompts])
    r = lines(tmp_path / "r.jsonl", [{"prompt": a, "response": b} for a, b in (("P1", "<<t>> ok"), ("P2", "a b"), ("P3", "z"), ("P2", "a, b"))])
    return p, r


def test_evaluate_job(spark, inputs, tmp_path, capsys):
    jobs.main(["evaluate", "--input-data", inputs[0], "--input-response-data", inputs[1], "--output-dir", f"{tmp_path}/out", "--model-name", "a/b:c", "--results-fname", f"{tmp_path}/results.json"], spark)
    got = json.loads((tmp_path / "out/en_a__b_c_score_results_strict.json").read_text())
    assert got == {
        "prompt_level_accuracy": 0.5, "instruction_level_accuracy": pytest.approx(2 / 3), "tier0_accuracy": {"en": pytest.approx(2 / 3)}, "tier1_accuracy": {"en:detectable_format:title": 1.0, "en:punctuation:no_comma": 0.5},
        "total_prompts": 2, "correct_prompts": 1, "total_instructions": 3, "correct_instructions": 2, "evaluated_prompts_ratio": pytest.approx(2 / 3),
    }
    board = json.loads((tmp_path / "results.json").read_text())
    assert board[0]["model_name"] == "a/b:c" and board[0]["dataset_name"] == "en_input_data" and board[0]["metrics"]["inst_level_strict_acc"] == pytest.approx(2 / 3)
    detail = spark.read.json(f"{tmp_path}/out/en_a__b_c_eval_results_strict")
    assert detail.columns == sorted(detail.columns) and detail.where("prompt = 'P2'").first().response == "a, b" and detail.count() == 3
    said = capsys.readouterr().out
    assert "accuracy: 0.333" in said and "prompt-level: 0.5" in said and said.index("en:detectable_format:title 1.0") < said.index("en:punctuation:no_comma 0.5")


def test_legacy_report_counts_all(spark, inputs):
    done = jobs.evaluate_turns(jobs.answered(files.read_prompts(spark, inputs[0]), files.read_responses(spark, inputs[1])), ["key"])
    r = report.full_report(done, legacy=True).first()
    assert (r.total_prompts, r.correct_prompts, r.total_instructions, r.correct_instructions, r.evaluated_prompts_ratio) == (3, 1, 4, 2, 1.0)
    nothing = report.full_report(done.limit(0)).first()
    assert (nothing.prompt_level_accuracy, nothing.total_prompts, nothing.tier0_accuracy, nothing.evaluated_prompts_ratio) == (0, 0, {}, 0)
    assert report.raw_accuracy(done).first().accuracy == pytest.approx(1 / 3)


def test_missing_key_fails_whatever_is_selected(spark, tmp_path):
    p = lines(tmp_path / "x.jsonl", [{"prompt": "a"}])
    with pytest.raises(Exception, match="missing"):
        files.read_prompts(spark, p).select("prompt").collect()


def test_dataset_and_run_jobs(spark, tmp_path, capsys):
    wide = [
        {"key": "a_ko", "language": "Korean", "turn_1_prompt": "하나", "turn_1_instruction_id_list": '["punctuation:no_comma"]', "turn_1_kwargs": "[{}]", "turn_2_prompt": "둘", "turn_2_instruction_id_list": '["punctuation:no_period"]', "turn_2_kwargs": "[{}]"},
        {"key": "b", "turn_1_prompt": "하나", "turn_1_instruction_id_list": '["punctuation:no_comma"]', "turn_1_kwargs": "[{}]"}, {"key": "c", "language": "English", "turn_1_prompt": '"three"', "turn_1_instruction_id_list": "[]"},
    ]
    path = lines(tmp_path / "w.jsonl", wide)
    with open(path, "a", encoding="utf-8") as f:
        f.write("\n{broken\n\n[1]\n")
    spark.sql("DROP TABLE IF EXISTS job_items")
    rejected = jobs.load_items(spark, path, "job_items", "Korean", unique=True).collect()
    # A turn whose fields are null, not '', is a turn without a prompt.
    assert {(r.key, r.turn_index, r.reason) for r in rejected} == {("c", 1, "no instructions"), ("c", 2, "empty prompt")}
    jobs.main(["dataset", "--list"], spark)
    assert "job_items 2" in capsys.readouterr().out
    jobs.main(["dataset", "--show", "--name", "job_items"], spark)
    assert "dict -> 2" in capsys.readouterr().out
    answers = spark.createDataFrame([("a_ko", 1, "가"), ("a_ko", 2, "나.")], "key string, turn_index int, response string")
    counts = jobs.run_items(spark, "job_items", answers, f"{tmp_path}/run").first()
    assert (counts.successful, counts.failed) == (1, 0)
    failed = jobs.run_items(spark, "job_items", answers.where("turn_index = 1"), f"{tmp_path}/run1").first()
    assert (failed.successful, failed.failed) == (0, 1)
    item = spark.read.json(f"{tmp_path}/run/results_by_item").first()
    assert [x.turn_index for x in item.results] == [1, 2] and item.error is None and item.results[1].result_strict.follow_all_instructions is False
    assert {(r.turn_index, r["name"]): r.value for r in spark.read.json(f"{tmp_path}/run/scores").collect()}[2, "overall_score"] == 0
    whole = [r.asDict(True) for r in spark.read.json(f"{tmp_path}/run/results").orderBy("turn_index").collect()]
    (tmp_path / "flat.json").write_text(json.dumps(whole), encoding="utf-8")
    jobs.main(["analyse", "--input", f"{tmp_path}/flat.json", "--output", f"{tmp_path}/analysis.json"], spark)
    document = json.loads((tmp_path / "analysis.json").read_text())
    assert list(document) == ["turn_1", "turn_2", "overall"] and document["overall"]["overall_accuracy"] == 0.5
    jobs.main(["dataset", "--delete", "--name", "job_items"], spark)
    assert not spark.catalog.tableExists("job_items")


def test_csv_and_settings(spark, tmp_path):
    (tmp_path / "w.csv").write_text('key,turn_1_prompt\n1,"a ""b""\nc"\n', encoding="utf-8")
    assert files.read_wide(spark, f"{tmp_path}/w.csv").first().turn_1_prompt == 'a "b"\nc'
    (tmp_path / "p.json").write_text('{"a": 1}')
    assert files.read_params(f"{tmp_path}/p.json") == {"a": 1}


def test_labels_lookup_and_fields(spark):
    items = spark.createDataFrame([(0, "k", "Korean"), (1, None, None)], "position int, key string, language string").withColumn("input", F.expr("map('turn_1', named_struct('prompt', 'p', 'instruction_id_list', '[\"a\"]', 'kwargs', string(null)))"))
    labelled = ingest.item_labels(items)
    assert [r.label for r in labelled.orderBy("position").collect()] == ["k (Korean)", "item_1 (Unknown)"]
    assert ingest.item_by_label(labelled, "item_1 (Unknown)").first().position == 1 and ingest.item_by_label(labelled, "nobody").first().position == 0
    r = ingest.turn_fields(items).first()
    assert (r.turn_1_prompt, json.loads(r.turn_1_instruction_id_list), r.turn_1_kwargs, r.turn_2_prompt, r.turn_2_instruction_id_list) == ("p", ["a"], "{}", "", "[]")
    assert [ingest.limited(items, "position", n).count() for n in (None, 0, -1, 1)] == [2, 2, 2, 1]


def test_statistics(spark):
    items = spark.createDataFrame([('{"a": 1}', '{"key": 1, "b": 2}', 0), ("[1]", None, 1), ("x" * 300, '{"a": 1}', 2), (None, "{}", 3)], "input string, metadata string, position int")
    r = ingest.dataset_stats(items).first()
    assert (r.n, r.metadata_keys, r.input_types) == (4, ["a", "b", "key"], {"dict": 1, "list": 1, "string": 1, "unknown": 1})
    assert ingest.dataset_stats(items.limit(0)).first().n == 0
    assert [len(x.input) for x in ingest.samples(items.where("position = 2"), "position").collect()] == [203]


def test_first_problem_of_an_edit(spark):
    edits = spark.createDataFrame([(2, 0, "no:such", "{}"), (1, 1, "punctuation:no_comma", '{"x": 1}'), (1, 0, "punctuation:no_comma", "{}")], "turn int, pos int, instruction_id string, kwargs string")
    assert ingest.first_problem(edits, registry_table(spark), "English").first().problem == "Invalid parameter: x"
    assert ingest.first_problem(edits.where("pos = 0 AND turn = 1"), registry_table(spark), "Korean").first().problem is None


def test_dedup_first(spark):
    rows = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), (None, 2, "z"), (None, 5, "w"), ("b", None, "v")], "key string, position int, other string")
    assert {r.key: r.other for r in ingest.dedup_first(rows, "key", "position").collect()} == {"a": "y", None: "z", "b": "v"}
    assert ingest.dedup_first(rows.limit(0), "key", "position").columns == ["key", "position", "other"]


def test_unregistered_rules(spark):
    df = spark.createDataFrame([(1, "One is here. Two is there.", "A cat sat", "a CAT a")], "id int, x string, a string, b string")
    texts = F.array(F.lit("One is here."), F.lit("Three."))
    assert df.select(instructions.key_sentences(F.col("x"), texts, F.lit(1)).alias("v")).first().v
    assert [instructions.rephrased(df, "id", "a", "b", *r).first().follows for r in ((2, 3), (0, 1), (3, 9))] == [True, False, False]
    assert df.select(instructions.constrained_start(F.col("x"), F.lit("(")).alias("v")).first().v is None


def test_registered_instruction(spark):
    name = "en:own:shouts"
    instructions.register_instruction(name, instructions.Instruction((), lambda x, _, c: F.endswith(x, F.lit("!"))))
    try:
        rows = spark.createDataFrame([(1, 0, name, "{}", "a!"), (2, 0, name, None, "a")], "k int, pos int, instruction_id string, kwargs string, response string")
        assert {r.k: r.strict for r in jobs.evaluate_turns(rows.selectExpr("k", "array(instruction_id) AS instruction_id_list", "array(kwargs) AS kwargs", "response"), ["k"]).selectExpr("k", "strict_list[0] AS strict").collect()} == {1: True, 2: False}
    finally:
        del instructions.REGISTRY[name]
    with pytest.raises(ValueError, match="begins with"):
        instructions.register_instruction("fr:x:y", None)


def test_added_patterns_reach_the_registry(spark):
    text = "우리 함께 가옵소서"
    rows = spark.createDataFrame([(1, ["ko:language:formal_text"], ["{}"], text)], "k int, instruction_id_list array<string>, kwargs array<string>, response string")
    follows = lambda: jobs.evaluate_turns(rows, ["k"]).first().strict_all
    assert not follows()
    korean.add_patterns(formal={"imperative": ["옵소서$"]})
    try:
        assert follows()
    finally:
        korean.FORMAL["imperative"].remove("옵소서$")


def test_generator_is_asked_again_and_answers_replayed(spark, tmp_path):
    """A marker file counts the calls, which run in workers."""
    calls = str(tmp_path / "calls")

    def answer(said):
        with open(calls, "a") as f:
            f.write("x")
        if "always" in said[-1][1] or len(open(calls).read()) < 3:
            raise ValueError("busy")
        return "ok"

    prompts = spark.createDataFrame([(1, 1, "a")], "conv_id int, turn int, prompt string")
    got = dialogue.generate(prompts, answer, retries=3, delay=0.01).first()
    assert (got.response, got.error, open(calls).read()) == ("ok", None, "xxx")
    failed = dialogue.generate(prompts.withColumn("prompt", F.lit("always")), answer, retries=2).first()
    assert (failed.response, failed.error, open(calls).read()) == (None, "busy", "xxxxx")
    answers = spark.createDataFrame([(1, 2, "b")], "conv_id int, turn int, response string")
    assert dialogue.replay(prompts, answers).first().error == "no response"


def test_likeness_of_a_rephrasing(spark):
    assert korean.normalized(" ＡＢ  c ,d") == "ab c, d"
    text = "배송을 빨리 12 확인은 a"
    assert korean.keywords(text) == {"배송", "빨리", "확인"} == set(spark.range(1).select(korean.keyword_set(F.lit(text)).alias("k")).first().k)
    assert korean.similarity("배송 확인", "오늘 배송 확인 부탁") == 1.0 and korean.similarity("배송", "12") == 0.0
    assert 0.7 / 2 < korean.similarity("배송을 확인", "배송은 취소") < 0.7
    assert korean.confirms("배송 상태 확인을 요청하셨네요.", "배송 상태 확인") and not korean.confirms("죄송합니다", "배송 상태 확인") and not korean.confirms("x", None)


def test_confirmations_as_columns(spark):
    """The columns decide as the plain function does."""
    texts = ["배송 상태 확인을 요청하셨네요.\n답", "네, 배송 상태 확인을 요청하셨네요.", "ＡＢ 문의 주셨습니다 .", "오늘 날씨가 좋습니다.", "", " \n", None, "\n 배송 상태에 대해 문의하셨네요 \n", "죄송합니다만 배송 상태 확인", "배송 상태 확인 부탁하셨네요!"]
    prompts = ["배송 상태 확인", "AB 문의", "", None]
    df = spark.createDataFrame([(texts, prompts)], "t array<string>, p array<string>")
    got = df.select(korean.confirming(F.col("t"), F.col("p")).alias("c")).first().c
    assert got == [[korean.confirms(t, p) for t in texts] for p in prompts] and any(got[0]) and any(got[1])


def test_scores_are_appended_once(spark, tmp_path):
    spark.createDataFrame([("a", 1, "overall_score", 0.5)], "key string, turn_index int, name string, value double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, turn_index int, name string, value double").parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second start finds nothing new
        q = append_scores(stream, "appended_scores", f"{tmp_path}/state")
        q.processAllAvailable()
        q.stop()
    assert spark.table("appended_scores").count() == 1
    spark.sql("DROP TABLE appended_scores")


WILD = st.text(st.one_of(st.characters(exclude_categories=("Cs", "Cn")), st.sampled_from("\n\n  **--[]<>,.1a　\x85\x1c")), max_size=40)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(WILD, min_size=60, max_size=60))
def test_measurements_on_random_unicode(spark, texts):
    """Columns against Python's own regular expressions, which the measurements are defined by."""
    want = {
        "bullets": lambda t: len(re.findall(r"^\s*\*[^\*].*$", t, re.M)) + len(re.findall(r"^\s*-.*$", t, re.M)), "placeholders": lambda t: len(re.findall(r"\[.*?\]", t)), "tokens": lambda t: len(t.split()),
        "digit_items": lambda t: len(re.findall(r"^\s*\d+\).*$", t, re.M)) + len(re.findall(r"^\s*\d+\..*$", t, re.M)), "blank": lambda t: not t.strip(), "strip": str.strip, "title": lambda t: any(x.lstrip("<").rstrip(">").strip() for x in re.findall(r"<<[^\n]+>>", t)),
    }
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", *(getattr(X, n)(F.col("t")).alias(n) for n in want)).collect():
        for n, f in want.items():
            assert r[n] == f(texts[r.i]), (n, texts[r.i])
