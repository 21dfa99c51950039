import json

import pytest

from tallyrule.operators import ingest
from tallyrule.sources import files
from tallyrule.streaming import dialogue


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    return str(path)


def test_last_response_wins(spark, tmp_path):
    p = lines(tmp_path / "r.jsonl", [{"prompt": "a", "response": "1"}, {"prompt": "b", "response": "x"}, {"prompt": "a", "response": "2"}])
    assert {r.prompt: r.response for r in files.read_responses(spark, p).collect()} == {"a": "2", "b": "x"}


def test_prompts(spark, tmp_path):
    p = lines(tmp_path / "ko_1.jsonl", [{"key": "1", "prompt": "p", "instruction_id_list": ["en:punctuation:no_comma"], "kwargs": [{}]}])
    assert files.read_prompts(spark, p).first().language == "ko"
    with pytest.raises(Exception, match="missing"):
        files.read_prompts(spark, lines(tmp_path / "x.jsonl", [{"key": "1", "prompt": "p"}])).collect()


def test_wide_skips_bad_lines(spark, tmp_path):
    df = files.read_wide(spark, lines(tmp_path / "w.jsonl", [{"key": "1", "turn_1_prompt": "p", "turn_2_prompt": ""}, "{bad", ""]))
    assert [r.turn_index for r in ingest.unpivot_turns(df).collect()] == [1]
    with pytest.raises(ValueError, match="neither"):
        files.read_wide(spark, "x.txt")


def test_generate_keeps_history(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "")], "conv_id long, turn long, prompt string")
    got = {(r.conv_id, r.turn): (r.response, r.error) for r in dialogue.generate(df, lambda said: str(len(said))).collect()}
    assert got == {(1, 0): ("1", None), (1, 1): ("3", None), (2, 0): (None, "empty prompt")}
