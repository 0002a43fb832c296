import json

import pytest
from pyspark.sql import functions as F

from gradeloom import cli, config
from gradeloom.plans import run as R
from gradeloom.plans.tasks import TASKS
from gradeloom.sources import files as S

CHOICES = {"A": "one", "B": "two", "C": "three", "D": "four"}
RAW = {
    "gpqa_diamond": [{"id": "g1", "question": "Q?", "choices": CHOICES, "answer": "C", "domain": "Physics"}, {"id": "g2", "question": "Q?", "choices": CHOICES, "answer": "A", "domain": "Chemistry"}],
    "mmlu_pro": [{"id": "m1", "question": "Q?", "choices": CHOICES | {"E": "five"}, "answer": "e", "category": "law"}],
    "agieval_en": [{"id": "a1", "question": "Q?", "choices": {"A": "x", "B": "y"}, "answer": "B", "subset": "sat-en"}],
    "aime24": [{"id": "t1", "problem": "p", "answer": "025"}],
    "aime25": [{"id": "t1", "problem": "p", "answer": "7"}],
    "bbh": [{"id": "b1", "subset": "date_understanding", "input": "i", "target": "(B)", "answer": "(B)"}],
    "humaneval_plus": [{"task_id": "h1", "prompt": "def add(a, b):\n", "entry_point": "add", "test": "def check(f):\n    assert f(1, 2) == 3", "canonical_solution": "x", "base_input": [], "plus_input": [], "atol": 0.0}],
    "ifeval": [{"key": 1, "prompt": "p", "instruction_id_list": ["punctuation:no_comma"], "kwargs": [{}]}],
    "ifbench": [{"key": "2", "prompt": "p", "instruction_id_list": ["sentence:keyword", "punctuation:no_comma"], "kwargs": [{"word": "hello", "N": 1}]}],
    "livecodebench": [{"id": "l1", "question_content": "q", "starter_code": "", "platform": "atcoder", "public_test_cases": json.dumps([{"input": "1", "output": "42\n"}]), "private_test_cases": "", "metadata": "{}"}],
    "zebralogic": [{"id": "z1", "size": "2*2", "puzzle": "p", "solution": {"header": ["House", "Name"], "rows": [["1", "Alice"]]}}],
}
RIGHT = {
    "gpqa_diamond": "Final answer: (C).",
    "mmlu_pro": "Answer: E",
    "agieval_en": "Therefore, the answer is (B).",
    "aime24": "so \\boxed{25}",
    "aime25": "the answer is 7",
    "bbh": "So the answer is B.",
    "humaneval_plus": "```python\n    return a + b\n```",
    "ifeval": "no commas here",
    "ifbench": "Say hello now. Then go.",
    "livecodebench": "```python\nprint(42)\n```",
    "zebralogic": '{"solution": {"House 1": {"Name": "alice"}}}',
}
PRIMARY = {"gpqa_diamond": 0.5}


def raw(spark, name, path):
    path.write_text("".join(json.dumps(r) + "\n" for r in RAW[name]))
    return R.load_raw(spark, TASKS[name], str(path))


def test_all_tasks_have_cases():
    assert set(TASKS) == set(RAW) == set(RIGHT)


@pytest.mark.parametrize("name", sorted(RAW))
def test_task(spark, tmp_path, name):
    rows = raw(spark, name, tmp_path / "x.jsonl")
    done = R.run_task(TASKS[name], rows, R.by_batches(lambda prompts, n: [[RIGHT[name]] * n for _ in prompts]), config={"n": 2, "temperature": 1.0})
    records = done.records.orderBy("sample_id", "gen_idx").collect()
    assert len(records) == 2 * len(RAW[name]) and records[0].prompt[0].role in ("user", "system")
    assert all(r.error is None for r in records)
    got = {r.metric: r.value for r in done.metrics.collect()}
    assert got[TASKS[name].primary] == PRIMARY.get(name, 1.0)
    prompt = R.inspect_prompts(TASKS[name], rows).first().prompt
    assert prompt.startswith(("user: ", "system: "))


def test_rules(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text(json.dumps({"id": "z", "question": " ", "choices": {"A": "x"}, "answer": "B"}) + "\n")
    rows = R.load_raw(spark, TASKS["mmlu_pro"], str(tmp_path / "x.jsonl"))
    assert {r.rule for r in TASKS["mmlu_pro"].errors(rows).collect()} == {"question is empty", "fewer than 2 choices", "answer is no choice"}
    with pytest.raises(ValueError):
        R.check(TASKS["mmlu_pro"], rows)


def test_resume_scores_anew(spark, tmp_path):
    rows = raw(spark, "ifeval", tmp_path / "x.jsonl")
    old = spark.createDataFrame([("1", 0, "a, b", 1.0, 2), ("1", 0, "fine", 0.0, 1), ("1", 9, "x", 1.0, 3), ("gone", 0, "x", 1.0, 4)], "sample_id string, gen_idx int, generation string, score double, load_seq int")
    old = old.withColumns({c: F.lit(None).cast(S.RECORD[c].dataType) for c in S.RECORD.names if c not in old.columns})
    calls = R.by_batches(lambda prompts, n: [["new text"] * n for _ in prompts])
    done = R.run_task(TASKS["ifeval"], rows, calls, existing=old, config={"n": 2, "temperature": 1})
    assert {(r.gen_idx, r.generation, r.score) for r in done.records.collect()} == {(0, "a, b", 0.0), (1, "new text", 1.0)}


def test_failed_batches_are_records(spark, tmp_path):
    def fail(prompts, n):
        raise RuntimeError("no model")

    done = R.run_task(TASKS["bbh"], raw(spark, "bbh", tmp_path / "x.jsonl"), R.by_batches(fail))
    r = done.records.first()
    assert r.error == "RuntimeError: no model" and r.score == 0.0 and r.generation == ""


def test_settings():
    assert R.generation_config(TASKS["aime24"], {"n": None, "top_p": 0.5}) | {} == {"n": 16, "max_new_tokens": 4096, "temperature": 1.0, "top_p": 0.5, "top_k": -1}
    with pytest.raises(ValueError):
        R.generation_config(TASKS["ifeval"], {"n": 2})
    assert R.select_tasks("all") == sorted(TASKS) and R.select_tasks("bbh, ifeval") == ["bbh", "ifeval"]
    for bad in ("", "nope"):
        with pytest.raises(ValueError):
            R.select_tasks(bad)


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("run:\n  model: m\n  tasks: [bbh]\ngeneration:\n  n: 4\ntemperature: 0.5\n")
    out = config.resolve({"n": 8, "output_dir": "o"}, S.read_yaml(str(tmp_path / "c.yaml")))
    assert out["run"]["model"] == "m" and out["generation"]["n"] == 8 and out["generation"]["temperature"] == 0.5 and out["run"]["output_dir"] == "o"
    (tmp_path / "bad.yaml").write_text("- a\n")
    with pytest.raises(ValueError):
        S.read_yaml(str(tmp_path / "bad.yaml"))
    assert S.parse_pairs(["a=1", "b=true", "c=none", "d=x y", "e=[1, 2]"]) == {"a": 1, "b": True, "c": None, "d": "x y", "e": [1, 2]}
    for bad in ("a", "=1"):
        with pytest.raises(ValueError):
            S.parse_pairs([bad])


def test_files(spark, tmp_path):
    schema = "id string, x int"
    assert S.read_jsonl(spark, str(tmp_path / "none.jsonl"), schema).collect() == []
    (tmp_path / "p.jsonl").write_text("version https://git-lfs.github.com/spec/v1\noid sha256:1\nsize 2\n")
    with pytest.raises(RuntimeError, match="oid"):
        S.read_jsonl(spark, str(tmp_path / "p.jsonl"), schema)
    df = spark.createDataFrame([("00123", 1), ("é", None)], schema)
    S.append_jsonl(df, str(tmp_path / "out"))
    S.append_jsonl(df.limit(1), str(tmp_path / "out"))
    assert sorted(map(tuple, S.read_jsonl(spark, str(tmp_path / "out"), schema).collect()), key=str) == sorted([("00123", 1), ("00123", 1), ("é", None)], key=str)


def test_command_line(spark, tmp_path, capsys):
    for name in ("ifeval", "bbh"):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in RAW[name]))
        (tmp_path / "gen").mkdir(exist_ok=True)
        ident = str(RAW[name][0].get("id", RAW[name][0].get("key")))
        (tmp_path / "gen" / f"{name}.jsonl").write_text(json.dumps({"sample_id": ident, "gen_idx": 0, "generation": RIGHT[name]}) + "\n")
    base = ["--data", str(tmp_path), "--generations", f"{tmp_path}/gen", "--output-dir", f"{tmp_path}/out", "--model", "org/My Model"]
    assert cli.main(["list"]) == 0 and "bbh" in capsys.readouterr().out
    assert cli.main(["inspect", "--tasks", "bbh", *base], spark) == 0 and "step by step" in capsys.readouterr().out
    for name in ("ifeval", "bbh", "bbh"):
        assert cli.main(["run", "--tasks", name, *base], spark) == 0
    summary = json.loads((tmp_path / "out/my-model/run_summary.json").read_text())
    assert summary["primary_mean"] == 1.0 and summary["num_tasks"] == 2
    assert len(S.read_predictions(spark, f"{tmp_path}/out/my-model/bbh/predictions").collect()) == 1
