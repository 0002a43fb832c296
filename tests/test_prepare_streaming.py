import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gradeloom.plans import prepare as P
from gradeloom.streaming import scores as S


def test_choice_sets(spark):
    a = spark.createDataFrame([(0, "Q: What? Answer Choices: (A)x (B)y", ["(A) x", "(B)y", "z"], [3]), (1, "plain", ["(A)", "b"], [0])], "row int, query string, choices array<string>, gold array<int>")
    rows = {r.id: r for r in P.choice_sets({"sat-en": a, "lsat": a.limit(1)}).collect()}
    r = rows["sat-en_00000"]
    assert (r.question, r.choices, r.answer) == ("What?", {"A": "x", "B": "y", "C": "z"}, "C")
    assert rows["sat-en_00001"].choices["A"] == "(A)" and len(rows) == 3


def test_four_choices(spark):
    names = ["Question", "Correct Answer", "Incorrect Answer 1", "Incorrect Answer 2", "Incorrect Answer 3", "Record ID", "High-level domain", "Subdomain"]
    src = spark.createDataFrame([(i, "q", "right", "w1", "w2", "w3", "nan" if i else "rec", "Physics", None) for i in range(5)], "row long, " + ", ".join(f"`{n}` string" for n in names))
    for r in P.four_choices(src, P.permutations(spark, 5)).collect():
        assert r.choices[r.answer] == "right" and sorted(r.choices.values()) == ["right", "w1", "w2", "w3"]
        assert r.id in ("rec", "row_0001", "row_0002", "row_0003", "row_0004")


def test_many_choices(spark):
    rows = [(7, "q", ["a", " ", "N/A", "d"], 3, "D", "law", "s"), (8, "q", ["n/a", "b", "c"], 0, "B", "law", "s")]
    got = {r.id: (r.choices, r.answer) for r in P.many_choices(spark.createDataFrame(rows, "question_id int, question string, options array<string>, answer_index int, answer string, category string, src string")).collect()}
    assert got == {"7": ({"A": "a", "B": "d"}, "B"), "8": ({"A": "b", "B": "c"}, "B")}


def test_lines_and_sources(spark):
    lines = spark.createDataFrame([('{"key": 1, "prompt": "p"}',), (" ",), ("no",), ('{"key": 1}',)], "value string")
    assert [r.ok for r in P.json_lines(lines, ["key", "prompt"]).collect()] == [True, False, False]
    kind = "solution struct<rows:array<array<string>>>"
    hidden, shown = (spark.createDataFrame([(([["1", x]],),)], kind) for x in ("___", "Bob"))
    assert P.first_with_solutions([("a", hidden), ("b", shown)])[0] == "b"
    with pytest.raises(RuntimeError):
        P.first_with_solutions([("a", hidden)])


def test_small_tables(spark):
    m = spark.createDataFrame([(1, "p", 25, "s", "u", 2024)], "id int, problem string, answer int, solution string, url string, year int")
    assert P.maths(m).first().answer == "25"
    b = spark.createDataFrame([(3, " i ", "(A)")], "row int, input string, target string")
    r = P.subsets({"snarks": b}).first()
    assert (r.id, r.answer, r.description) == ("snarks_00003", "(A)", "Determine which of two sentences is sarcastic.")
    names = "question_id question_title question_content starter_code platform difficulty contest_id public_test_cases private_test_cases metadata".split()
    l = spark.createDataFrame([(*[" x "] * len(names), dt.datetime(2024, 5, 1))], ", ".join(f"{n} string" for n in names) + ", contest_date timestamp")  # noqa: E741
    r = P.programs(l).first()
    assert (r.id, r.starter_code, r.contest_date) == ("x", " x ", "2024-05-01T00:00:00")


def test_stream(spark, tmp_path):
    def arrive(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("".join(json.dumps(dict(zip(("sample_id", "gen_idx", "generation", "ts"), r))) + "\n" for r in rows))

    score = lambda d: d.withColumn("score", (F.col("generation") == "good").cast("double"))
    run = lambda: S.upsert(S.arrivals(spark, str(tmp_path / "in")), score, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    arrive("a.json", [("x", 0, "bad", "2024-01-01T00:00:00"), ("y", 0, "good", "2024-01-01T00:10:00")])
    run()
    arrive("b.json", [("x", 0, "good", "2024-01-01T02:00:00")])
    run()
    assert {(r.sample_id, r.score) for r in S.latest(spark, str(tmp_path / "out")).collect()} == {("x", 1.0), ("y", 1.0)}
    stream = S.running_accuracy(score(S.arrivals(spark, str(tmp_path / "in"), watermark="1 day")))
    q = stream.writeStream.format("memory").queryName("acc").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.n, r.accuracy) for r in spark.table("acc").collect()} == {(2, 0.5)}
