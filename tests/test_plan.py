import pytest
from pyspark.sql import functions as F

from gradeloom.operators import plan as P


def test_pending_and_resume(spark):
    samples = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    old = spark.createDataFrame([("a", 0, "x", 1), ("a", 0, "y", 2), ("a", 5, "z", 3), ("c", 0, "w", 4), ("b", -1, "v", 5)], "sample_id string, gen_idx int, generation string, seq int")
    kept = P.resume(old, samples, 2)
    assert {(r.sample_id, r.gen_idx, r.generation) for r in P.keep_last(kept, "seq").collect()} == {("a", 0, "y")}
    todo = P.pending(samples, kept, 2)
    assert {tuple(r) for r in todo.collect()} == {("a", 1), ("b", 0), ("b", 1)}
    asked = P.pending_by_sample(todo)
    assert {(r.sample_id, tuple(r.missing), r.num_generations) for r in asked.collect()} == {("a", (1,), 1), ("b", (0, 1), 2)}
    told = asked.withColumn("generations", F.when(F.col("sample_id") == "b", F.array(F.lit("only one"))).otherwise(F.array(F.lit("p"), F.lit("q"))))
    assert {tuple(r) for r in P.attach_generations(told).collect()} == {("a", 1, "p"), ("b", 0, "only one"), ("b", 1, "")}


def test_results_and_unions(spark):
    samples = spark.createDataFrame([("a", "g"), ("b", "h")], "sample_id string, gold string")
    rec = spark.createDataFrame([("a", 1, 0.0), ("a", 0, 1.0)], "sample_id string, gen_idx int, score double")
    got = {r.sample_id: [(x.gen_idx, x.score) for x in r.records] for r in P.sample_results(samples, rec).collect()}
    assert got == {"a": [(0, 1.0), (1, 0.0)], "b": []}
    new, old = (spark.createDataFrame(x, "task string, v int") for x in ([("t", 1)], [("t", 2), ("u", 3)]))
    assert {tuple(r) for r in P.merge_summaries(new, old).collect()} == {("t", 1), ("u", 3)}


def test_guards(spark):
    P.check_unique(spark.createDataFrame([("a",), ("b",)], "sample_id string"))
    with pytest.raises(ValueError, match="a"):
        P.check_unique(spark.createDataFrame([("a",), ("a",)], "sample_id string"))


def test_inspect_and_workers(spark):
    s = spark.createDataFrame([(i, f"s{i}") for i in range(6)], "idx int, sample_id string")
    assert [r.prompt for r in P.inspect(s, F.upper("sample_id"), 0).collect()] == ["S0"]
    assert [r.worker for r in P.round_robin(s, "idx", 4).orderBy("idx").collect()] == [0, 1, 2, 3, 0, 1]
