import math

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import metrics as M


def records(spark, rows, extra="grp string, parsed boolean"):
    return spark.createDataFrame(rows, f"sample_id string, gen_idx int, score double, {extra}")


def as_dict(df):
    return {r.metric: round(r.value, 6) for r in df.collect()}


def test_pass_at_k_golden(spark):
    rows = [("q1", i, s, "g", True) for i, s in enumerate([1.0, 0.0, 0.0, 1.0])] + [("q2", i, s, "g", True) for i, s in enumerate([0.0, 0.0, 1.0, 0.0])]
    got = as_dict(M.binary_metrics(records(spark, rows), n=4))
    assert got["accuracy"] == 0.375 and got["accuracy@4"] == 0.375 and got["pass@1"] == 0.375
    assert got["pass@2"] == 0.666667 and got["pass@4"] == 1.0


def test_schedule():
    assert M.default_ks(5) == [1, 2, 4, 5] and M.default_ks(1) == [1] and M.default_ks(0) == []
    assert M.resolve_ks("4, 1,2", 4) == [1, 2, 4]
    with pytest.raises(ValueError):
        M.resolve_ks([8], 4)


def test_groups_and_parsed(spark):
    rows = [("a", 0, 1.0, "Sat-EN", True), ("a", 1, 0.0, "Sat-EN", False), ("b", 0, 0.0, "sat en", True), ("b", 1, 0.0, "sat en", False), ("c", 0, 0.0, " - ", False)]
    got = as_dict(M.binary_metrics(records(spark, rows), parsed=F.col("parsed"), group=F.col("grp"), ks=[1]))
    assert got["accuracy_sat_en"] == 0.25 and "accuracy_" not in got and got["parsed_rate"] == round(1 / 3, 6)


def test_pass_k_needs_enough_records(spark):
    rows = [("a", i, 1.0, "", True) for i in range(4)] + [("b", i, 0.0, "", True) for i in range(2)]
    got = as_dict(M.binary_metrics(records(spark, rows)))
    assert "pass@2" in got and "pass@4" not in got and got["accuracy@4"] == 0.5


def test_empty(spark):
    got = as_dict(M.binary_metrics(records(spark, [])))
    assert got == {"accuracy": 0, "accuracy_stderr": 0, "parsed_rate": 0, "pass@1": 0, "pass@1_stderr": 0}


def test_stderr(spark):
    rows = [("a", 0, 1.0, "", True), ("b", 0, 0.0, "", True), ("c", 0, 0.5, "", True)]
    got = as_dict(M.binary_metrics(records(spark, rows)))
    assert got["accuracy_stderr"] == round(0.5 / math.sqrt(3), 6)


def test_instruction_levels(spark):
    kind = "sample_id string, gen_idx int, score double, strict boolean, loose boolean, strict_flags array<boolean>, loose_flags array<boolean>, expected int"
    t, f = True, False
    one = [("s1", 0, 1.0, t, t, [t], [t], 1), ("s2", 0, 0.0, f, f, [f, f, f], [t, f, f], 3)]
    got = as_dict(M.instruction_metrics(spark.createDataFrame(one, kind)))
    assert (got["prompt_level_strict_acc"], got["prompt_level_loose_acc"], got["inst_level_strict_acc"], got["inst_level_loose_acc"]) == (0.5, 0.5, 0.25, 0.5)
    two = [("q1", 0, 1.0, t, t, [t, f], [t, t], 2), ("q1", 1, 0.0, f, t, [f, f], [f, f], 2), ("q2", 0, 0.0, f, f, [f, f], [t, f], 2), ("q2", 1, 1.0, t, t, [t, t], [t, t], 2)]
    got = as_dict(M.instruction_metrics(spark.createDataFrame(two, kind)))
    assert (got["prompt_level_strict_acc"], got["inst_level_strict_acc"], got["prompt_level_loose_acc"], got["inst_level_loose_acc"]) == (0.5, 0.375, 0.75, 0.625)
    missing = [("a", 0, 1.0, None, None, None, [], 2), ("b", 0, 0.0, f, None, [t], None, 2)]
    got = as_dict(M.instruction_metrics(spark.createDataFrame(missing, kind)))
    assert got["prompt_level_strict_acc"] == 0.5 and got["inst_level_strict_acc"] == 0.75


def test_first_record_rule(spark):
    rows = [("z1", 0, 1.0, 1.0, 1.0, None), ("z1", 1, 0.0, 0.0, 1.0, None), ("z2", 1, 1.0, 1.0, 1.0, "Easy one"), ("z2", 0, 0.0, 0.0, 1.0, "Easy one")]
    df = spark.createDataFrame(rows, "sample_id string, gen_idx int, score double, cell_accuracy double, parsed double, difficulty string")
    got = as_dict(M.grid_metrics(df, F.col("difficulty")))
    assert got["puzzle_accuracy"] == 0.5 and got["cell_accuracy"] == 0.5 and got["parsed"] == 1.0
    assert got["puzzle_accuracy_sub_unknown"] == 1.0 and got["puzzle_accuracy_sub_easy_one"] == 0.0


def test_bootstrap(spark):
    values = spark.createDataFrame(list(enumerate([0.0, 1.0, 1.0, 0.0])), "sample_id int, x double")
    r = M.bootstrap_mean(values, "x", resamples=500, seed=0).first()
    assert r.mean == 0.5 and r.stderr >= 0 and r.ci_low <= r.mean <= r.ci_high
    assert tuple(M.bootstrap_mean(values.limit(0), "x").first()) == (0.0, 0.0, 0.0, 0.0)
    assert tuple(M.bootstrap_mean(values.limit(1), "x").first()) == (0.0, 0.0, 0.0, 0.0)


def test_run_level(spark):
    m = spark.createDataFrame([("a", "accuracy", 1.0), ("a", "x", 0.0), ("b", "pass@1", 0.5), ("b", "accuracy", 0.0), ("c", "zeta", 2.0), ("c", "alpha", None)], "task string, metric string, value double")
    assert {(r.metric, r.value, r.num_tasks) for r in M.run_averages(m).collect()} == {("accuracy", 0.5, 2), ("x", 0.0, 1), ("pass@1", 0.5, 1), ("zeta", 2.0, 1)}
    p = M.primary_metric(m)
    assert {(r.task, r.metric) for r in p.collect()} == {("a", "accuracy"), ("b", "pass@1"), ("c", "zeta")}
    assert {(r.task, r.metric) for r in M.primary_metric(m, "x").collect()} >= {("a", "x")}
    assert M.primary_aggregate(p.where("task = 'none'")).first().primary_mean is None


def test_aliases_and_tiers(spark):
    m = spark.createDataFrame([("accuracy", 0.5), ("accuracy_x", 0.25), ("pass@1", 1.0)], "metric string, value double")
    assert as_dict(M.aliased(m, {"accuracy": "exact_match"}))["exact_match_x"] == 0.25
    f = spark.createDataFrame([("a:x", True), ("a:y", False), ("b:z", True)], "instruction_id string, followed boolean")
    assert {(r.tier, r["name"], r.accuracy) for r in M.tier_report(f).collect()} == {(0, "a", 0.5), (0, "b", 1.0), (1, "a:x", 1.0), (1, "a:y", 0.0), (1, "b:z", 1.0)}


def test_bootstrap_spread_is_the_standard_error(spark):
    for n in (15, 151, 1501, 7919):
        x = [(k, float((k * 37) % n % 16)) for k in range(n)]
        r = M.bootstrap_mean(spark.createDataFrame(x, "sample_id long, x double"), "x", resamples=400, seed=3).first()
        m = sum(v for _, v in x) / n
        true = (sum((v - m) ** 2 for _, v in x) / n / n) ** 0.5
        assert abs(r.stderr / true - 1) < 0.15 and abs(r["mean"] - m) < 1e-9
        assert abs((r.ci_high - r.ci_low) / (2 * 1.96 * true) - 1) < 0.25
