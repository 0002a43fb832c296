"""Evaluation runs: samples, pending pairs, generations, scores, metrics, summaries.

Everything between the sample table and the metrics table of a task is one lazy
plan. A generator is any function from a table (sample_id, prompt,
num_generations, missing) to one with ``generations`` (array of strings) and
maybe ``error``; a table of finished generations serves as well.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions.prompts import normalise, render
from gradeloom.operators import metrics as M
from gradeloom.operators import plan as P
from gradeloom.plans.tasks import TASKS, Task
from gradeloom.sources.files import RECORD, coerce_records

log = logging.getLogger("gradeloom")

Generator = Callable[[DataFrame], DataFrame]
#: Settings of a generator that no task and no caller sets.
FALLBACK = {"n": 1, "max_new_tokens": 256, "temperature": 0.0, "top_p": 1.0, "top_k": -1}


def select_tasks(wanted: str | Iterable[str], known: Iterable[str] = TASKS) -> list[str]:
    """Task names: ``all`` sorted, else as given; none or unknown ones raise."""
    names = [x.strip() for x in (wanted.split(",") if isinstance(wanted, str) else wanted) if x.strip()]
    if names == ["all"]:
        return sorted(known)
    unknown = sorted(set(names) - set(known))
    if unknown or not names:
        raise ValueError(f"unknown tasks: {', '.join(unknown)}" if unknown else "no tasks given")
    return list(dict.fromkeys(names))


def generation_config(task: Task, overrides: Mapping[str, Any] | None = None, defaults: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Settings: caller over given defaults over the task's over the fallback; nulls don't count; several greedy draws raise."""
    out = dict(FALLBACK)
    for layer in (task.defaults, defaults or {}, overrides or {}):
        out |= {k: v for k, v in layer.items() if v is not None}
    if int(out["n"]) < 1 or (int(out["n"]) > 1 and float(out["temperature"]) == 0):
        raise ValueError("n must be 1 or more, and 1 at temperature 0")
    return out


def from_table(generations: DataFrame) -> Generator:
    """A generator that looks up finished generations (sample_id, gen_idx, generation)."""

    def generate(asked: DataFrame) -> DataFrame:
        pairs = asked.select("sample_id", F.explode("missing").alias("gen_idx")).join(generations.select("sample_id", "gen_idx", "generation"), ["sample_id", "gen_idx"], "left")
        per = pairs.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("gen_idx", F.coalesce("generation", F.lit("")).alias("g")))), lambda x: x.g).alias("generations"))
        return asked.join(per, "sample_id", "left").withColumn("error", F.lit(None).cast("string"))

    return generate


def by_batches(call: Callable[[list[list[dict]], int], list[list[str]]]) -> Generator:
    """A generator from a Python function of prompts and a number of draws; a batch that raises gives empty texts and its error."""
    import pandas as pd

    def generate(asked: DataFrame) -> DataFrame:
        def run(parts):
            for pdf in parts:
                out, errors = [None] * len(pdf), [None] * len(pdf)
                for n, rows in pdf.groupby("num_generations").groups.items():
                    prompts = [[{"role": m["role"], "content": m["content"]} for m in p] for p in pdf.loc[rows, "prompt"]]
                    try:
                        texts, error = call(prompts, int(n)), None
                    except Exception as e:  # the error becomes data
                        texts, error = [[] for _ in prompts], f"{type(e).__name__}: {e}"
                    for i, r in enumerate(rows):
                        k = pdf.index.get_loc(r)
                        out[k], errors[k] = list(texts[i]) if i < len(texts) else [], error
                yield pd.DataFrame({"sample_id": pdf["sample_id"], "generations": out, "error": errors})

        said = asked.select("sample_id", "prompt", "num_generations").mapInPandas(run, "sample_id string, generations array<string>, error string")
        return asked.join(said, "sample_id")

    return generate


@dataclass
class TaskRun:
    """Tables of one task's run."""

    task: Task
    samples: DataFrame
    records: DataFrame
    metrics: DataFrame
    existing: int = 0
    new: int = 0


def check(task: Task, raw: DataFrame) -> None:
    """Raise if rows break the task's rules or repeat an id; names eight at most."""
    bad = task.errors(raw).limit(8).collect()
    if bad:
        raise ValueError(f"{task.name}: " + "; ".join(f"{r.sample}: {r.rule}" for r in bad))
    P.check_unique(task.samples(raw).select("sample_id"))


def score(task: Task, samples: DataFrame, generations: DataFrame) -> DataFrame:
    """Records of generations (sample_id, gen_idx, generation, error, ...) joined to their samples."""
    asked = F.transform(normalise(task.prompt()), lambda m: m)
    own = samples.withColumn("__prompt", asked)
    given = generations.select("sample_id", "gen_idx", "generation", F.col("error").alias("__error"))
    judged = task.score(given.join(own, "sample_id"))
    failed = F.col("__error").isNotNull()
    out = judged.select(
        "sample_id",
        F.col("gen_idx").cast("int").alias("gen_idx"),
        F.col("__prompt").alias("prompt"),
        "generation",
        F.when(failed, 0.0).otherwise(F.col("score")).alias("score"),
        F.coalesce(F.when(failed, False).otherwise(F.col("is_pass")), F.lit(False)).alias("is_pass"),
        "parsed",
        "gold",
        F.coalesce("__error", "error").alias("error"),
        "meta",
    )
    return out.select(*RECORD.names)


def run_task(task: Task, raw: DataFrame, generate: Generator, *, existing: DataFrame | None = None, config: Mapping[str, Any] | None = None, options: Mapping[str, Any] | None = None, validate: bool = True) -> TaskRun:
    """Score what exists anew, generate and score what is missing, and aggregate.

    ``existing``: earlier records with load_seq; of a repeated pair the last counts.
    """
    settings = generation_config(task, config)
    n = int(settings["n"])
    if validate:
        check(task, raw)
    samples = task.samples(raw)
    spark = raw.sparkSession
    if existing is None:
        old = spark.createDataFrame([], RECORD)
    else:
        old = P.keep_last(P.resume(coerce_records(existing), samples, n), "load_seq")
    todo = P.pending_by_sample(P.pending(samples, old, n))
    asked = todo.join(samples.withColumn("prompt", normalise(task.prompt())).select("sample_id", "prompt"), "sample_id")
    told = generate(asked)
    errors = told.select("sample_id", F.col("error").alias("error")) if "error" in told.columns else told.select("sample_id", F.lit(None).cast("string").alias("error"))
    fresh = P.attach_generations(told).join(errors, "sample_id")
    again = old.select("sample_id", "gen_idx", "generation", F.lit(None).cast("string").alias("error"))
    records = score(task, samples, P.union_records(again, fresh))
    metrics = task.aggregate(records, {"n": n} | dict(options or {})).select(F.lit(task.name).alias("task"), "metric", "value")
    return TaskRun(task, samples, records, metrics)


def summarise(metrics: DataFrame, declared: Mapping[str, str]) -> DataFrame:
    """(task, metrics, primary_metric, primary_score): one row a task."""
    spark = metrics.sparkSession
    names = spark.createDataFrame(list(declared.items()) or [("", "")], "task string, declared string")
    order = F.when(F.col("metric") == F.col("declared"), 0).otherwise(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, M.PRIMARY)), F.col("metric")), F.lit(0)), F.lit(99)))
    rows = metrics.join(F.broadcast(names), "task", "left")
    out = rows.groupBy("task").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"), F.min(F.when(F.col("value").isNotNull(), F.struct(order.alias("o"), "metric", "value"))).alias("p"))
    return out.select("task", "metrics", F.col("p.metric").alias("primary_metric"), F.col("p.value").alias("primary_score"))


def run_summary(summaries: DataFrame) -> dict[str, Any]:
    """Means over tasks, for the driver to write: metric averages and the mean of primary scores."""
    long = summaries.select("task", F.explode("metrics").alias("metric", "value"))
    averages = {r.metric: {"mean": r.value, "num_tasks": r.num_tasks} for r in M.run_averages(long).collect()}
    primary = M.primary_aggregate(summaries.select("task", F.col("primary_score").alias("value"))).first()
    tasks = [r.asDict() for r in summaries.select("task", "primary_metric", "primary_score").orderBy("task").collect()]
    return {"tasks": tasks, "metric_averages": averages, "primary_mean": primary.primary_mean, "num_tasks": primary.num_tasks}


def inspect_prompts(task: Task, raw: DataFrame, k: int = 1, renderer: Callable[[Column], Column] = render) -> DataFrame:
    """The first prompts as they would be sent."""
    return P.inspect(task.samples(raw), renderer(normalise(task.prompt())), k)


def load_raw(spark: SparkSession, task: Task, path: str) -> DataFrame:
    from gradeloom.sources.files import read_jsonl

    return read_jsonl(spark, path, task.raw)
