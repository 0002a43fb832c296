"""Command line: list tasks and defaults, inspect prompts, or evaluate stored generations."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gradeloom.config import resolve
from gradeloom.functions.text import run_id
from gradeloom.plans import run as R
from gradeloom.plans.tasks import TASKS
from gradeloom.sources.files import append_jsonl, parse_pairs, read_jsonl, read_predictions, read_yaml, write_json


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gradeloom")
    p.add_argument("command", choices=["list", "defaults", "inspect", "run"])
    p.add_argument("--config")
    p.add_argument("--tasks")
    p.add_argument("--model")
    p.add_argument("--data", default="data", help="folder with NAME.jsonl of each task")
    p.add_argument("--generations", help="folder with NAME.jsonl of finished generations")
    p.add_argument("--output-dir", dest="output_dir")
    p.add_argument("--run-id", dest="run_id")
    p.add_argument("--n", type=int)
    p.add_argument("--temperature", type=float)
    p.add_argument("--overwrite", action="store_const", const=True)
    p.add_argument("--limit", type=int, default=1)
    p.add_argument("--set", nargs="*", default=[], metavar="KEY=VALUE")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command in ("list", "defaults"):
        for name in sorted(TASKS):
            print(name if args.command == "list" else json.dumps({name: TASKS[name].defaults}))
        return 0
    given = {k: v for k, v in vars(args).items() if v is not None} | parse_pairs(args.set)
    options = resolve(given, read_yaml(args.config) if args.config else None)
    wanted = options["run"]["tasks"]
    if not wanted:
        raise SystemExit("no tasks given")
    spark = spark or SparkSession.builder.appName("gradeloom").getOrCreate()
    names = R.select_tasks(wanted)
    if args.command == "inspect":
        for name in names:
            for r in R.inspect_prompts(TASKS[name], R.load_raw(spark, TASKS[name], f"{args.data}/{name}.jsonl"), args.limit).collect():
                print(json.dumps({"task": name, "sample_id": r.sample_id, "prompt": r.prompt}, ensure_ascii=False))
        return 0
    model = options["run"]["model"] or "model"
    ident = options["run"]["run_id"] or spark.range(1).select(run_id(F.lit(model)).alias("r")).first().r
    folder = Path(options["run"]["output_dir"]) / ident
    metrics = None
    for name in names:
        task, out = TASKS[name], folder / name / "predictions"
        if options["run"]["overwrite"] and out.exists():
            import shutil

            shutil.rmtree(out)
        old = read_predictions(spark, str(out))
        given_rows = read_jsonl(spark, f"{args.generations}/{name}.jsonl", "sample_id string, gen_idx int, generation string")
        done = R.run_task(task, R.load_raw(spark, task, f"{args.data}/{name}.jsonl"), R.from_table(given_rows), existing=old, config=options["generation"], options=options["metrics"])
        fresh = folder / name / "predictions.new"
        append_jsonl(done.records, str(fresh))  # beside the old ones, which the plan still reads
        if out.exists():
            import shutil

            shutil.rmtree(out)
        fresh.rename(out)
        records = read_predictions(spark, str(out))
        own = task.aggregate(records, {"n": R.generation_config(task, options["generation"])["n"]}).select(F.lit(name).alias("task"), "metric", "value")
        metrics = own if metrics is None else metrics.unionByName(own)
    rows = R.summarise(metrics, {n: TASKS[n].primary for n in names})
    for r in rows.collect():
        write_json({"task": r.task, "metrics": r.metrics, "primary_metric": r.primary_metric, "primary_score": r.primary_score}, str(folder / r.task / "summary.json"))
    others = [json.loads(p.read_text()) for p in sorted(folder.glob("*/summary.json")) if p.parent.name not in names]
    if others:
        old_rows = spark.createDataFrame([(o["task"], {k: float(v) for k, v in o["metrics"].items() if v is not None}, o["primary_metric"], o["primary_score"]) for o in others], rows.schema)
        from gradeloom.operators.plan import merge_summaries

        rows = merge_summaries(rows, old_rows)
    write_json(options, str(folder / "run_config.json"))
    summary = R.run_summary(rows)
    write_json(summary, str(folder / "run_summary.json"))
    print(json.dumps(summary, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
