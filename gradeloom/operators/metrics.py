"""Aggregations over scored generations, as long tables of (metric, value).

``records`` has one row a generation: sample_id, gen_idx, score, and whatever the
flags read. Each metric is a mean over samples of a mean over the generations of
a sample: one shuffle by sample, then a global partial sum.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.text import slugify


def stderr(x: Column) -> Column:
    """Standard error of the mean with n - 1; 0 for one value or none."""
    n = F.count(x)
    return F.when(n > 1, F.coalesce(F.stddev_samp(x), F.lit(0.0)) / F.sqrt(n)).otherwise(F.lit(0.0))


def mean(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """Unbiased estimate that one of k draws among n passes, if c of the n pass."""
    falling = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (1.0 - k / i))
    return F.when((n <= 0) | (c <= 0), F.lit(0.0)).when(n - c < k, F.lit(1.0)).otherwise(1.0 - falling)


def default_ks(n: int) -> list[int]:
    """Powers of two up to n, and n."""
    return sorted({1 << p for p in range(max(n, 1).bit_length()) if 1 << p <= n} | ({n} if n > 0 else set()))


def resolve_ks(given: str | Sequence[int] | None, n: int) -> list[int]:
    """The wanted ks: a comma list, a sequence, or the default; each between 1 and n."""
    if given is None:
        return default_ks(n)
    ks = sorted({int(x) for x in (given.split(",") if isinstance(given, str) else given) if str(x).strip()})
    if not ks or ks[0] < 1 or ks[-1] > n:
        raise ValueError(f"k must lie between 1 and {n}: {given}")
    return ks


def per_sample(records: DataFrame, *, score: Column | None = None, parsed: Column | None = None, group: Column | None = None) -> DataFrame:
    """(sample_id, n, c, acc, parsed, grp): counts and means of each sample that has records."""
    score = F.coalesce(score if score is not None else F.col("score"), F.lit(0.0)).cast("double")
    flag = F.coalesce(parsed, F.lit(False)).cast("double") if parsed is not None else F.lit(0.0)
    label = slugify(F.coalesce(group.cast("string"), F.lit(""))) if group is not None else F.lit("")
    return records.groupBy("sample_id").agg(
        F.count("*").alias("n"),
        F.count_if(score >= 1.0).alias("c"),
        F.avg(score).alias("acc"),
        F.avg(flag).alias("parsed"),
        F.first(label, ignorenulls=True).alias("grp"),
    )


def _long(row: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One wide row as (metric, value) rows."""
    return row.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(f"`{c}`").cast("double") for c in columns]))).alias("metric", "value"))


def accuracy(samples: DataFrame) -> DataFrame:
    """accuracy, accuracy_stderr and parsed_rate over samples; zeros for none."""
    row = samples.agg(mean(F.col("acc")).alias("accuracy"), stderr(F.col("acc")).alias("accuracy_stderr"), mean(F.col("parsed")).alias("parsed_rate"))
    return _long(row, ["accuracy", "accuracy_stderr", "parsed_rate"])


def pass_metrics(samples: DataFrame, ks: Sequence[int]) -> DataFrame:
    """pass@k and pass@k_stderr for the ks that every sample has enough records for; k = 1 always."""
    least = samples.agg(F.min("n").alias("least"))
    each = samples.crossJoin(F.broadcast(least)).select("n", "c", F.explode(F.array(*[F.lit(k) for k in sorted({1, *ks})])).alias("k"), "least").where((F.col("k") == 1) | (F.col("k") <= F.col("least")))
    rates = each.select("k", pass_at_k(F.col("n"), F.col("c"), F.col("k")).alias("p")).groupBy("k").agg(mean(F.col("p")).alias("value"), stderr(F.col("p")).alias("err"))
    return rates.select(F.explode(F.create_map(F.concat(F.lit("pass@"), "k"), "value", F.concat(F.lit("pass@"), "k", F.lit("_stderr")), "err")).alias("metric", "value"))


def grouped(samples: DataFrame, prefix: str = "accuracy_") -> DataFrame:
    """The mean of sample means for each group; blank groups are left out."""
    return samples.where("grp <> ''").groupBy("grp").agg(F.avg("acc").alias("value")).select(F.concat(F.lit(prefix), "grp").alias("metric"), "value")


def binary_metrics(records: DataFrame, *, n: int | None = None, ks: str | Sequence[int] | None = None, score: Column | None = None, parsed: Column | None = None, group: Column | None = None, prefix: str = "accuracy_") -> DataFrame:
    """All metrics of a pass/fail task as (metric, value).

    ``n``: the configured number of generations; if unset, the largest found. An
    empty input gives zeros.
    """
    samples = per_sample(records, score=score, parsed=parsed, group=group)
    found = n or (samples.agg(F.max("n")).first()[0] or 0)
    base = accuracy(samples)
    if not found:
        spark = records.sparkSession
        return base.unionByName(spark.createDataFrame([("pass@1", 0.0), ("pass@1_stderr", 0.0)], "metric string, value double"))
    out = base.unionByName(pass_metrics(samples, resolve_ks(ks, found)))
    if found > 1:
        out = out.unionByName(base.where("metric = 'accuracy'").select(F.lit(f"accuracy@{found}").alias("metric"), "value"))
    return out.unionByName(grouped(samples, prefix)) if group is not None else out


def instruction_metrics(records: DataFrame) -> DataFrame:
    """Prompt-level means over samples, instruction-level means over all instructions of all samples.

    ``records``: sample_id, score, strict and loose (booleans, nullable), strict_flags
    and loose_flags (arrays, maybe empty or null), expected (number of instructions).
    """
    strict = F.coalesce(F.col("strict").cast("double"), F.col("score"), F.lit(0.0))
    loose = F.coalesce(F.col("loose").cast("double"), strict)

    def padded(flags: Column, instead: Column) -> Column:
        values = F.transform(flags, lambda x: x.cast("double"))
        own = F.when(F.coalesce(F.size(flags), F.lit(0)) > 0, F.slice(F.concat(values, F.array_repeat(F.lit(0.0), F.col("expected"))), F.lit(1), F.col("expected")))
        return F.coalesce(own, F.array_repeat(instead, F.col("expected")))

    base = records.select("sample_id", strict.alias("ps"), loose.alias("pl"), padded(F.col("strict_flags"), strict).alias("fs"), padded(F.col("loose_flags"), loose).alias("fl"))
    prompt = base.groupBy("sample_id").agg(F.avg("ps").alias("ps"), F.avg("pl").alias("pl"))
    each = base.select("sample_id", F.posexplode(F.arrays_zip("fs", "fl")).alias("pos", "f")).groupBy("sample_id", "pos").agg(F.avg("f.fs").alias("is"), F.avg("f.fl").alias("il"))
    out = None
    for rows, pairs in ((prompt, (("prompt_level_strict_acc", "ps"), ("prompt_level_loose_acc", "pl"))), (each, (("inst_level_strict_acc", "is"), ("inst_level_loose_acc", "il")))):
        row = rows.agg(*[x for name, c in pairs for x in (mean(F.col(c)).alias(name), stderr(F.col(c)).alias(f"{name}_stderr"))])
        long = _long(row, [x for name, _ in pairs for x in (name, f"{name}_stderr")])
        out = long if out is None else out.unionByName(long)
    return out


def aliased(metrics: DataFrame, names: dict[str, str]) -> DataFrame:
    """Metrics plus copies under other names, by prefix."""
    out = metrics
    for old, new in names.items():
        out = out.unionByName(metrics.where(F.col("metric").startswith(old)).select(F.concat(F.lit(new), F.substring("metric", len(old) + 1, 1000)).alias("metric"), "value"))
    return out


def first_records(records: DataFrame) -> DataFrame:
    """The record with the lowest gen_idx of each sample, by a partial minimum."""
    row = F.struct(*[F.col(c) for c in records.columns])
    return records.groupBy("sample_id").agg(F.min_by(row, "gen_idx").alias("r")).select("r.*")


def grid_metrics(records: DataFrame, group: Column) -> DataFrame:
    """Puzzle, cell and parsed means over first records, for all and for each group (blank: unknown), from one pass.

    ``records``: sample_id, gen_idx, score, cell_accuracy, parsed.
    """
    first = first_records(records.withColumn("grp", F.coalesce(F.nullif(slugify(F.coalesce(group.cast("string"), F.lit(""))), F.lit("")), F.lit("unknown"))))
    sums = first.groupingSets([[], ["grp"]], "grp").agg(F.avg("score").alias("puzzle_accuracy"), F.avg("cell_accuracy").alias("cell_accuracy"), F.avg("parsed").alias("parsed"), F.grouping("grp").alias("g"))
    names = ["puzzle_accuracy", "cell_accuracy", "parsed"]
    pairs = F.explode(F.array(*[F.struct(F.when(F.col("g") == 1, F.lit(c)).otherwise(F.concat(F.lit(f"{c}_sub_"), "grp")).alias("metric"), F.coalesce(F.col(c), F.lit(0.0)).alias("value")) for c in names]))
    return sums.select(pairs.alias("p")).select("p.metric", "p.value")


#: A uniform 32-bit value is a Poisson(1) draw of as many as it has of these bounds at or under it.
POISSON = [math.floor(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]


def bootstrap_mean(values: DataFrame, column: str, *, key: str = "sample_id", resamples: int = 1000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """One row (mean, stderr, ci_low, ci_high): percentile bootstrap of the mean, reproducible and distributed.

    Each resample weights each row by a Poisson(1) draw, read from a hash of (seed, resample, ``key``), and takes the
    weighted mean: one pass with partial sums, a group for four resamples, and no table of draws. ``key`` must tell
    the rows apart. Resamples without any row (for a few values only) don't count. Without values: zeros; with one
    value or no resamples: that mean, no spread.
    """
    base = values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"), F.col(key).cast("string").alias("k"))
    head = base.agg(F.count("*").alias("n"), mean(F.col("x")).alias("m")).first()
    spark = values.sparkSession
    if head.n <= 1 or resamples <= 0:
        return spark.createDataFrame([(float(head.m), 0.0, float(head.m), float(head.m))], "mean double, stderr double, ci_low double, ci_high double")
    hashed = base.select("x", "k", F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // 4))).alias("b"))
    hashed = hashed.select("x", "b", F.md5(F.concat_ws(":", F.lit(seed), "b", "k").cast("binary")).alias("h"))
    weights = []
    for j in range(4):
        u = F.conv(F.substring("h", 8 * j + 1, 8), 16, 10).cast("bigint")
        weights.append(sum(((u >= bound).cast("int") for bound in POISSON), F.lit(0)).alias(f"w{j}"))
    sums = hashed.select("x", "b", *weights).groupBy("b").agg(*[F.array(F.sum(f"w{j}").cast("double"), F.sum(F.col(f"w{j}") * F.col("x"))).alias(f"s{j}") for j in range(4)])
    each = sums.select("b", F.posexplode(F.array(*[f"s{j}" for j in range(4)])).alias("j", "s")).where((F.col("b") * 4 + F.col("j") < resamples) & (F.col("s")[0] > 0))
    means = each.select((F.col("s")[1] / F.col("s")[0]).alias("m"))
    lo, hi = (1 - confidence) / 2, (1 + confidence) / 2
    return means.agg(F.lit(float(head.m)).alias("mean"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("stderr"), F.percentile("m", lo).alias("ci_low"), F.percentile("m", hi).alias("ci_high"))


def run_averages(metrics: DataFrame) -> DataFrame:
    """(metric, value, num_tasks): the mean of each metric over the tasks that have it; ``metrics``: task, metric, value."""
    return metrics.where(F.col("value").isNotNull()).groupBy("metric").agg(F.avg("value").alias("value"), F.count_distinct("task").alias("num_tasks"))


#: The metrics that count as a task's primary one where it declares none, in this order.
PRIMARY = ("pass@1", "accuracy", "prompt_level_strict_acc")


def primary_metric(metrics: DataFrame, declared: str | None = None) -> DataFrame:
    """(task, metric, value): the declared metric, else the first of ``PRIMARY``, else the first by name."""
    order = F.array_position(F.array(*map(F.lit, [*([declared] if declared else []), *PRIMARY])), F.col("metric"))
    rank = F.when(order > 0, order).otherwise(F.lit(99))
    best = metrics.where(F.col("value").isNotNull()).groupBy("task").agg(F.min(F.struct(rank.alias("rank"), "metric", "value")).alias("b"))
    return best.select("task", F.col("b.metric").alias("metric"), F.col("b.value").alias("value"))


def primary_aggregate(primary: DataFrame) -> DataFrame:
    """One row (primary_mean, num_tasks); null without tasks."""
    return primary.agg(F.avg("value").alias("primary_mean"), F.count("value").alias("num_tasks"))


def tier_report(flags: DataFrame) -> DataFrame:
    """(tier, name, correct, total, accuracy) by instruction family and by instruction; ``flags``: instruction_id, followed."""
    both = flags.select(F.explode(F.array(F.struct(F.lit(0).alias("tier"), F.substring_index("instruction_id", ":", 1).alias("name")), F.struct(F.lit(1).alias("tier"), F.col("instruction_id").alias("name")))).alias("t"), "followed")
    return both.groupBy("t.tier", "t.name").agg(F.count_if("followed").alias("correct"), F.count("*").alias("total")).withColumn("accuracy", F.col("correct") / F.col("total"))
