"""Planning work: grids, resume, keep-last, pending pairs, unions and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["sample_id", "gen_idx"]


def grid(samples: DataFrame, n: int) -> DataFrame:
    """Every (sample_id, gen_idx) with gen_idx under n, without a join."""
    return samples.select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("gen_idx"))


def pending(samples: DataFrame, existing: DataFrame, n: int) -> DataFrame:
    """The pairs of the grid that have no record."""
    return grid(samples, n).join(existing.select(*KEY).distinct(), KEY, "left_anti")


def pending_by_sample(pairs: DataFrame) -> DataFrame:
    """(sample_id, missing, num_generations): what to ask a generator for, one row a sample."""
    return pairs.groupBy("sample_id").agg(F.array_sort(F.collect_list("gen_idx")).alias("missing")).withColumn("num_generations", F.size("missing"))


def resume(existing: DataFrame, samples: DataFrame, n: int) -> DataFrame:
    """Records of known samples with 0 <= gen_idx < n."""
    return existing.where(F.col("gen_idx").between(0, n - 1)).join(samples.select("sample_id").distinct(), "sample_id", "left_semi")


def keep_last(records: DataFrame, order: str | Column, keys: list[str] | None = None) -> DataFrame:
    """The last record of each key by ``order``: a partial maximum, not a sort of each key's rows."""
    keys = keys or KEY
    by = F.col(order) if isinstance(order, str) else order
    return records.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in records.columns if c not in keys]), by).alias("r")).select(*keys, "r.*")


def duplicate_ids(samples: DataFrame, key: str = "sample_id") -> DataFrame:
    return samples.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")


def check_unique(samples: DataFrame, key: str = "sample_id") -> None:
    """Raise if a sample id occurs twice; names eight at most."""
    bad = [str(r[0]) for r in duplicate_ids(samples, key).orderBy(key).limit(8).collect()]
    if bad:
        raise ValueError(f"duplicate sample ids: {', '.join(bad)}")


def pad_generations(generations: Column, n: Column | int) -> Column:
    """Exactly n generations: short lists end in empty strings, long ones are cut."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(F.concat(F.coalesce(generations, F.array().cast("array<string>")), F.array_repeat(F.lit(""), n)), F.lit(1), n)


def attach_generations(asked: DataFrame) -> DataFrame:
    """(sample_id, gen_idx, generation): the k-th text goes with the k-th missing index."""
    rows = asked.withColumn("generation", pad_generations(F.col("generations"), F.size("missing"))).select("sample_id", F.explode(F.arrays_zip("missing", "generation")).alias("z"))
    return rows.select("sample_id", F.col("z.missing").alias("gen_idx"), F.col("z.generation").alias("generation"))


def sample_results(samples: DataFrame, records: DataFrame) -> DataFrame:
    """Every sample with its records in the order of gen_idx; none: an empty list."""
    grouped = records.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("gen_idx", *[c for c in records.columns if c not in KEY]))).alias("records"))
    out = samples.join(grouped, "sample_id", "left")
    empty = F.array().cast(grouped.schema["records"].dataType)
    return out.withColumn("records", F.coalesce("records", empty))


def union_records(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new, allowMissingColumns=True)


def merge_summaries(new: DataFrame, old: DataFrame, key: str = "task") -> DataFrame:
    """New summaries, and the old ones of other tasks."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def load_order(records: DataFrame) -> DataFrame:
    """Adds load_seq: the position by file and row, the order in which files are read."""
    return records.withColumn("load_seq", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))


def round_robin(rows: DataFrame, index: str, workers: int) -> DataFrame:
    """Adds worker: the row's index modulo the workers."""
    return rows.withColumn("worker", F.pmod(F.col(index), F.lit(workers)))


def inspect(samples: DataFrame, prompt: Column, k: int, order: str = "sample_id") -> DataFrame:
    """The first k prompts; at least one."""
    return samples.orderBy(order).limit(max(1, k)).select("sample_id", prompt.alias("prompt"))
