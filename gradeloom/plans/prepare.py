"""Data preparation: raw tables of each source to the raw rows of a task.

Sources are DataFrames (read from CSV, JSON or Parquet); downloading is not the
engine's business. Invalid rows are kept out and reported by ``Task.errors``.
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions.text import strip
from gradeloom.plans.tasks import LETTERS, subset_description


def letter(index: Column) -> Column:
    return F.substring(F.lit(LETTERS), index.cast("int") + 1, F.lit(1))


def letter_map(options: Column) -> Column:
    return F.map_from_arrays(F.transform(options, lambda _, i: letter(i)), options)


def gold_index(index: Column, count: Column) -> Column:
    """An index that equals the number of choices counts from one."""
    return F.when((index == count) & (count >= 2), count - 1).otherwise(index)


def choice_sets(parts: Mapping[str, DataFrame], order: str = "row") -> DataFrame:
    """Union of subsets (query, choices, gold, ``order``): questions without prefixes, choices by letter, ids ``subset_00012``."""
    out = None
    for subset, rows in parts.items():
        query = strip(F.col("query"))
        body = strip(F.regexp_replace(query, r"^Q:", ""))
        question = strip(F.element_at(F.split(body, "Answer Choices:"), 1))
        clean = F.transform("choices", lambda c: F.coalesce(F.nullif(strip(F.regexp_replace(strip(c), r"(?U)^\([A-Z]\)\s*", "")), F.lit("")), strip(c)))
        own = rows.select(
            F.concat(F.lit(f"{subset}_"), F.lpad(F.col(order).cast("string"), 5, "0")).alias("id"),
            F.lit(subset).alias("subset"),
            F.coalesce(F.nullif(question, F.lit("")), query).alias("question"),
            query.alias("query"),
            letter_map(clean).alias("choices"),
            letter(gold_index(F.get("gold", F.lit(0)) if rows.schema["gold"].dataType.typeName() == "array" else F.col("gold"), F.size(clean))).alias("answer"),
            F.lit(subset).alias("source"),
        )
        out = own if out is None else out.unionByName(own)
    return out


def maths(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c).cast("string").alias(c) for c in ("id", "problem", "answer", "solution", "url", "year")], F.lit("").alias("source"))


def subsets(parts: Mapping[str, DataFrame], order: str = "row") -> DataFrame:
    """Union of subsets (input, target); the target is the answer as it stands."""
    out = None
    for subset, rows in parts.items():
        own = rows.select(F.concat(F.lit(f"{subset}_"), F.lpad(F.col(order).cast("string"), 5, "0")).alias("id"), F.lit(subset).alias("subset"), strip(F.col("input")).alias("input"), strip(F.col("target")).alias("target"), strip(F.col("target")).alias("answer"), subset_description(F.lit(subset)).alias("description"), F.lit("").alias("source"))
        out = own if out is None else out.unionByName(own)
    return out


def permutations(spark: SparkSession, rows: int, seed: int = 0) -> DataFrame:
    """(row, permutation): the order of four choices for each row, from one seeded generator on the driver, stored as data."""
    rng, out = random.Random(seed), []
    for i in range(rows):
        p = [0, 1, 2, 3]
        rng.shuffle(p)
        out.append((i, p))
    return spark.createDataFrame(out, "row long, permutation array<int>")


def four_choices(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """Questions with one right and three wrong answers in a given order; ``rows`` has the source's column names and row."""

    def clean(name: str) -> Column:
        text = strip(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")))
        return F.when(F.lower(text) == "nan", "").otherwise(text)

    every = F.array(*[clean(c) for c in ("Correct Answer", "Incorrect Answer 1", "Incorrect Answer 2", "Incorrect Answer 3")])
    ident = F.coalesce(F.nullif(clean("Record ID"), F.lit("")), F.format_string("row_%04d", F.col("row")))
    out = rows.join(orders, "row").withColumn("__c", F.transform("permutation", lambda i: F.get(every, i)))
    return out.select(ident.alias("id"), ident.alias("record_id"), clean("Question").alias("question"), letter_map(F.col("__c")).alias("choices"), letter(F.array_position("permutation", 0) - 1).alias("answer"), clean("Correct Answer").alias("correct_answer"), clean("High-level domain").alias("domain"), clean("Subdomain").alias("subdomain"), F.lit("").alias("source"))


def reindex(options: Column, index: Column, answer: Column | None = None) -> tuple[Column, Column]:
    """(options, index) without blank and N/A options; a dropped answer falls back on its letter."""
    tagged = F.transform(options, lambda o, i: F.struct(strip(o).alias("text"), i.alias("i")))
    kept = F.filter(tagged, lambda x: (x.text != "") & (F.upper(x.text) != "N/A"))
    at = F.array_position(F.transform(kept, lambda x: x.i), index.cast("int"))
    back = F.instr(F.lit(LETTERS), F.upper(strip(answer))) if answer is not None else F.lit(0)
    return F.transform(kept, lambda x: x.text), F.when(at > 0, at - 1).when(back > 0, back - 1).cast("int")


def many_choices(rows: DataFrame) -> DataFrame:
    kept, at = reindex(F.col("options"), F.col("answer_index"), F.col("answer"))
    return rows.select(F.col("question_id").cast("string").alias("id"), F.col("question_id").cast("int").alias("question_id"), strip(F.col("question")).alias("question"), letter_map(kept).alias("choices"), letter(at).alias("answer"), strip(F.col("category")).alias("category"), strip(F.col("src")).alias("src"), F.lit("").alias("source"))


def json_lines(lines: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """(value, ok): lines that aren't blank, and whether each is a JSON object with the required keys."""
    own = lines.select(F.trim("value").alias("value")).where("value <> ''")
    keys = F.json_object_keys("value")
    ok = keys.isNotNull()
    for r in required:
        ok = ok & F.array_contains(keys, r)
    return own.withColumn("ok", F.coalesce(ok, F.lit(False)))


def programs(rows: DataFrame) -> DataFrame:
    names = "question_id question_title question_content starter_code platform difficulty contest_id contest_date public_test_cases private_test_cases metadata".split()
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names}
    trimmed = {c: (strip(v) if c not in ("starter_code", "public_test_cases", "private_test_cases", "metadata", "contest_date") else v) for c, v in text.items()}
    date = F.col("contest_date")
    if rows.schema["contest_date"].dataType.typeName() == "timestamp":
        trimmed["contest_date"] = F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss")
    return rows.select(trimmed["question_id"].alias("id"), *[v.alias(k) for k, v in trimmed.items()])


def has_solutions(rows: DataFrame) -> bool:
    """Whether any solution cell behind the first of its row is neither blank nor redacted."""
    shown = F.exists("solution.rows", lambda r: F.exists(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), lambda x: ~strip(x).isin("", "___")))
    return bool(rows.where(shown).limit(1).count())


def first_with_solutions(candidates: Sequence[tuple[str, DataFrame]]) -> tuple[str, DataFrame]:
    """The first source that has solutions; none raises with all names."""
    for name, rows in candidates:
        if has_solutions(rows):
            return name, rows
    raise RuntimeError("no source with solutions: " + ", ".join(n for n, _ in candidates))
