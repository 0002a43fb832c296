"""Strict and loose evaluation of instructions.

``responses``: sample_id, gen_idx, generation, instruction_ids (array of
strings), kwargs (array of JSON objects as strings, maybe shorter).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.instructions import NATIVE, follow, known
from gradeloom.functions.instructions_python import PREDICATES, follow_many_udf
from gradeloom.functions.text import is_blank, strip

KEY = ["sample_id", "gen_idx"]


def variants(text: Column) -> Column:
    """The response as it is, and seven laxer readings: without the first line, the last, both, each also without asterisks."""
    lines = F.split(text, "\n")
    n = F.size(lines)

    def part(begin: int, cut: int) -> Column:
        return strip(F.array_join(F.slice(lines, F.lit(begin), F.greatest(n - cut, F.lit(0))), "\n"))

    own = [text, part(2, 1), part(1, 1), part(2, 2)]
    return F.array(*own, *[F.replace(v, F.lit("*"), F.lit("")) for v in own])


def evaluate(responses: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(sample_id, gen_idx, strict, loose, strict_flags, loose_flags, errors): one row a response.

    An instruction without its arguments follows neither way and is named in
    ``errors``. ``names``: the instruction ids that occur, if known.
    """
    wanted = names or known()
    slow, quick = any(n in PREDICATES for n in wanted), [n for n in wanted if n in NATIVE]
    args = F.transform("instruction_ids", lambda _, i: F.coalesce(F.get("kwargs", i), F.lit("{}")))
    each = responses.select(*KEY, F.coalesce("generation", F.lit("")).alias("text"), "instruction_ids", args.alias("args"))
    read = each.select(*KEY, "instruction_ids", "args", F.posexplode(variants(F.col("text"))).alias("v", "variant"))
    # Python sees each reading once, with all its instructions
    judge = follow_many_udf("variant", "instruction_ids", "args") if slow else F.transform("instruction_ids", lambda _: F.lit(None).cast("boolean"))
    told = read.withColumn("told", judge).select(*KEY, "v", "variant", F.posexplode(F.arrays_zip("instruction_ids", "args", "told")).alias("pos", "z"))
    name, own = F.col("z.instruction_ids"), F.col("z.told")
    flag = F.coalesce(follow(name, F.col("variant"), F.col("z.args"), quick), own) if quick else own
    blank = is_blank(F.col("variant"))
    judged = told.select(*KEY, "pos", name.alias("name"), "v", blank.alias("blank"), F.when(blank, F.lit(False)).otherwise(flag).alias("ok"))
    per = judged.groupBy(*KEY, "pos").agg(
        F.first("name").alias("name"),
        F.coalesce(F.bool_or(F.when(F.col("v") == 0, F.col("ok"))), F.lit(False)).alias("s"),
        F.coalesce(F.bool_or("ok"), F.lit(False)).alias("l"),
        F.bool_or(F.col("ok").isNull() & ~F.col("blank")).alias("e"),
    )
    rows = per.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "name", "s", "l", "e"))).alias("r"))
    return rows.select(
        *KEY,
        F.forall("r", lambda x: x.s).alias("strict"),
        F.forall("r", lambda x: x.l).alias("loose"),
        F.transform("r", lambda x: x.s).alias("strict_flags"),
        F.transform("r", lambda x: x.l).alias("loose_flags"),
        F.transform(F.filter("r", lambda x: x.e), lambda x: x["name"]).alias("errors"),
    )
