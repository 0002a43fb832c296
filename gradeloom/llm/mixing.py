"""Mixing sources to target weights, by entropy balancing.

Sources in order of code points, null last, have weights that repeat a given
list. Their targets share the words of all documents by weight; a target stops
at ``most`` times its source's words, and the excess goes to the others by
weight until none is above.

Document rates minimise the relative entropy to the rate 1, taken over words,
under the constraint that each source's words times rates equal its target. The
convex dual has one multiplier a source, and the rate of a document is the
exponential of its source's. Newton steps solve it: the gradient of the dual is the
sum over documents of words times rate, less the target, its second derivative that
sum itself, and mixed ones are zero, as no document has two sources. Each step sums
over all documents, partially on each task, and moves every multiplier by gradient
over curvature, by 2 at most; steps go on until no sum misses its target by more
than the tolerance.

Rates are rounded to copies: each document has the whole part of its rate, and a
share of a source's documents one more: in the order of a hash, those that fit
into what is missing, until the next would exceed it. That is done ``passes``
times with what is still missing and the documents without that extra copy; at
last the smallest one left is added if that comes nearer to the target.

All steps are DataFrame functions. Cumulative sums run over ranges of the hash in
each source, as many as the table's size asks for, so a hot source is spread over
tasks; the result is the same for any number of ranges.

Defined cases: a null text has size 0. Documents of size 0 are taken 0 words.
Null sources are one source, the last. Repeated rows count as documents each,
and have equal copies or copies in the order of the table's values; ties are
broken by (hash, id, size), and equal rows share their place. An empty table
gives an empty table. Columns other than the id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.shared import Scratch, discard, materialize

WEIGHTS = (5.0, 2.0, 1.0)


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def placed(sources: DataFrame) -> DataFrame:
    """Adds ``place``: the position of each source from 0, null last, from a distributed sort."""
    ordered = sources.orderBy(F.col("source").asc_nulls_last()).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    ordered = materialize(ordered, "mix-order")
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    begin = sizes.select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("begin"))
    return ordered.join(F.broadcast(begin), F.col("part") == F.col("of")).withColumn("place", F.col("begin") + F.col("row")).drop("part", "row", "of", "begin")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row for each source, read once for each round of capping."""
    place = F.pmod(F.col("place"), F.lit(len(weights)))
    ranked = materialize(placed(sources).withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))).drop("place"), "mix-sources")
    cap = F.lit(float(most)) * F.col("source_size")
    whole = ranked.agg(F.sum("source_size").alias("s"), F.sum("w").alias("w")).first()
    if not whole.s:
        return ranked.select("source", "source_size", F.lit(0.0).alias("target"))
    total = float(whole.s)
    level = total / whole.w
    while True:  # each round caps at least one more source, or ends
        capped = F.col("w") * F.lit(level) > cap
        r = ranked.agg(F.sum(F.when(capped, F.col("source_size"))).alias("s"), F.sum(F.when(~capped, F.col("w"))).alias("w")).first()
        new = (total - most * (r.s or 0)) / r.w if r.w else level
        if new <= level:
            break
        level = new
    return ranked.select("source", "source_size", F.least(F.col("w") * F.lit(level), cap).alias("target"))


def balance(rows: DataFrame, plan: DataFrame, *, tolerance: float = 1e-8, most_steps: int = 100) -> DataFrame:
    """``plan`` (source, source_size, target) with ``rate``: the exponential of the multiplier that solves the dual over ``rows`` (source, size).

    ``tolerance``: of the last step that is still taken; Newton's error after it is about its square.
    Where a target is 0 or its source has no words the rate is 0. Steps are far fewer than ``most_steps``; if they
    aren't, that raises.
    """
    open_ = (F.col("target") > 0) & (F.col("source_size") > 0)
    now = table = plan.withColumn("m", F.lit(0.0))
    for _ in range(most_steps):
        own = now.where(open_).select(F.col("source").alias("of"), "m")
        # the words at the present rates: the dual's curvature, and its gradient but for the target
        words = rows.where("size > 0").join(own, F.col("source").eqNullSafe(F.col("of"))).groupBy("of").agg(F.sum(F.col("size") * F.exp("m")).alias("words"))
        step = (F.col("words") - F.col("target")) / F.col("words")
        moved = now.join(words, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "source_size", "target", F.when(open_, F.col("m") - F.greatest(F.lit(-2.0), step)).alias("m"), F.abs(step).alias("missed"))
        moved = materialize(moved, "mix-multipliers")
        discard(table)
        missed, now, table = moved.agg(F.max("missed")).first()[0], moved.drop("missed"), moved
        if missed is None or missed <= tolerance:
            return now.select("source", "source_size", "target", F.round(F.when(open_, F.exp("m")).otherwise(F.lit(0.0)), 9).alias("rate"))
    raise RuntimeError(f"no balance after {most_steps} steps: {missed}")


def _gap(rows: DataFrame) -> DataFrame:
    """(of, gap): the words that each source's extra copies still miss."""
    return rows.groupBy(F.col("source").alias("of")).agg((F.first("extra") - F.coalesce(F.sum(F.when(F.col("more"), F.col("size"))), F.lit(0))).alias("gap"))


def _fill(rows: DataFrame) -> DataFrame:
    """Give one more copy to the documents without that fit into their source's gap, in the order of the hash, as long as their sum fits.

    The sums are cumulative inside buckets of the hash, and over the buckets' sums.
    """
    fits = (~F.col("more")) & (F.col("extra") > 0) & (F.col("size") <= F.col("gap"))
    own = rows.join(_gap(rows), F.col("source").eqNullSafe(F.col("of"))).withColumn("fit", F.when(fits, F.col("size")).otherwise(F.lit(0))).drop("of")
    sums = own.groupBy("source", "b").agg(F.sum("fit").alias("n"))
    before = sums.select(F.col("source").alias("of"), F.col("b").alias("k"), (F.sum("n").over(Window.partitionBy("source").orderBy("b")) - F.col("n")).alias("before"))
    inside = F.sum("fit").over(Window.partitionBy("source", "b").orderBy("h", "id", "size"))
    placed = own.withColumn("inside", inside).join(before, F.col("source").eqNullSafe(F.col("of")) & (F.col("b") == F.col("k")))
    more = F.col("more") | ((F.col("fit") > 0) & (F.col("before") + F.col("inside") <= F.col("gap")))
    return placed.withColumn("more", more).drop("gap", "fit", "of", "k", "before", "inside")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, passes: int = 6, per_bucket: int = 50_000) -> DataFrame:
    """(id, size, source, source_size, target, copies, taken) for every document.

    ``per_bucket``: the rows of a range of the hash, over which cumulative sums run in one task.
    """
    with Scratch(docs.sparkSession) as scratch:
        own = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
        own = materialize(own.withColumn("h", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))), "mix-docs")
        sized = own.groupBy("source").agg(F.sum("size").alias("source_size"))
        plan = balance(own, targets(sized, weights, most))
        buckets = own.count() // per_bucket + 1
        plan = plan.select(F.col("source").alias("of"), "source_size", "target", F.floor("rate").alias("base"), (F.col("target") - F.floor("rate") * F.col("source_size")).alias("extra"))
        b = F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") * buckets, 32)  # ranges in the hash's own order
        now = own.withColumn("b", b).join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("more", F.lit(False))
        for k in range(passes):
            before, now = now, materialize(_fill(now), "mix-taken")
            discard(before)
        now = scratch.keep(now if passes else materialize(now, "mix-taken"))
    gap = _gap(now)
    last = now.where((~F.col("more")) & (F.col("size") > 0) & (F.col("extra") > 0)).join(gap, F.col("source").eqNullSafe(F.col("of")))
    last = last.groupBy("of").agg(F.min(F.struct("size", "h", "id")).alias("pick"), F.first("gap").alias("gap")).where(F.col("pick.size") < 2 * F.col("gap")).drop("gap")
    hit = (F.col("pick.size") == F.col("size")) & (F.col("pick.h") == F.col("h")) & F.col("pick.id").eqNullSafe(F.col("id"))
    now = now.join(last, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("more", F.col("more") | F.coalesce(hit, F.lit(False)))
    copies = F.col("base") + F.col("more").cast("bigint")
    return now.select(F.col("id").alias(id_col), "size", "source", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("bigint").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))
