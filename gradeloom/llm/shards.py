"""Links inside shards, where a shard may hold any share of the rows.

A linker is a function of whole shards: from batches of rows (key, entry, ...) it
yields spanning links (a, b) between entries of one key. Shards of up to ``limit``
rows are dealt to tasks by key. A larger one is cut, and no link is lost:

1. the shard is cut into chunks by a hash of the entry, each linked by itself;
2. one entry of each component found so far stands for it; these are linked with
   each other, in chunks as well where they are many;
3. the entries outside of the shard's largest component, in blocks, meet every
   chunk of the shard.

Step 3 covers every pair that may still lack a link, as only pairs inside the
largest component are left out. A task holds two times ``limit`` rows of a shard
at most. The work of step 3 is (rest blocks) x (chunks), never a pair of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.components import connected_components
from gradeloom.llm.shared import materialize

Linker = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _parts(n: Column, limit: int) -> Column:
    return F.greatest(F.ceil(n / limit), F.lit(1)).cast("bigint")


def _dealt(rows: DataFrame, columns: list[str], n: int, per_task: int, linker: Linker) -> DataFrame:
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // per_task))
    kind = rows.schema["entry"].dataType.simpleString()
    return rows.select(*columns).repartition(tasks, "key").mapInArrow(linker, f"a {kind}, b {kind}")


def link_shards(rows: DataFrame, linker: Linker, *, limit: int, per_task: int) -> tuple[DataFrame, bool]:
    """(a, b): links that span what ``linker`` would link in whole shards of ``rows`` (key: long, entry, ...); whether all shards stayed whole.

    ``rows`` should be a written table, as it is read more than once.
    """
    columns = rows.columns
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"))
    found = sizes.agg(F.sum("size").alias("n"), F.sum(F.when(F.col("size") > limit, F.col("size"))).alias("hot")).first()
    if not found.hot:
        return _dealt(rows, columns, found.n or 0, per_task, linker), True
    # there are fewer large shards than rows / limit; Spark broadcasts the list if it is small, else splits skewed keys
    large = materialize(sizes.where(F.col("size") > limit).select(F.col("key").alias("of"), _parts(F.col("size"), limit).alias("parts")), "large-shards")
    small = _dealt(rows.join(large, F.col("key") == F.col("of"), "left_anti"), columns, found.n - found.hot, per_task, linker)
    cut = rows.join(large, F.col("key") == F.col("of")).drop("of").withColumn("chunk", F.pmod(F.xxhash64("entry", F.lit(1)), F.col("parts")))
    cut = materialize(cut, "cut-shards")

    def linked(some: DataFrame, chunk: Column, n: int, name: str) -> DataFrame:
        return materialize(_dealt(some.withColumn("key", F.xxhash64(F.lit(name), "key", chunk)), columns, n, per_task, linker), name)

    links = linked(cut, F.col("chunk"), found.hot, "links-in-chunks")

    def components() -> DataFrame:
        roots = connected_components(links)
        return cut.select("key", "entry", "parts").join(roots, F.col("entry") == F.col("node"), "left").select("key", "entry", "parts", F.coalesce("root", "entry").alias("root"))

    first = components().groupBy("key", "root").agg(F.min("entry").alias("entry"))
    first = materialize(first.select("key", "entry"), "representatives")
    many = first.groupBy("key").agg(_parts(F.count("*"), limit).alias("p")).withColumnRenamed("key", "of")
    own = cut.join(first.select(F.col("key").alias("k"), F.col("entry").alias("e")), (F.col("key") == F.col("k")) & (F.col("entry") == F.col("e")), "left_semi").dropDuplicates(["key", "entry"])
    own = own.join(many, F.col("key") == F.col("of"))
    links = materialize(links.unionByName(linked(own, F.pmod(F.xxhash64("entry", F.lit(2)), F.col("p")), first.count(), "links-between")), "links")

    named = materialize(components(), "shard-components")
    counts = named.groupBy("key", "root").agg(F.count("*").alias("n"))
    best = counts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("best"), F.sum("n").alias("all")).select(F.col("key").alias("of"), F.col("best.root").alias("most"), _parts(F.col("all") - F.col("best.n"), limit).alias("blocks"), (F.col("all") > F.col("best.n")).alias("open"))
    rest = named.join(best, F.col("key") == F.col("of")).where("root <> most").select(F.col("key").alias("k"), F.col("entry").alias("e")).distinct()
    rest = materialize(rest, "rest")
    n_rest = rest.count()
    if not n_rest:
        return small.unionByName(links), False
    open_ = cut.join(best.where("open").select("of", "blocks"), F.col("key") == F.col("of")).drop("of")
    block = F.pmod(F.xxhash64("entry", F.lit(3)), F.col("blocks"))
    hosts = open_.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    guests = open_.join(rest, (F.col("key") == F.col("k")) & (F.col("entry") == F.col("e")), "left_semi").withColumn("block", block)
    guests = guests.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).select(*hosts.columns)
    n = hosts.count() + guests.count()
    met = linked(hosts.unionByName(guests), F.struct("chunk", "block"), n, "links-of-rest")
    return small.unionByName(links).unionByName(met), False
