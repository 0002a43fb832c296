"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of (hi, lo, n, last, open), bucketed and sorted by the 128-bit
line hash: the number of documents that hold the line, the largest id among them,
and while they are under ``min_docs`` the ids of all of them. A batch of documents
becomes a run at level 0, which is merge-joined bucket by bucket with the earlier
runs; only the batch is shuffled. A line that now has ``min_docs`` documents is
lost by all documents of the batch but the one with the largest id, by the earlier
documents that were open, and by the earlier largest one if the batch has a larger
id. So each batch's decisions are complete with the batch, and no earlier document
is read again. When a level has ``fanout`` runs they are compacted into one run of
the next level.

Line keys are the line without ``[\\x20\\x09-\\x0D]`` at both ends, with A-Z in
lower case; keys under ``min_chars`` code points always stay.

Defined cases: a null text is one empty line. Every row counts as a document, so
a repeated row counts twice, and all rows with the largest id keep the line. A
null id is smaller than any other; if only null ids hold a line, all keep it. An
empty table gives an empty table. Columns other than the id, the text and those
named in ``carry`` are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.shared import Scratch, bounded_batches, fresh_path, lookup, materialize, remove


def line_keys(text: bytes) -> list[bytes]:
    """Keys of all lines; bytes.lower and bytes.strip know ASCII only, as the rule asks."""
    return [k.strip() for k in text.lower().split(b"\n")]


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def _digests(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype="<i8").reshape(-1, 2)


def _binary(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in pc.cast(pc.cast(column, pa.large_string()), pa.large_binary()).to_pylist()]


def occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int, batches: int) -> DataFrame:
    """(batch, hi, lo, id): one row for each distinct long line of each document."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows, keys = [], []
            for i, text in enumerate(_binary(part.column(2))):
                own = {k for k in line_keys(text) if _long_enough(k, min_chars)}
                rows += [i] * len(own)
                keys += sorted(own)
            if keys:
                h, at = _digests(keys), pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(h[:, 0]), pa.array(h[:, 1]), part.column(1).take(at)], ["batch", "hi", "lo", "id"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.pmod(F.xxhash64(F.col(id_col)), F.lit(batches)).cast("int").alias("batch"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, f"batch int, hi bigint, lo bigint, id {kind}")


class LineRuns:
    """Levels of sorted runs as bucketed tables; the driver keeps only their names."""

    def __init__(self, spark: SparkSession, fanout: int = 3, *, min_docs: int = 3, buckets: int | None = None):
        """``buckets``: of every run; equal hashes meet in one, so runs are joined without a shuffle."""
        self.spark, self.fanout, self.min_docs = spark, fanout, min_docs
        self.buckets = buckets or spark.sparkContext.defaultParallelism
        self.root, self.levels, self.written = fresh_path(spark, "line-runs"), {}, 0
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # a bucket is one sorted file

    def _deal(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, "hi", "lo")

    def _write(self, rows: DataFrame) -> str:
        """A run of rows that lie in the partitions of ``_deal``: one sorted file a bucket."""
        name, self.written = f"line_run_{self.root.rsplit('-', 1)[1]}_{self.written}", self.written + 1
        rows.sortWithinPartitions("hi", "lo").write.bucketBy(self.buckets, "hi", "lo").sortBy("hi", "lo").option("path", f"{self.root}/{name}").format("parquet").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, f"{self.root}/{name}")

    def runs(self) -> list[str]:
        return [r for level in sorted(self.levels) for r in self.levels[level]]

    def _of_batch(self, batch: DataFrame) -> DataFrame:
        own = batch.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("who").alias("last"), F.min("who").alias("least"))
        open_ = F.when(F.col("n") == 1, F.array("last")).when(F.col("n") == 2, F.array("least", "last"))
        if self.min_docs > 3:  # some lines have more than two open documents, under min_docs
            few = own.where((F.col("n") > 2) & (F.col("n") < self.min_docs)).select("hi", "lo")
            more = batch.join(few, ["hi", "lo"]).groupBy("hi", "lo").agg(F.collect_list("who").alias("all"))
            own, open_ = own.join(more, ["hi", "lo"], "left"), open_.otherwise(F.col("all"))
        return own.select("hi", "lo", "n", "last", F.when(F.col("n") < self.min_docs, open_).alias("open"))

    def _every(self, runs: list[str]) -> DataFrame:
        """The rows of some runs as plain files: a union of bucketed tables claims a partitioning that it lacks."""
        return self.spark.read.schema(self.spark.table(runs[0]).schema).parquet(*[f"{self.root}/{r}" for r in runs])

    def _compact(self, level: int) -> None:
        full = self.levels.pop(level)
        merged = self._every(full).groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.flatten(F.collect_list("open")).alias("open"))
        self.levels.setdefault(level + 1, []).append(self._write(self._deal(merged.withColumn("open", F.when(F.col("n") < self.min_docs, F.col("open"))))))
        for r in full:
            self._drop(r)

    def add(self, batch: DataFrame) -> DataFrame:
        """Add a batch (hi, lo, id), a written table; (hi, id): the lines that documents lose by it, of this batch and of earlier ones."""
        size = batch.count()
        batch = batch.select("hi", "lo", F.struct(F.col("id").isNotNull().alias("known"), F.col("id").alias("id")).alias("who"))
        run = self._write(self._deal(self._of_batch(batch)))
        now = self.spark.table(run).withColumns({"n0": F.lit(0).cast("bigint"), "last0": F.lit(None).cast(batch.schema["who"].dataType), "open0": F.array().cast(f"array<{batch.schema['who'].dataType.simpleString()}>")})
        for r in self.runs():
            old = self.spark.table(r).select(F.col("hi").alias("h"), F.col("lo").alias("l"), F.col("n").alias("m"), F.col("last").alias("a"), F.col("open").alias("o"))
            joined = now.join(old, (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l")), "left")
            now = joined.select("hi", "lo", "n", "last", (F.col("n0") + F.coalesce("m", F.lit(0))).alias("n0"), F.coalesce(F.greatest("last0", "a"), "last0", "a").alias("last0"), F.concat("open0", F.coalesce("o", F.slice("open0", 1, 0))).alias("open0"))
        hot = materialize(now.where(F.col("n") + F.col("n0") >= self.min_docs).withColumn("keeper", F.coalesce(F.greatest("last", "last0"), "last")), "hot-lines")
        mine = lookup(batch.withColumn("key", F.struct("hi", "lo")), "key", hot.select(F.struct("hi", "lo").alias("of"), "n", "keeper"), "of", size)
        mine = mine.where(F.col("who") < F.col("keeper")).select("hi", "who")
        # earlier documents: all that are still open, or the one that has kept the line
        earlier = F.when(F.col("n0") == 0, F.slice("open0", 1, 0)).when(F.col("n0") < self.min_docs, F.col("open0")).otherwise(F.array("last0"))
        theirs = hot.select("hi", "keeper", F.explode(earlier).alias("who")).where(F.col("who") < F.col("keeper")).select("hi", "who")
        lost = materialize(mine.unionByName(theirs).select("hi", F.col("who.id").alias("id")), "lost-lines")
        self.levels.setdefault(0, []).append(run)
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            self._compact(level)
            level += 1
        return lost

    def lines(self) -> DataFrame:
        """(hi, lo, n, last) over all runs."""
        out = self._every(self.runs()).groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
        return out.select("hi", "lo", "n", F.col("last.id").alias("last"))

    def clear(self) -> None:
        """Remove the runs; the decisions of ``add`` stay."""
        for r in self.runs():
            self._drop(r)
        self.levels = {}


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, n_lines, n_dropped, *carry): every document with the lines that it keeps, joined by newlines.

    ``carry`` names columns of ``docs`` to pass through. Whole texts are shuffled
    once, by id, and never grouped by line; a line that most documents hold is one
    row of a run, and its occurrences stay where they are.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    with Scratch(spark) as scratch:
        found = materialize(occurrences(docs, id_col, text_col, min_chars, batches), "line-occurrences", by="batch")
        runs = LineRuns(spark, fanout, min_docs=min_docs, buckets=max(spark.sparkContext.defaultParallelism, found.count() // (batches * 2_000_000)))
        lost = None
        for b in range(batches):
            own = scratch.keep(runs.add(found.where(F.col("batch") == b)))
            lost = own if lost is None else lost.unionByName(own)
        runs.clear()
    doomed = lost.groupBy("id").agg(F.collect_set("hi").alias("doomed"))
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)])
    joined = own.join(doomed, F.col("__id").eqNullSafe(F.col("id")), "left").drop("id")
    more = [docs.schema[c].dataType.simpleString() for c in carry]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            kept, n_lines, n_dropped = [], [], []
            for text, bad in zip(_binary(part.column(1)), part.column(part.num_columns - 1).to_pylist()):
                if not bad:
                    kept.append(text)
                    n_lines.append(text.count(b"\n") + 1)
                    n_dropped.append(0)
                    continue
                lines, bad = text.split(b"\n"), set(bad)
                at = [i for i, k in enumerate(line_keys(text)) if _long_enough(k, min_chars) and int.from_bytes(xxhash.xxh3_128_digest(k)[:8], "little", signed=True) in bad]
                gone = set(at)
                kept.append(b"\n".join(x for i, x in enumerate(lines) if i not in gone))
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
            text = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), text, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), *[part.column(2 + i) for i in range(len(carry))]], names)

    names = [id_col, text_col, "__n_lines", "__n_dropped", *carry]
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, [kind, "string", "bigint", "bigint", *more]))
    out = joined.mapInArrow(run, schema)
    return out.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), *[F.col(f"`{c}`") for c in carry])
