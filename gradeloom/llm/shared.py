"""Helpers that the operators of this subpackage share.

Intermediate tables go to the shared folder that the cluster names in
``spark.checkpoint.dir`` as Parquet: every executor reads them again after a
loss, and no lineage is replayed.
"""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset (tests, local mode)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="gradeloom-")
    return _LOCAL[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gradeloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors. ``by``: a column to lay folders out by."""
    path = fresh_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    if _OPEN.get():
        _OPEN.get().paths.append(path)
    return out


class Scratch:
    """``with Scratch(spark) as scratch``: tables materialized inside are removed at its end, but those given to ``keep``.

    What stays must be a written table, so that nothing which is removed is ever read again, not by a recovery either.
    After an error all tables stay.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], []

    def keep(self, table: DataFrame) -> DataFrame:
        self.kept.append(table.written_to)
        return table

    def __enter__(self) -> Scratch:
        self.token = _OPEN.set(self)
        return self

    def __exit__(self, error: type | None, *_) -> None:
        _OPEN.reset(self.token)
        if _OPEN.get():
            _OPEN.get().paths += self.paths if error else self.kept
        if not error:
            for path in set(self.paths) - set(self.kept):
                remove(self.spark, path)


_OPEN: ContextVar[Scratch | None] = ContextVar("open scratch", default=None)


def discard(table: DataFrame) -> None:
    """Remove a materialized table that nothing reads any more; others are left alone."""
    if hasattr(table, "written_to"):
        remove(table.sparkSession, table.written_to)


#: A key with over one in so many rows is hot; by that there are at most so many hot keys.
HOT = 1000


def lookup(rows: DataFrame, key: str, table: DataFrame, of: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (one row for each value of ``of``, with the number ``n`` of its rows; ``n`` and ``of`` are dropped).

    ``total``: at least the number of rows. Keys with over ``total / HOT`` rows are at most ``HOT`` by that, so
    they are broadcast and their rows stay where they are; the others are joined by a shuffle.
    """
    hot = table.where(F.col("n") * HOT > total)
    own = F.col(key) == F.col(of)
    spread = rows.join(F.broadcast(hot), own).drop("n", of)
    cold = rows.join(F.broadcast(hot.select(of)), own, "left_anti").join(table.where(F.col("n") * HOT <= total), own).drop("n", of)
    return spread.unionByName(cold)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear_shared(spark: SparkSession) -> None:
    """Remove all intermediate tables of these operators from the shared folder; call it once their results are written."""
    remove(spark, f"{shared_dir(spark)}/gradeloom")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Limit what one Arrow batch holds, so that very long texts don't meet in one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def not_held_out(doc_id: Column) -> Column:
    """True for rows that training may read: crc32 of the id as text, modulo 3, is not 1 (null ids: of the empty text)."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3) != 1
