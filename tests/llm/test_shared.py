from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gradeloom.llm.shared import Scratch, clear_shared, discard, materialize, not_held_out, shared_dir


def test_tables_go_to_the_shared_folder(spark):
    folder = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:"))
    df = materialize(spark.range(5), "test-table")
    assert df.count() == 5 and list(folder.glob("gradeloom/test-table-*"))
    assert materialize(spark.range(0), "empty").count() == 0
    clear_shared(spark)
    assert not (folder / "gradeloom").exists()
    assert materialize(spark.range(3), "again").count() == 3


def test_split(spark):
    import zlib

    rows = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long")
    got = {r.doc_id: r.m for r in rows.select("doc_id", not_held_out(F.col("doc_id")).alias("m")).collect()}
    assert all(got[i] == (zlib.crc32(str("" if i is None else i).encode()) % 3 != 1) for i in got)


def test_scratch_removes_what_is_not_kept(spark):
    with Scratch(spark) as outer:
        with Scratch(spark) as scratch:
            a = materialize(spark.range(3), "a")
            b = scratch.keep(materialize(a.select((F.col("id") + 1).alias("id")), "b"))
        at = lambda t: Path(t.written_to.removeprefix("file://")).exists()
        assert not at(a) and at(b)
        assert sorted(r.id for r in b.collect()) == [1, 2, 3]
        discard(spark.range(1))  # not a written table
    assert not at(b)
    with pytest.raises(ValueError), Scratch(spark):
        c = materialize(spark.range(2), "c")
        raise ValueError
    assert at(c)
