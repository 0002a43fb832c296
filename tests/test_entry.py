import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents benchmark conversations pages".split()

needs_data = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are absent")


@needs_data
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["metric", "value"] and df.count() > 10


def test_every_oracle_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_without_the_optional_subpackage():
    code = "import sys; sys.modules['gradeloom.llm'] = sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert e.llm is None and 'pipeline' not in e.queries() and not [q for q in e.queries() if q.startswith('op')] and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_it():
    for p in (ROOT / "gradeloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "gradeloom.llm" not in p.read_text(), p


SOME = ["sample_accuracy", "pass_at_k", "pass_k_gate", "accuracy_by_group", "first_record", "micro_instruction", "bootstrap_ci", "grid_pending", "keep_last", "sample_results", "mcq_extract", "if_strict_loose", "mmlu_reindex", "run_id", "if_words__repeats"]


@needs_data
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda d: sorted(tuple(map(str, r)) for r in d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False))
    assert rows(got) == rows(want)


@needs_data
def test_binary_metrics_see_every_event(spark):
    got = {r.metric: r.value for r in entry.queries()["binary_metrics"](spark, str(DATA)).collect()}
    con = duckdb.connect()
    want = con.sql(f"SELECT avg(a), avg(p) FROM (SELECT avg(CAST(event_type = 'purchase' AS INT)) AS a, avg(CAST(value > 10 AS INT)) AS p FROM read_parquet('{DATA}/events.parquet') GROUP BY user_id)").df().iloc[0]
    assert abs(got["accuracy"] - want.iloc[0]) < 1e-8 and abs(got["parsed_rate"] - want.iloc[1]) < 1e-8
