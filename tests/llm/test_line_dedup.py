import hashlib
from collections import defaultdict

from gradeloom.llm.line_dedup import LineRuns, dedup_lines

WS = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=3):
    key = lambda x: x.strip(WS).translate(UPPER)
    held = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                held[k].append(i)
    rank = lambda i: -1 if i is None else i
    hot = {k: max(v, key=rank) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in hot or hot[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in dedup_lines(df, **options).select("doc_id", "n_lines", "n_dropped", "text").collect()]
    assert sorted(got, key=str) == brute(rows, options.get("min_docs", 3))


def test_against_brute_force(spark):
    a, b, é = "A line that many pages share", "Another passage shared by several", "É" * 19 + "x"
    rows = [(i, "\n".join([f"own text {i}", f" {a}\t" if i % 2 else a.upper(), b if i % 3 == 0 else "short", "", é if i < 5 else "Z"])) for i in range(30)]
    check(spark, rows)
    check(spark, rows, batches=5, fanout=2)
    more = [(i, "\n".join(f"line number {i % k} of modulus {k}" for k in range(2, 20))) for i in range(40)]
    for m in (5,):
        check(spark, more, batches=4, fanout=2, min_docs=m)


def test_edges(spark):
    line = "x" * 20
    check(spark, [(None, line), (1, line), (2, line), (2, line), (3, None), (4, ""), (5, "\n"), (6, line + "\n" + line), (7, "é" * 19), (8, "y" * 300_000)])
    check(spark, [(None, line)] * 3)
    check(spark, [])


def test_extra_columns_are_carried_or_ignored(spark):
    df = spark.createDataFrame([(i, "z" * 30, "a", 1) for i in range(4)], "doc_id long, text string, `n` string, `last` int")
    out = dedup_lines(df, carry=("n", "last"))
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped", "n", "last"]
    assert {(r.doc_id, r.text) for r in out.collect()} == {(0, ""), (1, ""), (2, ""), (3, "z" * 30)}


def test_runs_compact(spark):
    runs = LineRuns(spark, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(k, 0, b) for k in range(b + 1)], "hi long, lo long, id long"))
    assert {k: len(v) for k, v in runs.levels.items() if v} == {0: 1, 2: 1}
    assert {(r.hi, r.n, r["last"]) for r in runs.lines().collect()} == {(k, 5 - k, 4) for k in range(5)}


def test_each_batch_decides_with_the_runs(spark):
    """Earlier documents lose a line when a later batch makes it frequent, or brings a larger id."""
    runs = LineRuns(spark)
    add = lambda ids: {r.id for r in runs.add(spark.createDataFrame([(1, 2, i) for i in ids], "hi long, lo long, id long")).collect()}
    assert add([5]) == set() and add([3]) == set()
    assert add([4]) == {3, 4}  # three documents: the largest keeps it
    assert add([9, 7]) == {5, 7} and add([8]) == {8} and add([None]) == {None}
    from pyspark.sql import functions as F

    plan = runs.spark.table(runs.runs()[0]).alias("x").join(runs.spark.table(runs.runs()[-1]).alias("y"), [F.col("x.hi") == F.col("y.hi"), F.col("x.lo") == F.col("y.lo")])
    runs.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        runs.spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "Exchange" not in text and "Sort [" not in text


def test_query_digest(spark, tmp_path):
    from gradeloom.llm.queries import op9_line_dedup

    rows = [(i, f"shared line number one here\n{i}") for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in op9_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows)}
