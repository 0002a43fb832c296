import random
from collections import Counter

import pytest
from test_line_dedup import brute as brute_lines

import corpus_pipeline as cp
from gradeloom.llm.mixing import mix


def word(rng):
    return "".join(rng.choice(["ba", "ko", "ri", "te", "lu", "sha", "mi"]) for _ in range(rng.randint(2, 4)))


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    rng = random.Random(8)
    rows, labels = [], []
    passage = "this passage of the terms of service is found on many pages of the site"
    for i in range(700):
        toxic = i % 7 == 0
        words = [word(rng) for _ in range(rng.randint(30, 120))]
        if toxic:
            for insult in rng.sample(["idiot", "moron", "vexlorp"], 2):
                words.insert(rng.randrange(len(words)), insult)
        text = " ".join(words) + (f"\n{passage}" if i % 5 == 0 else "")
        rows.append((i, text, "en", f"s{i % 4}", len(text), "extra"))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    copies = [(1000 + i, ("one more " if i % 2 else "") + rows[i * 7 + 3][1], "en", "s9", 1, "extra") for i in range(30)]
    odd = [(2000, None, None, None, None, None), (2001, "", "en", "s1", 0, ""), (None, "a text without an id", "en", "s1", 20, "x"), (2002, "long " * 60_000, "en", "s2", 300_000, "x")]
    return rows + copies + odd, labels, tmp_path_factory.mktemp("tables")


@pytest.fixture(scope="module")
def stages(spark, tables):
    rows, labels, path = tables
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, entry string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs, out = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in cp.STAGES:
        after = stage(spark, docs, str(path))
        after.write.parquet(f"{path}/{name}")
        out.append((name, docs, spark.read.parquet(f"{path}/{name}")))
        docs = out[-1][2]
    return {name: (a, b) for name, a, b in out}


def test_order_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == before.columns


def test_toxicity(stages):
    before, after = stages["toxicity"]
    bad = {r.doc_id for r in before.collect() if any(w in (r.text or "") for w in ("idiot", "moron", "vexlorp"))}
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == bad


def test_line_dedup(stages):
    before, after = stages["line_dedup"]
    want = [(i, t) for i, _, _, t in brute_lines([(r.doc_id, r.text) for r in before.collect()])]
    assert sorted(((r.doc_id, r.text) for r in after.collect()), key=str) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_near_dedup(stages):
    before, after = stages["near_dedup"]
    kept = {r.doc_id for r in after.collect()}
    gone = {r.doc_id for r in before.collect()} - kept
    assert gone == {i for i in range(1000, 1030) if i in {r.doc_id for r in before.collect()}} | {2001}


def test_mixing(stages):
    before, after = stages["mixing"]
    want = Counter({r.doc_id: r.copies for r in mix(before).collect() if r.copies})
    rows = after.collect()
    assert Counter(r.doc_id for r in rows) == want and max(want.values()) <= 3
    texts = {r.doc_id: r.text for r in before.collect()}
    assert all(texts[r.doc_id] == r.text for r in rows)


def test_packing_and_run(spark, stages, tables):
    before, after = stages["packing"]
    assert Counter(r.doc_id for r in after.where("piece = 0").collect()) == Counter(r.doc_id for r in before.collect())
    used = after.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in used) <= 4096
    assert Counter(map(tuple, cp.run(spark, str(tables[2])).drop("sequence_id", "offset").collect())) == Counter(map(tuple, after.drop("sequence_id", "offset").collect()))


@pytest.mark.parametrize("stage", [s for _, s in cp.STAGES], ids=[n for n, _ in cp.STAGES])
def test_empty_table(spark, stages, tables, stage):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert stage(spark, docs, str(tables[2])).collect() == []
