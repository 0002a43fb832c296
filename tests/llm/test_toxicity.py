import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm.shared import not_held_out
from gradeloom.llm.toxicity import LabelModel, ToxicityModel, Voters, choose_entries, default_model, drop_toxic, entries_of, fit_linear, score, train


def word(rng):
    return "".join(rng.choice(["ba", "ko", "ri", "te", "lu", "sha", "mi", "no"]) for _ in range(rng.randint(2, 4)))


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        toxic = i % 8 == 0
        words = [word(rng) for _ in range(rng.randint(20, 80))]
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["gromf", "vexlorp" + word(rng), "idiot"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy(spark, labelled):
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in labelled], "doc_id long, text string, y string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled], "doc_id long, toxic int")
    model = train(docs, labels, not_held_out(F.col("doc_id")))
    assert any("gromf".startswith(e.strip("=*")) for e in model.voters.entries) and any(e.startswith("vexlor") for e in model.voters.entries)
    got = {r.doc_id: r.score for r in score(docs, model).collect()}
    held = [(y, got[i] >= 0.7) for i, _, y in labelled if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(0 <= s <= 1 for s in got.values())
    assert sum(p for y, p in held if y) >= 0.97 * sum(y for y, _ in held) and not any(p for y, p in held if not y)
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.7}


def test_edges(spark, labelled):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "idiot moron"), (3, "fine"), (3, "fine"), (4, "calm " * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(1, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    for labels in (none, odd):
        got = [(r.doc_id, round(r.score, 3)) for r in score(docs, train(docs, labels, F.lit(True))).collect()]
        assert sorted(got, key=str) == sorted([(1, 0.05), (2, 0.05), (None, 0.9), (3, 0.05), (3, 0.05), (4, 0.05)], key=str)
    assert score(docs.limit(0), default_model()).collect() == []


def test_label_model_counts_copies_once():
    """Voters that repeat each other become one factor; an inaccurate one is given little weight."""
    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.3).astype(int)
    good = ((y == 1) & (rng.random(4000) < 0.8)).astype(float)
    noise = (rng.random(4000) < 0.3).astype(float)
    votes = np.stack([good, good, np.where(rng.random(4000) < 0.02, 1 - good, good), noise], axis=1)
    flipped = np.where(rng.random(4000) < 0.03, 1 - y, y)
    model = LabelModel()
    q = model.fit(votes, flipped)
    assert [0, 1, 2] in [sorted(g) for g in model.groups] and [3] in model.groups
    assert ((q > 0.5) == y).mean() >= 0.97
    w = fit_linear(votes, q)
    assert w[:3].sum() > 5 * abs(w[3])


def test_entries():
    assert {"=idiots", "idio*", "idiots*"} <= entries_of({"idiots"}) and "idio**" in entries_of({"idiots", "idiotic"})
    n1 = {"=bad": 50, "bad*": 50, "=the": 60, "=rare": 2}
    assert choose_entries(n1, {"=the": 600}, 60, 600, 5, 30.0, 0.7) == ["=bad"]


def test_votes():
    v = Voters(["=bad", "vexl*", "vexl**"])
    names = lambda t: [v.names[j] for j in v.vote(t)]
    assert names("so BAD") == ["=bad"] and names("vexla") == ["vexl*"] and names("vexla vexlo") == ["vexl*", "vexl**"]
    assert names("") == ["clean"] and "fixed" in names("you idiot") and "threat" in names("I will kill you")
    assert ToxicityModel.features(v, v.matrix([v.vote("bad vexla")])).shape[1] == len(v.names) + 2


def test_no_lexicon_entry_is_cut(spark):
    rng = random.Random(6)
    bad = ["".join(rng.choice("bdfgkpvwxz") for _ in range(8)) for _ in range(130)]
    docs = []
    for i in range(6240):
        words = ["".join(rng.choice("aeiostrnlm") for _ in range(5)) for _ in range(12)]
        docs.append((i, " ".join(words[:6] + ([bad[i // 4 % 130]] if i % 4 == 0 else []) + words[6:]), int(i % 4 == 0)))
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True))
    found = score(spark.createDataFrame([(k, f"rosti melon {w} tarne") for k, w in enumerate(set(bad))], "doc_id long, text string"), model).where("score >= 0.7").count()
    assert found == len(set(bad))


def test_label_model_against_brute_force():
    """Rates of independent voters and of a noisy label, from labelled and unlabelled rows; one step against plain loops."""
    rng = np.random.default_rng(4)
    n, on1, on0 = 6000, np.array([0.7, 0.5, 0.3, 0.6]), np.array([0.02, 0.05, 0.01, 0.1])
    y = rng.random(n) < 0.2
    votes = (rng.random((n, 4)) < np.where(y[:, None], on1, on0)).astype(float)
    labels = np.where(rng.random(n) < 0.5, rng.random(n) < np.where(y, 0.85, 0.06), -1).astype(int)
    model = LabelModel()
    q = model.fit(votes, labels)
    assert model.groups == [[0], [1], [2], [3]] and np.abs(model.on1 - on1).max() < 0.06 and np.abs(model.on0 - on0).max() < 0.02
    assert abs(model.label_on1 - 0.85) < 0.04 and abs(model.label_on0 - 0.06) < 0.02 and abs(model.prior - 0.2) < 0.02
    assert ((q > 0.5) == y).mean() > 0.95
    twice = LabelModel().fit(np.vstack([votes[:500], votes[:500]]), np.concatenate([labels[:500]] * 2))
    assert np.allclose(LabelModel().fit(votes[:500], labels[:500], np.full(500, 2.0)), twice[:500])
    q = rng.random(200)
    x, said = votes[:200], labels[:200]
    model.maximise(x, said, q, np.ones(200))
    for j in range(4):
        assert np.isclose(model.on1[j], (sum(a * b for a, b in zip(q, x[:, j])) + 0.1) / (sum(q) + 1))
    own = [(a, b) for a, b in zip(q, said) if b >= 0]
    assert np.isclose(model.label_on1, (sum(a for a, b in own if b) + 0.97 * 20) / (sum(a for a, _ in own) + 20))
    got = model.expect(x, said)
    for k in range(200):
        a, b = model.prior, 1 - model.prior
        if said[k] >= 0:
            a, b = (a * model.label_on1, b * model.label_on0) if said[k] else (a * (1 - model.label_on1), b * (1 - model.label_on0))
        for j in range(4):
            p1, p0 = (model.on1[j], model.on0[j]) if x[k, j] else (1 - model.on1[j], 1 - model.on0[j])
            a, b = a * p1 ** model.share[j], b * p0 ** model.share[j]
        assert np.isclose(got[k], a / (a + b))
