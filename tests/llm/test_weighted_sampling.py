import hashlib
import math
import random
from collections import Counter

import numpy as np

from gradeloom.llm.weighted_sampling import edited, fingerprint, fingerprint_with_next, likeness, sample, terms


def jaccard(a, b):
    x, y = (dict(zip(h.tolist(), n.tolist())) for h, n in map(terms, (a.encode(), b.encode())))
    keys = x.keys() | y.keys()
    return sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)


def test_collision_rate_equals_generalised_jaccard():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(30)]
    errors = []
    for _ in range(300):
        base = [rng.choice(vocab[: rng.choice([2, 5, 30])]) for _ in range(rng.choice([40, 300, 900]))]
        cut = rng.randrange(len(base))
        a, b = " ".join(base), " ".join(base[:cut] + [rng.choice(vocab) for _ in range(len(base) - cut)] * rng.choice([1, 1, 2]))
        s = sample([terms(a.encode()), terms(b.encode())])
        no = np.array([False])
        errors.append(likeness(s[:1], s[1:], no, no)[0] - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.08


def test_weights_matter():
    h = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one, two = np.ones(2000), np.full(2000, 2.0)
    s = sample([(h, one), (h, two)])
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.15


def test_heavy_terms_count():
    h = np.arange(1, 501, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for few, often in ((500, 2000), (12, 200), (1, 50), (100, 1)):
        errors = []
        for k in range(12):
            terms_, one = h[:few] + np.uint64(1000 * k), np.ones(few)
            two = one.copy()
            two[0] = often
            s = sample([(terms_, one), (terms_, two)])
            errors.append((s[0] == s[1]).mean() - (few / (few + often - 1) * 255 + 1) / 256)
        assert abs(np.mean(errors)) < 0.05 and np.abs(errors).max() < 0.2


def test_draws_are_gamma_draws():
    from gradeloom.llm import weighted_sampling as W

    h = np.arange(1, 401, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    of, slot, ln_rate = W._arrivals(h, np.full(400, np.log(60.0)), np.ones(400 * W.SLOTS, bool), np.arange(400) * W.SLOTS)
    assert len(of) == 400 * W.SLOTS
    v = np.sort(np.exp(np.interp(ln_rate, W._LN_RATE, W._LN_V)))
    g = np.random.default_rng(3)
    want = np.sort(g.gamma(2, size=len(v)) * np.exp(-g.gamma(2, size=len(v))))
    for q in (0.001, 0.01, 0.1, 0.5, 0.9, 0.99):
        assert abs(np.searchsorted(v, want[int(q * len(v))]) / len(v) - q) < 6 * (q * (1 - q) / len(v)) ** 0.5


def test_draws_are_shared_by_the_texts_of_a_block(monkeypatch):
    from gradeloom.llm import weighted_sampling as W

    rng = random.Random(7)
    words = [f"w{rng.randrange(400)}" for _ in range(600)]
    texts = [" ".join(words), " ".join(words[:200] * 3), " ".join(words[100:] + words), "w1", "", "w2 " * 40, " ".join(words)]
    found = [terms(t.encode()) for t in texts]
    alone = [sample([f])[0] for f in found]
    drawn, arrivals = [], W._arrivals
    monkeypatch.setattr(W, "_arrivals", lambda h, *rest: drawn.append(len(h)) or arrivals(h, *rest))
    assert (sample(found) == np.array(alone)).all()
    assert max(drawn) == len(np.unique(np.concatenate([h for h, _ in found]))) < sum(len(h) for h, _ in found) / 2


def test_words_at_the_cut_only_are_hashed_again(monkeypatch):
    from gradeloom.llm import weighted_sampling as W

    rng = random.Random(3)
    pieces = ["a", "B", " ", "\n", "\x0b", "\x1c", "\x85", "\xa0", "é", "🙂", "\t ", "zz zz ", "Word"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 2, 4, 9, 60]))) for _ in range(400)]
    for i, (a, b) in enumerate(zip(texts, texts[1:])):
        (row,) = W._rows([(i, a)], b)
        e = edited(a, b)
        assert row[2:5] == (hashlib.sha256(e.encode()).hexdigest(), fingerprint(a), fingerprint(e))
    hashed, hashes = [], W._hashes
    monkeypatch.setattr(W, "_hashes", lambda words: hashed.append(len(words)) or hashes(words))
    list(W._rows([(0, "some words " * 500)], "more words " * 500))
    assert sum(hashed) <= 2000 + 3


def test_query_rows(spark):
    rng = random.Random(1)
    rows = [(7 * i - 50, " ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randrange(40)))) for i in range(150)]
    rows += [(None, "null id é"), (3000, None), (3001, "🙂é" * 50), (3001, "tie"), (3001, "tie"), (5000, "x" * 200_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, range int")
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = Counter()
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        e = edited(t, nxt)
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint(t), fingerprint(e)] += 1
    for per_task in (10, 10_000):
        got = fingerprint_with_next(df, per_task=per_task).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        assert all(r.near_edited == 1 for r in got if r.fingerprint == r.edited_fingerprint)


def test_small_tables(spark):
    assert fingerprint_with_next(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    r = fingerprint_with_next(spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")).collect()
    assert len(r) == 1 and r[0].near_next == 1 and not math.isnan(r[0].near_edited)
    assert fingerprint("") == fingerprint(" \n") == "00" * 128
