import hashlib
import math
import random
from collections import defaultdict

import pytest

from gradeloom.llm.mixing import balance, mix, placed, targets


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    total, out, free = float(sum(sizes.values())), {}, set(order)
    while free:
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return out | share
        out |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return out


def brute_copies(rows, target):
    """rows of one source: (id, size)."""
    total = sum(n for _, n in rows)
    rate = round(target / total, 9) if total and target else 0.0
    base, extra = math.floor(rate), target - math.floor(rate) * total
    order = sorted((hashlib.md5(str("" if i is None else i).encode()).hexdigest(), i, n) for i, n in rows)
    more = set()
    for _ in range(6):
        old, more = more, set(more)
        gap, upto = extra - sum(n for _, i, n in order if i in old), 0
        for h, i, n in order:
            if i not in old and 0 < n <= gap:
                upto += n
                if upto <= gap:
                    more.add(i)
    gap = extra - sum(n for _, i, n in order if i in more)
    pick = min(((n, h, i) for h, i, n in order if n and i not in more and extra > 0), default=None)
    if pick and pick[0] < 2 * gap:
        more.add(pick[2])
    return {i: (base + (i in more)) if n else 0 for _, i, n in order}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        s = rng.choice(["a", "a", "a", "B", "é", None, "z", "tiny"]) if i > 3 else "one"
        n = rng.choice([0, 1, 3, 10, 50, 400]) if s != "tiny" else 1
        rows.append((i, " \t".join(["w"] * n) if rng.random() > 0.02 else None, s))
    got = mix(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, h int, target int")).collect()
    sizes, by = defaultdict(int), defaultdict(list)
    for i, t, s in rows:
        n = len((t or "").split())
        sizes[s] += n
        by[s].append((i, n))
    want = brute_targets(sizes)
    copies = {i: c for s in by for i, c in brute_copies(by[s], want[s]).items()}
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.copies == copies[r.doc_id] and r.taken == r.copies * r["size"] <= 3 * r["size"]
        taken[r.source] += r.taken
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    for s in by:
        assert abs(taken[s] - want[s]) <= max(0.01 * want[s], 1)


def test_rates_solve_the_dual(spark):
    plan = [("a", 100, 300.0), ("b", 1000, 1.0), ("c", 7, 7.0), (None, 10**6, 1.0), ("e", 0, 0.0), ("f", 5, 0.0)]
    docs = [("a", 60), ("a", 40), ("b", 999), ("b", 1), ("c", 7), (None, 10**6), ("e", 0), ("f", 5), ("a", 0)]
    got = {r.source: r.rate for r in balance(spark.createDataFrame(docs, "source string, size long"), spark.createDataFrame(plan, "source string, source_size long, target double")).collect()}
    assert got["a"] == 3 and got["b"] == 0.001 and got["c"] == 1 and got["e"] == got["f"] == 0 and got[None] == 1e-6


def test_places_and_ranges(spark):
    names = [None, *sorted(f"s{i % 89}-{i}" for i in range(300))]
    df = spark.createDataFrame([(n, 1) for n in reversed(names)], "source string, source_size long").repartition(7)
    assert {r.source: r.place for r in placed(df).collect()} == {n: i for i, n in enumerate([*names[1:], None])}
    docs = spark.createDataFrame([(i, "w " * (i % 40), "ab"[i % 3 % 2]) for i in range(400)], "doc_id long, text string, source string")
    one, many = (sorted(map(tuple, mix(docs, per_bucket=k).collect())) for k in (10**6, 7))
    assert one == many


def test_edges(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    r = mix(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")).collect()
    assert {(x.doc_id, x.taken, x.target) for x in r} == {(1, 0, 0.0), (2, 0, 0.0)}
    same = mix(spark.createDataFrame([(1, "a b", "s")] * 4 + [(None, "c d", "s"), (2, "x", "t")], "doc_id long, text string, source string")).collect()
    assert len(same) == 6 and all(x.taken <= 3 * x["size"] for x in same)
    assert targets(spark.createDataFrame([("a", 1)], "source string, source_size long")).first().target == 1.0
