import re

import numpy as np
import pytest
import xxhash

from gradeloom.llm.components import connected_components
from gradeloom.llm.simhash import BKForest, _cuts, link_entries, near_duplicates, shingles, signed


def fingerprint(text, k):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(pairs, radius):
    """pairs: (key, fp); the smallest key reachable."""
    label = list(range(len(pairs)))
    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= radius and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    out = {}
    for x, (k, _) in zip(label, pairs):
        if k is not None:
            out[x] = min(out.get(x, k), k)
    return [out.get(x) for x in label]


def family(rng, n, groups=6, flips=7):
    base = rng.integers(0, 1 << 63, groups, dtype=np.uint64)
    out = set()
    while len(out) < n:
        x = int(base[rng.integers(groups)])
        for b in rng.integers(0, 64, rng.integers(0, flips)):
            x ^= 1 << int(b)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_forest_equals_brute_force(most):
    rng = np.random.default_rng(3)
    fps = family(rng, 150) + family(rng, 150, groups=60)
    shard = np.repeat([0, 1], 150)
    got = BKForest(np.array(fps, np.uint64), shard, 4).connect(most)
    for s in (0, 1):
        own = [(i, f) for i, f in enumerate(fps) if shard[i] == s]
        assert [got[i] for i, _ in own] == brute(own, 4)


@pytest.mark.parametrize("per_shard", [1000, 1, 0])
def test_keys_lose_no_link(spark, per_shard):
    rng = np.random.default_rng(5)
    fps = family(rng, 200, groups=40)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r.node: r.root for r in connected_components(link_entries(df, 4, len(fps), per_shard=per_shard)).collect()}
    sign = [signed(f) for f in fps]
    assert [got.get(f, f) for f in sign] == brute([(s, f) for s, f in zip(sign, fps)], 4)


def test_cuts_cover():
    assert len(_cuts(4, 10, 64)) == 5 and len(_cuts(4, 10**7, 64)) > 5


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (7, 7), (300, 200), (-5, 300)] + [(1000, 1000 + k) for k in range(1, 60)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: -5, 200: -5, 300: -5, -5: -5} | {1000 + k: 1000 for k in range(60)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_documents_against_brute_force(spark):
    rng = np.random.default_rng(7)
    vocab = [f"w{i}" for i in range(400)] + ["É", "ABC", "ß"]
    rows, base = [], []
    for i in range(160):
        if base and i % 2:
            words = list(base[rng.integers(len(base))])
            for _ in range(rng.integers(0, 3)):
                words[rng.integers(len(words))] = "new"
        else:
            words = [vocab[j] for j in rng.integers(0, len(vocab), rng.integers(1, 200))]
            base.append(words)
        rows.append((i * 3, " \t".join(words)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (None, "null id text"), (5003, "one"), (5003, "one"), (5004, "ONE"), (5005, "x " * 40_000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, root string")
    for k in (4, 5):
        got = sorted(((r.doc_id, r.fp, r.component_id) for r in near_duplicates(df, words=k).collect()), key=str)
        fps = [fingerprint(t, k) for _, t in rows]
        comp = brute([(i, f) for (i, _), f in zip(rows, fps)], 4)
        assert got == sorted(((i, signed(f), c) for (i, _), f, c in zip(rows, fps, comp)), key=str)


def test_shingles():
    assert shingles(b"A b\tc", 4) == [b"a b c"]
    assert shingles(b" a b c d e ", 4) == [b"a b c d", b"b c d e"]
    assert shingles(b" \n", 4) == []


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def shingle_set(text, k=5):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def corpus(rng):
    """(rows, groups): near copies at a similarity of 0.9 and up, exact copies, and texts that share a fifth."""
    vocab = [f"w{i}" for i in range(3000)]
    text = lambda n: [vocab[j] for j in rng.integers(0, len(vocab), n)]
    rows, groups, shared = [], [], text(40)
    for g in range(40):
        base = text(200)
        own = []
        for c in range(int(rng.integers(1, 6))):
            words = list(base)
            if c % 3 == 1:
                words[int(rng.integers(200))] = "edited"
            if c % 3 == 2:
                words = words + text(5)
            own.append(len(rows))
            rows.append((len(rows), " ".join(words)))
        groups.append(own)
        groups.append([len(rows)])
        rows.append((len(rows), " ".join(shared + text(160))))
    return rows, groups


def test_similar_documents(spark):
    from gradeloom.llm.simhash import keep_one, similar_documents

    rows, groups = corpus(np.random.default_rng(11))
    want = {i: g[0] for g in groups for i in g}
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, entry string, component_id int")
    assert {r.doc_id: r.component_id for r in similar_documents(df).collect()} == want
    kept = keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({g[0] for g in groups})


def test_keep_one_edges(spark):
    from gradeloom.llm.simhash import keep_one

    rows = [(None, "a b"), (None, "a b"), (3, "A  b"), (4, "zzz"), (4, "zzz"), (5, None), (6, ""), (None, "lone null"), (8, "x y z " * 30_000)]
    got = sorted((r.doc_id or -1 for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [-1, -1, -1, 3, 4, 4, 5, 8]
    assert keep_one(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_links_are_exact_near_the_threshold(spark):
    from gradeloom.llm.simhash import similar_documents

    rng, rows, want = np.random.default_rng(5), [], {}
    for g in range(120):
        n = int(rng.choice([40, 60, 200, 400]))
        base = [f"w{j}" for j in rng.integers(0, 100_000, n)]
        other = list(base)
        similarity = rng.uniform(0.72, 0.92)
        other[n - max(1, round((1 - similarity) / (1 + similarity) * (n - 4))) :] = [f"v{j}" for j in rng.integers(0, 100_000, max(1, round((1 - similarity) / (1 + similarity) * (n - 4))))]
        if g % 3 == 0:
            base = base + base[:14] * int(rng.integers(20, 100))  # repeats leave the set nearly as it is
        a, b = shingle_set(" ".join(base)), shingle_set(" ".join(other))
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
        want |= {2 * g: 2 * g, 2 * g + 1: 2 * g if len(a & b) >= 0.8 * len(a | b) else 2 * g + 1}
    assert 30 < sum(i == c for i, c in want.items() if i % 2) < 90
    assert {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_large_shards_are_cut_without_loss(spark):
    rng = np.random.default_rng(8)
    fps = family(rng, 300, groups=3, flips=9)
    entries = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    links = link_entries(entries, 4, len(fps), per_shard=1000, limit=25, per_task=60).collect()
    label = {signed(f): signed(f) for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 64
        label[root(a)] = root(b)
    want = brute(list(enumerate(fps)), 4)
    got = [root(signed(f)) for f in fps]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want)) > 1


def test_large_candidate_groups_are_cut_without_loss(spark):
    import random

    from gradeloom.llm.simhash import similar_documents

    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(60):
        words = list(base)
        for _ in range(rng.randrange(12)):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for t in texts]
    label = list(range(60))
    for i in range(60):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    want = [min(j for j in range(60) if label[j] == label[i]) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar_documents(df, limit=20, texts_limit=9).collect()}
    assert [got[i] for i in range(60)] == want and len(set(want)) > 3
