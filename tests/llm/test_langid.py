import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm.langid import MARK, UNKNOWN, Pieces, Scorer, expected, forward, predict, train, vocabulary, words_of
from gradeloom.llm.queries import tokenizer_file
from gradeloom.llm.shared import not_held_out

PIECES = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "bb", "aba"]


def segmentations(word):
    if not word:
        yield []
        return
    for k in range(1, min(3, len(word)) + 1):
        head = word[:k]
        if head in PIECES or k == 1:
            for rest in segmentations(word[k:]):
                yield [head, *rest]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(1)
    t = rng.random((len(PIECES) + 2, 2))
    t[-2], t[-1] = UNKNOWN, 0
    return t


def p_of(table, seg, lang):
    return np.prod([table[PIECES.index(x) if x in PIECES else len(PIECES), lang] for x in seg])


def test_forward_sums_all_segmentations(table):
    words = ["a", "ab", "abba", "babab", "axb", "ab"]
    got = forward(Pieces(PIECES), table, words)
    for w, row in zip(words, got):
        for lang in (0, 1):
            assert np.isclose(row[lang], np.log(sum(p_of(table, s, lang) for s in segmentations(MARK + w))))


def test_expected_counts(table):
    words, times = ["abba", "ab", "axb"], np.array([2.0, 3.0, 1.0])
    want = np.zeros(len(PIECES) + 1)
    for w, n in zip(words, times):
        segs = list(segmentations(MARK + w))
        ps = np.array([p_of(table, s, 0) for s in segs])
        for s, p in zip(segs, ps / ps.sum()):
            for x in s:
                want[PIECES.index(x) if x in PIECES else len(PIECES)] += n * p
    assert np.allclose(expected(Pieces(PIECES), table[:-1, 0], words, times), want, atol=1e-5)


def test_texts_are_sums_over_words(table):
    s = Scorer(Pieces(PIECES), table, most=3)
    long = "ab" * 60
    for _ in range(2):
        total, n = s.totals(["ab, AB a!", "", long + " b"])
        one = lambda w: forward(Pieces(PIECES), table, [w])[0]
        assert n.tolist() == [3, 0, 2] and np.allclose(total[0], one("ab") + one("AB") + one("a")) and np.allclose(total[1], 0)
        assert np.allclose(total[2], one(long) + one("b"))
    assert words_of("Éa1b_c ß") == ["Éa", "b", "c", "ß"]


def test_long_words_are_summed_whole(table):
    """Words far beyond the range of doubles, against sums of logarithms."""
    for word in ("ab" * 700, "x" * 900, "abba" * 25):
        t, w = np.log(table[:-1, 0]), MARK + word
        f = np.full(len(w) + 1, -np.inf)
        f[0] = 0
        for e in range(1, len(w) + 1):
            for b in range(max(0, e - 3), e):
                x = w[b:e]
                if x in PIECES or e - b == 1:
                    f[e] = np.logaddexp(f[e], f[b] + t[PIECES.index(x) if x in PIECES else len(PIECES)])
        assert np.isclose(forward(Pieces(PIECES), table, [word])[0, 0], f[-1], rtol=1e-12)
    long = expected(Pieces(PIECES), table[:-1, 0], ["ab" * 700], np.ones(1))
    assert 700 < long.sum() < 1401 and np.isclose(long @ np.array([0, 1, 1, 1, 2, 2, 2, 2, 3, 1]), 1400, atol=1)
    assert np.array_equal(long, np.rint(long * 2**24) / 2**24)


def rows():
    rng = random.Random(5)
    syllables = {"xx": ["ka", "to", "mi", "ru"], "yy": ["eau", "ille", "ment", "que"], "zz": ["sch", "ung", "ein", "ver"]}
    out = []
    for i in range(240):
        lang = rng.choice(sorted(syllables))
        out.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(25)), lang if i % 10 else None))
    return out, {k: set(v) for k, v in syllables.items()}


def test_held_out_accuracy_and_edges(spark):
    data, _ = rows()
    odd = [(1000, None, "xx"), (1001, "", None), (1002, "12 - 3", "yy"), (None, "ka to mi ka to mi", None), (1003, "ka " * 100_000, None), (1003, "ka " * 100_000, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in data + odd], "doc_id long, text string, lang string, word string, piece int")
    vocab = vocabulary(tokenizer_file("piece_bpe_32k.model"))
    assert len(vocab) > 25_000 and max(map(len, vocab)) > 12
    langs, table = train(docs, vocab, not_held_out(F.col("doc_id")))
    assert langs == ["xx", "yy", "zz"] and np.allclose(table[:-2].sum(axis=0), 1)
    got = predict(docs, vocab, langs, table).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(data) + len(odd)
    assert np.array_equal(train(docs.repartition(7), vocab, not_held_out(F.col("doc_id")))[1], table)  # to the last bit
    with pytest.raises(ValueError):
        train(docs, vocab, F.lit(True), most_langs=2)
    assert all(by[i].lang_pred == lang for i, _, lang in data if lang and zlib.crc32(str(i).encode()) % 3 == 1)
    assert [(by[i].lang_pred, by[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by[None].lang_pred == by[1003].lang_pred == "xx" and 0 <= by[None].score <= 1


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    langs, table = train(docs, PIECES, F.lit(True))
    assert [(r.lang_pred, r.score) for r in predict(docs, PIECES, langs, table).collect()] == [("und", 0.0)]
    assert predict(docs.limit(0), PIECES, ["xx"], np.ones((len(PIECES) + 2, 1))).collect() == []
