import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradeloom.llm.packing import WordEncoder, best_fit, pack, pack_documents, pieces
from gradeloom.llm.queries import tokenizer_file

PATH = tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


TEXTS = ["", "Hello  World\n\nfoo's BAR", "Straße ΣΑΣ é é 中文字 123 45.6 <|endoftext|> a<|startoftext|>b", "x\ty z w\x1cq\x0bv", "á ́b Å", "it's we'll I'M 'tis", "word " * 3000, "é" * 5000, "e ̀\ņx", "🙂🙃 ok"]


def test_word_ids_equal_whole_text_ids(tok):
    for options in ({"most": 50}, {"segment": 100}, {}):
        enc = WordEncoder(PATH, **options)
        for _ in range(2):
            for text, ids in zip(TEXTS, enc.encode(TEXTS)):
                assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


@settings(deadline=None)
@given(st.lists(st.text(st.sampled_from("aBé ÉßİΣ'sd.,\n\tﬁ中1²ªμ\u0301\u200b\xa0ǅ"), max_size=30), max_size=4))
def test_any_text(texts):
    enc = test_any_text.enc = getattr(test_any_text, "enc", None) or WordEncoder(PATH)
    for text, ids in zip(texts, enc.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == enc.tok.encode(text, add_special_tokens=False).ids


def test_only_odd_words_take_the_whole_tokenizer(tok):
    enc, whole = WordEncoder(PATH), []
    batch = enc.batch
    enc.batch = lambda words, **options: whole.extend(words) or batch(words, **options)
    words = ["abc&&&", "échchque###", "Ingti.%%%", "a1b22", "3,14", "x_y@z.Org", "É?!É", "ab.,", "word's", "中文", "a<|endoftext|>", "<|EndOfText|>", "a<b", "|x|"]
    for w, ids in zip(words, enc.encode(words)):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(w, add_special_tokens=False).ids, w
    assert sorted(whole) == sorted(["word's", "中文", "a<|endoftext|>", "<|EndOfText|>"])


def test_words_in_use_are_not_forgotten(tok):
    enc, learnt = WordEncoder(PATH, most=100), []
    learn = enc._learn
    enc._learn = lambda words: learnt.extend(words) or learn(words)
    for k in range(40):
        text = f"often met every time {' '.join('rare' + chr(97 + i) + chr(97 + k % 26) * (1 + k // 26) for i in range(10))}"
        assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
        assert len(enc.known) + len(enc.older) <= 100 + 14
    assert learnt.count("often") == 1 and len(learnt) == 404


def verify(spark, tok, rows, capacity, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [r.asDict() for r in pack_documents(df, PATH, capacity=capacity, **options).collect()]
    want = Counter()
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), capacity)):
            one = np.array(ids[s : s + capacity], "<u4")
            want[i, k, s, len(one), zlib.crc32(one.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    return len(by), sum(r["length"] for r in out)


def test_documents(spark, tok):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, None), (3, "same"), (3, "same")]
    n, total = verify(spark, tok, rows, 512)
    assert n <= -(-total // 512) + 2


def test_rounds_come_near_the_bound(spark, tok):
    rng = np.random.default_rng(1)
    rows = [(i, "the " * int(n)) for i, n in enumerate(rng.geometric(0.02, 800))]
    n, total = verify(spark, tok, rows, 256, per_task=60, fan_in=2)
    assert n <= 1.02 * total / 256 + 2


def test_no_two_fit(spark, tok):
    rows = [(i, "the " * 150) for i in range(200)]
    n, _ = verify(spark, tok, rows, 256, per_task=20)
    assert n == 200


def test_empty(spark, tok):
    assert verify(spark, tok, [], 64) == (0, 0)


def test_best_fit_takes_the_tightest():
    bins, left = best_fit([70, 60, 30, 40, 5], 100)
    assert bins == [0, 1, 0, 1, 2] and left == [0, 0, 95]


def test_reruns_agree_and_extra_columns(spark):
    df = spark.createDataFrame([(i, "some words here " * (i % 7), "x", 1) for i in range(60)], "doc_id long, text string, length string, bin int")
    runs = [sorted(map(tuple, pack(pieces(d, PATH, capacity=64), capacity=64).collect())) for d in (df, df.repartition(3))]
    assert runs[0] == runs[1]
