import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm.media import BASIS, ZIGZAG, Bits, Codes, Component, Decoder, decode_media, encode, inspect, pad, store


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 5000, 20_000])
def test_round_trip_and_both_readers_agree(size):
    raw = random.Random(size).randbytes(size)
    media = encode(pad(raw))
    fast, slow = Decoder(media), Decoder(media, fast=False)
    assert fast.payload() == slow.payload() == pad(raw)
    assert all(np.array_equal(a.coefficients, b.coefficients) for a, b in zip(fast.components, slow.components))
    assert np.array_equal(fast.rgb(), slow.rgb()) and fast.rgb().shape == (fast.height, fast.width, 3)


def test_every_byte_and_no_marker_in_scans():
    raw = bytes(range(256)) * 9
    assert Decoder(encode(raw)).payload() == raw
    assert Decoder(encode(b"\xff" * 5760)).payload() == b"\xff" * 5760


def test_inverse_transform():
    rng = np.random.default_rng(0)
    f = rng.normal(size=64).astype(np.float32)
    x, y = np.meshgrid(range(8), range(8))
    want = np.zeros((8, 8))
    for k, place in enumerate(ZIGZAG):
        v, u = divmod(int(place), 8)
        scale = (np.sqrt(0.5) if u == 0 else 1) * (np.sqrt(0.5) if v == 0 else 1) / 4
        want += scale * f[k] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
    assert np.allclose((f @ BASIS).reshape(8, 8), want, atol=1e-4)


def bits_of(text):
    raw = "".join(text.split())
    raw += "1" * (-len(raw) % 8)
    return Bits(bytes(int(raw[i : i + 8], 2) for i in range(0, len(raw), 8)))


def test_general_scans():
    """Runs of zeros, end-of-band runs and refinement with new coefficients, written out by hand."""
    codes = Codes({(1, 0): 0x21, (2, 2): 0x00, (3, 6): 0x10, (4, 14): 0xF0, (5, 30): 0x01})
    v = np.zeros(64, np.int16)
    assert Decoder._band(bits_of("0 1  10"), codes, v, 1, 20, 1, 0) == 0  # two zeros, then +1 at bit 1; end of band
    assert v[3] == 2 and np.count_nonzero(v) == 1
    w = np.zeros(64, np.int16)
    assert Decoder._band(bits_of("110 1"), codes, w, 1, 20, 1, 0) == 2 and not w.any()  # a run of three blocks
    assert Decoder._band(bits_of("1110 11110 0"), codes, w, 1, 17, 0, 0) == 0 and w[17] == -1
    # new -1 after two zeros, passing the old coefficient, which gets its bit; then end of band
    assert Decoder._refine(bits_of("0 0 1  10"), codes, v, 2, 20, 0, 0) == 0
    assert v[3] == 3 and v[5] == -1
    assert Decoder._refine(bits_of("1 0"), codes, v, 1, 20, 0, 2) == 1 and v[3] == 3 and v[5] == -1


def test_other_jpegs_are_refused():
    with pytest.raises(ValueError):
        Decoder(b"GIF89a")
    with pytest.raises(ValueError):
        Decoder(encode(pad(b"x")).replace(b"\xff\xc2", b"\xff\xc0"))


def test_restart_marks_and_grey():
    """One component, DC and restart after each block; codes of DC sizes 0 and 3."""
    seg = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    media = b"\xff\xd8" + seg(0xDB, b"\0" + b"\x10" * 64) + seg(0xC2, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0])) + seg(0xC4, bytes([0, 1, 1, *[0] * 14, 0, 3])) + seg(0xDD, b"\0\1") + seg(0xDA, bytes([1, 1, 0, 0, 0, 0])) + bytes([0b10101111]) + b"\xff\xd0" + bytes([0b10010111]) + b"\xff\xd9"
    d = Decoder(media)
    assert isinstance(d.components[0], Component) and d.components[0].coefficients[:, 0].tolist() == [5, -5]
    rgb = d.rgb()
    assert rgb.shape == (8, 16, 3) and rgb[0, 0].tolist() == [138] * 3 and rgb[0, 15].tolist() == [118] * 3


def test_documents(spark):
    texts = ["", None, "é" * 300, "x" * 575, "same", "same", "z" * 120_000, os.urandom(600).hex()]
    df = spark.createDataFrame([(i if i else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, media string, n_bytes int")
    out = {r.doc_id: r for r in inspect(store(df)).collect()}
    for i, t in enumerate(texts):
        r, raw = out[i or None], (t or "").encode()
        p = pad(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(encode(p)), hashlib.sha256(encode(p)).hexdigest())
    assert out[4].feature == out[5].feature != out[3].feature
    tensors = {r.doc_id: r for r in decode_media(store(df)).collect()}
    assert len(tensors[6].rgb) == tensors[6].width * tensors[6].height * 3
    assert tensors[6].rgb == Decoder(tensors[6].media).rgb().tobytes() and "n_bytes" in decode_media(store(df)).columns
    with pytest.raises(ValueError):
        decode_media(store(df).withColumn("rgb", F.lit(1)))
    assert inspect(store(df.limit(0))).collect() == []


def independent(spark, media):
    """The picture as the decoder of the Java runtime sees it."""
    jvm = spark._jvm
    img = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(media))
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(img, "bmp", out)
    raw = bytes(out.toByteArray())
    w, h = (int.from_bytes(raw[k : k + 4], "little") for k in (18, 22))
    rows = np.frombuffer(raw, np.uint8, offset=int.from_bytes(raw[10:14], "little")).reshape(h, -1)
    return rows[::-1, : 3 * w].reshape(h, w, 3)[:, :, ::-1]


def luma(rgb):
    return rgb.astype(float) @ np.array([0.299, 0.587, 0.114])


#: Progressive files of other encoders, where the machine has them.
FOREIGN = [p for p in ("/usr/share/doc/nodejs/full-white-stripe.jpg", "/usr/share/doc/nodejs/thin-white-stripe.jpg") if os.path.exists(p)]


@pytest.mark.skipif(not FOREIGN, reason="no foreign progressive file here")
@pytest.mark.parametrize("path", FOREIGN)
def test_foreign_files_against_an_independent_decoder(spark, path):
    with open(path, "rb") as f:
        media = f.read()
    d = Decoder(media)
    assert max(len(c) for c in d.codes.values()) > 2  # ordinary Huffman codes
    want, got = independent(spark, media), d.rgb()
    assert got.shape == want.shape
    assert np.abs(luma(got) - luma(want)).mean() < 1 and np.abs(got.astype(int) - want).mean() < 3


def test_another_decoder_reads_what_is_stored(spark):
    """Between chroma samples decoders may filter, but not at the picture's corners."""
    for seed in range(4):
        media = encode(pad(np.random.default_rng(seed).bytes(5000)))
        want, got = independent(spark, media).astype(int), Decoder(media).rgb().astype(int)
        assert got.shape == want.shape
        assert np.abs((got - want)[[0, 0, -1, -1], [0, -1, 0, -1]]).max() <= 3
        assert np.corrcoef(luma(got).ravel(), luma(want).ravel())[0, 1] > 0.8
