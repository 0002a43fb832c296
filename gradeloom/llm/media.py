"""Media columns: progressive JPEG.

``decode`` accumulates the scans of a progressive JPEG (spectral selection and
successive approximation) into coefficient arrays, applies the inverse transform
in numpy, upsamples chroma and returns a full-resolution RGB tensor.

``encode`` stores bytes without loss in the format's own unit, the quantised
coefficient: byte b is the coefficient b if b >= 128, else b - 255, so all have
eight significant bits. Each block holds 48 of them at the zigzag places 1 to
48; six blocks are a unit of 16 x 16 pixels with 4:2:0 chroma, so two units hold
576 bytes. Scans: DC; the bands 1-5 and 6-48 of each component without the last
bit; the last bit of 1-48 of each component. Any progressive decoder reads it.

A scan whose code has a single symbol has fixed-length entries and is read with
array operations; any other goes through a reader that looks each symbol up by the
next 16 bits, with the same results.

``decode_media`` adds the tensors as columns beside the stored bytes: height, width
and the RGB bytes, row by row; ``describe`` reads payload and features from these
columns. A written tensor column is about 2.7 times as large as its text.

Defined cases: a null text is empty; an empty payload is one unit of 255s.
Repeated rows give equal values; null ids are kept. An empty table gives an
empty table. Columns other than the id and the text are ignored. A text over
the format's largest picture (4.8 GB) is refused.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.shared import bounded_batches

UNIT, PER_BLOCK, PER_MCU = 576, 48, 288
BANDS = ((1, 5), (6, PER_BLOCK))
#: The zigzag order of the format; entry k is the place of coefficient k in the 8 x 8 block.
ZIGZAG = np.array(
    [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
)


def _basis() -> np.ndarray:
    """Row k: the 64 pixels that zigzag coefficient k contributes, as multiples of 2**-20.

    Sums of their products with whole numbers are exact in doubles, so the order in which a
    matrix product adds them, which differs between machines and threads, changes no pixel.
    """
    x = np.arange(8)
    cos = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x == 0, np.sqrt(0.125), 0.5)[:, None]
    full = np.einsum("uy,vx->uvyx", cos, cos).reshape(64, 64)
    return np.rint(full[ZIGZAG] * 2**20) / 2**20


BASIS = _basis()


def pad(raw: bytes) -> bytes:
    """The payload: bytes 255 up to a positive multiple of 576."""
    return raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, number: int, symbol: int) -> bytes:
    """A Huffman table with one symbol, whose code is the bit 0."""
    return _segment(0xC4, bytes([kind << 4 | number, 1, *[0] * 15, symbol]))


def _scan(components: list[tuple[int, int]], first: int, last: int, high: int, low: int) -> bytes:
    body = bytes([len(components), *[x for c, table in components for x in (c, table)], first, last, high << 4 | low])
    return _segment(0xDA, body)


def _stuff(raw: np.ndarray) -> bytes:
    return raw.tobytes().replace(b"\xff", b"\xff\x00")


def _pack(bits: np.ndarray) -> np.ndarray:
    """Bits as bytes, with ones up to the end of the last."""
    short = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(short, np.uint8)]) if short else bits)


def _picture(size: int) -> tuple[int, int]:
    """Rows and columns of units for so many payload bytes."""
    n = size // PER_MCU
    cols = min(4095, max(2, 2 * int(np.ceil(np.sqrt(n) / 2))))
    rows = -(-n // cols)
    if rows > 4095:
        raise ValueError("the payload is larger than the largest picture")
    return rows, cols


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload; its comment has the payload's length."""
    rows, cols = _picture(len(payload))
    data = np.zeros(rows * cols * PER_MCU, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    units = data.reshape(rows, cols, 6, PER_BLOCK)
    luma = units[:, :, :4].reshape(rows, cols, 2, 2, PER_BLOCK).transpose(0, 2, 1, 3, 4).reshape(-1, PER_BLOCK)
    planes = [(1, luma), (2, units[:, :, 4].reshape(-1, PER_BLOCK)), (3, units[:, :, 5].reshape(-1, PER_BLOCK))]
    out = [
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\1\2\0\0\1\0\1\0\0"),
        _segment(0xFE, b"payload %d" % len(payload)),
        _segment(0xDB, b"\0" + b"\1" * 64),
        _segment(0xC2, struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _table(0, 0, 0),
        _table(1, 0, 7),
        _table(1, 1, 0),
        _scan([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 0),
        _stuff(_pack(np.zeros(rows * cols * 6, np.uint8))),
    ]
    for first, last in BANDS:
        for c, blocks in planes:
            out += [_scan([(c, 0)], first, last, 0, 1), (blocks[:, first - 1 : last] >> 1).tobytes()]  # code 0, then seven bits
    for c, blocks in planes:
        bits = np.zeros((len(blocks), 1 + PER_BLOCK), np.uint8)  # end of band, then a bit for each coefficient
        np.bitwise_xor(blocks & 1, blocks < 128, out=bits[:, 1:])
        out += [_scan([(c, 1)], 1, PER_BLOCK, 1, 0), _stuff(_pack(bits.ravel()))]
    return b"".join([*out, b"\xff\xd9"])


@dataclass
class Component:
    number: int
    across: int  # sampling factors
    down: int
    quant: int
    width: int = 0  # in blocks, as interleaved scans count them
    height: int = 0
    own_width: int = 0  # in blocks, as scans of this component alone count them
    own_height: int = 0
    coefficients: np.ndarray | None = None  # (blocks, 64) in zigzag order


class Bits:
    """A bit reader over entropy-coded bytes without stuffing; behind the end all bits are ones."""

    def __init__(self, raw: bytes):
        data = np.frombuffer(raw + b"\xff" * 8, np.uint8).astype(np.uint32)
        #: The 32 bits from each byte on, so that any 16 bits are one shift away.
        self.windows = (data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]).tolist()
        self.at, self.last = 0, len(self.windows) - 1

    def peek(self) -> int:
        """The next 16 bits."""
        return self.windows[min(self.at >> 3, self.last)] >> (16 - (self.at & 7)) & 0xFFFF

    def bit(self) -> int:
        out = self.windows[min(self.at >> 3, self.last)] >> (31 - (self.at & 7)) & 1
        self.at += 1
        return out

    def bits(self, n: int) -> int:
        if not n:
            return 0
        out = self.peek() >> (16 - n)
        self.at += n
        return out

    def signed(self, n: int) -> int:
        v = self.bits(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def symbol(self, codes: Codes) -> int:
        found = codes.lookup()[self.peek()]
        if not found:
            raise ValueError("no such code")
        self.at += found >> 8
        return found & 0xFF


class Codes(dict):
    """A Huffman code, (length, bits) to symbol, and its table: for any 16 bits the length and the symbol of the code that begins them."""

    table: list[int] | None = None

    def lookup(self) -> list[int]:
        if self.table is None:
            out = np.zeros(1 << 16, np.int32)
            for (n, code), symbol in self.items():
                out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbol
            self.table = out.tolist()
        return self.table


class Decoder:
    """Coefficients, picture and payload of a progressive JPEG."""

    def __init__(self, media: bytes, fast: bool = True):
        self.fast, self.comment, self.components = fast, b"", []
        self.quant: dict[int, np.ndarray] = {}
        self.codes: dict[tuple[int, int], Codes] = {}
        self.restart = 0
        if media[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        at = 2
        while at < len(media):
            marker = media[at + 1]
            if marker == 0xD9:
                break
            size = struct.unpack_from(">H", media, at + 2)[0]
            body, at = media[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDA:
                end = at
                while True:
                    end = media.find(b"\xff", end)
                    if end < 0 or end + 1 >= len(media):
                        end = len(media)
                        break
                    if media[end + 1] and not 0xD0 <= media[end + 1] <= 0xD7:
                        break
                    end += 2
                self._read_scan(body, media[at:end])
                at = end
            elif marker == 0xC4:
                self._read_codes(body)
            elif marker == 0xDB:
                self._read_quant(body)
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xC2:
                self._read_frame(body)
            elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise ValueError("not a progressive JPEG")

    def _read_quant(self, body: bytes) -> None:
        while body:
            wide, number = body[0] >> 4, body[0] & 15
            n = 128 if wide else 64
            self.quant[number] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
            body = body[1 + n :]

    def _read_codes(self, body: bytes) -> None:
        while body:
            counts, code, at = body[1:17], 0, 17
            codes = Codes()
            for n, count in enumerate(counts, 1):
                for _ in range(count):
                    codes[n, code] = body[at]
                    code, at = code + 1, at + 1
                code <<= 1
            self.codes[body[0] >> 4, body[0] & 15] = codes
            body = body[at:]

    def _read_frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
        self.components = [Component(p[0], p[1] >> 4, p[1] & 15, p[2]) for p in parts]
        self.across, self.down = max(c.across for c in self.components), max(c.down for c in self.components)
        self.cols, self.rows = -(-self.width // (8 * self.across)), -(-self.height // (8 * self.down))
        for c in self.components:
            c.width, c.height = self.cols * c.across, self.rows * c.down
            c.own_width, c.own_height = -(-self.width * c.across // (8 * self.across)), -(-self.height * c.down // (8 * self.down))
            c.coefficients = np.zeros((c.width * c.height, 64), np.int16)

    def _read_scan(self, body: bytes, raw: bytes) -> None:
        n = body[0]
        chosen = [(next(c for c in self.components if c.number == body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
        first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        if self.fast and not self.restart and self._read_fixed(chosen, first, last, high, low, raw):
            return
        parts, begin, at = [], 0, 0
        while (at := raw.find(b"\xff", at)) >= 0:  # restart marks part the scan
            if at + 1 < len(raw) and 0xD0 <= raw[at + 1] <= 0xD7:
                parts.append(raw[begin:at])
                begin = at + 2
            at += 2
        parts = [p.replace(b"\xff\0", b"\xff") for p in [*parts, raw[begin:]]]
        if n == 1:
            c = chosen[0][0]
            order = [[(0, y * c.width + x)] for y in range(c.own_height) for x in range(c.own_width)]
        else:
            order = [[(i, (my * c.down + v) * c.width + mx * c.across + h) for i, (c, _, _) in enumerate(chosen) for v in range(c.down) for h in range(c.across)] for my in range(self.rows) for mx in range(self.cols)]
        step = self.restart or len(order)
        for k, part in enumerate(parts):
            bits, pred, run = Bits(part), [0] * n, 0
            for unit in order[k * step : (k + 1) * step]:
                for i, block in unit:
                    c, dc, ac = chosen[i]
                    values = c.coefficients[block]
                    if first == 0:
                        if high:
                            values[0] |= bits.bit() << low
                        else:
                            pred[i] += bits.signed(bits.symbol(self.codes[0, dc]))
                            values[0] = pred[i] << low
                    elif high:
                        run = self._refine(bits, self.codes[1, ac], values, first, last, low, run)
                    else:
                        run = self._band(bits, self.codes[1, ac], values, first, last, low, run)

    @staticmethod
    def _band(bits: Bits, codes: Codes, values: np.ndarray, first: int, last: int, low: int, run: int) -> int:
        if run:
            return run - 1
        k = first
        while k <= last:
            zeros, size = divmod(bits.symbol(codes), 16)
            if size:
                k += zeros
                values[k] = bits.signed(size) * (1 << low)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                return (1 << zeros) + bits.bits(zeros) - 1
        return 0

    @staticmethod
    def _refine(bits: Bits, codes: Codes, values: np.ndarray, first: int, last: int, low: int, run: int) -> int:
        one = 1 << low

        def correct(k: int) -> None:
            if bits.bit() and not abs(int(values[k])) & one:
                values[k] += one if values[k] > 0 else -one

        k = first
        if not run:
            while k <= last:
                zeros, size = divmod(bits.symbol(codes), 16)
                new = 0
                if size:
                    new = one if bits.bit() else -one
                elif zeros < 15:
                    run = (1 << zeros) + bits.bits(zeros)
                    break
                while k <= last:
                    if values[k]:
                        correct(k)
                    elif zeros:
                        zeros -= 1
                    else:
                        break
                    k += 1
                if new and k <= last:
                    values[k] = new
                k += 1
        if run:
            for j in range(k, last + 1):
                if values[j]:
                    correct(j)
            run -= 1
        return run

    def _read_fixed(self, chosen: list, first: int, last: int, high: int, low: int, raw: bytes) -> bool:
        """Read a scan whose entries all have one length with array operations; False if it isn't one."""
        if first == 0:
            return not high and all(list(self.codes[0, dc].items()) == [((1, 0), 0)] for _, dc, _ in chosen)
        c, _, ac = chosen[0]
        codes = self.codes[1, ac]
        if len(codes) != 1 or (c.own_width, c.own_height) != (c.width, c.height):
            return False
        ((length, _), symbol), = codes.items()
        data = np.frombuffer(raw.replace(b"\xff\0", b"\xff"), np.uint8)
        blocks, band = len(c.coefficients), last - first + 1
        if not high and 1 <= symbol <= 10 and length == 1:
            if symbol == 7:
                v = data[: blocks * band].astype(np.int16)
            else:
                own = np.unpackbits(data, count=blocks * band * (1 + symbol)).reshape(-1, 1 + symbol)[:, 1:]
                v = own @ (1 << np.arange(symbol)[::-1]).astype(np.int16)
            half, top = np.int16(1 << (symbol - 1)), np.int16((1 << symbol) - 1)
            v = np.where(v >= half, v, v - top).astype(np.int16)
            c.coefficients[:, first : last + 1] = (v << low).reshape(blocks, band)
            return True
        if high and symbol == 0 and length == 1:
            part = c.coefficients[:, first : last + 1]
            if not part.all():
                return False
            bits = np.unpackbits(data, count=blocks * (1 + band)).reshape(blocks, 1 + band)[:, 1:].astype(np.int16)
            bits <<= low
            part += np.where(part > 0, bits, -bits)
            return True
        return False

    def payload(self) -> bytes:
        """The bytes that ``encode`` stored."""
        size = int(self.comment.split()[1])
        y, cb, cr = (c.coefficients[:, 1 : 1 + PER_BLOCK].astype(np.uint8) for c in self.components)  # b - 255 and b are the same byte but for one
        parts = [np.where(c.coefficients[:, 1 : 1 + PER_BLOCK] < 0, p - np.uint8(1), p) for c, p in zip(self.components, (y, cb, cr))]
        luma = parts[0].reshape(self.rows, 2, self.cols, 2, PER_BLOCK).transpose(0, 2, 1, 3, 4).reshape(self.rows, self.cols, 4, PER_BLOCK)
        chroma = [p.reshape(self.rows, self.cols, 1, PER_BLOCK) for p in parts[1:]]
        return np.concatenate([luma, *chroma], axis=2).tobytes()[:size]

    def rgb(self) -> np.ndarray:
        """The picture: (height, width, 3), uint8."""
        planes = []
        for c in self.components:
            used = 1 + int(np.flatnonzero(c.coefficients.any(axis=0))[-1]) if c.coefficients.any() else 1
            pixels = ((c.coefficients[:, :used] * self.quant[c.quant][:used]) @ BASIS[:used]).astype(np.float32)
            np.clip(np.rint(pixels, out=pixels), -128, 127, out=pixels)  # samples are whole numbers of eight bits
            plane = pixels.reshape(c.height, c.width, 8, 8).transpose(0, 2, 1, 3).reshape(c.height * 8, c.width * 8)
            plane = plane.repeat(self.down // c.down, axis=0).repeat(self.across // c.across, axis=1)
            planes.append(plane[: self.height, : self.width])
        out = np.empty((self.height, self.width, 3), np.uint8)
        if len(planes) == 1:
            out[:] = np.clip(np.rint(planes[0] + 128), 0, 255)[:, :, None]
            return out
        y, cb, cr = planes
        y = y + np.float32(128)
        for i, plane in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
            np.clip(np.rint(plane, out=plane), 0, 255, out=plane)
            out[:, :, i] = plane
        return out


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each channel in hundredths, and a 64-bit hash of the brightness in an 8 x 8 grid."""
    h, w, _ = rgb.shape
    columns = rgb.sum(axis=1, dtype=np.uint64)
    means = columns.sum(axis=0) * np.uint64(100) // np.uint64(h * w)
    green = rgb[:, :, 1]
    grid = np.add.reduceat(np.add.reduceat(green, np.arange(8) * w // 8, axis=1, dtype=np.uint32), np.arange(8) * h // 8, axis=0, dtype=np.uint64)
    bits = np.packbits(grid.ravel() * np.uint64(64) > grid.sum())
    return f"{w}x{h};" + ",".join(map(str, means.tolist())) + ";" + bits.tobytes().hex()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as a progressive JPEG."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo in range(0, part.num_rows, 100):
                b = part.slice(lo, 100)
                texts = [t or b"" for t in pc.cast(pc.cast(b.column(1), pa.large_string()), pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array([encode(pad(t)) for t in texts], pa.binary())], ["id", "n_bytes", "media"])

    bounded_batches(docs.sparkSession, 500)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def _kinds(df: DataFrame) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]


def decode_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """``media`` with the columns width, height and rgb: the full-resolution tensor of each progressive JPEG; null for null.

    Columns of these names are refused.
    """
    if {"width", "height", "rgb"} & set(media.columns):
        raise ValueError("the table has a column width, height or rgb already")
    at, names = media.columns.index(media_col), [*media.columns, "width", "height", "rgb"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lo = 0
            sizes = [len(m or b"") for m in part.column(at).to_pylist()]
            while lo < part.num_rows:  # about 32 MB of tensors at once
                hi, held = lo, 0
                while hi < part.num_rows and (hi == lo or held + 3 * sizes[hi] < 32 << 20):
                    held, hi = held + 3 * sizes[hi], hi + 1
                b, lo = part.slice(lo, hi - lo), hi
                found = [None if m is None else Decoder(m).rgb() for m in b.column(at).to_pylist()]
                shape = lambda k: pa.array([None if x is None else x.shape[k] for x in found], pa.int32())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([*b.columns, shape(1), shape(0), pa.array([None if x is None else x.tobytes() for x in found], pa.binary())], names)

    return media.mapInArrow(run, ", ".join([*_kinds(media), "width int", "height int", "rgb binary"]))


def describe(tensors: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), from the stored bytes and the tensors beside them."""
    kind = tensors.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = []
            for m, w, h, rgb in zip(*(b.column(k).to_pylist() for k in range(2, 6))):
                p = Decoder(m).payload()
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(np.frombuffer(rgb, np.uint8).reshape(h, w, 3))))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    own = tensors.select(F.col(id_col).alias("id"), "n_bytes", "media", "width", "height", "rgb")
    return own.mapInArrow(run, f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string").withColumnRenamed("id", id_col)


def inspect(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``describe`` of the tensors of ``media`` (id, n_bytes, media)."""
    return describe(decode_media(media.select(id_col, "n_bytes", "media")), id_col)
