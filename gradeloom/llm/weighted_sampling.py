"""Document fingerprints by consistent weighted sampling.

A text's weighted terms are its shingles of five words (with fewer words: the
whole sequence) and their counts. For each term and each of ``SLOTS`` slots, a
hash of both draws r and c from Gamma(2, 1) and beta uniformly; with weight w,
t = floor(ln w / r + beta) and ln a = ln c - r (t - beta + 1). A slot's sample is
the (term, t) with the least a of all terms, so that two texts agree in a slot
with the probability of their generalised Jaccard similarity. A fingerprint has
one byte of each sample's hash; the share of equal bytes, corrected for chance,
estimates the similarity.

As a >= v / w with v = c exp(-r), a term is only looked at in the slots where v
is small: its slots arrive in the order of v, and the search ends once each slot
has an a that no later arrival can beat. No draw that could win is left out.
Draws don't depend on weights, so they are made once for all texts of a block
that hold the term, as a text, its edited text and the one before it mostly do.

Defined cases: a null text is empty. Texts without words have the fingerprint of
zeros; their likeness to each other is 1, to any other text 0. Ids are whole
numbers; a null id is smaller than any other. The next text is that of the next
row in the order (id, text), after the last the first, so repeated rows and ties
follow each other, and a single row follows itself. An empty table gives an
empty table. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.shared import bounded_batches

SLOTS, SHINGLE = 128, 5
_U = np.uint64


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser with multiplications and shifts."""
    x = x + _U((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _uniforms(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two uniforms in (0, 1) from each 64-bit value."""
    return ((x >> _U(32)).astype(np.float64) + 0.5) * 2.0**-32, ((x & _U(0xFFFFFFFF)).astype(np.float64) + 0.5) * 2.0**-32


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64) if words else np.zeros(0, np.uint64)


def _counted(h: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of words with these hashes, and their counts."""
    if not len(h):
        return h, np.zeros(0, np.int64)
    k = min(shingle, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * _U(0x9FB21C651E98DF25) + h[i : i + n]
    return np.unique(mix(out, 1), return_counts=True)


def terms(text: bytes, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles and their counts; ``split`` parts words at the bytes 32 and 9 to 13."""
    return _counted(_hashes(text.lower().split()), shingle)


def _joined(head: bytes, tail: bytes, own: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Word hashes of ``head + tail``, a prefix each of texts in lower case with these word hashes: only words at the cuts are hashed."""
    first, then = head.split(), tail.split()
    glued = first and then and not head[-1:].isspace() and not tail[:1].isspace()
    seam = [first[-1] + then[0]] if glued else first[-1:] + then[:1]
    return np.concatenate([own[: max(len(first) - 1, 0)], _hashes(seam), following[1 : max(len(then) - 1, 1)], _hashes(then[1:][-1:])])


def _tables() -> tuple[np.ndarray, ...]:
    """ln rate, ln v, ln E1(v) on a grid of v: P(c exp(-r) >= v) = exp(-rate), and E1 is the exponential integral."""
    ln_v = np.linspace(np.log(1e-18), np.log(64), 1 << 13)
    v, step = np.exp(ln_v), (np.log(64) - np.log(1e-18)) / ((1 << 13) - 1)

    def above(y: np.ndarray, last: float) -> np.ndarray:
        return np.append(np.cumsum(((y[1:] + y[:-1]) * step / 2)[::-1])[::-1], 0) + last

    e1 = above(np.exp(-v), np.exp(-64) / 65)
    stay = above(e1 * v, np.exp(-64) / 65 / 65)
    gone = np.append(0, np.cumsum((e1 * v)[1:] + (e1 * v)[:-1]) * step / 2) + v[0] * (e1[0] + 1)
    rate = np.where(gone < 0.5, -np.log1p(-np.minimum(gone, 0.5)), -np.log(stay))
    return np.maximum.accumulate(np.log(rate)), ln_v, np.log(e1)


_LN_RATE, _LN_V, _LN_E1 = _tables()
#: The same with even steps of ln rate and of ln E1, so that a value's place needs no search.
_EVEN_RATE, _EVEN_E1 = np.linspace(_LN_RATE[0], _LN_RATE[-1], 1 << 14), np.linspace(_LN_E1[-1], _LN_E1[0], 1 << 14)
_V_OF_RATE, _E1_OF_RATE = np.interp(_EVEN_RATE, _LN_RATE, _LN_V), np.interp(_EVEN_RATE, _LN_RATE, _LN_E1)
_S_OF_E1 = np.interp(_EVEN_E1, _LN_E1[::-1], _LN_V[::-1])


def _look(x: np.ndarray, even: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    at = np.clip((x - even[0]) * ((len(even) - 1) / (even[-1] - even[0])), 0, len(even) - 1)
    i = np.minimum(at.astype(np.int64), len(even) - 2)
    at -= i
    return [v[i] + at * np.diff(v)[i] for v in values]


_TERM, _DRAW, _AT = _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)


def _arrivals(h: np.ndarray, ln_limit: np.ndarray, wanted: np.ndarray | None = None, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, slot, ln rate) of every first arrival of a term in a wanted slot whose v is under the term's limit.

    A term's arrivals have exponential gaps and a slot each, so that the first
    in each of the slots are independent draws of that slot's v, least first.
    ``wanted`` has truth values, or eight of them a byte; a term's begin at ``base``.
    """
    until = np.exp(_look(ln_limit, _LN_V, _LN_RATE)[0])
    of, now, k, found = np.arange(len(h)), np.zeros(len(h)), 0, []
    while len(of):
        more = max(1, k // 2)
        x = mix(h[of][:, None] + np.arange(k, k + more, dtype=np.uint64) * _DRAW, 2)
        at = (x >> _U(11)).astype(np.float64)
        at += 0.5
        at *= 2.0**-53
        np.log(at, out=at)
        if more > 1:
            np.cumsum(at, axis=1, out=at)
        at /= -SLOTS
        at += now[:, None]
        end = until[of]
        i = np.flatnonzero(at < end[:, None])
        term, slot, rate = of[i // more], (x.ravel()[i] & _U(SLOTS - 1)).astype(np.int64), at.ravel()[i]
        if wanted is not None:
            at_slot = base[term] + slot
            keep = wanted[at_slot] if wanted.dtype == bool else (wanted[at_slot >> 3] & (128 >> (at_slot & 7))) > 0
            term, slot, rate = term[keep], slot[keep], rate[keep]
        found.append((term, slot, rate))
        now = at[:, -1]
        go = now < end
        of, now, k = of[go], now[go], k + more
    of, slot, at = (np.concatenate(c) for c in zip(*found))
    # a term's first in a slot; places fit below the keys, so that whole numbers are sorted
    bits = _U(int(len(of)).bit_length())
    first = np.sort(((of * SLOTS + slot).astype(np.uint64) << bits) | np.arange(len(of), dtype=np.uint64))
    own = first >> bits
    first = (first[np.append(True, own[1:] != own[:-1])[: len(own)]] & ((_U(1) << bits) - _U(1))).astype(np.int64)
    return of[first], slot[first], np.log(at[first])


def sample(found: list[tuple[np.ndarray, np.ndarray]], kind: type = np.uint8) -> np.ndarray:
    """Fingerprints (texts, SLOTS) of texts given by their weighted terms, as 8-bit or 16-bit values."""
    n = len(found)
    sizes = np.array([len(h) for h, _ in found], np.int64)
    h = np.concatenate([x for x, _ in found])
    w = np.concatenate([x for _, x in found]).astype(np.float64)
    row = np.repeat(np.arange(n), sizes)
    ln_total = np.log(np.maximum(np.bincount(row, w, n), 1))
    out, wanted = np.zeros(n * SLOTS, kind), np.repeat(sizes > 0, SLOTS)
    by_term = np.argsort(h)  # the texts of a term side by side
    h, ln_w, row = h[by_term], np.log(w[by_term]), row[by_term]
    for bound in (3.0, 8.0, 20.0, 60.0):
        slots = wanted.reshape(n, SLOTS)
        live = slots.any(axis=1)[row]
        h, ln_w, row = h[live], ln_w[live], row[live]
        if not len(h):
            break
        begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        held = np.diff(np.append(begin, len(h)))
        term, limit = h[begin], np.maximum.reduceat(ln_w - ln_total[row], begin) + np.log(bound)
        if slots.all():
            of, slot, ln_rate = _arrivals(term, limit)
        else:  # slots that any text of the term wants
            any_of = np.bitwise_or.reduceat(np.packbits(slots, axis=1).view(np.uint64)[row], begin, axis=0)
            of, slot, ln_rate = _arrivals(term, limit, any_of.view(np.uint8).ravel(), np.arange(len(term)) * SLOTS)
        ln_v, ln_e1 = _look(ln_rate, _EVEN_RATE, _V_OF_RATE, _E1_OF_RATE)
        key = term[of] + slot.astype(np.uint64) * _AT
        u1, u2 = _uniforms(mix(key, 3))
        beta, _ = _uniforms(mix(key, 4))
        # given v, c is s + an exponential draw, where s over v has the density exp(-s) / s
        ln_c = np.log(np.exp(_look(ln_e1 + np.log(u1), _EVEN_E1, _S_OF_E1)[0]) - np.log(u2))
        r = np.maximum(ln_c - ln_v, 1e-12)
        # each draw with each text of its term
        often = held[of]
        draw = np.repeat(np.arange(len(of)), often)
        entry = np.arange(len(draw)) + np.repeat(begin[of] - (np.cumsum(often) - often), often)
        to = row[entry] * SLOTS + slot[draw]
        t = np.floor(ln_w[entry] / r[draw] + beta[draw])
        ln_a = ln_c[draw] - r[draw] * (t - beta[draw] + 1)
        # what has not arrived has an a over the bound, so a slot is settled by what lies under it, else by a later round
        under = np.flatnonzero(wanted[to] & ((ln_a < np.log(bound) - ln_total[row[entry]]) | (bound == 60)))
        least = np.full(n * SLOTS, np.inf)
        np.minimum.at(least, to[under], ln_a[under])
        won = under[ln_a[under] == least[to[under]]]
        out[to[won]] = mix(key[draw[won]] + t[won].astype(np.int64).astype(np.uint64) * _TERM, 6) >> _U(64 - 8 * np.dtype(kind).itemsize)
        wanted[to[won]] = False
    return out.reshape(n, SLOTS)


def likeness(a: np.ndarray, b: np.ndarray, a_empty: np.ndarray, b_empty: np.ndarray) -> np.ndarray:
    """Estimated generalised Jaccard similarity of fingerprints, row by row."""
    same = (a == b).mean(axis=1)
    out = np.clip((same - 1 / 256) / (1 - 1 / 256), 0, 1)
    return np.where(a_empty | b_empty, (a_empty & b_empty).astype(float), out)


def fingerprint(text: str) -> str:
    return sample([terms(text.encode())])[0].tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first as many of the next text."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


def _rows(part: list[tuple], following: str) -> Iterator[tuple]:
    texts = [t for _, t in part] + [following]
    words = [_hashes(t.encode().lower().split()) for t in texts]
    own, other, digests = [_counted(h) for h in words], [], []
    for i, (a, b) in enumerate(zip(texts, texts[1:])):
        m = len(a) // 4
        head, tail = a[: len(a) - m].encode(), b[:m].encode()
        digests.append(hashlib.sha256(head + tail).hexdigest())
        other.append(_counted(_joined(head.lower(), tail.lower(), words[i], words[i + 1])))
    both = sample(own + other)
    marks, changed = both[: len(own)], both[len(own) :]
    void = np.array([not len(h) for h, _ in own])
    void_new = np.array([not len(h) for h, _ in other])
    near_new = likeness(marks[:-1], changed, void[:-1], void_new)
    near_next = likeness(marks[:-1], marks[1:], void[:-1], void[1:])
    for i, (ident, t) in enumerate(part):
        yield ident, len(t), digests[i], marks[i].tobytes().hex(), changed[i].tobytes().hex(), float(near_new[i]), float(near_next[i])


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, per_task: int = 8000) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Texts move once, dealt by ranges of ids; the first row of a range goes to the
    range before it as well, so that no row needs a text from another task.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 500)
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = own.select("id")
    n = ids.count()
    tasks = max(1, min(-(-n // per_task), 20_000))
    cuts = ids.agg(F.percentile_approx("id", [k / tasks for k in range(1, tasks)] or [0.5], min(100 * tasks, 1_000_000))).first()[0] if n else None
    bounds = np.array(sorted(set(cuts or [])) if tasks > 1 else [], np.int64)

    def place(values: pa.Array) -> np.ndarray:
        null = np.asarray(values.is_null())
        filled = np.asarray(values.fill_null(0))
        return np.where(null, 0, np.searchsorted(bounds, filled, side="right"))

    def least(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            v = b.column(0)
            t = pa.table({"range": place(v), "id": v, "null": v.is_null().cast(pa.int32())}).group_by("range").aggregate([("id", "min"), ("null", "max")])
            yield pa.RecordBatch.from_arrays([t.column("range").combine_chunks(), t.column("id_min").combine_chunks(), t.column("null_max").combine_chunks()], ["range", "id", "has_null"])

    firsts = {r["range"]: None if r.has_null else r.id for r in ids.mapInArrow(least, "range bigint, id bigint, has_null int").groupBy("range").agg(F.min("id").alias("id"), F.max("has_null").alias("has_null")).collect()}
    ranges = sorted(firsts)

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = {firsts[r]: ranges[i - 1] for i, r in enumerate(ranges)}
        for b in parts:
            values = b.column(0).to_pylist()
            more = [i for i, v in enumerate(values) if v in to]
            at = pa.array([*range(b.num_rows), *more], pa.int64())
            where = np.concatenate([place(b.column(0)), np.array([to[values[i]] for i in more], np.int64)]).astype(np.int32)
            halo = np.repeat([0, 1], [b.num_rows, len(more)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(halo), b.column(0).take(at), b.column(1).take(at)], ["range", "halo", "id", "text"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flow() -> Iterator[tuple]:
            held: list[tuple] = []
            where, size, ended = None, 0, False
            for b in parts:
                for r, halo, ident, text in zip(*(c.to_pylist() for c in b.columns)):
                    if r != where:
                        where, ended = r, False
                    if halo:
                        if not ended:
                            yield from _rows(held, text)
                            held, size, ended = [], 0, True
                        continue
                    if held and (len(held) >= 64 or size > 1 << 20):
                        yield from _rows(held, text)
                        held, size = [], 0
                    held.append((ident, text))
                    size += len(text)

        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        block: list[tuple] = []
        for row in flow():
            block.append(row)
            if len(block) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*block), kinds)], names)
                block = []
        if block:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*block), kinds)], names)

    dealt = own.mapInArrow(deal, "range int, halo int, id bigint, text string")
    ordered = dealt.repartitionById(max(1, len(bounds) + 1), F.col("range")).sortWithinPartitions("range", "halo", "id", "text")
    return ordered.mapInArrow(run, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)
