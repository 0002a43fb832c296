"""Best-fit packing of documents into token sequences, by hierarchical residual packing.

Documents become pieces of at most ``capacity`` tokens. Each partition packs its
pieces best-fit, largest first, and emits bins that are nearly full. Underfull
bins go on as items to fewer partitions and are packed again, until one
partition holds them all or their number stops to shrink.

Defined cases: a null text is empty and gives one piece with the end id alone.
Repeated rows are packed each. A null id is kept. An empty table gives an empty
table. Columns other than the id and the text are ignored. Ties between equal
lengths are broken by id, piece and checksum, so reruns agree.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.shared import bounded_batches, materialize

_ENCODERS: dict[str, WordEncoder] = {}
#: Letters for which composition and lower-casing go letter by letter.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Words of such letters, digits and ASCII marks without the apostrophe, and the parts that the tokenizer encodes each for itself.
_MADE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ!-&(-~]+")
_PART = re.compile(r"[a-zà-öø-ÿß]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
#: The characters that stand for bytes in a byte-level vocabulary, with the space left as it is.
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (0x20 < b < 0x7F or 0xA0 < b < 0xAD or 0xAD < b)) if b != 0x20}


class WordEncoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its parts between spaces and newlines, which are remembered.
    Unknown parts that are plain words, maybe before a comma or full stop, and
    runs of letters or marks and digits that others are made of are encoded
    many at once in lower case, and told apart by their last tokens. About
    ``most`` are remembered, in two halves: once the younger is full it becomes
    the older, whose words that were not met again since are forgotten.
    """

    def __init__(self, path: str, most: int = 1_000_000, longest: int = 48, segment: int = 1 << 19):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.most, self.longest, self.segment = most, longest, segment
        self.tok, bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        bare.normalizer = normalizers.Sequence([])
        bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()  # bytes are written as their characters before
        self.batch, self.bare = (getattr(t, "encode_batch_fast", t.encode_batch) for t in (self.tok, bare))
        vocab = self.tok.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.marks = self._each([".", ","])

    def _each(self, words: list[str]) -> dict[str, bytes]:
        return {w: np.asarray(e.ids, dtype="<u4").tobytes() for w, e in zip(words, self.batch(words, add_special_tokens=False))}

    def _plain(self, words: list[str], line: int = 100) -> dict[str, bytes]:
        """Plain words in lower case, or single parts of words, ``line`` of them encoded as one text."""
        out = {}
        lines = [words[i : i + line] for i in range(0, len(words), line)]
        texts = [" ".join(x) for x in lines]
        texts = [t if t.isascii() else t.encode().decode("latin-1").translate(_BYTES) for t in texts]
        for own, e in zip(lines, self.bare(texts, add_special_tokens=False)):
            ids = np.asarray(e.ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) == len(own):
                raw = ids.tobytes()
                out.update(zip(own, [raw[a:b] for a, b in zip([0, *ends], ends)]))
            else:
                out.update(self._each(own))
        return out

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        plain, made = {}, {}  # a word and its stem in lower case, or its parts
        for w in words:
            stem = w[:-1] if w[-1] in ".," else w
            if stem.isalpha() and (stem.isascii() or _PLAIN.fullmatch(stem)):
                plain[w] = stem.lower()
            elif _MADE.fullmatch(w) and "<|" not in w:  # special tokens begin with <|
                made[w] = _PART.findall(w.lower())
        stems = set(plain.values()).union(*made.values())
        had = {s: ids for s in stems if (ids := self.known.get(s) or self.older.get(s))}
        out = self._plain(list(stems - had.keys()))
        rest = words - plain.keys() - made.keys()
        if rest:
            out.update(self._each(list(rest)))
        for w, s in plain.items():
            if w not in out:
                ids = out[s] if s in out else had[s]
                out[w] = ids if len(w) == len(s) else ids + self.marks[w[-1]]
        for w, own in made.items():
            if w not in out:
                out[w] = b"".join([out[s] if s in out else had[s] for s in own])
        return out

    def _segments(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > self.segment and (cut := text.find(" ", at + self.segment)) >= 0:
            yield text[at:cut]
            at = cut
        yield text[at:] if at else text

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; most that is looked up at once is a segment of about ``segment`` characters."""
        out, parts, size = [b""] * len(texts), [], 0
        for i, text in enumerate(texts):
            for own in self._segments(text):
                parts.append((i, own.replace("\n", " ").split(" ")))
                size += len(own)
                if size > self.segment:
                    self._look_up(parts, out)
                    parts, size = [], 0
        self._look_up(parts, out)
        return out

    def _look_up(self, parts: list[tuple[int, list[str]]], out: list[bytes]) -> None:
        words = set().union(*[own for _, own in parts])
        unknown, long = words.difference(self.known), []
        if unknown:
            again = {w: self.older[w] for w in unknown & self.older.keys()} if self.older else {}
            learnt = self._learn(unknown - again.keys()) | again
            long = [w for w in learnt if len(w) > self.longest]
            self.known.update(learnt)
        find = self.known.__getitem__
        for i, own in parts:
            out[i] += b"".join(map(find, own))
        for w in long:
            del self.known[w]
        if 2 * len(self.known) > self.most:
            self.known, self.older = {"": b""}, self.known


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the pieces of every document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, size = encoder(tokenizer_path), np.uint32(end_id).tobytes(), 4 * capacity
        for part in parts:
            rows, piece, start, length, crc = [], [], [], [], []
            for lo in range(0, part.num_rows, 64):
                for i, ids in enumerate(enc.encode([t or "" for t in part.column(1).slice(lo, 64).to_pylist()]), lo):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), size)):
                        one = ids[at : at + size]
                        rows.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(one) // 4)
                        crc.append(zlib.crc32(one))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin of each item in the order given, and what each bin has left; the tightest bin that takes the item, the latest among equals."""
    left: list[int] = []
    open_at: dict[int, list[int]] = {}
    sizes: list[int] = []
    bins = []
    for n in lengths:
        k = bisect_left(sizes, n)
        if k == len(sizes):
            b, room = len(left), capacity - n
            left.append(room)
        else:
            was = sizes[k]
            b = open_at[was].pop()
            if not open_at[was]:
                del open_at[was], sizes[k]
            room = left[b] = was - n
        bins.append(b)
        if room:
            if room not in open_at:
                insort(sizes, room)
                open_at[room] = []
            open_at[room].append(b)
    return bins, left


def _pack_round(level: int, capacity: int, slack: int, last: bool):
    """A mapInArrow function: items of a partition into bins; items are lists of members with their offsets."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = list(parts)
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        members = table.column("members").combine_chunks()
        flat, ends = members.flatten(), np.asarray(pc.list_value_length(members)).cumsum()
        begins = np.concatenate([[0], ends[:-1]])
        first = flat.take(pa.array(begins))
        keys = pa.table({"l": table.column("length"), "i": first.field("id"), "p": first.field("piece"), "c": first.field("ids_crc32")})
        order = np.asarray(pc.sort_indices(keys, sort_keys=[("l", "descending"), ("i", "ascending"), ("p", "ascending"), ("c", "ascending")]))
        lengths = np.asarray(table.column("length"))[order]
        bins, left = best_fit(lengths.tolist(), capacity)
        bins, left = np.asarray(bins), np.asarray(left)
        by_bin = np.argsort(bins, kind="stable")  # items of a bin side by side
        b, n, item = bins[by_bin], lengths[by_bin], order[by_bin]
        before = np.cumsum(n) - n
        new = np.concatenate([[True], b[1:] != b[:-1]])
        base = before - before[new][np.cumsum(new) - 1]  # offset of the item in its bin
        counts = ends[item] - begins[item]
        take = np.repeat(begins[item] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        child = flat.take(pa.array(take))
        offset = pa.array(np.asarray(child.field("offset")) + np.repeat(base, counts))
        fields = [child.field(f.name) if f.name != "offset" else offset for f in child.type]
        struct = pa.StructArray.from_arrays(fields, names=[f.name for f in child.type])
        per_bin = np.add.reduceat(counts, np.flatnonzero(new))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], per_bin.cumsum()]), pa.int32()), struct)
        ident = (np.int64(level) << 56) | (np.int64(TaskContext.get().partitionId()) << 34) | np.arange(len(left))
        out = pa.table({"bin": pa.array(ident), "length": pa.array(capacity - left), "done": pa.array((left <= slack) | last), "members": lists})
        yield from out.to_batches(max_chunksize=2000)

    return run


def pack(items: DataFrame, *, capacity: int = 4096, slack: int = 8, per_task: int = 50_000, fan_in: int = 8) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): every piece with its place.

    ``items`` is the table of ``pieces``. ``slack``: tokens that a nearly full bin
    may miss. A task holds about ``per_task`` items; no round goes to one task
    unless at most so many underfull bins are left.
    """
    kind = items.schema["id"].dataType.simpleString()
    member = f"struct<id:{kind},piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>"
    schema = f"bin bigint, length bigint, done boolean, members array<{member}>"
    items = materialize(items, "pieces")
    left, level, done = items.count(), 0, []
    tasks = max(1, -(-left // per_task))
    rows = items.repartition(tasks, "id", "piece", "start").select("length", F.array(F.struct("id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("bigint").alias("offset"))).alias("members"))
    while True:
        packed = materialize(rows.mapInArrow(_pack_round(level, capacity, slack, tasks == 1), schema), "packed")
        done.append(packed.where("done"))
        rest = packed.where("not done")
        if tasks == 1:
            break
        n = rest.count()
        fewer = max(1, -(-n // per_task), tasks // fan_in if n > per_task else 1)
        if n == 0:
            break
        if fewer >= tasks:  # the bins no longer shrink: what is left is as full as its partition allows
            done.append(rest)
            break
        tasks, level = fewer, level + 1
        rows = rest.repartition(tasks, "bin").select("length", "members")
    every = reduce(DataFrame.unionByName, done)
    return every.select(F.col("bin").alias("sequence_id"), F.explode("members").alias("m")).select(*[F.col(f"m.{c}").alias(c) for c in ("id", "piece", "start", "length", "ids_crc32")], "sequence_id", F.col("m.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for all documents."""
    cut = {k: options[k] for k in ("capacity", "end_id") if k in options}
    out = pack(pieces(docs, tokenizer_path, id_col, text_col, **cut), **{k: v for k, v in options.items() if k != "end_id"})
    return out.withColumnRenamed("id", id_col)
