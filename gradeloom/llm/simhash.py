"""Near-duplicate detection by SimHash and BK-trees.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes of a text's
word shingles. Equal fingerprints become one entry. Entries that share a key are
a shard, and each shard is a BK-tree: children hang on their parent by integer
Hamming distance, and a search follows only edges within the radius.

Shards: with a radius r, the 64 bits are cut into b > r blocks; two entries
within the radius agree in at least b - r blocks, so each choice of b - r blocks
gives a key, and no link is lost. b grows with the number of entries, so that a
shard stays small. Trees are as large as the corpus together, so they have no
bound to be broadcast under; trees and their queries are dealt to the tasks by
key instead, and a shard over a limit is cut (``shards``). Within a shard, entries
already connected are not compared again: a subtree whose entries all belong to
the searcher's component is skipped, and only a spanning chain of links leaves
the task.

``similar_documents`` asks for a Jaccard similarity of the shingle sets instead
of a distance in bits. Its shards are documents that agree in a band of a
sampled sketch; a search in a shard's BK-tree follows the edges within the wide
radius that the similarity implies, and its links, by estimates with a margin,
only name candidates: within each group of candidates another BK-tree search
accepts a link by the exact similarity of the two shingle sets.

Defined cases: a null text is empty; a text without words has fingerprint zero
and links like any other. Repeated rows are members of their component. A null
id is a member, but never names a component unless all its ids are null. An
empty table gives an empty table. Columns other than the id and the text are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.components import connected_components
from gradeloom.llm.shards import link_shards
from gradeloom.llm.shared import Scratch, bounded_batches, lookup, materialize
from gradeloom.llm.weighted_sampling import SLOTS, mix, sample, terms

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42


def shingles(text: bytes, k: int) -> list[bytes]:
    """Shingles of k words, repeats included, lower-case A-Z, joined by a space; with fewer words the whole sequence."""
    words = WORD.findall(text.lower())
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    return [line[a:b] for a, b in zip(begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(s, SEED) for s in shingles(text, k)]), ">u8")


def simhash(hashes: np.ndarray, block: int = 65536) -> int:
    """The fingerprint as an unsigned integer."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), block):
        part = hashes[i : i + block]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = pc.cast(pc.cast(part.column(1), pa.large_string()), pa.large_binary())
            out = [signed(simhash(shingle_hashes(t.as_py() or b"", words))) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.int64())], ["id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


class BKForest:
    """BK-trees over the entries of many shards at once, built and searched level by level in numpy."""

    def __init__(self, fps: np.ndarray, shard: np.ndarray, radius: int, same: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None):
        """``fps``: unsigned 64-bit; ``shard``: sorted shard numbers; ``same`` may refuse a link between entries within the radius."""
        self.fps, self.radius, self.same = fps, radius, same or (lambda a, b: np.ones(len(a), bool))
        n = len(fps)
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if n else np.zeros(0, np.int64)
        self.root = np.repeat(first, np.diff(np.concatenate([first, [n]])))
        self.parent = np.full(n, -1, np.int64)
        keys, kids, self.levels, links = [], [], [], []
        items = np.setdiff1d(np.arange(n), first, assume_unique=True)
        at = self.root[items]
        while len(items):
            d = self.distance(items, at)
            near = d <= radius  # an entry meets its ancestors on its way down
            if near.any():
                links.append((items[near], at[near]))
            key = at * 65 + d
            uniq, lead, where = np.unique(key, return_index=True, return_inverse=True)
            child = items[lead]
            keys.append(uniq)
            kids.append(child)
            self.parent[child] = at[lead]
            self.levels.append(child)
            rest = np.ones(len(items), bool)
            rest[lead] = False
            items, at = items[rest], child[where][rest]
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(self.keys)
        self.keys = self.keys[order]
        self.kids = np.concatenate(kids)[order] if kids else np.zeros(0, np.int64)
        self.label = np.arange(n)
        for a, b in links:
            self._link(a, b)

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fps[a] ^ self.fps[b]).astype(np.int64)

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
        keep = self.same(a, b)
        a, b = a[keep], b[keep]
        while len(a):
            la, lb = label[a], label[b]
            low = np.minimum(la, lb)
            np.minimum.at(label, la, low)
            np.minimum.at(label, lb, low)
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up
            more = label[a] != label[b]
            a, b = a[more], b[more]
        self.label = label

    def _uniform(self) -> np.ndarray:
        """The label that a whole subtree has, or -1."""
        low, high = self.label.copy(), self.label.copy()
        for nodes in reversed(self.levels):
            np.minimum.at(low, self.parent[nodes], low[nodes])
            np.maximum.at(high, self.parent[nodes], high[nodes])
        return np.where(low == high, low, -1)

    def connect(self, most: int = 1 << 20) -> np.ndarray:
        """Search the radius around every entry; the label of each entry: the first entry of its component in its shard."""
        n, r = len(self.fps), self.radius
        size = np.bincount(self.root, minlength=n)[self.root] if n else np.zeros(0, np.int64)
        uniform = self._uniform()
        todo = np.flatnonzero(uniform[self.root] != self.label)
        i = 0
        while i < len(todo):
            j = i + max(1, int(np.searchsorted(np.cumsum(size[todo[i : i + most]]), most)))
            q = todo[i:j]
            i = j
            node = self.root[q]
            while len(q):
                d = self.distance(q, node)
                near = (d <= r) & (q != node)
                if near.any():
                    self._link(q[near], node[near])
                lo = np.searchsorted(self.keys, node * 65 + np.maximum(d - r, 0))
                hi = np.searchsorted(self.keys, node * 65 + np.minimum(d + r, 64), side="right")
                count = hi - lo
                q = np.repeat(q, count)
                node = self.kids[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(len(q))]
                more = uniform[node] != self.label[q]
                q, node = q[more], node[more]
            uniform = self._uniform() if i < len(todo) and size[todo[i]] > 1000 else uniform
        return self.label


def _cuts(radius: int, entries: int, per_shard: int) -> list[tuple[int, ...]]:
    """Masks of the keys: for b blocks all choices of b - radius of them, with the least b whose shards hold about ``per_shard`` entries."""
    b = radius + 1
    while b < 2 * radius + 2 and entries > per_shard * 2 ** (64 * (b - radius) // b):
        b += 1
    edges = [64 * i // b for i in range(b + 1)]
    blocks = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(b)]
    return [tuple(c) for c in combinations(blocks, b - radius)]


def _spanned(entry: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    """(a, b): entries of one label as a chain, so that no entry has more than two links of a shard."""
    order = np.argsort(label, kind="stable")
    same = label[order][1:] == label[order][:-1]
    return pa.RecordBatch.from_arrays([pa.array(entry[order[1:][same]]), pa.array(entry[order[:-1][same]])], ["a", "b"])


def _shards(*columns: np.ndarray) -> np.ndarray:
    """Numbers of runs of equal rows in sorted columns."""
    new = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.concatenate([[0], np.cumsum(new)])


def _link_fingerprints(radius: int):
    """A linker of (key, entry): the entries are fingerprints as signed longs."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(parts)
        if got:
            table = pa.Table.from_batches(got)
            key, fp = (np.asarray(table.column(c)) for c in ("key", "entry"))
            order = np.lexsort((fp, key))
            key, fp = key[order], fp[order]
            yield _spanned(fp, BKForest(fp.view(np.uint64), _shards(key), radius).connect())

    return run


def link_entries(entries: DataFrame, radius: int, n: int, *, per_shard: int = 64, limit: int = 100_000, per_task: int = 200_000) -> DataFrame:
    """(a, b): spanning links between entries (fp: distinct signed longs) within the radius."""
    masks = [signed(sum(c)) for c in _cuts(radius, n, per_shard)]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    return link_shards(entries.select(F.explode(keys).alias("key"), F.col("fp").alias("entry")), _link_fingerprints(radius), limit=limit, per_task=per_task)[0]


def _component_ids(entries: DataFrame, links: DataFrame) -> DataFrame:
    """(entry, component_id, n) from entries (entry, least, n) and links (a, b) between them.

    The nodes are (no id, smallest id, entry), so a component's smallest node names the smallest id: nothing is
    joined by component, however large one is. Links are chains, so no entry has many.
    """
    node = entries.select("entry", F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), F.col("entry").alias("entry")).alias("node"))
    a, b = node.toDF("ea", "na"), node.toDF("eb", "nb")
    edges = links.join(a, F.col("a") == F.col("ea")).join(b, F.col("b") == F.col("eb")).select(F.col("na").alias("a"), F.col("nb").alias("b"))
    roots = connected_components(edges).select(F.col("node.entry").alias("of"), F.col("root.id").alias("component_id"))
    return materialize(entries.join(roots, F.col("entry") == F.col("of"), "left").select("entry", F.when(F.col("of").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), "n"), "component-ids")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, radius: int = 4) -> DataFrame:
    """(id, fp, component_id): each document with its fingerprint and the smallest id that links reach."""
    marked = materialize(fingerprints(docs, id_col, text_col, words=words), "simhash")
    with Scratch(docs.sparkSession) as scratch:
        entries = materialize(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "entries")
        size = entries.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
        links = link_entries(entries, radius, size.k)
        member = scratch.keep(_component_ids(entries.withColumnRenamed("fp", "entry"), links))
    return lookup(marked, "fp", member.withColumnRenamed("entry", "of"), "of", size.n or 0).select(F.col("id").alias(id_col), "fp", "component_id")


BANDS, BAND_ROWS = 25, 5  # a pair at a similarity of 0.8 agrees in no band with a chance of 5e-5
#: What an estimate may fall short of the similarity: over four standard errors at 0.8.
MARGIN = 0.15


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, h, entry, fp, sketch, bands): ``entry`` is the same for equal words, ``h`` for equal texts, ``fp`` is that of the set of shingles; texts without words have no bands."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo in range(0, part.num_rows, 64):
                b = part.slice(lo, 64)
                raw = [t or b"" for t in pc.cast(pc.cast(b.column(1), pa.large_string()), pa.large_binary()).to_pylist()]
                found = [(h, np.ones(len(h))) for h, _ in (terms(t, words) for t in raw)]
                marks = sample(found, np.uint16)
                keys = np.zeros((len(raw), BANDS), np.uint64)
                for j in range(BAND_ROWS):
                    keys = keys * np.uint64(0x9FB21C651E98DF25) + marks[:, j * BANDS : (j + 1) * BANDS]
                keys = mix(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), 11).view(np.int64)
                thin = (marks >> 8).astype(np.uint8)
                fps = [signed(simhash(h)) for h, _ in found]
                entry = [signed(xxhash.xxh64_intdigest(b" ".join(WORD.findall(t.lower())))) for t in raw]
                cols = [b.column(0), b.column(2), pa.array(entry, pa.int64()), pa.array(fps, pa.int64()), pa.array([m.tobytes() for m in thin], pa.binary()), pa.array([k.tolist() if len(h) else [] for k, (h, _) in zip(keys, found)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "h", "entry", "fp", "sketch", "bands"])

    bounded_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    return own.mapInArrow(run, f"id {kind}, h bigint, entry bigint, fp bigint, sketch binary, bands array<bigint>")


def _repeated(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's (key, entry), those whose key has two entries or more."""
    got = list(parts)
    if got:
        table = pa.Table.from_batches(got)
        key = np.asarray(table.column("key"))
        _, back, n = np.unique(key, return_inverse=True, return_counts=True)
        yield from table.filter(pa.array(n[back] > 1)).to_batches()


def _alike(sketch: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    least = similarity * (1 - 1 / 256) + 1 / 256
    return np.concatenate([np.zeros(0, bool), *[(sketch[a[i : i + 65536]] == sketch[b[i : i + 65536]]).mean(axis=1) >= least for i in range(0, len(a), 65536)]])


def similar_sets(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted arrays of different values have at least this Jaccard similarity."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < similarity * len(b) - 1e-9:
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0
    return both * (1 + similarity) >= similarity * (len(a) + len(b)) - 1e-9


def _link_sets(radius: int, similarity: float, words: int):
    """A linker of (key, entry, fp, sketch, text) by exact similarities; each entry is linked to the first of its component."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols, sets = [], []
        for b in parts:
            cols.append(pa.Table.from_batches([b]).drop(["text"]))
            sets += [terms((t.as_py() or "").encode(), words)[0] for t in b.column("text")]
        if not sets:
            return
        table = pa.concat_tables(cols)
        key, entry, fp = (np.asarray(table.column(c)) for c in ("key", "entry", "fp"))
        order = np.lexsort((entry, fp, key))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SLOTS)[order]
        key, entry, fp, sets = key[order], entry[order], fp[order], [sets[i] for i in order]

        def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            out = _alike(sketch, a, b, similarity - MARGIN)
            out[out] = [similar_sets(sets[i], sets[j], similarity) for i, j in zip(a[out], b[out])]
            return out

        label = BKForest(fp.view(np.uint64), _shards(key), radius, same).connect()
        linked = label != np.arange(len(entry))
        yield pa.RecordBatch.from_arrays([pa.array(entry[linked]), pa.array(entry[label[linked]])], ["a", "b"])

    return run


def _link_sketches(radius: int, similarity: float):
    """A linker of (key, entry, fp, sketch) by estimates."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(parts)
        if not got:
            return
        table = pa.Table.from_batches(got)
        key, entry, fp = (np.asarray(table.column(c)) for c in ("key", "entry", "fp"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SLOTS)
        digest = mix(sketch.view(np.uint64) + np.arange(SLOTS // 8, dtype=np.uint64), 12).sum(axis=1, dtype=np.uint64)
        order = np.lexsort((entry, digest, fp, key))
        key, entry, fp, digest = key[order], entry[order], fp[order], digest[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1]) | (digest[1:] != digest[:-1])])
        of = np.cumsum(new) - 1  # entries that agree in all stand behind the first of them
        label = BKForest(fp[new].view(np.uint64), _shards(key[new]), radius, lambda a, b: _alike(sketch[order[new]], a, b, similarity - MARGIN)).connect()
        yield _spanned(entry, label[of])

    return run


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, similarity: float = 0.8, radius: int = 32, per_task: int = 200_000, limit: int = 50_000, texts_limit: int = 5000) -> DataFrame:
    """(id, component_id): documents whose sets of word shingles have at least this Jaccard similarity are linked.

    ``radius``: at a similarity of 0.8 a bit of the sets' fingerprints differs with a chance of at most a fifth, over 32 of 64 with one under 1e-7.
    ``limit``, ``texts_limit``: the entries of a band, and of a group of candidates with their texts, that one task takes; larger ones are cut.
    """
    marked = materialize(sketches(docs, id_col, text_col, words), "sketches")
    entries = materialize(marked.groupBy("entry").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.min_by(F.struct("h", "fp", "sketch", "bands"), "h").alias("s")).select("entry", "least", "n", "s.*"), "entries")
    size = entries.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size.k * BANDS // per_task))
    keyed = entries.select(F.explode("bands").alias("key"), "entry").repartition(tasks, "key").mapInArrow(_repeated, "key bigint, entry bigint")
    shards = materialize(materialize(keyed, "bands").join(entries.select("entry", "fp", "sketch"), "entry").select("key", "entry", "fp", "sketch"), "band-shards")
    groups = connected_components(link_shards(shards, _link_sketches(radius, similarity), limit=limit, per_task=per_task)[0])
    groups = materialize(groups.join(entries.select("entry", "h", "fp", "sketch"), F.col("node") == F.col("entry")).select(F.col("h").alias("of"), F.col("root").alias("key"), "entry", "fp", "sketch"), "groups")
    text = F.col(text_col).cast("string")
    own = docs.select(F.xxhash64(text).alias("h"), text.alias("text"))
    # one text for each entry: copies of a text are reduced before they meet
    found = own.join(groups.select("of"), F.col("h") == F.col("of"), "left_semi").groupBy("h").agg(F.first("text").alias("text"))
    found = materialize(found.join(groups, F.col("h") == F.col("of")).select("key", "entry", "fp", "sketch", "text"), "group-texts")
    links, whole = link_shards(found, _link_sets(radius, similarity, words), limit=texts_limit, per_task=max(1, per_task // 20))
    if whole:  # an entry has one group, so what links in it are whole components already
        roots = materialize(links.toDF("node", "root"), "roots")
        named = entries.select("entry", "least", "n").join(roots, F.col("entry") == F.col("node"), "left").select("entry", "least", F.col("n").alias("rows"), F.coalesce("root", "entry").alias("root"))
        least = materialize(named.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "least")
        member = materialize(lookup(named, "root", least, "r", size.k).select(F.col("entry").alias("of"), "component_id", F.col("rows").alias("n")), "component-ids")
    else:
        member = _component_ids(entries.select("entry", "least", "n"), links).withColumnRenamed("entry", "of")
    return lookup(marked.select("id", "entry"), "entry", member, "of", size.n or 0).select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their group; rows of one id stay or go together; null ids stay where a group has no other."""
    with Scratch(docs.sparkSession) as scratch:
        groups = similar_documents(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), "i", "t", **options)
        kept = scratch.keep(materialize(groups.where(F.col("i").eqNullSafe(F.col("component_id"))).select("i").distinct(), "kept"))
    mark = "kept_" + max([*docs.columns, ""], key=len)  # longer than any column of the caller's
    return docs.join(kept.withColumnRenamed("i", mark), F.col(f"`{id_col}`").eqNullSafe(F.col(f"`{mark}`")), "left_semi")
