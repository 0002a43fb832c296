"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A
word's probability is the sum over all its segmentations into pieces, by the
forward algorithm; a text's is the product over its words. Piece probabilities
are learnt by expectation maximisation with forward-backward counts.

Words are runs of letters as they stand, behind the vocabulary's word mark, of any
length; the sums are rescaled on the way, so that they can't vanish. A letter that
the vocabulary lacks is a piece with the same small probability in every language.

The fit reads a bounded sample: ``per_lang`` texts of each language in
expectation, chosen by a hash of their ids. Counts are rounded to a binary grid
on which their sums are exact, so that reruns agree to the last bit. Scoring reads
whole texts. The model has a column a language and must fit one worker, so more than
``most_langs`` languages are refused.

Defined cases: a null text and a text without letters are ``und`` with score 0,
as is every text if nothing could be learnt. Rows with a null language teach
nothing. Ties go to the first language in order. Repeated rows are scored alike;
null ids are kept. An empty table gives an empty table. Columns other than those
named are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.shared import bounded_batches, materialize

LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"
UNKNOWN = 1e-7
#: Sums are rescaled after so many letters: 1e-7 a letter stays far above the least double.
RESCALE = 16
#: Expected counts are multiples of this.
GRID = 2.0**-24
_MULT = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(model_file: str) -> list[str]:
    """All pieces made of letters, with or without the word mark."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    every = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return sorted({p for p in every if p == MARK or LETTERS.fullmatch(p.removeprefix(MARK))})


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text)


class Pieces:
    """Finds all pieces in words: a trie as an open table from (node, letter) to node, walked from all places at once in numpy."""

    def __init__(self, pieces: list[str]):
        self.n, self.longest = len(pieces), max(map(len, pieces), default=1)
        nodes: dict[tuple[int, str], int] = {}
        of = [self.n]  # the piece that ends at a node; n + 1 for none
        of[0] = self.n + 1
        for i, piece in enumerate(pieces):
            at = 0
            for c in piece:
                step = nodes.setdefault((at, c), len(of))
                if step == len(of):
                    of.append(self.n + 1)
                at = step
            of[at] = i
        self.piece = np.array(of, np.int32)
        keys = np.array([self._key(a, ord(c)) for a, c in nodes], np.uint64)
        bits = max(4, int(np.ceil(np.log2(4 * max(1, len(keys))))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.next = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64), np.zeros(1 << bits, np.int32)
        self.probes = 1
        for k, node in zip(keys, nodes.values()):
            at, step = ((int(k) * int(_MULT)) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift), 1
            while self.next[at]:
                at, step = (at + 1) & self.mask, step + 1
            self.keys[at], self.next[at] = k, node
            self.probes = max(self.probes, step)

    @staticmethod
    def _key(node: int, letter: int) -> int:
        return node << 21 | letter

    def _step(self, keys: np.ndarray) -> np.ndarray:
        """The next node, 0 for none."""
        at = ((keys * _MULT) >> self.shift).astype(np.int64)
        out = np.where(self.keys[at] == keys, self.next[at], 0)
        for _ in range(self.probes - 1):
            at = (at + 1) & self.mask
            out = np.where((out == 0) & (self.keys[at] == keys), self.next[at], out)
        return out

    def arcs(self, words: list[str]) -> tuple[list[list[tuple[int, np.ndarray, np.ndarray]]], int]:
        """For each begin, the arcs (length, words, pieces) of words of one length; piece n is an unknown letter."""
        size = len(words[0]) + 1
        codes = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le"), np.uint32).reshape(-1, size).T.astype(np.uint64)
        at = np.arange(size * len(words))  # by begin, then by word
        node = np.zeros(len(at), np.int64)
        out: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(size)]
        for k in range(min(self.longest, size)):
            begin, word = np.divmod(at, len(words))
            fits = begin + k < size
            at, node, begin, word = at[fits], node[fits], begin[fits], word[fits]
            node = self._step(node.astype(np.uint64) << np.uint64(21) | codes[begin + k, word])
            piece = self.piece[node]
            own = piece <= self.n
            if k == 0:
                piece = np.where(own, piece, self.n)  # a letter without a piece
                own = np.ones(len(piece), bool)
            b, w, p = begin[own], word[own], piece[own]
            cuts = np.searchsorted(b, np.arange(size + 1))
            for s in np.flatnonzero(np.diff(cuts)):
                out[s].append((k + 1, w[cuts[s] : cuts[s + 1]], p[cuts[s] : cuts[s + 1]]))
            live = node > 0
            at, node = at[live], node[live]
            if not len(at):
                break
        return out, size


def _by_length(words: list[str], most: int = 1 << 16) -> Iterator[np.ndarray]:
    """Blocks of words of one length, of at most about ``most`` letters."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
        block = max(1, most // (int(size[part[0]]) + 1))
        for i in range(0, len(part), block):
            yield part[i : i + block]


def forward(pieces: Pieces, table: np.ndarray, words: list[str]) -> np.ndarray:
    """log P(word) for each language; table: (pieces + 2, languages), the last two rows for unknown letters and for no piece."""
    out = np.empty((len(words), table.shape[1]))
    for at in _by_length(words):
        arcs, size = pieces.arcs([words[i] for i in at])
        ring = pieces.longest + 1  # sums for the places that a piece can still reach
        alpha = np.zeros((ring, len(at), table.shape[1]))
        alpha[0], scale = 1, np.zeros((len(at), table.shape[1]))
        for s in range(size):
            now = alpha[s % ring]
            if s and s % RESCALE == 0:
                scale += np.log(now)
                alpha /= now.copy()
            for k, word, piece in arcs[s]:
                alpha[(s + k) % ring, word] += now[word] * table[piece]
            now[:] = 0
        out[at] = np.log(alpha[size % ring]) + scale
    return out


def expected(pieces: Pieces, p: np.ndarray, words: list[str], times: np.ndarray) -> np.ndarray:
    """Forward-backward counts of the pieces over all segmentations of the words of one language, as multiples of ``GRID``."""
    counts = np.zeros(len(p))
    for at in _by_length(words):
        arcs, size = pieces.arcs([words[i] for i in at])
        alpha, beta, log_a, log_b = np.zeros((4, size + 1, len(at)))
        alpha[0] = beta[size] = 1
        for s in range(size):
            if s and s % RESCALE == 0:
                log_a[s:] += np.log(alpha[s])
                alpha[s + 1 : s + pieces.longest] /= alpha[s]
                alpha[s] = 1
            for k, word, piece in arcs[s]:
                alpha[s + k, word] += alpha[s, word] * p[piece]
        short = size <= RESCALE  # never rescaled
        for s in reversed(range(size)):
            for k, word, piece in arcs[s]:
                step = p[piece] * beta[s + k, word]
                beta[s, word] += step if short else step * np.exp(log_b[s + k, word] - log_b[s, word])
            if s and s % RESCALE == 0:
                log_b[: s + 1] += np.log(beta[s])
                beta[s] = 1
        total = np.log(alpha[size]) + log_a[size]
        weight = times[at] / alpha[size]
        found, shares = [], []
        for s in range(size):
            for k, word, piece in arcs[s]:
                share = alpha[s, word] * p[piece] * beta[s + k, word]
                shares.append(share * weight[word] if short else share * times[at][word] * np.exp(log_a[s, word] + log_b[s + k, word] - total[word]))
                found.append(piece)
        counts += np.bincount(np.concatenate(found), np.rint(np.concatenate(shares) / GRID) * GRID, len(p))
    return counts


def train(docs: DataFrame, vocab: list[str], may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, per_lang: int = 2000, rounds: int = 3, smooth: float = 0.05, most_langs: int = 2000) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the table of piece probabilities with the rows of ``forward``.

    ``per_lang`` bounds the sample; what returns to the driver is at most the
    vocabulary times the languages.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    pieces = spark.sparkContext.broadcast(Pieces(vocab))
    own = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r.lang: r.n for r in own.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).limit(most_langs + 1).collect()}
    if len(sizes) > most_langs:
        raise ValueError(f"over {most_langs} languages: raise most_langs, or clean the column")
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((len(vocab) + 2, 0))
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 30))
    share = spark.createDataFrame([(k, int((1 << 30) * min(1.0, per_lang / n))) for k, n in sizes.items()], "lang string, most long")
    sample = own.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"), part.alias("part")).join(F.broadcast(share), "lang").where("part < most").select("lang", "text")

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            n: Counter[tuple[str, str]] = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n.update((lang, w) for w in words_of(text))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["lang", "word", "n"])

    tasks = spark.sparkContext.defaultParallelism
    words = sample.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialize(words.repartition(tasks, "word"), "langid-words").repartition(tasks, "word")
    v = len(vocab)
    table = np.full((v + 2, len(langs)), 1.0 / max(v, 1))
    table[v], table[v + 1] = UNKNOWN, 0
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(table)

        def step(parts: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros((v + 1, len(langs)))
            for b in parts:
                of, word, n = np.array(b.column(0).to_pylist(), object), np.array(b.column(1).to_pylist(), object), np.asarray(b.column(2)).astype(float)
                for j, lang in enumerate(langs):
                    mine = of == lang
                    if mine.any():
                        total[:, j] += expected(pieces.value, sent.value[: v + 1, j], word[mine].tolist(), n[mine])
            piece, lang = np.nonzero(total[:v])
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], ["piece", "lang", "n"])

        got = words.mapInArrow(step, "piece bigint, lang bigint, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros((v, len(langs)))
        counts[np.asarray(got.column("piece")), np.asarray(got.column("lang"))] = np.asarray(got.column("n"))
        table = np.vstack([(counts + smooth) / (counts.sum(axis=0) + smooth * v), table[v:]])
    return langs, table


class Scorer:
    """Sums words' log probabilities for texts; remembers words, up to ``most`` of them."""

    def __init__(self, pieces: Pieces, table: np.ndarray, most: int = 400_000):
        self.pieces, self.table, self.most = pieces, table, most
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, self.table.shape[1]))

    def _learn(self, words: list[str]) -> None:
        fresh = [w for w in words if w not in self.at]
        self.at.update((w, i) for i, w in enumerate(fresh, len(self.rows)))
        self.rows = np.vstack([self.rows, forward(self.pieces, self.table, fresh)])

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text by language, and its number of words."""
        words = [words_of(t) for t in texts]
        new = set().union(*words).difference(self.at)
        if new:
            if len(self.at) + len(new) > self.most:
                self._forget()
                new = set().union(*words)
            self._learn(sorted(new))
        n = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter((self.at[w] for ws in words for w in ws), np.int64, int(n.sum()))
        out = np.zeros((len(texts), self.table.shape[1]))
        has = np.flatnonzero(n)
        if len(has):
            out[has] = np.add.reduceat(self.rows[at], (np.cumsum(n) - n)[has], axis=0)
        return out, n


def predict(docs: DataFrame, vocab: list[str], langs: list[str], table: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): the likeliest language of every whole text and its posterior under equal priors."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    sent = spark.sparkContext.broadcast((Pieces(vocab), table))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for b in parts:
            names, scores = [], []
            for lo in range(0, b.num_rows, 256):
                texts = [t or "" for t in b.column(1).slice(lo, 256).to_pylist()]
                total, n = scorer.totals(texts) if langs else (None, np.zeros(len(texts), np.int64))
                for i in range(len(texts)):
                    if not n[i]:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    best = int(np.argmax(total[i]))
                    names.append(langs[best])
                    scores.append(float(1 / np.exp(total[i] - total[i, best]).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
