"""Toxicity by weak supervision.

Voters are lexicon entries (words and word beginnings that labelled toxic texts
hold far more often than the others, and fixed lists of insults) and patterns
(threats, direct insults, shouting, exclamations). A voter votes toxic or
abstains; a text without any lexicon vote gets a vote for clean. A generative
label model estimates each voter's rate given either label by expectation
maximisation, over labelled and unlabelled texts. The given label is one more voter,
which abstains where there is none; its two rates are estimated like the others',
from a weak prior. Correlations of voters given the label are estimated too: voters
above a correlation are one factor, and the evidence of a factor is divided by one
plus its remaining correlations with the others, so none can count twice. A linear
classifier is trained on the posterior labels and scores every text.

The fit reads bounded samples: ``max_labelled`` labelled and ``max_unlabelled`` other
rows in expectation, chosen by a hash of their ids, near copies once. Scoring reads
all rows.

Defined cases: a null or empty text is scored as a text without votes. Null
labels and labels without a document are ignored; a document with several labels
has their mean, rounded. Without labels the classifier falls back on the fixed
lists with default rates. Repeated rows are scored alike; null ids are kept. An
empty table gives an empty table. Columns other than id and text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.shared import bounded_batches, discard, materialize

WORD = re.compile(r"\w+")
#: Common insults by language.
LEXICON = {
    "en": "idiot moron stupid scum trash clown loser pathetic worthless disgusting dumb jerk bastard bitch asshole",
    "de": "idiot trottel dumm abschaum müll versager arschloch wertlos widerlich depp schwachkopf",
    "fr": "idiot crétin stupide ordure déchet perdant connard minable pathétique imbécile salaud",
    "es": "idiota imbécil estúpido basura escoria perdedor payaso patético asqueroso cabrón tonto",
}
#: Patterns of threats, direct insults and shouting.
PATTERNS = {
    "threat": r"\b(?:kill|hurt|beat|destroy)\s+(?:you|yourself|them|him|her)\b",
    "direct": r"\b(?:you(?:'re| are)|du bist|tu es|eres)\s+(?:an?|so|such|ein|une?|una?)\b",
    "hate": r"\b(?:i|we)\s+hate\s+(?:you|them)\b",
    "bangs": r"!{3,}",
    "spaced": r"\b(?:\w[.*\-_ ]){4,}\w\b",
}
_COMPILED = {k: re.compile(v) for k, v in PATTERNS.items()}
PREFIXES = (4, 5, 6, 7, 8, 9)


def entries_of(words: set[str]) -> set[str]:
    """Lexicon candidates: each word as ``=word``, its beginnings as ``beginning*``, and as ``beginning**`` where two words share one."""
    out = {f"={w}" for w in words}
    for k in PREFIXES:
        for p, n in Counter(w[:k] for w in words if len(w) >= k).items():
            out.add(f"{p}*")
            if n > 1:
                out.add(f"{p}**")
    return out


@dataclass
class Voters:
    """Lexicon entries and patterns; column j of the votes is voter j."""

    entries: list[str] = field(default_factory=list)

    def __post_init__(self):
        fixed = sorted({w for v in LEXICON.values() for w in v.split()})
        self.names = [*self.entries, "fixed", *PATTERNS, "shouting", "clean"]
        self.lexical = len(self.entries) + 1
        self._fixed = frozenset(fixed)
        self._words = {e[1:]: j for j, e in enumerate(self.entries) if e[0] == "="}
        self._begin: dict[int, dict[str, list[tuple[int, int]]]] = {}
        for j, e in enumerate(self.entries):
            if e[0] != "=":
                begin = e.rstrip("*")
                self._begin.setdefault(len(begin), {}).setdefault(begin, []).append((len(e) - len(begin), j))

    def vote(self, text: str) -> list[int]:
        """The voters that don't abstain."""
        low = text.lower()
        words = set(WORD.findall(low))
        on = {self._words[w] for w in words & self._words.keys()}
        for k, begin in self._begin.items():
            heads = [w[:k] for w in words]
            for p in begin.keys() & set(heads):
                n = heads.count(p)
                on.update(j for least, j in begin[p] if n >= least)
        if words & self._fixed:
            on.add(len(self.entries))
        if not on:
            on.add(len(self.names) - 1)
        at = len(self.entries) + 1
        on.update(j for j, p in enumerate(_COMPILED.values(), at) if p.search(low))
        letters = sum(map(len, words))
        if letters >= 20 and text.isupper():
            on.add(at + len(_COMPILED))
        return sorted(on)

    def matrix(self, votes: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(votes), len(self.names)))
        for i, v in enumerate(votes):
            out[i, v] = 1
        return out


@dataclass
class LabelModel:
    """Rates of voters and of the given label, given the true label; the voters' correlation factors; the posterior labels.

    ``label_accuracy`` and ``label_rows``: mean and weight, in rows, of the prior of the given label's rates.
    """

    threshold: float = 0.5
    slack: float = 0.1  # correlations up to here count as none
    label_accuracy: float = 0.97
    label_rows: float = 20.0
    rounds: int = 25

    def fit(self, votes: np.ndarray, labels: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
        """The probability of label 1 for each row; ``labels``: 1, 0, or -1 for none; ``times``: how often each row occurs."""
        given, times = labels >= 0, np.ones(len(labels)) if times is None else times
        q = np.where(labels > 0.5, self.label_accuracy, 1 - self.label_accuracy)
        for k in range(3):
            corr = self._conditional(votes[given], q[given], times[given])
            self.groups = self._factors(corr)
            x = self.factors(votes)
            self.correlation = self._conditional(x[given], q[given], times[given])
            others = np.maximum(self.correlation - np.diag(np.diag(self.correlation)) - self.slack, 0)
            self.share = 1 / (1 + (others.sum(axis=1) if k else 0 * others[0]))  # the first posterior has the labels' own noise
            q = self._em(x, labels, q, times)  # first rates from the labelled rows, then from all
        return q

    def factors(self, votes: np.ndarray) -> np.ndarray:
        return np.stack([votes[:, g].max(axis=1) for g in self.groups], axis=1)

    def _conditional(self, votes: np.ndarray, q: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Correlation of voters within a label, averaged over the posterior."""
        cov = np.zeros((votes.shape[1],) * 2)
        for w in (q * times, (1 - q) * times):
            centred = votes - (w @ votes) / w.sum()
            cov += (centred * w[:, None]).T @ centred / times.sum()
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        return cov / np.outer(sd, sd)

    def _factors(self, corr: np.ndarray) -> list[list[int]]:
        left, out = list(range(len(corr))), []
        while left:
            group, edge = [left.pop(0)], None
            while edge := [j for j in left if max(corr[j, i] for i in group) > self.threshold]:
                group += edge
                left = [j for j in left if j not in edge]
            out.append(group)
        return out

    def maximise(self, x: np.ndarray, labels: np.ndarray, q: np.ndarray, times: np.ndarray) -> None:
        """Rates from posterior labels."""
        given, said = labels >= 0, labels > 0.5
        one, zero = q * times, (1 - q) * times
        rate = lambda w, mean: (w @ said[given] + mean * self.label_rows) / (w.sum() + self.label_rows)
        self.label_on1, self.label_on0 = rate(one[given], self.label_accuracy), rate(zero[given], 1 - self.label_accuracy)
        self.prior = np.clip(one.sum() / times.sum(), 1e-4, 1 - 1e-4)
        self.on1 = np.clip((one @ x + 0.1) / (one.sum() + 1), 1e-5, 1 - 1e-5)
        self.on0 = np.clip((zero @ x + 0.1) / (zero.sum() + 1), 1e-5, 1 - 1e-5)

    def expect(self, x: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Posterior labels from rates."""
        says = np.where(labels > 0.5, np.log(self.label_on1 / self.label_on0), np.log((1 - self.label_on1) / (1 - self.label_on0)))
        logit = np.log(self.prior / (1 - self.prior)) + np.where(labels >= 0, says, 0.0)
        logit = logit + x @ (self.share * np.log(self.on1 / self.on0)) + (1 - x) @ (self.share * np.log((1 - self.on1) / (1 - self.on0)))
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))

    def _em(self, x: np.ndarray, labels: np.ndarray, q: np.ndarray, times: np.ndarray) -> np.ndarray:
        given = labels >= 0
        self.maximise(x[given], labels[given], q[given], times[given])
        q = self.expect(x, labels)
        for _ in range(self.rounds):
            self.maximise(x, labels, q, times)
            new = self.expect(x, labels)
            done = np.abs(new - q).max() < 1e-6
            q = new
            if done:
                break
        return q


def fit_linear(x: np.ndarray, q: np.ndarray, times: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last weight is the intercept."""
    times = np.ones(len(x)) if times is None else times
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (times * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (times * (q - p)) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class ToxicityModel:
    voters: Voters
    weights: np.ndarray

    @staticmethod
    def features(voters: Voters, votes: np.ndarray) -> np.ndarray:
        lexical = votes[:, : voters.lexical].sum(axis=1, keepdims=True)
        return np.hstack([votes, lexical > 0, np.log1p(lexical)])

    def score(self, texts: list[str]) -> np.ndarray:
        x = self.features(self.voters, self.voters.matrix([self.voters.vote(t) for t in texts]))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def default_model() -> ToxicityModel:
    """The fixed lists alone: a text with an entry scores 0.9, another 0.05."""
    voters = Voters()
    weights = np.zeros(len(voters.names) + 3)
    weights[-1] = np.log(0.05 / 0.95)
    weights[len(voters.names)] = np.log(0.9 / 0.1) - weights[-1]
    return ToxicityModel(voters, weights)


def _near_copy_key(words: list[str]) -> int:
    """The same for most near copies: the least hashes of the shingles under three seeds, so that a shared passage alone rarely makes one."""
    shingles = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    return xxhash.xxh64_intdigest(repr([min(xxhash.xxh64_intdigest(s, seed) for s in shingles) for seed in range(3)])) >> 1


def _counts(rows: DataFrame, among: frozenset[str] | None) -> DataFrame:
    """(entry, n): in how many texts a lexicon candidate occurs."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n: Counter[str] = Counter()
            for text in part.column(0).to_pylist():
                own = entries_of(set(WORD.findall(text.lower())))
                n.update(own if among is None else own & among)
            yield pa.RecordBatch.from_arrays([pa.array(list(n.keys()), pa.string()), pa.array(list(n.values()), pa.int64())], ["entry", "n"])

    return rows.select("text").mapInArrow(run, "entry string, n bigint").groupBy("entry").agg(F.sum("n").alias("n"))


def choose_entries(n1: dict[str, int], n0: dict[str, int], size1: int, size0: int, least: int, evidence: float, precision: float) -> list[str]:
    """Candidates with a log-likelihood ratio of ``evidence`` and a share of toxic texts of ``precision``, best first; of nested ones the best alone."""
    base = size1 / (size1 + size0)

    def ratio(a: int, b: int) -> float:
        n = a + b
        return 2 * (a * np.log(a / (n * base)) + (b * np.log(b / (n * (1 - base))) if b else 0.0))

    good = [(ratio(n, n0.get(e, 0)), e) for e, n in n1.items() if n >= least and n >= precision * (n + n0.get(e, 0)) and n * size0 > n0.get(e, 0) * size1]
    chosen, taken = [], []
    for g, e in sorted(good, key=lambda x: (-x[0], -len(x[1]), x[1])):
        word = e.strip("=*")
        if g >= evidence and not any(word.startswith(t) or t.startswith(word) for t in taken):
            chosen.append(e)
            taken.append(word)
    return chosen


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, max_labelled: int = 20_000, max_unlabelled: int = 20_000, support: float = 0.004, evidence: float = 30.0, precision: float = 0.7) -> ToxicityModel:
    """Fit voters, label model and classifier. ``may_learn``: a condition on ``id_col`` of both tables.

    ``max_labelled`` and ``max_unlabelled`` bound the samples, and with them what the driver holds;
    ``support`` is the least share of toxic texts that hold a lexicon entry.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    given = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(may_learn).groupBy(F.col(id_col).alias("id")).agg((F.avg(F.col(label_col)) >= 0.5).cast("int").alias("y"))
    n = given.count()
    own = docs.where(may_learn).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def sampled(rows: DataFrame, n: int, most: int) -> DataFrame:
        return rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(n, 1))))

    def keyed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            keys = [_near_copy_key(WORD.findall(t.lower())) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], ["text", "y", "key"])

    some = sampled(own, own.count(), max_unlabelled).join(given, "id", "left_anti").select("text", F.lit(-1).alias("y"))
    marked = own.join(F.broadcast(sampled(given, n, max_labelled)), "id").select("text", "y")
    found = marked.unionByName(some).mapInArrow(keyed, "text string, y int, key bigint")
    sample = materialize(found.groupBy("key", "y").agg(F.min("text").alias("text")), "toxicity-sample")
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    size1, size0 = sizes.get(1, 0), sizes.get(0, 0)
    if not size1 or not size0:
        discard(sample)
        return default_model()
    least = max(5, int(support * size1))
    n1 = {r.entry: r.n for r in _counts(sample.where("y = 1"), None).where(F.col("n") >= least).collect()}
    n0 = {r.entry: r.n for r in _counts(sample.where("y = 0"), frozenset(n1)).collect()}
    voters = Voters(choose_entries(n1, n0, size1, size0, least, evidence, precision))

    def voted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            votes = pa.array([voters.vote(t) for t in b.column(0).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([votes, b.column(1)], ["votes", "y"])

    table = sample.select("text", "y").mapInArrow(voted, "votes array<int>, y int").groupBy("votes", "y").agg(F.count("*").alias("n")).orderBy("votes", "y").toArrow()
    discard(sample)
    votes = voters.matrix(table.column("votes").to_pylist())  # different votes only, with their times
    times, y = np.asarray(table.column("n")).astype(float), np.asarray(table.column("y"))
    q = LabelModel().fit(votes, y, times)
    return ToxicityModel(voters, fit_linear(ToxicityModel.features(voters, votes), q, times))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score([t or "" for t in b.column(1).to_pylist()]), pa.float64())], ["id", "score"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield b.filter(pa.array(model.score([t or "" for t in b.column(at).to_pylist()]) < threshold))

    return docs.mapInArrow(run, docs.schema)
