"""Problem 8: abusive, hateful or sexual content, by cumulative-link ordinal regression on sparse text features.

Reviewers' judgements give each labelled document a severity grade: 0 (nobody calls it abusive), 1 (disputed), 2 (all do).
The model has one weight for each hashed feature, shared by two ordered thresholds:
P(grade <= k) = sigmoid(threshold_k - w.x); the severity of a sentence is its expected grade, that of a document the
greatest of its sentences. A grade belongs to a document, so fitting alternates: of a document of grade 1 or 2 the
sentence that the model finds worst carries the grade, all sentences of a document of grade 0 have grade 0.

Features of a sentence: words, pairs and triples of neighbouring words, and words without vowels, after undoing
disguises (look-alike and invisible characters, letters spelt apart, repeated letters, digits and signs for letters).

Scale: the fit uses a bounded sample of labelled documents (``LABELLED``; chosen by a hash of doc_id, the same on every
run); the corpus is scored in one narrow pass with the weights broadcast (a fixed 2^18 floats). Rates per source are a
map-side aggregation, so a hot source costs nothing more.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import shingles as S
from folioflow.llm.lookalike import LOOKALIKES, UNSEEN

U = np.uint64
#: At most about so many labelled documents are used for the fit.
LABELLED = 12_000
BITS = 18
DIMENSIONS = 1 << BITS
ROUNDS, STEPS, RATE = 4, 120, 0.1
#: The penalty on squared weights, in documents: as many must agree before a feature counts in full; less if few are bad.
PENALTY, PENALTY_SHARE, LEAST_PENALTY = 3.0, 0.05, 0.5
#: The expected severity below which a judgement against a document counts as wrong in later rounds.
DOUBTFUL = 0.8
#: A document is reported if its expected severity (0 to 2) is at least this.
REPORTED = 0.5
#: Documents and sentences that are taken together, and sentences whose scores are kept for later ones.
DOCUMENTS, SENTENCES, KNOWN = 2048, 20_000, 50_000

_DROP = {ord(c): None for c in map(chr, UNSEEN)}
_SAME = {ord(a): b for a, b in LOOKALIKES.items()}
_SENTENCE = re.compile(r"(?<=[.!?।])[\"'”)]?\s+|[\r\n]+")
_SPELT = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_*·]{1,2}){3,}[^\W_](?![^\W_])")
_APART = re.compile(r"[ .\-_*·]+")
_WORD = re.compile(r"[^\W_][\w*@$!|+]*[\w*$]|[^\W_]|[@$*][\w*@$!|+]*[\w$]")
_REPEAT = re.compile(r"(.)\1{2,}")
_VOWELS = re.compile(r"[aeiouyäöüéèêàâîïôûù0134@*!|]+")
_SIGNS = str.maketrans("013457@$!|+", "oieastasiit")


def sentences(text: str | None) -> list[str]:
    """The sentences of a text; none for null and blank texts."""
    return [s for s in _SENTENCE.split(text or "") if s and not s.isspace()]


def _undo(word: str) -> tuple[str, str]:
    """The word with signs read as letters, and its consonants with ``_`` for vowels and the signs that hide them."""
    if word.isdigit():
        return "0", ""
    word = _REPEAT.sub(r"\1", word)
    bare = _VOWELS.sub("_", word.replace("$", "s").replace("5", "s").replace("7", "t"))
    return word.translate(_SIGNS), bare


def _plain(sentence: str) -> str:
    """The sentence lower-cased, in compatibility forms, without invisible and look-alike characters and letters spelt apart."""
    low = sentence.lower() if sentence.isascii() else unicodedata.normalize("NFKC", sentence.translate(_DROP)).translate(_SAME).lower()
    return _SPELT.sub(lambda m: _APART.sub("", m.group()), low)


class Words:
    """Numbers of words as written, with the hashes of what they stand for: once for each word of a task."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.plain: list[int] = []
        self.bare: list[int] = []

    def of(self, words: list[str]) -> list[int]:
        numbers = self.numbers
        for raw in words:
            if raw not in numbers:
                plain, bare = _undo(raw)
                numbers[raw] = len(self.plain)
                self.plain.append(zlib.crc32(plain.encode("utf-8", "replace")))
                self.bare.append(zlib.crc32(bare.encode("utf-8", "replace")) | 1 << 33 if bare else 0)
        return [numbers[raw] for raw in words]


_FIRST, _LAST = U(1 << 34), U(1 << 35)
_words = Words()


def features(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed features of sentences as a sparse matrix: indexes row by row, and where each row starts."""
    global _words
    if len(_words.plain) > 200_000:
        _words = Words()
    rows = [_words.of(_WORD.findall(_plain(s))) for s in some]
    lengths = np.array([len(x) for x in rows], dtype=np.int64)
    numbers = np.fromiter(itertools.chain.from_iterable(rows), np.int64, lengths.sum())
    ends = np.cumsum(lengths + 2)
    starts = ends - lengths - 2
    owner = np.repeat(np.arange(len(some)), lengths + 2)
    word = np.zeros(len(owner), dtype=U)
    inner = np.ones(len(owner), dtype=bool)
    inner[starts] = inner[ends - 1] = False
    word[starts], word[ends - 1], word[inner] = _FIRST, _LAST, np.array(_words.plain, dtype=U)[numbers]
    word = S.mix(word)
    pair = S.mix(word[:-1] * U(3) + word[1:])
    triple = S.mix(pair[:-1] * U(5) + word[2:])
    bare = np.array(_words.bare, dtype=U)[numbers]
    kinds = [(word, owner), (pair, np.where(owner[:-1] == owner[1:], owner[1:], -1)), (triple, np.where(owner[:-2] == owner[2:], owner[2:], -1)), (S.mix(bare), np.where(bare > 0, owner[inner], -1))]
    hashed, of = (np.concatenate(x) for x in zip(*kinds))
    keys = np.sort((of << BITS | (hashed & U(DIMENSIONS - 1)).astype(np.int64))[of >= 0])
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]  # far faster than numpy's unique
    return keys & (DIMENSIONS - 1), np.searchsorted(keys, np.arange(len(some) + 1) << BITS)


@dataclass
class Ordinal:
    """A cumulative-link model: weights of the features, increasing thresholds between the grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, index: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The expected grade of each row of a sparse 0/1 matrix; every row has a feature."""
        score = np.add.reduceat(self.weights[index], start[:-1]) if len(start) > 1 else np.zeros(0)
        return (1 / (1 + np.exp(np.clip(self.thresholds[:, None] - score, -30, 30)))).sum(axis=0)


def fit(index: np.ndarray, start: np.ndarray, grade: np.ndarray, weight: np.ndarray, penalty: float) -> Ordinal:
    """The regularised maximum-likelihood fit by Adam on all rows; grades 0 .. 2."""
    w, low, gap = np.zeros(DIMENSIONS), 2.0, -1.0  # the thresholds are low and low + exp(gap): increasing by construction
    moments = [np.zeros(DIMENSIONS + 2), np.zeros(DIMENSIONS + 2)]
    lengths, total = np.diff(start), weight.sum()
    row = np.repeat(np.arange(len(lengths)), lengths)
    for step in range(1, STEPS + 1):
        score = np.add.reduceat(w[index], start[:-1])
        width = np.exp(gap)
        t = np.array([low, low + width])
        at = 1 / (1 + np.exp(-np.clip(t[:, None] - score, -30, 30)))  # P(grade <= 0), P(grade <= 1)
        edges = np.vstack((np.zeros(len(score)), at, np.ones(len(score))))
        slope = np.vstack((np.zeros(len(score)), at * (1 - at), np.zeros(len(score))))
        every = np.arange(len(score))
        p = np.maximum(edges[grade + 1, every] - edges[grade, every], 1e-9)
        upper, lower = slope[grade + 1, every] / p * weight, slope[grade, every] / p * weight
        by_score = upper - lower  # derivative of -log likelihood by the score
        by_t = np.array([(lower * (grade == 1)).sum() - (upper * (grade == 0)).sum(), (lower * (grade == 2)).sum() - (upper * (grade == 1)).sum()])
        gradient = np.concatenate((np.bincount(index, weights=by_score[row], minlength=DIMENSIONS) / total + penalty / total * w, [by_t.sum() / total, by_t[1] * width / total]))
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.999 * moments[1] + 0.001 * gradient**2
        move = RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        w, low, gap = w - move[:-2], low - move[-2], gap - move[-1]
    return Ordinal(w, np.array([low, low + np.exp(gap)]))


def train(texts: list[str], grades: list[int]) -> Ordinal:
    """Fits the model to documents and their grades; without documents of both kinds nothing is ever abusive."""
    place: dict[str, int] = {}
    of: list[np.ndarray] = []
    for text in texts:
        mine = []
        for s in sentences(text):
            key = re.sub(r"[0-9]+", "0", s)
            mine.append(place.setdefault(key, len(place)))
        of.append(np.unique(np.array(mine, dtype=np.int64)))
    grade = np.array(grades, dtype=np.int64)
    if not place or not (grade == 0).any() or not (grade > 0).any():
        return Ordinal(np.zeros(DIMENSIONS), np.array([20.0, 21.0]))
    index, start = features(list(place))
    flat, owner = np.concatenate(of), np.repeat(np.arange(len(of)), [len(x) for x in of])
    # the first guess of a sentence's severity: how much rarer its features are in documents of grade 0
    bad = grade[owner] > 0
    with_bad = np.bincount(flat, weights=bad, minlength=len(place))
    with_good = np.bincount(flat, weights=~bad, minlength=len(place))
    lengths = np.diff(start)
    f_bad = np.bincount(index, weights=np.repeat(with_bad, lengths), minlength=DIMENSIONS)
    f_good = np.bincount(index, weights=np.repeat(with_good, lengths), minlength=DIMENSIONS)
    odds = np.log((f_bad + 0.05) / (f_bad.sum() + 1)) - np.log((f_good + 0.5) / (f_good.sum() + 1))
    guess = np.add.reduceat(np.where(f_bad + f_good > 0, odds, 0)[index], start[:-1]) / np.sqrt(lengths)
    penalty = min(PENALTY, max(LEAST_PENALTY, PENALTY_SHARE * int((grade > 0).sum())))
    model = None
    for turn in range(ROUNDS):
        carried: dict[tuple[int, int], float] = {}
        for k, mine in enumerate(of):
            if not len(mine):
                continue
            worst = guess[mine].max()
            if turn and (worst < DOUBTFUL if grade[k] else worst > 2 - DOUBTFUL):
                continue  # contradicted by the others' judgements: taken as wrong
            if grade[k] == 0:
                for s in mine.tolist():
                    carried[s, 0] = carried.get((s, 0), 0.0) + 1.0
            else:
                s = int(mine[np.argmax(guess[mine])])
                carried[s, int(grade[k])] = carried.get((s, int(grade[k])), 0.0) + 1.0
        which = np.array([s for s, _ in carried], dtype=np.int64)
        target = np.array([g for _, g in carried], dtype=np.int64)
        weight = np.sqrt(np.array(list(carried.values())))
        spans = [index[start[s] : start[s + 1]] for s in which.tolist()]
        model = fit(np.concatenate(spans), np.concatenate(([0], np.cumsum([len(x) for x in spans]))), target, weight, penalty)
        guess = model.severity(index, start)
    return model


def grades(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 if all judgements are 0, 2 if all are 1, 1 if both occur; null judgements count for nothing."""
    judged = labels.where("doc_id is not null and abusive in (0, 1)").groupBy("doc_id").agg(F.min("abusive").alias("low"), F.max("abusive").alias("high"))
    return judged.select("doc_id", (F.col("low") + F.col("high")).cast("int").alias("grade"))


def learn(documents: DataFrame, labels: DataFrame) -> Ordinal:
    """The model of the labelled documents, of at most about LABELLED of them."""
    graded = grades(labels)
    share = graded.count() / LABELLED
    if share > 1:
        graded = graded.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) / share))
    texts = documents.where("text is not null").select("doc_id", "text")
    known = texts.join(F.broadcast(graded), "doc_id").select("doc_id", "text", "grade").toArrow().sort_by("doc_id")
    return train(known.column("text").to_pylist(), known.column("grade").to_pylist())


def _score(held):
    """Each distinct sentence of a batch, and one of those scored lately, is scored once."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Ordinal = held.value
        known: dict[str, float] = {}
        for batch in rows:
            for begin in range(0, len(batch), DOCUMENTS):
                part = batch.slice(begin, DOCUMENTS)
                if len(known) > KNOWN:
                    known.clear()
                texts = [sentences(text) for text in part.column(2).to_pylist()]
                fresh = list({s: None for mine in texts for s in mine if s not in known})
                for first in range(0, len(fresh), SENTENCES):
                    some = fresh[first : first + SENTENCES]
                    known.update(zip(some, model.severity(*features(some)).tolist()))
                values = [[known[s] for s in mine] for mine in texts]
                severity = np.array([max(x, default=0.0) for x in values])
                n = np.array([sum(v >= REPORTED for v in x) for x in values], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(severity), pa.array(n)], names=["doc_id", "source", "severity", "n_sentences"])

    return run


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, source, severity (0 to 2), n_sentences (reported ones) of every document.

    Null, empty and blank texts have severity 0. Without labels of both kinds every severity is 0 (to eight digits).
    Other columns are ignored.
    """
    held = documents.sparkSession.sparkContext.broadcast(learn(documents, labels))
    schema = "doc_id long, source string, severity double, n_sentences long"
    return documents.select("doc_id", "source", "text").mapInArrow(_score(held), schema)


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """p8_found: doc_id of the documents with a sentence whose expected severity is at least REPORTED."""
    return scores(documents, labels).where(F.col("severity") >= REPORTED).select("doc_id")


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """source, n_documents, n_reported, rate, mean_severity; a null source is its own group."""
    reported = (F.col("severity") >= REPORTED).cast("long")
    return (
        scores(documents, labels).groupBy("source")
        .agg(F.count("*").alias("n_documents"), F.sum(reported).alias("n_reported"), F.avg("severity").alias("mean_severity"))
        .withColumn("rate", F.col("n_reported") / F.col("n_documents"))
    )
