"""Toxicity by a classifier chain of linear models.

Categories are predicted in order. The model of a category is a logistic
regression over the words a document contains and the probabilities of the
categories before it; while training, those probabilities are out-of-fold
predictions, so that a later model learns from errors such as it will meet.

The chain is fitted on a bounded sample of the labelled rows (``SAMPLE``, the
smallest hashes of their ids); the word statistics that choose its vocabulary
are those of the sample, whose texts are split into words once, as in scoring.
Scoring reads every whole text once, without a shuffle.

Edges: a null or empty text has no words and scores the chain's base rates; a
label row with a null category is left out; several label rows of one id count as
the largest labels; labels of unknown ids are unused; without labels, or where a
category has one value only, its probability is that share (0.0 without rows); of
several documents of a labelled id the least text is learned from. Extra columns are
kept and unused; ``score`` puts its own columns in the place of those of their names,
``drop_toxic`` keeps every column as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table, texts_of

#: Labelled rows used at most, words used at most, folds, and how many standard errors a word's share must differ.
SAMPLE = 10_000
VOCABULARY = 4096
FOLDS = 4
MIN_Z = 5.0
ROUNDS, L2 = 150, 0.3
#: In order: category and its value (0 or 1) in a row of labels.
CATEGORIES = (("low_quality", "1 - quality"), ("toxic", "toxic"), ("unfit", "greatest(toxic, 1 - quality)"))
REJECT = "toxic"

_WORDS = re.compile(r"[^\W\d_]+")


#: Letters of a word's beginning that are a feature of their own: "abcd*" stands for longer words that begin so.
BEGINNING = 4


def words_of(text: str) -> set[str]:
    """The distinct lower-case words of a text and the beginnings of its longer words."""
    words = set(_WORDS.findall(text.lower()))
    words.update([w[:BEGINNING] + "*" for w in words if len(w) > BEGINNING])
    return words


@dataclass
class Sparse:
    """Rows of present words: row and word of each entry, and dense columns (earlier probabilities)."""

    row: np.ndarray
    word: np.ndarray
    n: int
    words: int
    dense: np.ndarray

    def take(self, rows: np.ndarray) -> Sparse:
        at = np.full(self.n, -1, np.int64)
        at[rows] = np.arange(len(rows))
        keep = at[self.row] >= 0
        return Sparse(at[self.row[keep]], self.word[keep], len(rows), self.words, self.dense[rows])

    def with_column(self, p: np.ndarray) -> Sparse:
        return Sparse(self.row, self.word, self.n, self.words, np.column_stack([self.dense, p]))


@dataclass
class Linear:
    """A logistic regression: weights of words, of earlier probabilities, and the intercept."""

    words: np.ndarray
    dense: np.ndarray
    base: float

    def margin(self, x: Sparse) -> np.ndarray:
        return np.bincount(x.row, self.words[x.word], x.n) + x.dense @ self.dense + self.base

    def predict(self, x: Sparse) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_linear(x: Sparse, y: np.ndarray) -> Linear:
    """Full-batch accelerated gradient steps, scaled by each column's weight."""
    n, k = x.n, x.dense.shape[1]
    share = float(y.mean()) if n else 0.0
    if share in (0.0, 1.0):
        return Linear(np.zeros(x.words), np.zeros(k), 40.0 if share else -40.0)
    model = Linear(np.zeros(x.words), np.zeros(k), float(np.log(share / (1 - share))))
    width = np.bincount(x.row, minlength=n).max(initial=1) + k + 1
    step_w = 4 / (np.bincount(x.word, minlength=x.words) * min(width, 12) + L2)
    step_d, step_b = 4 / ((x.dense**2).sum(0) * 12 + L2), 4 / (n * 12)
    past = [np.zeros(x.words), np.zeros(k), model.base]
    now = [model.words, model.dense, model.base]
    for t in range(ROUNDS):
        m = t / (t + 3)
        ahead = [a + m * (a - b) for a, b in zip(now, past, strict=True)]
        g = Linear(*ahead).predict(x) - y
        past = now
        now = [
            ahead[0] - step_w * (np.bincount(x.word, g[x.row], x.words) + L2 * ahead[0]),
            ahead[1] - step_d * (x.dense.T @ g + L2 * ahead[1]),
            ahead[2] - step_b * g.sum(),
        ]
    return Linear(*now)


@dataclass
class Chain:
    """A fitted chain with its vocabulary and the rejecting probability of each category."""

    names: list[str]
    vocabulary: dict[str, int]
    models: list[Linear]
    thresholds: list[float]

    def predict(self, x: Sparse) -> np.ndarray:
        columns = []
        for m in self.models:
            p = m.predict(x)
            columns.append(p)
            x = x.with_column(p)
        return np.column_stack(columns) if columns else np.zeros((x.n, 0))

    def features(self, texts: list[str]) -> Sparse:
        known, rows, words = self.vocabulary, [], []
        for i, t in enumerate(texts):
            found = [known[w] for w in words_of(t) if w in known]
            rows += [i] * len(found)
            words += sorted(found)
        return Sparse(np.array(rows, np.int64), np.array(words, np.int64), len(texts), len(known), np.zeros((len(texts), 0)))


def sparse_rows(lists: pa.ChunkedArray, words: int) -> Sparse:
    """Rows of lists of word numbers, without Python objects for the entries."""
    sizes = np.concatenate([np.zeros(0, np.int64), *[pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in lists.chunks]])
    flat = np.concatenate([np.zeros(0, np.int64), *[c.flatten().to_numpy() for c in lists.chunks]])
    return Sparse(np.repeat(np.arange(len(sizes)), sizes.astype(np.int64)), flat, len(sizes), words, np.zeros((len(sizes), 0)))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The out-of-fold probability at which F1 is largest, halfway to the next lower one.

    A half where there are no positives, or where no border has more right than wrong above it.
    """
    if not len(y) or not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit, n = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    f1 = np.where(2 * hit > n, 2 * hit / (n + y.sum()), 0)
    f1[:-1][p[order][:-1] == p[order][1:]] = 0  # no border between equal probabilities
    if not f1.any():
        return 0.5
    at = int(f1.argmax())
    below = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float((p[order][at] + below) / 2)


def fit_chain(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Chain:
    """Fit on at most ``sample`` labelled documents; only their word numbers and labels come to the driver."""
    names = [n for n, _ in categories]
    y = [F.max(F.expr(e)).cast("double").alias(f"_y{i}") for i, (_, e) in enumerate(categories)]
    chosen = labels.groupBy(F.col(key).alias("_key")).agg(*y).dropna().orderBy(F.xxhash64("_key"), "_key").limit(sample)
    texts = docs.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    first = texts.join(F.broadcast(chosen), "_key").groupBy("_key").agg(F.min("_text").alias("_text"), *[F.first(f"_y{i}").alias(f"_y{i}") for i in range(len(names))])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(words_of(t.as_py())) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(found, pa.list_(pa.string()))], names=["_key", *batch.schema.names[2:], "w"])

    kind = dict(first.dtypes)["_key"]
    rows = map_arrow(first, split, f"_key {kind}, " + ", ".join(f"_y{i} double" for i in range(len(names))) + ", w array<string>").persist()
    try:
        total = rows.agg(F.count("*"), *[F.sum(f"_y{i}") for i in range(len(names))]).first()
        n = total[0]
        said = rows.select(*[f"_y{i}" for i in range(len(names))], F.explode("w").alias("w"))
        counts = said.groupBy("w").agg(F.count("*").alias("n"), *[F.sum(f"_y{i}").alias(f"s{i}") for i in range(len(names))]).where("n >= 4")
        z = []
        for i in range(len(names)):
            share = (total[1 + i] or 0) / max(n, 1)
            z.append(F.abs(F.col(f"s{i}") - F.col("n") * share) / F.sqrt(F.col("n") * max(share * (1 - share), 1e-9)) if 0 < share < 1 else F.lit(0.0))
        best = F.greatest(*z, F.lit(0.0)).alias("z")
        picked = counts.select("w", best).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "w").limit(VOCABULARY)
        vocabulary = {r.w: i for i, r in enumerate(picked.collect())}
        chain = Chain(names, vocabulary, [], [])

        def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [sorted(vocabulary[w] for w in ws if w in vocabulary) for ws in batch.column(len(names) + 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.int32()))], names=batch.schema.names)

        data = map_arrow(rows, numbered, f"_key {kind}, " + ", ".join(f"_y{i} double" for i in range(len(names))) + ", w array<int>").toArrow().sort_by("_key")
    finally:
        rows.unpersist()
    targets = [data.column(f"_y{i}").to_numpy() for i in range(len(names))]
    x = sparse_rows(data.column("w"), len(vocabulary))
    n = x.n
    del data
    fold = np.random.default_rng(0).permutation(n) % FOLDS
    for i in range(len(names)):
        target = targets[i]
        p = np.zeros(n)
        for f in range(FOLDS):
            inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            p[outside] = fit_linear(x.take(inside), target[inside]).predict(x.take(outside))
        chain.models.append(fit_linear(x, target))
        chain.thresholds.append(best_threshold(p, target))
        x = x.with_column(p)
    return chain


def _judged(docs: DataFrame, chain: Chain, text: str) -> tuple[DataFrame, list[str]]:
    """Columns c0, c1, ... (those of ``docs``, whose names are also returned), p0, ... and d0, ... (probability and decision of each category)."""
    columns = docs.columns
    inside = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    at = columns.index(text)
    limits = np.array(chain.thresholds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = chain.predict(chain.features(texts_of(batch.column(at)).to_pylist()))
            made = [pa.array(p[:, i]) for i in range(p.shape[1])] + [pa.array(p[:, i] >= limits[i]) for i in range(p.shape[1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *[f"p{i}" for i in range(p.shape[1])], *[f"d{i}" for i in range(p.shape[1])]])

    schema = ", ".join([*[f"c{i} {k}" for i, (_, k) in enumerate(docs.dtypes)], *[f"p{i} double" for i in range(len(chain.names))], *[f"d{i} boolean" for i in range(len(chain.names))]])
    return map_arrow(inside, run, schema), columns


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """``docs`` with a probability ``p_<category>`` and a decision ``is_<category>`` of each category."""
    out, columns = _judged(docs, chain, text)
    made = {f"{m}_{n}": F.col(f"{k}{i}") for k, m in (("p", "p"), ("d", "is")) for i, n in enumerate(chain.names)}
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns) if c not in made], *[v.alias(n) for n, v in made.items()])


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the chain does not reject, with their own columns alone."""
    chain = fit_chain(docs, labels)
    out, columns = _judged(docs, chain, "text")
    return out.where(~F.col(f"d{chain.names.index(REJECT)}")).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit_chain(docs, table(spark, sf_dir, "labels"))).drop("text")
