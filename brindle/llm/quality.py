"""Text quality by naive Bayes support vectors (Wang and Manning 2012).

Features are indicators of hashed n-grams: three-byte grams, and runs of two and three word shapes (case,
digits, signs around, repetition of the word before), so both spelling and layout are seen. Class counts
of every indicator are summed over all labelled training rows; the log of their ratio scales the
indicators, and a linear machine with hinge loss is fitted by dual coordinate descent on a sample of about
``sample`` labelled rows, drawn by a hash of the id. Its margins, from folds that did not see the row, are turned
into probabilities by a logistic curve.

Defined results: a null or empty text has no features and scores by the constant alone; labels that are
null, not 0 or 1, or without a document are not learned from; an id with several label rows counts once
for each; without both labels every score is 0.5; repeated rows are scored each; a very long text is one set of indicators, gathered in
pieces of PIECE bytes; rows that share an id are drawn for the fit together, so their order does not matter; empty input gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brindle.llm.linear import hinge_fit, logistic_scale
from brindle.llm.tables import stage, workers_import
from brindle.llm.words import buffer, chained, mix, words

BITS = 16
SLICE, PIECE = 500, 1_000_000
_U = np.uint64

# byte classes: 0 space, 1 lower, 2 upper, 3 digit, 4 other letter (beyond ASCII), 5 and more signs
_CLASS = np.full(256, 5, np.uint8)
_CLASS[[0x20, *range(9, 14)]] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4


def _shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shape of every word, first word per text: first and last byte class, sign, longer than one, same as the one before."""
    hashes, ends, first = words(data, offsets)
    if not len(hashes):
        return hashes, first
    full = np.concatenate([[False], _CLASS[data] > 0])
    opens = full[1:] & ~full[:-1]
    opens[offsets[:-1][(offsets[:-1] < offsets[1:])]] = True
    begins = np.flatnonzero(opens & (_CLASS[data] > 0))
    a, z = data[begins], data[ends - 1]
    sign = np.where(_CLASS[z] == 5, z, 0).astype(np.uint64)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[first[:-1][first[:-1] < len(hashes)]] = False
    second = _CLASS[data[np.minimum(begins + 1, ends - 1)]]
    shape = (_CLASS[a].astype(np.uint64) | second.astype(np.uint64) << _U(3) | _CLASS[z].astype(np.uint64) << _U(6) | sign << _U(9)
             | same.astype(np.uint64) << _U(17) | (ends - begins == 1).astype(np.uint64) << _U(18))
    return shape, first


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of every text, one text after the other, and the n + 1 bounds of the texts."""
    data, offsets = buffer(texts)
    n = len(offsets) - 1
    keys = []
    owner_of = lambda at: (np.searchsorted(offsets, at, side="right") - 1).astype(np.uint64)
    for a in range(0, len(data), PIECE):
        part = data[a:a + PIECE + 2].astype(np.uint64)
        if len(part) > 2:
            gram = (part[:-2] << _U(16) | part[1:-1] << _U(8) | part[2:]) * BASE_GRAM >> _U(64 - BITS)
            at = np.arange(a, a + len(gram))
            who = owner_of(at)
            inside = at + 2 < offsets[who.astype(np.int64) + 1]
            keys.append(np.unique((who << _U(BITS) | gram)[inside]))
    shape, first = _shapes(data, offsets)
    word_owner = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
    for size in (2, 3):
        runs = chained(shape, size)
        if len(runs):
            whole = word_owner[:len(runs)] == word_owner[size - 1:]
            keys.append(np.unique((word_owner[:len(runs)] << _U(BITS) | mix(runs + _U(size)) >> _U(64 - BITS))[whole]))
    every = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    return (every & _U((1 << BITS) - 1)).astype(np.int64), np.searchsorted(every >> _U(BITS), np.arange(n + 1, dtype=np.uint64))


BASE_GRAM = _U(0x9E3779B97F4A7C15)


def _featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            some = batch.slice(at, SLICE)
            f, bounds = features(some.column(2))
            sets = [f[a:b].astype(np.uint16).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(sets, pa.binary())], names=["label", "drawn", "features"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with each feature in either class, summed over a partition: as many rows as features at most."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for label, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[label, np.frombuffer(f, np.uint16)] += 1
    seen = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[0, seen]), pa.array(counts[1, seen])], names=["feature", "zero", "one"])


class Scorer:
    """Weights of a text's indicators and the curve from margins to probabilities."""

    def __init__(self, ratio: np.ndarray, rows: list[tuple[int, np.ndarray]], folds: int = 3):
        self.ratio = ratio
        y = np.array([1.0 if label else -1.0 for label, _ in rows])
        values = [self._values(f) for _, f in rows]
        columns = [f for _, f in rows]
        # both classes weigh the same in the fit; the curve brings back how frequent they are
        cost = np.where(y > 0, 1 / max((y > 0).mean(), 1e-9), 1 / max((y < 0).mean(), 1e-9)) / 2
        margins = np.zeros(len(y))
        for fold in range(folds):
            rest, here = np.flatnonzero(np.arange(len(y)) % folds != fold), np.flatnonzero(np.arange(len(y)) % folds == fold)
            w = hinge_fit([columns[i] for i in rest], [values[i] for i in rest], y[rest], 1 << BITS, cost=cost[rest], epochs=10)
            for i in here:
                margins[i] = w[columns[i]] @ values[i] + w[-1]
        self.weights = hinge_fit(columns, values, y, 1 << BITS, cost=cost, epochs=10)
        self.slope, self.offset = logistic_scale(margins, y > 0)

    def _values(self, f: np.ndarray) -> np.ndarray:
        r = self.ratio[f]
        return r / max(float(np.sqrt(r @ r)), 1e-9) * 4.0

    def score(self, f: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        margins = np.full(len(bounds) - 1, self.weights[-1])
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            if b > a:
                margins[i] += self.weights[f[a:b]] @ self._values(f[a:b])
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -30, 30)))


def _scored(scorer: Scorer | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                score = scorer.score(*features(some.column(2))) if scorer else np.full(some.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                                                 names=["id", "held_out", "score", "predicted"])
    return run


def fit(docs: DataFrame, labels: DataFrame, *, key: str, text: str, label: str, sample: int) -> Scorer | None:
    marked = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("lid"), F.col(label).cast("int").alias("label"))
    number = marked.count()
    drawn = F.pmod(F.xxhash64("lid", F.lit("quality sample")), F.lit(1 << 40)) < F.lit(int(min(1.0, sample / max(number, 1)) * (1 << 40)))
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("body"))
    # the labels grow with the corpus, so texts meet them in a sorted merge at every size
    found = stage(rows.join(marked.hint("merge"), rows["id"] == marked["lid"]).select("label", drawn.alias("drawn"), "body")
                  .mapInArrow(_featurised, "label int, drawn boolean, features binary"), "quality-features")
    counts = (found.select("label", "features").mapInArrow(_counted, "feature long, zero long, one long")
              .groupBy("feature").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")).collect())
    fitted = sorted((r["label"], bytes(r["features"])) for r in found.where("drawn").select("label", "features").collect())
    if len({y for y, _ in fitted}) < 2:
        return None
    totals = {y: n for y, n in ((r["label"], r["count"]) for r in found.groupBy("label").count().collect())}
    seen = np.ones((2, 1 << BITS))
    for r in counts:
        seen[:, r["feature"]] += r["zero"], r["one"]
    ratio = np.log(seen[1] / (totals[1] + 2)) - np.log(seen[0] / (totals[0] + 2))
    order = np.random.default_rng(3).permutation(len(fitted))
    return Scorer(ratio, [(fitted[i][0], np.frombuffer(fitted[i][1], np.uint16).astype(np.int64)) for i in order])


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column, *, key: str = "doc_id", text: str = "text", label: str = "quality",
                  sample: int = 8000, threshold: float = 0.3) -> DataFrame:
    """One row per document: key, held_out, score (higher: label 1 likelier), predicted (score >= threshold)."""
    workers_import(docs.sparkSession)
    held = F.coalesce(held_out, F.lit(False))
    scorer = fit(docs.where(~held), labels, key=key, text=text, label=label, sample=sample)
    rows = docs.select(F.col(key).cast("long").alias("id"), held.alias("held_out"), F.col(text).cast("string").alias("body"))
    return rows.mapInArrow(_scored(scorer, threshold), "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", key)
