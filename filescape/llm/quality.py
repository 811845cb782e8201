"""Quality of texts by positive-unlabelled learning.

Texts marked good are trusted positives; all other texts are unlabelled, and no text is ever
taken as bad. A text is described by what it is made of: shares of letters, digits and every
mark, how its words begin, end, repeat and vary. Each of these numbers falls into a bin, and
the score is the sum of the weights of its bins.

First two classifiers, each fitted to one half of the texts, tell positives from unlabelled
texts of the other half. Their scores of all texts estimate the class prior, the share of
good ones: above a threshold, unlabelled texts are at least the prior times the share of
positives there, and the bound is tightest at the threshold that keeps its error small. Then
the non-negative unbiased risk is minimised: prior * risk of positives as good, plus the
risk of unlabelled texts as bad less prior * the risk of positives as bad. Where this second
part, which cannot really be below zero, is, its gradient is followed upwards instead. Last,
scale and offset of the scores minimise the unbiased risk of all texts, where with two
numbers nothing can be learned by heart.

Weights are fitted on a sample of at most `sample` positives and as many unlabelled texts,
taken by a hash of id and features; prior, scale and offset cover all texts.

Positives are ids whose marks are all 1; null ids and marks count as unmarked. Null and empty
texts are scored by their features, which are all 0. Rows with equal ids are rows of their
own. Without a positive text, or without a text to learn from, every score is 0.5. An empty
table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filescape.llm.language import lettered
from filescape.llm.tables import bytes_of, lists, slices
from filescape.llm.words import mix, range_hashes, spans

SAMPLE, THRESHOLD = 10_000, 0.3
BINS, STEPS, RATE, DECAY = 8, 150, 0.05, 3.0
_PLACES, _RISK, _RIDGE = 4096, 0.1, 1e-2
_BLOCK = 1 << 20

_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASSES = 8 + len(_MARKS)
FEATURES = _CLASSES + 12


def _classes() -> np.ndarray:
    """The class of every byte as rows of a 0-1 matrix: small and capital letters, digits,
    blanks, line ends, other white space, control bytes, bytes beyond ASCII, every mark."""
    kind = np.full(256, 6)
    for number, own in enumerate((range(97, 123), range(65, 91), range(48, 58), [32], [10, 13], [9, 11, 12])):
        kind[list(own)] = number
    kind[128:] = 7
    kind[_MARKS] = 8 + np.arange(len(_MARKS))
    return np.eye(_CLASSES)[kind]


_BYTES = _classes()
_LAST = np.full(256, 2)
_LAST[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 0
_LAST[list(b".,;:?")] = 1


def text_features(texts: pa.Array) -> np.ndarray:
    """A row of numbers for every whole text."""
    raw, bounds = bytes_of(texts)
    size = np.diff(bounds)
    held = np.zeros((len(size), 256))
    for row, (low, high) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
        for at in range(low, high, _BLOCK):
            held[row] += np.bincount(raw[at : min(at + _BLOCK, high)], minlength=256)
    shares = np.sqrt(held @ _BYTES / np.maximum(size, 1)[:, None])
    data, starts, ends, counts = spans(texts)
    row = np.repeat(np.arange(len(counts)), counts)
    n = np.maximum(counts, 1)
    mean = lambda values: np.bincount(row, values, len(counts)) / n
    length = ends - starts
    last = _LAST[data[ends - 1]] if len(ends) else np.zeros(0, int)
    first = data[starts] if len(starts) else np.zeros(0, np.uint8)
    keys = range_hashes(data, starts, ends)
    again = np.zeros(len(keys), bool)
    again[1:] = (keys[1:] == keys[:-1]) & (row[1:] == row[:-1])
    line = np.sort((row.astype(np.uint64) << np.uint64(32)) | (mix(keys) >> np.uint64(32)))
    fresh = np.ones(len(line), bool)
    fresh[1:] = line[1:] != line[:-1]
    kinds = np.bincount((line[fresh] >> np.uint64(32)).astype(np.int64), minlength=len(counts))
    middle = mean(length)
    about = [
        np.log1p(counts), middle, np.sqrt(np.maximum(mean(length.astype(float) ** 2) - middle**2, 0)),
        mean((first >= 65) & (first <= 90)), mean(first >= 128), mean(last == 0), mean(last == 1), mean(last == 2),
        mean(~lettered(data, starts, ends)), mean(again), kinds / n, np.log1p(kinds) / np.log1p(n),
    ]
    return np.concatenate([shares, np.stack(about, axis=1)], axis=1).astype(np.float32)


class Model:
    """Weights of the bins of every feature."""

    def __init__(self, rows: np.ndarray):
        levels = np.arange(1, BINS) / BINS
        self.edges = [np.unique(np.quantile(column, levels)) for column in rows.T]
        self.weights = np.zeros(rows.shape[1] * BINS)
        self.bias = 0.0

    def bins(self, rows: np.ndarray) -> np.ndarray:
        """The place in `weights` of every feature."""
        found = [np.searchsorted(edges, column) + BINS * i for i, (edges, column) in enumerate(zip(self.edges, rows.T))]
        return np.stack(found, axis=1)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return self.weights[bins].sum(axis=1) + self.bias

    def descend(self, samples: list[np.ndarray], slopes, steps: int = STEPS, rate: float = RATE) -> None:
        """Adam on all of `samples` (bins of rows), weights held small the more the fewer rows
        the first has. `slopes` turns their margins into the derivatives of the loss."""
        size, decay = len(self.weights), DECAY / len(samples[0])
        flat = np.concatenate([s.ravel() for s in samples])
        past, square = np.zeros(size + 1), np.zeros(size + 1)
        for step in range(1, steps + 1):
            slope = np.concatenate(slopes([self.margins(s) for s in samples]))
            change = np.append(np.bincount(flat, np.repeat(slope, samples[0].shape[1]), size) + decay * self.weights, slope.sum())
            past = 0.9 * past + 0.1 * change
            square = 0.999 * square + 0.001 * change * change
            move = rate * (past / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
            self.weights -= move[:-1]
            self.bias -= move[-1]


def sigmoid(values: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * values))


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """(risk of positives as good, risk of all texts as bad without what positives add) of
    margins, by logistic loss; the second may fall below zero, the true one cannot."""
    good = prior * np.logaddexp(0, -positive).mean()
    bad = np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, positive).mean()
    return float(good), float(bad)


def risk_slopes(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> list[np.ndarray]:
    """Derivatives that lead to a smaller non-negative risk, for every margin."""
    as_bad = [-prior * sigmoid(positive) / len(positive), sigmoid(unlabelled) / len(unlabelled)]
    if risk(positive, unlabelled, prior)[1] < 0:
        return [-slope for slope in as_bad]
    return [as_bad[0] - prior * sigmoid(-positive) / len(positive), as_bad[1]]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """The model of least non-negative risk."""
    model = Model(unlabelled)
    model.descend([model.bins(positive), model.bins(unlabelled)], lambda m: risk_slopes(*m, prior))
    return model


def fit_contrast(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """A model that tells positives from unlabelled texts."""
    model = Model(unlabelled)
    slopes = lambda m: [-sigmoid(-m[0]) / len(m[0]), sigmoid(m[1]) / len(m[1])]
    model.descend([model.bins(positive), model.bins(unlabelled)], slopes, 2 * STEPS // 3)
    return model


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of good texts, from the numbers of texts by falling contrast score.

    Of all thresholds the one with the least upper bound of the ratio is taken; the bound
    allows for the sampling error of both shares.
    """
    p, u = np.cumsum(positive) / positive.sum(), np.cumsum(unlabelled) / unlabelled.sum()
    error = sum(math.sqrt(math.log(4 / _RISK) / (2 * counts.sum())) for counts in (positive, unlabelled))
    some = np.flatnonzero(p > 0)
    best = some[np.argmin((u[some] + error) / p[some])]
    return float(min(u[best] / p[best], 1.0))


def calibrate(margins: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """(scale, offset) of margins with the least unbiased risk, by Newton's method on numbers
    of texts per margin. By logistic loss the risk is convex; a small ridge keeps texts that
    are told apart without error from growing the scale without end."""
    p, u = positive / positive.sum(), unlabelled / unlabelled.sum()
    found, target = np.array([1.0, 0.0]), prior * np.array([p @ margins, 1.0])
    line = np.stack([margins, np.ones(len(margins))])
    for _ in range(100):
        chance = sigmoid(found @ line)
        slope = line @ (u * chance) - target + _RIDGE * np.array([found[0] - 1, 0.0])
        bend = (line * (u * chance * (1 - chance))) @ line.T + np.diag([_RIDGE, 1e-4])
        step = np.linalg.solve(bend, slope)
        found = found - step * min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return max(float(found[0]), _RIDGE), float(found[1])


def described(documents: DataFrame, held_out: Column, doc="doc_id", text="text") -> DataFrame:
    """(doc_id, held_out, features) of every row."""
    kind = documents.schema[doc].dataType.simpleString()
    rows = documents.select(F.col(doc).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = text_features(part.column("text"))
                arrays = [part.column("doc_id"), part.column("held_out"), lists(found.ravel(), np.full(len(found), FEATURES), pa.float32())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "features"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, features array<float>")


def _drawn(rows: DataFrame, sample: int) -> np.ndarray:
    """Features of at most `sample` rows, the same ones at every run."""
    count = rows.count()
    place = F.pmod(F.xxhash64("doc_id", "features"), F.lit(1 << 30)) / float(1 << 30)
    near = rows.select(place.alias("at"), "features").filter(F.col("at") < min(1.0, 2.0 * sample / max(count, 1)))
    found = near.orderBy("at", "features").limit(sample).toArrow().column("features").combine_chunks()
    return found.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def _tally(rows: DataFrame, place) -> np.ndarray:
    """How many rows have each place, which `place` takes from their halves and features."""
    shared = rows.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_PLACES, np.int64)
        for batch in batches:
            counts += np.bincount(shared.value(batch.column("half").to_numpy(), _matrix(batch)), minlength=_PLACES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_PLACES)), pa.array(counts)], ["place", "n"])

    found = np.zeros(_PLACES)
    counted = rows.select("half", "features").mapInArrow(run, "place bigint, n bigint").where("n > 0")
    for at, count in counted.groupBy("place").agg(F.sum("n")).collect():
        found[at] = count
    shared.unpersist()
    return found


class _Contrast:
    """Places by falling contrast score; a half is scored by the other's model."""

    def __init__(self, models: list[Model]):
        self.models = models

    def __call__(self, half: np.ndarray, rows: np.ndarray) -> np.ndarray:
        score = np.zeros(len(rows))
        for own, model in enumerate(self.models):
            some = half != own
            score[some] = sigmoid(model.margins(model.bins(rows[some])))
        return np.minimum(((1 - score) * _PLACES).astype(np.int64), _PLACES - 1)


class _Margin:
    """Places by margin, between the smallest and the largest of a sample."""

    def __init__(self, model: Model, rows: np.ndarray):
        margins = model.margins(model.bins(rows))
        self.model, self.low = model, float(margins.min())
        self.step = max(float(margins.max() - margins.min()), 1e-6) / (_PLACES - 1)

    def __call__(self, half: np.ndarray, rows: np.ndarray) -> np.ndarray:
        at = (self.model.margins(self.model.bins(rows)) - self.low) / self.step
        return np.clip(np.round(at), 0, _PLACES - 1).astype(np.int64)

    def margins(self) -> np.ndarray:
        return self.low + self.step * np.arange(_PLACES)


def learn(rows: DataFrame, labels: DataFrame, cut, doc="doc_id", mark="quality", sample: int = SAMPLE) -> tuple[Model | None, float | None]:
    """(model, class prior) from the rows of `described` that are not held out."""
    trusted = labels.filter(F.col(doc).isNotNull()).groupBy(F.col(doc).alias("doc_id")).agg(
        F.min(F.coalesce(F.col(mark) == 1, F.lit(False))).alias("good")
    ).filter("good").select("doc_id")
    # texts with equal features are in one half, so copies do not tell a model its own texts
    unlabelled = rows.filter("not held_out").withColumn("half", F.pmod(F.xxhash64("features"), F.lit(2)).cast("int"))
    positives = cut(unlabelled.join(trusted, "doc_id", "left_semi"))
    samples = [[_drawn(kind.filter(f"half = {half}"), sample // 2) for kind in (positives, unlabelled)] for half in (0, 1)]
    good, some = (np.concatenate([samples[half][kind] for half in (0, 1)]) for kind in (0, 1))
    if not len(good):
        return None, None
    halves = [fit_contrast(*(own if all(map(len, own)) else (good, some))) for own in samples]
    contrast = _Contrast(halves)
    prior = class_prior(_tally(positives, contrast), _tally(unlabelled, contrast))
    model = fit(good, some, prior)
    place = _Margin(model, some)
    scale, offset = calibrate(place.margins(), _tally(positives, place), _tally(unlabelled, place), prior)
    model.weights, model.bias = model.weights * scale, model.bias * scale + offset
    return model, prior


def score_quality(documents: DataFrame, labels: DataFrame, held_out: Column, cut, doc="doc_id", text="text", mark="quality",
                  sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row; `cut` writes a frame that is read again."""
    rows = cut(described(documents, held_out, doc, text))
    model, _ = learn(rows, labels, cut, doc, mark, sample)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = _matrix(batch)
            score = np.full(len(found), 0.5) if known is None else sigmoid(known.margins(known.bins(found)))
            predicted = pa.array((score >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), predicted], ["doc_id", "held_out", "score", "predicted"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
