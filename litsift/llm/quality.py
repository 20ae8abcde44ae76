"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every text. The votes of all documents are
counted by pattern (at most 3 to the power of the labellers), and expectation-maximisation
over these counts estimates how often each labeller votes each way on good and on bad texts,
and the share of good ones. The patterns' posteriors then are the soft labels of a hashed
linear scorer, fitted by gradient steps on a bounded sample of distinct texts:
``FIT_ROWS``, half of them likely good and half likely bad as far as there are any. Its
features are hashed words, hashed word shapes and repeats of the word before.

A null or empty text (or one without words) has no votes, posterior and score 0, and isn't
kept. If all labellers abstain on everything, the posterior is the prior. Repeated rows are
scored one by one; a null id is carried through. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labellers that vote bad or nothing: a measure, its limit in ordinary prose, and the limit
#: from which it is a bad vote. The last labeller, ``prose``, votes good or nothing: good where
#: every measure that applies keeps to its limit in prose.
MEASURES = [
    ("symbols", 0.02, 0.06),       # bytes that are neither letters, digits, space nor plain punctuation
    ("capitals", 0.12, 0.35),      # capital letters among the letters of ASCII
    ("top_word", 0.15, 0.25),      # the most frequent word among the words (texts of 20 words or more)
    ("repeats", 0.05, 0.15),       # words equal to the one before
    ("marks", 0.03, 0.10),         # words with bars, hashes, stars and the like
    ("long_words", 0.88, 0.94),    # words of more than three bytes (texts of 20 words or more)
    ("open_lines", 0.40, 0.75),    # lines that don't end with a stop
    ("odd_words", 0.10, 0.25),     # words that aren't letters with at most one mark at the end
]
LABELLERS = [*[m[0] for m in MEASURES], "prose"]
ITERATIONS = 100
#: Rows that the scorer is fitted on, in expectation, and its features.
FIT_ROWS = 4000
FEATURES = 1 << 16
STEPS, PENALTY = 150, 1e-4
KEEP = 0.5

_SPACE, _LOWER, _UPPER, _DIGIT, _STOP, _OTHER = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[list(common.SPACES.nonzero()[0])] = _SPACE
_KIND[0x61:0x7B] = _LOWER
_KIND[0x80:] = _LOWER
_KIND[0x41:0x5B] = _UPPER
_KIND[0x30:0x3A] = _DIGIT
_KIND[list(b".,;:!?'\"()-")] = _STOP
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True


class Texts:
    """The words of a slice and what the labellers measure of each row."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray):
        self.flat, self.offsets = flat, offsets
        self.starts, self.ends, self.first = common.find_words(flat, offsets)
        self.hashes = common.word_hashes(flat, self.starts, self.ends)
        self.counts = np.diff(self.first)
        self.same = np.zeros(len(self.starts), bool)
        self.same[1:] = self.hashes[1:] == self.hashes[:-1]
        self.same[self.first[:-1][self.counts > 0]] = False

    def _bytes(self, wanted: np.ndarray) -> np.ndarray:
        return _sums(wanted, self.offsets)

    def _words(self, wanted: np.ndarray) -> np.ndarray:
        return _sums(wanted, self.first)

    def measures(self) -> np.ndarray:
        """A row of the labellers' measures for each text; not a number where one doesn't apply."""
        kind = _KIND[self.flat]
        words = np.maximum(self.counts, 1).astype(float)
        size = np.maximum(np.diff(self.offsets), 1).astype(float)
        capitals, letters = self._bytes(kind == _UPPER), self._bytes((kind == _LOWER) & (self.flat < 0x80))
        with np.errstate(invalid="ignore", divide="ignore"):
            capital_share = capitals / (capitals + letters)
        top = np.full(len(words), np.nan)
        for i in np.flatnonzero(self.counts >= 20):
            top[i] = np.unique(self.hashes[self.first[i]:self.first[i + 1]], return_counts=True)[1].max() / words[i]
        last = self.flat[self.ends - 1] if len(self.ends) else np.zeros(0, np.uint8)
        bare = self.ends - self.starts - (_KIND[last] == _STOP)
        letter = np.concatenate([[0], np.cumsum((kind == _LOWER) | (kind == _UPPER))])
        plain = letter[self.ends] - letter[self.starts] == bare
        marked = np.concatenate([[0], np.cumsum(kind == _OTHER)])
        marks = marked[self.ends] > marked[self.starts]
        # a line ends before a line feed or at the text's end; its last byte that isn't space counts
        breaks = np.zeros(len(self.starts), bool)
        if len(self.starts):
            feeds = np.concatenate([[0], np.cumsum(self.flat == 0x0A)])
            breaks[:-1] = feeds[self.starts[1:]] > feeds[self.ends[:-1]]
            breaks[self.first[1:][self.counts > 0] - 1] = True
        lines = np.maximum(self._words(breaks), 1)
        long_share = np.where(self.counts >= 20, self._words(bare > 3) / words, np.nan)
        out = np.stack([
            self._bytes(kind == _OTHER) / size, capital_share, top, self._words(self.same) / words,
            self._words(marks) / words, long_share, self._words(breaks & ~_ENDS[last]) / lines,
            self._words(~plain) / words], axis=1)
        out[self.counts == 0] = np.nan
        return out

    def features(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each text's feature numbers and values: words and shapes, each block of length 1."""
        kind = _KIND[self.flat]
        shape = np.where(kind == _OTHER, self.flat, kind)
        new = np.ones(len(shape), bool)
        new[1:] = shape[1:] != shape[:-1]
        new[self.starts] = True
        at = np.concatenate([[0], np.cumsum(new)])
        shapes = common.range_hash(shape[new].astype(np.uint64) + np.uint64(1), at[self.starts], at[self.ends])
        shapes = common.mix(shapes + self.same, 1)
        out = []
        for a, b in zip(self.first.tolist(), self.first[1:].tolist()):
            place, value = [], []
            for block, hashes in enumerate((self.hashes[a:b], shapes[a:b])):
                # half of the features are for words, half for shapes
                own, n = np.unique(hashes % np.uint64(FEATURES // 2), return_counts=True)
                place.append(own.astype(np.int64) + block * (FEATURES // 2))
                value.append(n / np.sqrt(np.sum(n * n * 1.0)) if b > a else n * 1.0)
            out.append((np.concatenate(place), np.concatenate(value)))
        return out


def _sums(wanted: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(wanted)])
    return total[cuts[1:]] - total[cuts[:-1]]


def votes(measures: np.ndarray) -> np.ndarray:
    """2 for good, 1 for bad, 0 for no vote, for each text and labeller."""
    calm, bad = (np.array([m[k] for m in MEASURES]) for k in (1, 2))
    with np.errstate(invalid="ignore"):
        cast = np.where(measures >= bad, 1, 0)
        prose = ~(measures > calm).any(1) & ~np.isnan(measures).all(1)
    return np.concatenate([cast, np.where(prose, 2, 0)[:, None]], axis=1)


_POWERS = 3 ** np.arange(len(LABELLERS))


def learn(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each vote pattern, each labeller's vote shares by class, the prior.

    The shares have the axes class (bad, good), labeller, vote. Estimates start from texts
    being good that no labeller calls bad; every share is smoothed by one vote.
    """
    if not len(patterns):
        return np.zeros(0), np.full((2, len(LABELLERS), 3), 1 / 3), 0.5
    cast = patterns[:, None] // _POWERS % 3
    posterior = np.where((cast == 1).any(1), 0.05, 0.95)
    weight = counts.astype(float)
    for _ in range(ITERATIONS):
        prior = np.clip((posterior @ weight) / weight.sum(), 0.01, 0.99)
        shares = np.empty((2, len(LABELLERS), 3))
        for k, own in enumerate((weight * (1 - posterior), weight * posterior)):
            for vote in range(3):
                shares[k, :, vote] = own @ (cast == vote) + 1
        shares /= shares.sum(2, keepdims=True)
        log = np.log(shares)
        rows = np.arange(len(LABELLERS))
        bad, good = (log[k][rows, cast].sum(1) for k in (0, 1))
        new = 1 / (1 + np.exp(np.clip(bad + np.log(1 - prior) - good - np.log(prior), -500, 500)))
        done = np.abs(new - posterior).max() < 1e-9
        posterior = new
        if done:
            break
    return posterior, shares, float(prior)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer, by full gradient steps with adaptive rates."""
    weights = np.zeros(FEATURES + 1)
    if not rows:
        return weights
    place = np.concatenate([p for p, _ in rows])
    value = np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows])
    # both classes weigh the same
    good = labels.sum()
    balance = np.where(labels >= 0.5, 0.5 / max(good, 1), 0.5 / max(len(labels) - good, 1))
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        score = np.bincount(row, weights[place] * value, len(rows)) + weights[-1]
        error = balance * (1 / (1 + np.exp(-score)) - labels)
        slope = np.append(np.bincount(place, error[row] * value, FEATURES), error.sum())
        slope[:-1] += PENALTY * weights[:-1]
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        weights -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return weights


def _voted(source: DataFrame) -> DataFrame:
    """(text hash, pattern) of every row with words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                texts = Texts(*common.raw(part.column("text")))
                pattern = (votes(texts.measures()) @ _POWERS)[texts.counts > 0]
                code, n = np.unique(pattern, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["pattern", "n"])

    return source.select("text").mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


class Scorer:
    """The fitted model: posteriors by vote pattern and the linear scorer's weights."""

    def __init__(self, posteriors: dict[int, float], shares: np.ndarray, prior: float, weights: np.ndarray):
        self.posteriors, self.shares, self.prior, self.weights = posteriors, shares, prior, weights

    def posterior(self, texts: Texts) -> np.ndarray:
        codes = votes(texts.measures()) @ _POWERS
        out = np.array([self.posteriors.get(c, self.prior) for c in codes.tolist()])
        return np.where(texts.counts > 0, out, 0.0)

    def score(self, texts: Texts) -> np.ndarray:
        # the sample holds as many good as bad texts: its even odds give way to the prior's
        bias = self.weights[-1] + np.log(self.prior / (1 - self.prior))
        total = np.array([self.weights[p] @ v for p, v in texts.features()]) + bias
        return np.where(texts.counts > 0, 1 / (1 + np.exp(-total)), 0.0)


def fit(docs: DataFrame, text_col: str = "text") -> Scorer:
    """Estimate the labellers over all rows, then fit the scorer on a sample of distinct texts."""
    spark = docs.sparkSession
    common.prepare(spark)
    source = docs.select(F.col(text_col).cast("string").alias("text")).filter(F.length("text") > 0)
    found = _voted(source).toPandas().sort_values("pattern")
    patterns, counts = found["pattern"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    posterior, shares, prior = learn(patterns, counts)
    model = Scorer(dict(zip(patterns.tolist(), posterior.tolist())), shares, prior, np.zeros(FEATURES + 1))
    if not len(patterns):
        return model
    sent = spark.sparkContext.broadcast(model)
    good = counts[posterior >= 0.5].sum()
    share = {k: min(1.0, FIT_ROWS / 2 / max(n, 1)) for k, n in ((True, good), (False, counts.sum() - good))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in common.slices(batch, "text"):
                texts = Texts(*common.raw(part.column("text")))
                label = model.posterior(texts)
                draw = part.column("draw").to_numpy()
                use = (texts.counts > 0) & (draw < np.where(label >= 0.5, share[True], share[False]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("text"), pa.array(label)], ["text", "label"]).filter(pa.array(use))

    draw = F.xxhash64("text").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    sample = source.select("text", draw.alias("draw")).mapInArrow(run, "text string, label double").groupBy("text").agg(
        F.first("label").alias("label"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                rows = Texts(*common.raw(part.column("text"))).features()
                yield pa.RecordBatch.from_arrays([
                    pa.array([p.astype(np.int32) for p, _ in rows], pa.list_(pa.int32())),
                    pa.array([v for _, v in rows], pa.list_(pa.float64())), part.column("label"),
                ], ["place", "value", "label"])

    rows = sample.mapInArrow(number, "place array<int>, value array<double>, label double").toArrow()
    pairs = [(p.values.to_numpy().astype(np.int64), v.values.to_numpy()) for p, v in zip(rows["place"], rows["value"])]
    labels = rows["label"].to_numpy()
    order = sorted(range(len(pairs)), key=lambda i: (labels[i], len(pairs[i][0]), pairs[i][0].tobytes()))
    model.weights = train([pairs[i] for i in order], labels[order])
    return model


def predict(docs: DataFrame, model: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, posterior, score, keep) of every row."""
    common.prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                texts = Texts(*common.raw(part.column("text")))
                score = sent.value.score(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(sent.value.posterior(texts)), pa.array(score),
                     pa.array(score >= KEEP)], ["id", "posterior", "score", "keep"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, posterior double, score double, keep boolean").withColumnRenamed(
        "id", id_col)


def op7_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weak label, score, and whether it is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))
