"""Cross-fitting: the recipes, statistics and fits of all folds together.

*Recipes.* One aggregate by term holds each fold's term and document counts; a fold's recipe is
fitted on the other folds, so its counts are the totals less its own.

*Rows.* Each training row is kept as its counts over the union of all vocabularies, with its fold. A
pass builds a row's features under every recipe that it trains in the task: term frequencies are
relative to a recipe's own vocabulary, so they can't be had from another recipe's by subtraction.

*Moments.* One pass sums, for each recipe and class, rows, features and products of features. Linear
discriminant, partial least squares, naive Bayes, the null model and the scales of the
penalised fits follow from these sums.

*Penalised fits.* Every problem (fold x model, and the inner folds of the support vector machine)
is a column of one pass, which sums its loss, gradient and Hessian. The task that adds up a problem's sums
solves for its proximal Newton step (the vocabulary bounds its size), so the driver gets vectors only, and the
next pass evaluates all of them; a problem that has converged is left out. The hinge loss has no second derivative, so its
problems are solved by an interior-point method in some forty steps whatever the rows: one pass sums for a step, the next finds
how far it can go. A row's slacks and multipliers are not kept: a pass makes them again from the steps taken so far.

The sums are at most half of 500 x 500 numbers for each problem: a task sends the triangle of a Hessian, or the rows that
it is made of where these are fewer. Sums of more than 64 tasks
are added in two levels, so no task holds more than about the root of all tasks' sums of one problem.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litsift.models.features import FittedFeaturizer, add_tokens
from litsift.operators.prefix import global_row_number
from litsift.operators.sampling import seeded_hash
from litsift.operators.terms import MAX_TOKENS
from litsift.session import ensure_checkpoint_dir, ship_package

#: The recipe and the fits on all training rows.
WHOLE = 0
INNER_FOLDS, INNER_SEED = 3, 7
#: Rows that are made dense at once, and rows for each task of a pass.
CHUNK, TASK_ROWS = 1024, 512
#: Steps at which the loss along a direction is summed besides the full one.
STEPS = 0.5 ** np.arange(20)
#: Objective decrease that a step must promise for a problem to go on.
TOLERANCE = 1e-10
#: Of the interior-point steps: the gap between a solution and a bound on it at which they end, the slack and multiplier of a
#: row at the start, the shares of the mean complementarity that are aimed at, the lengths that are tried, and how much of the way to the boundary.
GAP, START, SHARES, LENGTHS, REACH = 1e-13, (2.0, 0.5), (0.0, 0.001, 0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.7), 0.98 ** np.arange(500), 0.995
#: Tasks whose sums one task adds up; the sums of more are added in two levels.
ONE_LEVEL = 64


# ------------------------------------------------------------------ folds and recipes


def fold_bounds(train: DataFrame, v: int) -> list[tuple[str, str]]:
    """The last (h, class) of folds 1 to v - 1 when the rows in that order are cut into v near-equal parts.

    Only these two columns are put in order. Rows that agree in both stay together.
    """
    numbered = global_row_number(train.select("h", "class"), [F.col("h"), F.col("class")], name="rn")
    n = train.count()
    ends, end = [], 0
    for k in range(v - 1):
        end += n // v + (k < n % v)
        ends.append(end)
    found = {r.rn: (r.h, r["class"]) for r in numbered.filter(F.col("rn").isin(ends)).collect()}
    return [found[e] for e in ends if e in found]


def _fold_of(bounds: list[tuple[str, str]]) -> Column:
    fold = F.lit(len(bounds) + 1)
    for k in range(len(bounds), 0, -1):
        end, last = bounds[k - 1]
        fold = F.when((F.col("h") < end) | ((F.col("h") == end) & (F.col("class") <= last)), F.lit(k)).otherwise(fold)
    return fold


@dataclass
class Recipe:
    """The vocabulary and idf of one set of training rows, and its columns in the union of all vocabularies."""
    vocab: list[str]
    idf: np.ndarray
    n_docs: int
    columns: np.ndarray

    def featurizer(self) -> FittedFeaturizer:
        return FittedFeaturizer(self.vocab, self.idf.tolist())

    def features(self, counts: np.ndarray) -> np.ndarray:
        own = counts[:, self.columns]
        size = own.sum(1)
        return own * (self.idf / np.where(size > 0, size, 1.0)[:, None])


def recipes(tokens: DataFrame, folds: list[int], max_tokens: int = MAX_TOKENS) -> tuple[dict[int, Recipe], list[str]]:
    """The recipe without each of ``folds`` (and of all rows, ``WHOLE``) of (fold, tokens), and all their terms."""
    docs = {r.fold: r.n for r in tokens.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    each = tokens.select("fold", F.inline(F.concat(
        F.transform("tokens", lambda t: F.struct(t.alias("term"), one.alias("n"), none.alias("d"))),
        F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("term"), none.alias("n"), one.alias("d"))))))
    sums = each.groupBy("term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), *[
        F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(none)).alias(f"{c}_{k}") for k in folds for c in "nd"])
    sets = [F.struct(F.lit(WHOLE).alias("fold"), F.col("n"), F.col("d"))]
    sets += [F.struct(F.lit(k).alias("fold"), (F.col("n") - F.col(f"n_{k}")).alias("n"),
                      (F.col("d") - F.col(f"d_{k}")).alias("d")) for k in folds]
    ranked = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("n"), F.asc("term")))
    top = sums.select("term", F.inline(F.array(*sets))).filter("n > 0").withColumn("rank", ranked) \
        .filter(F.col("rank") <= max_tokens).orderBy("fold", "rank").collect()
    union = sorted({r.term for r in top})
    place = {t: i for i, t in enumerate(union)}
    out = {}
    for k in [WHOLE, *folds]:
        own = [r for r in top if r.fold == k]
        n = sum(docs.values()) - docs.get(k, 0)
        out[k] = Recipe([r.term for r in own], np.array([math.log(1.0 + n / r.d) for r in own]), n,
                        np.array([place[r.term] for r in own], np.int64))
    return out, union


# ------------------------------------------------------------------ passes over the rows


def fit_tasks(spark: SparkSession, rows: int) -> int:
    """Tasks of a pass over so many rows: every task sends sums as large as the model, however few its rows are."""
    return max(1, min(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


class Design:
    """The training rows of all folds and the recipes that they are seen under.

    Rows that have ``tokens`` are not analysed again, and not kept a second time if the caller keeps them.
    """

    def __init__(self, train: DataFrame, v: int = 5, seed: int = 42, stem: bool = True):
        spark = self.spark = train.sparkSession
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        inner = F.abs(F.xxhash64(F.col("pmid"), F.lit(INNER_SEED))) % INNER_FOLDS
        given = "tokens" in train.columns
        cols = train.select("pmid", "class", "label", seeded_hash("pmid", seed).alias("h"),
                            inner.cast("int").alias("inner"), "tokens" if given else "abstract")
        self._held = cols if given else add_tokens(cols, stem=stem).drop("abstract")
        level = train.storageLevel
        self._own = not (given and (level.useMemory or level.useDisk))
        if self._own:
            self._held = self._held.persist(StorageLevel.MEMORY_AND_DISK)
        fold = _fold_of(fold_bounds(self._held, v)) if v else F.lit(WHOLE + 1)
        self.tokens = self._held.withColumn("fold", fold).drop("h")
        self.folds = list(range(1, v + 1))
        self.recipes, union = recipes(self.tokens, self.folds)
        self.width = len(union)
        n = self.recipes[WHOLE].n_docs
        self.tasks = fit_tasks(spark, n)
        rows = self.tokens.select("pmid", "class", "label", "fold", "inner", "tokens")
        if union:
            counted = CountVectorizerModel.from_vocabulary(union, inputCol="tokens", outputCol="counts").transform(rows)
            rows = counted.withColumn("counts", F.unwrap_udt("counts"))
            rows = rows.select("pmid", "class", "label", "fold", "inner", F.col("counts.indices").alias("term"),
                               F.col("counts.values").alias("n"))
        else:
            rows = rows.select("pmid", "class", "label", "fold", "inner", F.array().cast("array<int>").alias("term"),
                               F.array().cast("array<double>").alias("n"))
        self.rows = rows.repartition(self.tasks).persist(StorageLevel.MEMORY_AND_DISK)

    def release(self) -> None:
        self.rows.unpersist()
        if self._own:
            self._held.unpersist()

    def summed(self, each: Callable[["Chunk", dict], None],
               finish: Callable[[int, np.ndarray], np.ndarray] | None = None) -> dict[int, np.ndarray]:
        """The sums by key that ``each`` adds to for every chunk of rows (``add(sums, key, array)``).

        With ``finish``, what it makes of a key's sum in the task that has added it up.
        """
        width, own = self.width, self.spark.sparkContext.broadcast(self.recipes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, Total] = {}
            for batch in batches:
                for a in range(0, batch.num_rows, CHUNK):
                    each(Chunk(batch.slice(a, CHUNK), width, own.value), sums)
            for key, total in sums.items():
                yield from total.table(key).to_batches()

        def add_up(table: pa.Table) -> pa.Table:
            return _added(table).table(table.column("key")[0].as_py())

        def last(table: pa.Table) -> pa.Table:
            key, value = table.column("key")[0].as_py(), _added(table).whole()
            value = finish(key, value) if finish else value
            return pa.table({"key": pa.array([key], pa.int32()), "value": pa.array([value.tobytes()], pa.binary())})

        schema = "key int, plain binary, rows binary, triangle binary, size int"
        parts = self.rows.select("label", "fold", "inner", "term", "n").mapInArrow(run, schema)
        if self.tasks > ONE_LEVEL:
            group = F.pmod(F.spark_partition_id(), F.lit(math.isqrt(self.tasks)))
            parts = parts.withColumn("part", group).groupBy("key", "part").applyInArrow(
                lambda t: add_up(t.drop_columns("part")), schema)
        found = parts.groupBy("key").applyInArrow(last, "key int, value binary")
        out = {r["key"]: np.frombuffer(r["value"], np.float64) for r in found.toArrow().to_pylist()}
        own.unpersist()
        return out


@functools.lru_cache(maxsize=8)
def _upper(size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(size)


@dataclass
class Total:
    """What has been added up under one key: plain sums, and a sum of outer products of ``size`` numbers each.

    The latter is kept as the rows themselves while they are the smaller, else as the upper triangle.
    """
    plain: np.ndarray
    rows: np.ndarray
    triangle: np.ndarray

    @property
    def size(self) -> int:
        return self.rows.shape[1]

    def add(self, other: "Total") -> None:
        self.plain = self.plain + other.plain
        if len(other.triangle):
            self.triangle = self.triangle + other.triangle if len(self.triangle) else other.triangle
        self.rows = np.concatenate([self.rows, other.rows]) if len(other.rows) else self.rows
        if 2 * len(self.rows) > self.size:
            own = (self.rows.T @ self.rows)[_upper(self.size)]
            self.triangle = self.triangle + own if len(self.triangle) else own
            self.rows = np.zeros((0, self.size))

    def whole(self) -> np.ndarray:
        """The plain sums, then the full matrix."""
        full = self.rows.T @ self.rows
        if len(self.triangle):
            upper = np.zeros_like(full)
            upper[_upper(self.size)] = self.triangle
            full += upper + np.triu(upper, 1).T
        return np.concatenate([self.plain, full.ravel()])

    def table(self, key: int) -> pa.Table:
        values = [pa.array([np.ascontiguousarray(x, np.float64).tobytes()], pa.binary()) for x in (self.plain, self.rows, self.triangle)]
        return pa.table([pa.array([key], pa.int32()), *values, pa.array([self.size], pa.int32())],
                        ["key", "plain", "rows", "triangle", "size"])


def _added(table: pa.Table) -> Total:
    total = None
    for i in range(table.num_rows):
        plain, rows, triangle = (np.frombuffer(table.column(c)[i].as_buffer(), np.float64) for c in ("plain", "rows", "triangle"))
        one = Total(plain, rows.reshape(-1, size) if (size := table.column("size")[i].as_py()) else np.zeros((0, 0)), triangle)
        if total is None:
            total = one
        else:
            total.add(one)
    return total


class Chunk:
    """Some rows of a task: labels, folds, and features under a recipe."""

    def __init__(self, batch: pa.RecordBatch, width: int, own: dict[int, Recipe]):
        self.label = batch.column("label").to_numpy()
        self.fold = batch.column("fold").to_numpy()
        self.inner = batch.column("inner").to_numpy()
        term = batch.column("term")
        row = np.repeat(np.arange(batch.num_rows), np.diff(term.offsets.to_numpy()))
        self.counts = np.zeros((batch.num_rows, width))
        self.counts[row, term.flatten().to_numpy()] = batch.column("n").flatten().to_numpy()
        self.recipes = own
        self._features: dict[int, np.ndarray] = {}
        self._wide: dict[int, np.ndarray] = {}

    def wide(self, fold: int) -> np.ndarray:
        """The features and a column of ones."""
        if fold not in self._wide:
            self._wide[fold] = np.concatenate([self.features(fold), np.ones((len(self.label), 1))], axis=1)
        return self._wide[fold]

    def features(self, fold: int) -> np.ndarray:
        if fold not in self._features:
            self._features[fold] = self.recipes[fold].features(self.counts)
        return self._features[fold]

    def training(self, fold: int, inner: int | None = None) -> np.ndarray:
        """Whether each row trains the fits of a fold (and of an inner fold)."""
        use = self.fold != fold
        return use if inner is None else use & (self.inner != inner)


def add(sums: dict[int, Total], key: int, value: np.ndarray, rows: np.ndarray | None = None) -> None:
    """Add plain sums under a key, and the outer products of ``rows`` with themselves."""
    one = Total(value, np.zeros((0, 0 if rows is None else rows.shape[1])), np.zeros(0))
    sums.setdefault(key, one if rows is None else Total(np.zeros(len(value)), one.rows, one.triangle))
    if rows is not None:
        sums[key].add(Total(value, rows, np.zeros(0)))
    elif sums[key] is not one:
        sums[key].add(one)


# ------------------------------------------------------------------ moments


@dataclass
class Moments:
    """Rows, mean and unbiased covariance of the features in one class."""
    n: int
    mean: np.ndarray
    cov: np.ndarray
    square: np.ndarray  # mean of squares


def _split(value: np.ndarray, size: int) -> Moments:
    n, total = int(round(value[0])), value[1:size + 1]
    gram = value[size + 1:].reshape(size, size)
    mean = total / max(n, 1)
    cov = (gram - n * np.outer(mean, mean)) / (n - 1) if n > 1 else np.zeros((size, size))
    return Moments(n, mean, cov, np.diag(gram) / max(n, 1))


def class_moments(design: Design, folds: list[int]) -> dict[int, tuple[Moments, Moments]]:
    """The negative and positive rows' moments of each recipe's training rows, from one pass."""
    def each(chunk: Chunk, sums: dict) -> None:
        for k in folds:
            use = chunk.training(k)
            for c in (0, 1):
                x = chunk.features(k)[use & (chunk.label == c)]
                add(sums, 2 * k + c, np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()]))

    found = design.summed(each)
    out = {}
    for k in folds:
        size = len(design.recipes[k].vocab)
        empty = np.zeros(1 + size + size * size)
        out[k] = tuple(_split(found.get(2 * k + c, empty), size) for c in (0, 1))
    return out


# ------------------------------------------------------------------ penalised fits


@dataclass
class Problem:
    """min over (w, b) of mean loss + l1 |w| + l2 |w|^2 / 2, w on the features' standard deviations.

    ``loss`` is ``logistic``, or ``hinge`` in :class:`Interior`; ``fold`` and ``inner`` name the rows that are left out.
    """
    fold: int
    loss: str
    l1: float
    l2: float
    inner: int | None = None
    n: int = 0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    sd: np.ndarray = field(default_factory=lambda: np.zeros(0))
    done: bool = False
    passes: int = 0

    def start(self, n: int, mean: np.ndarray, sd: np.ndarray) -> None:
        self.n, self.mean, self.sd = n, mean, np.where(sd > 0, sd, np.inf)
        size = len(mean)
        self.at = np.zeros(size + 1)        # w and b
        self.way = np.zeros(size + 1)       # the step that is being tried
        self.length = 0.0                   # how far along it; 0: the first look under this loss
        self.objective, self.promise, self.damping = math.inf, 0.0, 0.0
        self.again = False                  # the same point once more, for a damped step
        self.done = n == 0 or size == 0

    def raw(self, point: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights on the features as they are, and the intercept."""
        u = point[:-1] / self.sd
        return u, float(point[-1] - self.mean @ u)

    def penalty(self, point: np.ndarray) -> float:
        w = point[:-1]
        return self.l1 * np.abs(w).sum() + self.l2 / 2 * (w @ w)

    def request(self) -> tuple:
        """What a task needs to evaluate the point that is tried, and the line that it lies on."""
        return (self.fold, self.inner, self.loss, *self.raw(self.at), *self.raw(self.way), self.length)

    def take(self, value: np.ndarray) -> None:
        """What :meth:`aim` says of the point that was tried: accept it or shorten the step, and choose the next."""
        self.passes += 1
        size = len(self.mean) + 1
        point = self.at + self.length * self.way
        if self.again:
            self.again = False
            self._step(value)
            return
        line = value[:len(STEPS)] / self.n
        here = value[len(STEPS)] / self.n
        objective = here + self.penalty(point)
        enough = self.objective + 1e-4 * self.length * self.promise
        if self.length == 1.0 and objective > enough or 0 < self.length < 1 and objective >= self.objective:
            along = [x + self.penalty(self.at + t * self.way) for x, t in zip(line, STEPS)]
            best = int(np.argmin(along))
            if along[best] < self.objective - 1e-15 * abs(self.objective) and STEPS[best] != self.length:
                self.length = float(STEPS[best])
            elif -self.promise > 1e-6 * abs(self.objective) and self.damping < 1e6:
                self.damping = max(100 * self.damping, 1e-6)  # nothing along the line is lower: a shorter, steeper step
                self.again, self.way, self.length = True, np.zeros(size), 0.0
            else:
                self.done = True
            return
        self.damping = 0.0
        self.at, self.objective = point, objective
        self.gradient = value[len(STEPS) + 1:len(STEPS) + 1 + size]
        self._step(value)
        if -self.promise <= TOLERANCE * max(1.0, abs(self.objective)):
            self.done = True

    def _step(self, value: np.ndarray) -> None:
        size = len(self.mean) + 1
        self.way, self.promise, self.length = value[-size - 1:-1].copy(), float(value[-1]), 1.0

    def aim(self) -> Callable[[np.ndarray], np.ndarray]:
        """Of the sums at the point that is tried: the losses as they are, the gradient, and the next step with its promise.

        The step leads to the minimum of the quadratic model, damped if the last one led nowhere.
        """
        size, n, mean, sd, l1, l2 = len(self.mean), self.n, self.mean, self.sd, self.l1, self.l2
        at, damping = self.at + self.length * self.way, self.damping if self.again else 0.0

        def run(value: np.ndarray) -> np.ndarray:
            body = value[len(STEPS) + 1:] / n
            g, h = body[:size + 1], body[size + 1:].reshape(size + 1, size + 1)
            turn = _turn(mean, sd)
            gradient = turn @ g
            gradient[:-1] += l2 * at[:-1]
            hessian = turn @ h @ turn.T
            hessian[np.arange(size), np.arange(size)] += l2
            if damping:
                hessian = hessian + damping * np.eye(len(hessian)) * max(1e-12, float(np.trace(hessian)) / len(hessian))
            way = _newton(hessian, gradient, at, l1, np.isfinite(sd))
            after = at + way
            promise = float(gradient @ way + l1 * (np.abs(after[:-1]).sum() - np.abs(at[:-1]).sum()))
            return np.concatenate([value[:len(STEPS) + 1], gradient, way, [promise]])

        return run

    def residual(self) -> float:
        """The largest violation of the optimality conditions at the end: 0 at the minimum."""
        g, w = self.gradient, self.at[:-1]
        own = np.where(w != 0, np.abs(g[:-1] + self.l1 * np.sign(w)), np.maximum(np.abs(g[:-1]) - self.l1, 0.0))
        return float(max(own[np.isfinite(self.sd)].max(initial=0.0), abs(g[-1])))


def _turn(mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """From the features as they are, and ones, to centred and scaled ones."""
    turn = np.diag(np.append(1 / sd, 1.0))
    turn[:-1, -1] = -mean / sd
    return turn


class Interior(Problem):
    """The hinge loss and a quadratic penalty, by a primal-dual interior-point method.

    With z a row's margin times its sign, its loss is the least x >= 0 with s = z - 1 + x >= 0, and a, b = 1 - a are the
    multipliers of s and x. A step solves the conditions a s = b x = t linearised, for t a share of their mean over the rows; it goes
    as far as no row's x, s, a or b leaves the positive numbers. All rows start alike, so their values follow from the steps.
    """

    def start(self, n: int, mean: np.ndarray, sd: np.ndarray) -> None:
        super().start(n, mean, sd)
        self.steps: list[tuple[np.ndarray, float, float]] = []  # way, t, length
        self.ways: np.ndarray | None = None     # the next step as far as it doesn't depend on t, and for each unit of it

    def request(self) -> tuple:
        points = [w for w, _, _ in self.steps] + ([] if self.ways is None else list(self.ways))
        raw = [np.append(*self.raw(p)) for p in points]
        ways = np.array(raw).T if raw else np.zeros((len(self.mean) + 1, 0))
        return self.fold, self.inner, self.loss, ways, [(t, a) for _, t, a in self.steps], self.ways is not None, self.mu if self.steps or self.ways is not None else 0.0

    def aim(self) -> Callable[[np.ndarray], np.ndarray]:
        """Of a pass's sums: the next step's two parts, or its share and length."""
        size, n, mean, sd, l2, at = len(self.mean), self.n, self.mean, self.sd, self.n * self.l2, self.at

        def direction(value: np.ndarray) -> np.ndarray:
            pull, shift, centre = value[2:2 + 3 * (size + 1)].reshape(3, size + 1)
            turn, own = _turn(mean, sd), l2 * np.append(np.ones(size), 0.0)
            h = turn @ value[2 + 3 * (size + 1):].reshape(size + 1, size + 1) @ turn.T + np.diag(own)
            h[np.diag_indices_from(h)] += 1e-14 * float(np.trace(h)) / len(h)
            slope = turn @ pull - own * at
            ways = np.linalg.solve(h, np.stack([slope + turn @ shift, turn @ centre], 1))
            return np.concatenate([value[:2], [np.abs(slope).max()], ways.T.ravel()])

        def length(value: np.ndarray) -> np.ndarray:
            body = value.reshape(len(SHARES), len(LENGTHS) + 1)
            tried = LENGTHS[[int(np.flatnonzero(row).max(initial=0)) for row in body[:, 1:]]]
            after = (1 - tried * (1 - np.array(SHARES))) * self.mu + tried * tried * body[:, 0] / (2 * n)
            best = int(np.argmin(np.maximum(after / self.mu, 1 - tried)))
            return np.array([SHARES[best] * self.mu, tried[best]])

        return direction if self.ways is None else length

    def take(self, value: np.ndarray) -> None:
        self.passes += 1
        if self.ways is None:
            size = len(self.mean) + 1
            last, self.mu = self.mu if self.steps else math.inf, value[0] / (2 * self.n)
            self.objective = value[1] / self.n + self.penalty(self.at)
            self.ways = value[3:].reshape(2, size).copy()
            gap = 2 * self.mu / max(1.0, self.objective)
            near = value[2] <= 100 * TOLERANCE * self.n and (gap <= GAP or gap <= 1e3 * GAP and self.mu > last / 2)
            near = near or gap <= 1e-3 * GAP  # beyond, rounding decides
            self.done = bool(near or not np.isfinite(value).all())
        else:
            t, length = value.tolist()
            way = self.ways[0] + t * self.ways[1]
            self.at = self.at + length * way
            self.steps.append((way, t, length))
            self.ways = None


def _moves(state: tuple, t: float | np.ndarray, along: np.ndarray) -> tuple:
    """The changes of each row's x, s, a and b in a step with these changes of the margins."""
    x, s, a, b = state
    da = (t * (1 / a - 1 / b) - s + x - along) / (x / b + s / a)
    dx = (t + x * da) / b - x
    return dx, along + dx, da, -da


def _interior(chunk: Chunk, sums: dict, key: int, fold: int, inner: int | None, ways: np.ndarray, steps: list, reach: bool, mu: float) -> None:
    use = chunk.training(fold, inner)
    x, y = chunk.wide(fold)[use], 2.0 * chunk.label[use] - 1.0
    along = y[:, None] * (x @ ways)
    state = tuple(np.full(len(y), v) for v in (START[0], START[0] - 1, START[1], 1 - START[1]))
    for j, (t, length) in enumerate(steps):
        state = tuple(v + length * d for v, d in zip(state, _moves(state, t, along[:, j])))
    if reach:
        value = np.zeros((len(SHARES), len(LENGTHS) + 1))
        for j, share in enumerate(SHARES):
            way = along[:, -2] + share * mu * along[:, -1]
            moves = _moves(state, share * mu, way)
            most = max(float((-d / v).max(initial=0.0)) for v, d in zip(state, moves))
            value[j, 0] = moves[2] @ way
            value[j, 1 + min(int(np.searchsorted(-LENGTHS * most, -REACH, side="right")), len(LENGTHS) - 1)] = 1.0
        add(sums, key, value.ravel())
        return
    slack, s, a, b = state
    weight = 1 / (slack / b + s / a)
    margin = along @ np.array([length for _, length in steps])
    pulls = np.stack([a * y, weight * (slack - s) * y, weight * (1 / a - 1 / b) * y])
    add(sums, key, np.concatenate([[a @ s + b @ slack, np.maximum(1 - margin, 0).sum()], (pulls @ x).ravel()]), x * np.sqrt(weight)[:, None])


def _newton(h: np.ndarray, g: np.ndarray, at: np.ndarray, l1: float, free: np.ndarray) -> np.ndarray:
    """The step that minimises the quadratic model plus the l1 penalty; the last coordinate is free of it."""
    use = np.append(np.flatnonzero(free), len(g) - 1)
    step = np.zeros(len(g))
    if not l1:
        part = h[np.ix_(use, use)]
        part[np.diag_indices_from(part)] += 1e-12 * max(1.0, float(np.trace(part)) / len(part))
        step[use] = -np.linalg.solve(part, g[use])
        return step
    slope, curve = g.copy(), np.maximum(np.diag(h), 1e-12)
    last = len(g) - 1

    def visit(places: np.ndarray) -> float:
        most = 0.0
        for j in places.tolist():
            c, now = curve[j], at[j] + step[j]
            want = now - slope[j] / c
            if j != last:
                want = math.copysign(max(abs(want) - l1 / c, 0.0), want)
            move = want - now
            if move:
                step[j] += move
                slope[:] += h[j] * move
                most = max(most, c * move * move)
        return most

    limit = 1e-16
    for _ in range(200):
        if visit(use) <= limit:
            break
        for _ in range(500):
            if visit(use[(at[use] + step[use] != 0) | (use == last)]) <= limit:
                break
    return step


def losses(kind: str, width: float, label: np.ndarray, margin: np.ndarray, only: bool = False):
    """Loss and its first two derivatives by the margin; of the hinge, smoothed over ``width``."""
    y = 2.0 * label - 1.0
    z = y * margin
    if kind == "logistic":
        loss = np.logaddexp(0.0, -z)
        if only:
            return loss
        p = np.exp(-np.logaddexp(0.0, z))
        return loss, -y * p, p * (1 - p)
    short = 1.0 - z
    near = (short > 0) & (short < width)
    loss = np.where(near, short * short / (2 * width), np.maximum(short - width / 2, 0.0) * (short >= width))
    if only:
        return loss
    return loss, -y * np.clip(short / width, 0.0, 1.0), near / width


def solve(design: Design, problems: list[Problem], max_passes: int = 300) -> list[Problem]:
    """Fit all problems together, one pass over the rows for each step of all of them."""
    scales = _scales(design, problems)
    for p, (n, mean, sd) in zip(problems, scales):
        p.start(n, mean, sd)
    for _ in range(max_passes):
        active = [(i, p.request()) for i, p in enumerate(problems) if not p.done]
        if not active:
            break
        aims = {i: problems[i].aim() for i, _ in active}
        found = design.summed(_evaluate(active), lambda key, value: aims[key](value))
        for i, _ in active:
            problems[i].take(found[i])
    return problems


def _evaluate(active: list[tuple[int, tuple]]) -> Callable:
    def each(chunk: Chunk, sums: dict) -> None:
        for i, (fold, inner, kind, *rest) in active:
            if kind == "hinge":
                _interior(chunk, sums, i, fold, inner, *rest)
                continue
            u, c, du, dc, length = rest
            use = chunk.training(fold, inner)
            x, label = chunk.features(fold)[use], chunk.label[use]
            base, along = x @ u + c, x @ du + dc
            line = [losses(kind, 1.0, label, base + t * along, True).sum() for t in STEPS] if length else np.zeros(len(STEPS))
            loss, g, h = losses(kind, 1.0, label, base + length * along)
            some = h > 0
            root = np.sqrt(h[some])[:, None]
            add(sums, i, np.concatenate([line, [loss.sum()], x.T @ g, [g.sum()]]), np.concatenate([x[some] * root, root], axis=1))

    return each


def _scales(design: Design, problems: list[Problem]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Rows, means and standard deviations of each problem's features, from one pass."""
    sets = sorted({(p.fold, -1 if p.inner is None else p.inner) for p in problems})

    def each(chunk: Chunk, sums: dict) -> None:
        for i, (fold, inner) in enumerate(sets):
            x = chunk.features(fold)[chunk.training(fold, None if inner < 0 else inner)]
            add(sums, i, np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))

    found, out = design.summed(each), []
    for p in problems:
        size = len(design.recipes[p.fold].vocab)
        value = found.get(sets.index((p.fold, -1 if p.inner is None else p.inner)), np.zeros(1 + 2 * size))
        n = int(round(value[0]))
        mean = value[1:size + 1] / max(n, 1)
        var = np.maximum(value[size + 1:] - n * mean * mean, 0.0) / max(n - 1, 1)
        out.append((n, mean, np.where(var > 1e-24, np.sqrt(var), 0.0)))
    return out


def sigmoids(design: Design, margins: dict[int, dict[int, tuple[np.ndarray, float]]], max_passes: int = 30) -> dict[int, tuple[float, float]]:
    """Slope and intercept of a sigmoid on each fold's held-out margins.

    ``margins`` has, for each fold and inner fold, the weights that were fitted without the latter's rows.
    """
    at = {k: np.zeros(2) for k, own in margins.items() if own}
    value: dict[int, float] = {}
    open_ = set(at)
    way = {k: np.zeros(2) for k in at}
    while open_ and max_passes:
        max_passes -= 1
        tried = {k: at[k] + way[k] for k in open_}

        def each(chunk: Chunk, sums: dict) -> None:
            for k, (a, b) in tried.items():
                for i, (u, c) in margins[k].items():
                    use = (chunk.fold != k) & (chunk.inner == i)
                    m = chunk.features(k)[use] @ u + c
                    loss, g, h = losses("logistic", 1.0, chunk.label[use], a * m + b)
                    add(sums, k, np.array([loss.sum(), g @ m, g.sum(), h @ (m * m), h @ m, h.sum(), len(m)]))

        found = design.summed(each)
        for k in list(open_):
            loss, *body = found.get(k, np.zeros(7))
            n = max(body[-1], 1.0)
            if k in value and loss / n > value[k]:
                way[k] = way[k] / 2
                if np.abs(way[k]).max() < 1e-9:
                    open_.discard(k)
                continue
            at[k], value[k] = tried[k], loss / n
            g, h = np.array(body[:2]) / n, np.array([[body[2], body[3]], [body[3], body[4]]]) / n
            way[k] = -np.linalg.lstsq(h + 1e-12 * np.eye(2), g, rcond=None)[0]
            if -g @ way[k] <= 1e-9:
                open_.discard(k)
    return {k: (float(a), float(b)) for k, (a, b) in at.items()}


# ------------------------------------------------------------------ all models of all folds

#: The models that are fitted here; the others have no sums to be fitted from.
TOGETHER = ("ldm", "logit", "mr", "nb", "null", "pls", "svm_linear")


def penalised(design: Design, name: str, fold: int, n: int) -> list[Problem]:
    """The problems that a penalised model of one fold needs.

    ``logit``: penalty 0.1, mixture 0.5. ``mr``: 0.01 and 0.5 on the weights of both classes; these are
    opposite at the minimum, so it is the logistic problem of their difference with half of the
    quadratic penalty. ``svm_linear``: C = 1, and one problem without each inner fold.
    """
    if name == "logit":
        return [Problem(fold, "logistic", 0.05, 0.05)]
    if name == "mr":
        return [Problem(fold, "logistic", 0.005, 0.0025)]
    l2 = 1.0 / max(n, 1)
    return [Interior(fold, "hinge", 0.0, l2), *[Interior(fold, "hinge", 0.0, l2, inner=i) for i in range(INNER_FOLDS)]]


def fit(design: Design, names: list[str], folds: list[int]) -> dict[tuple[int, str], object]:
    """(fold, model name) -> fitted model, for names of ``TOGETHER``. A fold of one class has null models."""
    from litsift.models import classifiers as c

    out: dict[tuple[int, str], object] = {}
    counts = {(r.fold, r.inner, r.label): r.n for r in design.rows.groupBy("fold", "inner", "label").agg(
        F.count(F.lit(1)).alias("n")).collect()}  # a row for each fold, inner fold and class

    def rows(fold: int, inner: int | None = None) -> dict[float, int]:
        return {y: sum(n for (f, i, z), n in counts.items() if z == y and f != fold and i != inner) for y in (0.0, 1.0)}

    both = [k for k in folds if min(rows(k).values()) > 0]
    closed = [x for x in names if x in ("ldm", "nb", "pls")]
    moments = class_moments(design, both) if closed and both else {}
    problems = {(k, x): penalised(design, x, k, sum(rows(k).values())) for k in both for x in names
                if x in ("logit", "mr", "svm_linear")}
    for own in problems.values():  # an inner fold that leaves one class only has no fit
        own[:] = [p for p in own if p.inner is None or min(rows(p.fold, p.inner).values()) > 0]
    solve(design, [p for own in problems.values() for p in own])
    svm = {k: {p.inner: p.raw(p.at) for p in problems[k, "svm_linear"] if p.inner is not None}
           for k in both if "svm_linear" in names}
    turned = sigmoids(design, svm) if svm else {}
    for k in folds:
        n = rows(k)
        prior = n[1.0] / max(sum(n.values()), 1) if sum(n.values()) else 0.5
        for name in names:
            if k not in both or name == "null":
                out[k, name] = c._NullModel(prior)
            elif name == "ldm":
                out[k, name] = c.lda_model(*moments[k])
            elif name == "pls":
                out[k, name] = c.pls_model(*moments[k])
            elif name == "nb":
                out[k, name] = c.nb_model(*moments[k])
            else:
                a, b = turned.get(k, (1.0, 0.0)) if name == "svm_linear" else (1.0, 0.0)
                u, at = problems[k, name][0].raw(problems[k, name][0].at)
                out[k, name] = c._LinearScoreModel(a * u, a * at + b)
    return out


def predictions(design: Design, models: dict[tuple[int, str], object]) -> DataFrame:
    """(model_name, fold, pmid, class, label, p_positive) of every row by the models of its own fold."""
    own, width = design.spark.sparkContext.broadcast(design.recipes), design.width
    names = sorted({name for _, name in models})
    sent = design.spark.sparkContext.broadcast({key: model.arrays() for key, model in models.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                chunk = Chunk(part, width, own.value)
                p = np.zeros((part.num_rows, len(names)))
                for k in np.unique(chunk.fold).tolist():
                    rows = np.flatnonzero(chunk.fold == k)
                    x = chunk.features(k)[rows]
                    for j, name in enumerate(names):
                        kind, *values = sent.value[k, name]
                        if kind == "prior":
                            p[rows, j] = values[0]
                            continue
                        score = x @ values[0] + values[1]
                        if len(values) > 2:
                            score = score + (x * x) @ values[2]
                        p[rows, j] = 1.0 / (1.0 + np.exp(-np.clip(score, -700, 700)))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, len(names)), pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("fold", "pmid", "class", "label")), flat],
                                                 ["fold", "pmid", "class", "label", "p"])

    kinds = design.rows.schema
    schema = ", ".join(f"{c} {kinds[c].dataType.simpleString()}" for c in ("fold", "pmid", "class", "label"))
    found = design.rows.select("fold", "pmid", "class", "label", "inner", "term", "n").mapInArrow(run, f"{schema}, p array<double>")
    labels = F.array(*map(F.lit, names))
    return found.select("fold", "pmid", "class", "label", F.posexplode("p").alias("at", "p_positive")).select(
        F.get(labels, "at").alias("model_name"), "fold", "pmid", "class", "label", "p_positive")
