"""k nearest neighbours as a distributed, exact search.

Labelled rows are dealt to their nearest pivot and packed in blocks of bounded size; rows to be scored are packed as
they come. Every block of the latter meets a run of blocks of the former, one after the other, and keeps the best k
of each of its rows, so the shuffle gets k rows of a row and run, however many blocks there are. Before blocks meet, a row is
left out if it can't have a neighbour there: the members nearest to each pivot, and the neighbours found so far, bound the
distance of its k-th neighbour from above, and the triangle inequality bounds its distance to a pivot's members from
below. Neither side is collected, and no label row is left out. The comparisons remain as many as pairs of rows that can't be ruled out.

Two rows are compared by one product in single precision; its rounding error is bounded, and only rows that may be among the
best k for that bound have their distance taken in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litsift.session import ensure_checkpoint_dir, ship_package

#: Most pivots, labelled rows of a block, rows to be scored of a block, and blocks of labelled rows in a run.
PIVOTS, BLOCK_ROWS, QUERY_ROWS, RUN_BLOCKS = 64, 2048, 4096, 64
#: Decimals of a distance: closer ones are the same, and the lower label comes first.
DECIMALS = 9
#: Rows to be scored that are compared at once.
STEP_ROWS = 512


def _rows(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), width)


def _pack(key: np.ndarray, x: np.ndarray) -> bytes:
    """Rows in few bytes: 8 bytes of each row's key, which values aren't 0, and these."""
    some = x != 0
    return b"".join([np.int64(len(x)).tobytes(), key.tobytes(), np.packbits(some, axis=1).tobytes(), x[some].tobytes()])


def _unpack(value: bytes, width: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    n, each = int(np.frombuffer(value, "<i8", 1)[0]), -(-width // 8)
    key, at = np.frombuffer(value, kind, n, 8), 8 + 8 * n
    some = np.unpackbits(np.frombuffer(value, np.uint8, n * each, at).reshape(n, each), axis=1, count=width).astype(bool)
    x = np.zeros((n, width))
    x[some] = np.frombuffer(value[at + n * each:], "<f8")
    return key, x


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _slack(a: np.ndarray, b: np.ndarray) -> float:
    """How far a distance from the products can be off: the root of the squares' rounding error."""
    top = float((a * a).sum(1).max(initial=0.0) + (b * b).sum(1).max(initial=0.0))
    return math.sqrt(top * 1e-12) + 10.0**-DECIMALS


def _margin(width: int) -> float:
    """A row product of ``width`` numbers and one more in single precision is off by at most this share of half the one row's
    square and the other's whole: the bound of a sum's rounding error, twice."""
    return 2 * (width + 8) * 2.0**-24


def _single(x: np.ndarray, last: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Rows and one more column in single precision, if their squares fit it."""
    out = np.empty((len(x), x.shape[1] + 1), np.float32 if square.max(initial=0.0) < 1e30 else np.float64)
    out[:, :-1], out[:, -1] = x, last
    return out


class _Rows:
    """Rows of a block, ready to be compared by their products."""

    def __init__(self, x: np.ndarray):
        self.x, self.square = x, np.einsum("ij,ij->i", x, x)

    def asking(self) -> np.ndarray:
        return _single(self.x, np.ones(len(self.x)), self.square)

    def asked(self) -> np.ndarray:
        """Their product with a row that asks is at least (that row's square - square of the distance) / 2, but for what
        the margin of the former's square allows."""
        return _single(self.x, (_margin(self.x.shape[1]) - 0.5) * self.square, self.square)


def nearest(queries: _Rows, asking: np.ndarray, own: np.ndarray, rows: _Rows, asked: np.ndarray, label: np.ndarray, k: int,
            most: np.ndarray) -> tuple[np.ndarray, ...]:
    """Place in ``own`` (the queries that are compared), row number, rank and distance of each query's nearest ``k`` rows that
    are not farther than ``most``; ties by label, then row."""
    score = asking[own] @ asked.T
    square, margin, k = queries.square[own], _margin(queries.x.shape[1]), min(k, len(rows.x))

    def least(square: np.ndarray, far: np.ndarray) -> np.ndarray:
        far = (np.sqrt(far) + 2 * 10.0**-DECIMALS) ** 2
        return np.nextafter(((0.5 - margin) * square - far / 2).astype(score.dtype), score.dtype.type(-np.inf))[:, None]

    hit = score >= least(square, most * most)
    many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 4 * k)
    if len(many):
        # by the k-th best score k rows are not farther than this
        best = np.partition(score[many], len(rows.x) - k, axis=1)[:, len(rows.x) - k].astype(np.float64)
        far = np.maximum((1 + margin) * square[many] - 2 * best + 4 * margin * rows.square.max(), 0.0)
        hit[many] = score[many] >= least(square[many], np.minimum(most[many] * most[many], far))
    q, r = np.divmod(np.flatnonzero(hit), len(rows.x))
    exact = np.empty(len(q))
    for a in range(0, len(q), 8192):  # distances by differences: equal rows are at 0
        b = slice(a, a + 8192)
        gap = queries.x[own[q[b]]] - rows.x[r[b]]
        exact[b] = np.sqrt((gap * gap).sum(1))
    exact = np.round(exact, DECIMALS)
    order = np.lexsort((r, label[r], exact, q))
    q, r, exact = q[order], r[order], exact[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return q[rank < k], r[rank < k], rank[rank < k], exact[rank < k]


class _Best:
    """The best k of each row of a block, of the labelled rows that it has met."""

    def __init__(self, value: bytes, width: int, k: int, pivots: np.ndarray, reach: list, sd: np.ndarray):
        self.row, x = _unpack(value, width, "<i8")
        self.x, self.k, n = x / sd, k, len(self.row)
        self.rows = _Rows(self.x)
        self.asking = self.rows.asking()
        self.reach = {r[0]: (i, r[1], r[2]) for i, r in enumerate(reach)}
        own = pivots[[r[0] for r in reach]]
        self.away = _distances(self.x, own)
        self.slack = 2 * _slack(self.x, own)
        near = np.concatenate([np.array(r[4]) for r in reach])
        bounds = self.away[:, np.concatenate([np.full(len(r[4]), i) for i, r in enumerate(reach)])] + near
        self.most = np.partition(bounds, k - 1, axis=1)[:, k - 1] if bounds.shape[1] >= k else np.full(n, np.inf)
        self.distance, self.label = np.full((n, k), np.inf), np.zeros((n, k))

    def meet(self, pivot: int, label: np.ndarray, rows: np.ndarray) -> None:
        i, low, high = self.reach[pivot]
        most = np.minimum(self.most, self.distance[:, -1]) + self.slack
        can = np.flatnonzero((self.away[:, i] - high <= most) & (low - self.away[:, i] <= most))
        if not len(can):
            return
        block = _Rows(rows)
        asked = block.asked()
        for a in range(0, len(can), STEP_ROWS):
            own = can[a:a + STEP_ROWS]
            q, r, rank, distance = nearest(self.rows, self.asking, own, block, asked, label, self.k, most[own])
            d, y = np.full((len(own), self.k), np.inf), np.zeros((len(own), self.k))
            d[q, rank], y[q, rank] = distance, label[r]
            d, y = np.concatenate([self.distance[own], d], 1), np.concatenate([self.label[own], y], 1)
            order = np.lexsort((y, d), axis=1)[:, :self.k]
            self.distance[own], self.label[own] = np.take_along_axis(d, order, 1), np.take_along_axis(y, order, 1)

    def found(self) -> pa.RecordBatch:
        q, at = np.nonzero(np.isfinite(self.distance))
        return pa.RecordBatch.from_arrays([pa.array(self.row[q]), pa.array(self.distance[q, at]), pa.array(self.label[q, at])],
                                          ["row", "distance", "label"])


class KnnModel:
    """Labelled rows in blocks around pivots (written to the checkpoint folder), and the pivots."""

    def __init__(self, rows: DataFrame, pivots: np.ndarray, reach: list[tuple[int, float, float, int, list[float]]],
                 sd: np.ndarray, k: int):
        self.rows = rows        # (pivot, data): packed labels and features divided by sd
        self.pivots = pivots
        self.reach = reach      # pivot, least and greatest distance of its members, blocks, least k distances
        self.sd, self.k = sd, k

    def transform(self, df: DataFrame) -> DataFrame:
        from litsift.models.classifiers import with_class

        spark = df.sparkSession
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        width, k = self.pivots.shape[1], self.k
        sent = spark.sparkContext.broadcast((self.pivots, self.reach, self.sd))

        def meet(pairs):
            pivots, reach, sd = sent.value
            number, best = None, None
            for pair in pairs:
                for at, data, pivot, rows in zip(*(pair.column(c) for c in ("number", "data", "pivot", "rows"))):
                    if at.as_py() != number:
                        if best is not None:
                            yield best.found()
                        number, best = at.as_py(), _Best(data.as_py(), width, k, pivots, reach, sd)
                    best.meet(pivot.as_py(), *_unpack(rows.as_py(), width, "<f8"))
            if best is not None:
                yield best.found()

        held = df.withColumn("_row", F.monotonically_increasing_id()).checkpoint()
        cores = spark.sparkContext.defaultParallelism
        tasks = cores * max(1, -(-held.count() // (cores * QUERY_ROWS)))  # a block each: every one meets all labelled rows

        def pack(batches):
            rest, count = [], 0
            for batch in batches:
                for a in range(0, batch.num_rows, 1024):
                    part = batch.slice(a, 1024)
                    rest.append((part.column("row").to_numpy(), _rows(part.column("x"), width)))
                    count += part.num_rows
                    if count > QUERY_ROWS:  # rows are dealt out evenly but for a few
                        yield block(rest)
                        rest, count = [], 0
            if rest:
                yield block(rest)

        def block(parts):
            value = _pack(*(np.concatenate(c) for c in zip(*parts)))
            return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], ["data"])

        queries = held.select(F.col("_row").alias("row"), "features").repartition(tasks) \
            .select("row", vector_to_array("features").alias("x")).mapInArrow(pack, "data binary") \
            .withColumn("number", F.monotonically_increasing_id()).checkpoint()
        blocks = sum(r[3] for r in self.reach)
        rows = self.rows.select("pivot", F.col("data").alias("rows")).repartition(max(1, -(-blocks // RUN_BLOCKS)))
        found = queries.crossJoin(rows.checkpoint()).mapInArrow(meet, "row long, distance double, label double")
        rank = F.row_number().over(Window.partitionBy("row").orderBy("distance", "label"))
        weight = F.lit(1.0) / (F.col("distance") + 1e-9)
        votes = found.withColumn("rank", rank).filter(F.col("rank") <= k).groupBy("row").agg(
            (F.sum(weight * F.col("label")) / F.sum(weight)).alias("p_positive"))
        return with_class(held.join(votes.withColumnRenamed("row", "_row"), "_row").drop("_row"))


class KnnSpec:
    """k nearest neighbours (k = 5, Euclidean, inverse-distance vote), exact over all labelled rows.

    ``scale=True`` divides each feature by its standard deviation first.
    """
    name = "knn"

    def __init__(self, k: int = 5, scale: bool = False, seed: int = 7):
        self.k, self.scale, self.seed = k, scale, seed

    def fit(self, df: DataFrame) -> KnnModel:
        spark = df.sparkSession
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
        n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
        if not n:
            raise ValueError("no rows to fit on")
        sd = np.ones(width)
        if self.scale and n > 1:
            spread = df.select(Summarizer.metrics("std").summary(F.col("features")).alias("s")).first()["s"]["std"].toArray()
            sd = np.where(spread > 0, spread, 1.0)
        most = max(1, min(PIVOTS, math.isqrt(-(-n // 64))))
        picked = rows.select("x", F.xxhash64("x", F.lit(self.seed)).alias("h")).distinct().orderBy("h").limit(most).collect()
        pivots = np.array([r.x for r in picked]) / sd  # PIVOTS rows at most
        sent = spark.sparkContext.broadcast((pivots, sd))

        def deal(batches):
            own, scale = sent.value
            for batch in batches:
                for a in range(0, batch.num_rows, 1024):
                    part = batch.slice(a, 1024)
                    x = _rows(part.column("x"), width) / scale
                    d = _distances(x, own)
                    at = d.argmin(1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(x)), at]), part.column("label"),
                         pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, width), pa.int32()), pa.array(x.ravel()))],
                        ["pivot", "distance", "label", "x"])

        dealt = rows.mapInArrow(deal, "pivot int, distance double, label double, x array<double>") \
            .withColumn("number", F.monotonically_increasing_id()).checkpoint()
        rank = F.row_number().over(Window.partitionBy("pivot").orderBy("distance"))
        near = dealt.select("pivot", "distance", rank.alias("rank")).filter(F.col("rank") <= self.k) \
            .groupBy("pivot").agg(F.sort_array(F.collect_list("distance")).alias("near"))
        stats = dealt.groupBy("pivot").agg(F.min("distance").alias("low"), F.max("distance").alias("high"),
                                           F.count(F.lit(1)).alias("n")).join(near, "pivot").collect()  # a row a pivot
        reach = [(r.pivot, r.low, r.high, -(-r.n // BLOCK_ROWS), list(r.near)) for r in sorted(stats, key=lambda r: r.pivot)]
        parts = F.lit(1).cast("long")
        for pivot, _, _, blocks, _ in reach:
            parts = F.when(F.col("pivot") == pivot, F.lit(blocks).cast("long")).otherwise(parts)

        def block(table: pa.Table) -> pa.Table:
            value = _pack(table.column("label").to_numpy(), _rows(table.column("x").combine_chunks(), width))
            return pa.table({"pivot": table.column("pivot")[:1], "data": pa.array([value], pa.binary())})

        rows = dealt.select("pivot", F.pmod(F.xxhash64("number"), parts).cast("int").alias("part"), "label", "x") \
            .groupBy("pivot", "part").applyInArrow(block, "pivot int, data binary").checkpoint()
        return KnnModel(rows, pivots, reach, sd, self.k)


def save_parts(model: KnnModel, spark, path: str) -> dict:
    """Write a model's rows, pivots and scales; what is left for its description is returned."""
    model.rows.write.mode("overwrite").parquet(path + "/rows")
    spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(model.pivots)], "i int, x array<double>") \
        .coalesce(1).write.mode("overwrite").parquet(path + "/pivots")
    return {"k": model.k, "sd": [float(v) for v in model.sd], "reach": [list(r) for r in model.reach]}


def load_parts(spark, path: str, meta: dict) -> KnnModel:
    pivots = np.array([r.x for r in spark.read.parquet(path + "/pivots").orderBy("i").collect()])
    return KnnModel(spark.read.parquet(path + "/rows"), pivots, [tuple(r) for r in meta["reach"]],
                    np.array(meta["sd"]), meta["k"])
