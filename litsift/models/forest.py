"""Forests of deep trees, grown from binned rows.

Spark's own forest sends the sums of every node of every tree through a shuffle, which deep trees of many
features can't afford: there are about as many nodes as rows in each tree. Here only nodes of more than
``LOCAL_ROWS`` rows are split that way, level by level, a bounded number of nodes a pass; the tasks' last
reduction picks the split, so the driver gets one row a node. The rows of a smaller node go to one task, which
grows all that is below it. While all rows fit such a task, they are sent once for each batch of trees.

Trees are those of Spark's forest: a row counts Poisson(1) times in a tree, features are cut into 32 bins at
quantiles of a sample of 10,000 rows, a split maximises the Gini gain over a random choice of features, and a
node's probability is its share of positive rows. A row's draws follow from its number and the tree's, a node's
from its path, so they don't depend on how the work is dealt.

A fitted forest is a DataFrame of subtrees in the checkpoint folder. Rows are scored block by block against
batches of subtrees.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsift.session import ensure_checkpoint_dir, ship_package

#: Bins of a feature, and rows that their limits are taken from.
BINS, SAMPLE_ROWS = 32, 10_000
#: Most (weighted) rows of a node whose subtree is grown in one task.
LOCAL_ROWS = 5 << 17
#: Most histogram cells of the nodes that are split in one pass, and most cells or values that a task holds for a step.
PASS_CELLS, STEP_CELLS = 1 << 24, 1 << 20
#: Rows of a block, trees of a batch.
BLOCK_ROWS, BATCH_TREES = 1 << 14, 10
#: Less gain than this is rounding.
LEAST_GAIN = 1e-12

NODE = np.dtype([("feature", "<i2"), ("bin", "u1"), ("left", "<i4"), ("p", "<f8")])
_ARRAY = "row long, label double, x binary"


# ------------------------------------------------------------------ draws


def _mix(x: np.ndarray) -> np.ndarray:
    """Well mixed 64 bits of each (splitmix64)."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POISSON = np.cumsum([math.exp(-1.0) / math.factorial(i) for i in range(18)])


def weights(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row counts in a tree: Poisson(1)."""
    own = _mix(np.array([(seed << 32) + tree], np.uint64))
    u = (_mix(row.astype(np.uint64) ^ own) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(_POISSON, u, side="right").astype(np.float64)


def choices(path: np.ndarray, width: int, some: int) -> np.ndarray:
    """The features that are looked at in each node, ascending."""
    if some >= width:
        return np.broadcast_to(np.arange(width), (len(path), width))
    draws = _mix(path[:, None] ^ _mix(np.arange(1, width + 1, dtype=np.uint64))[None, :])
    return np.sort(np.argpartition(draws, some, axis=1)[:, :some], axis=1)


def _root(tree: int, seed: int) -> np.ndarray:
    return _mix(np.array([(seed << 32) + tree + (1 << 31)], np.uint64))


def _below(path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The paths of both children."""
    return _mix(path ^ np.uint64(1)), _mix(path ^ np.uint64(2))


# ------------------------------------------------------------------ splits


def best_splits(both: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """Of histograms (node, feature, bin) of rows and positive rows in one number: gain, place of the feature, bin, and the left
    side's rows and positives of each node's best split. A gain of 0 stands for none."""
    nodes, some = both.shape[:2]
    size = some * BINS
    left = np.cumsum(both, 2)
    total, ones = _rows(left[:, 0, -1])
    left = left.reshape(-1)
    # a split after an empty bin is the one before it once more
    at = np.flatnonzero(both)
    packed, node = left[at], at // size
    nl, yl = _rows(packed)
    n, y = total[node], ones[node]
    nr = n - nl
    can = (nl >= least) & (nr >= max(least, 1))
    at, node, nl, yl, n, y, nr = (v[can] for v in (at, node, nl, yl, n, y, nr))
    yr = y - yl
    # Gini impurity times rows is 2 y (n - y) / n
    gain = 2 * (y * (n - y) / n - yl * (nl - yl) / nl - yr * (nr - yr) / nr) / n
    out = np.zeros((3, nodes)), np.zeros((2, nodes), np.int64)
    if len(gain):
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        most = np.maximum.reduceat(gain, first)
        top = np.flatnonzero(gain == np.repeat(most, np.diff(np.append(first, len(gain)))))
        top = top[np.concatenate([[True], node[top[1:]] != node[top[:-1]]])]  # the first of equal ones
        top = top[gain[top] > LEAST_GAIN]
        out[0][:, node[top]] = gain[top], nl[top], yl[top]
        out[1][:, node[top]] = at[top] % size // BINS, at[top] % BINS
    return out[0][0], *out[1], *out[0][1:]


def _rows(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and positive rows of two whole numbers in one sum."""
    ones = np.floor(both * 2.0**-26)
    return both - ones * 2.0**26, ones


def _histograms(x: np.ndarray, rows: np.ndarray, both: np.ndarray, slot: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Rows and positive rows (``both``) by (node, feature, bin); most bins of a row are 0 and follow from the others."""
    nodes, some = features.shape
    at = features[slot]
    at += (rows * x.shape[1])[:, None]
    bins = x.reshape(-1).take(at).reshape(-1)
    more = np.flatnonzero(bins > 0)
    row = more // some
    key = (slot * (some * BINS))[row] + (more - row * some) * BINS + bins[more]
    out = np.bincount(key, both[row], nodes * some * BINS).reshape(nodes, some, BINS)
    out[:, :, 0] = np.bincount(slot, both, nodes)[:, None] - out @ np.ones(BINS)
    return out


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, path: np.ndarray, depth: int, shape: "Shape") -> np.ndarray:
    """The subtree (``NODE`` records, children side by side) of a node with these rows."""
    rows = np.flatnonzero(w > 0)
    both = w[rows] + (w * y)[rows] * 2.0**26
    n, ones = float(w[rows].sum()), float((w * y)[rows].sum())
    levels = [np.array([(-1, 0, 0, ones / n if n else 0.5)], NODE)]
    node = np.zeros(len(rows), np.int64)          # place among the open nodes, ascending
    open_ = np.zeros(1, np.int64) if 0 < ones < n and depth < shape.depth else np.zeros(0, np.int64)
    total, positive, path = np.array([n]), np.array([ones]), path[:len(open_)]
    made = 1
    while len(open_):
        features = choices(path, x.shape[1], shape.some)
        ends = np.searchsorted(node, np.arange(len(open_)), side="right")
        found, a, some = [], 0, features.shape[1]
        step = max(1, STEP_CELLS // some)
        while a < len(open_):  # nodes whose histograms and values fit a step, one at least
            start = ends[a - 1] if a else 0
            b = min(len(open_), a + max(1, STEP_CELLS // (some * BINS)),
                    max(a + 1, int(np.searchsorted(ends, start + step, side="right"))))
            part = 0.0
            for s in range(start, ends[b - 1], step):
                own = slice(s, min(s + step, ends[b - 1]))
                part = part + _histograms(x, rows[own], both[own], node[own] - a, features[a:b])
            found.append(best_splits(part, shape.least))
            a = b
        gain, place, cut, nl, yl = (np.concatenate(f) for f in zip(*found))
        split = gain > 0
        feature = features[np.arange(len(open_)), place]
        last = levels[-1]
        last["feature"][open_[split]], last["bin"][open_[split]] = feature[split], cut[split]
        left = made + 2 * np.arange(int(split.sum()))
        last["left"][open_[split]] = left
        made += 2 * len(left)
        depth += 1
        # children in order: left, right of each node that was split
        nc = np.stack([nl, total - nl], 1)[split].ravel()
        yc = np.stack([yl, positive - yl], 1)[split].ravel()
        level = np.zeros(len(nc), NODE)
        level["feature"], level["p"] = -1, yc / np.maximum(nc, 1)
        levels.append(level)
        more = (yc > 0) & (yc < nc) & (nc >= 2 * shape.least) & (depth < shape.depth)
        paths = np.stack(_below(path[split]), 1).ravel()
        # the place of each node's children among the open ones, and of the rows in their order
        number = np.full((len(open_), 2), -1)
        number[split] = np.where(more, np.cumsum(more) - 1, -1).reshape(-1, 2)
        right = (x.reshape(-1).take(rows * x.shape[1] + feature[node]) > cut[node]).astype(np.int64)
        at = number.reshape(-1).take(2 * node + right)
        stay = np.flatnonzero(at >= 0)
        order = stay[np.argsort(at[stay].astype(np.int32), kind="stable")]
        rows, both, node = rows[order], both[order], at[order]
        open_, total, positive, path = np.flatnonzero(more), nc[more], yc[more], paths[more]
    return np.concatenate(levels)


def leaves(nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of the leaf that each row ends in."""
    at = np.zeros(len(x), np.int64)
    feature, cut, left = nodes["feature"].astype(np.int64), nodes["bin"].copy(), nodes["left"].astype(np.int64)
    flat, start = x.reshape(-1), np.arange(len(x)) * x.shape[1]
    going = np.arange(len(x)) if feature[0] >= 0 else np.zeros(0, np.int64)
    here, use = at[going], feature[at[going]]
    while len(going):
        here = left.take(here) + (flat.take(start + use) > cut.take(here))
        use = feature.take(here)
        more = np.flatnonzero(use >= 0)
        if len(more) < len(going):
            at[going] = here
            going, here, use, start = going[more], here[more], use[more], start[more]
    return at


# ------------------------------------------------------------------ rows


def limits(values: np.ndarray, zeros: int) -> np.ndarray:
    """The upper limits of a feature's bins but the last: middles between distinct values, near the quantiles."""
    value, count = np.unique(values, return_counts=True)
    if zeros:
        at = int(np.searchsorted(value, 0.0))
        if at < len(value) and value[at] == 0.0:
            count[at] += zeros
        else:
            value, count = np.insert(value, at, 0.0), np.insert(count, at, zeros)
    middle = (value[:-1] + value[1:]) / 2
    if len(middle) < BINS:
        return middle
    done, stride = np.cumsum(count), count.sum() / BINS
    found, target = [], stride
    for i in range(1, len(value)):
        if abs(done[i - 1] - target) < abs(done[i] - target):
            found.append(middle[i - 1])
            target += stride
    return np.array(found[:BINS - 1])


def _pack(x: np.ndarray, row: np.ndarray, label: np.ndarray) -> bytes:
    """Rows in few bytes: numbers, labels, which bins aren't 0, and these."""
    some = x != 0
    return b"".join([np.int64(len(x)).tobytes(), row.astype("<i8").tobytes(), label.astype("<f8").tobytes(),
                     np.packbits(some, axis=1).tobytes(), x[some].tobytes()])


def _unpack(value: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(value, "<i8", 1)[0])
    row, label = np.frombuffer(value, "<i8", n, 8), np.frombuffer(value, "<f8", n, 8 + 8 * n)
    bytes_, at = -(-width // 8), 8 + 16 * n
    some = np.unpackbits(np.frombuffer(value, np.uint8, n * bytes_, at).reshape(n, bytes_), axis=1, count=width).astype(bool)
    x = np.zeros((n, width), np.uint8)
    x[some] = np.frombuffer(value, np.uint8, -1, at + n * bytes_)
    return x, row, label


def _gathered(values: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of all blocks in the order of their numbers; besides these, one block is held at a time."""
    row = np.concatenate([np.frombuffer(v.as_buffer(), "<i8", int(np.frombuffer(v.as_buffer(), "<i8", 1)[0]), 8) for v in values])
    place = np.empty(len(row), np.int64)
    place[np.argsort(row, kind="stable")] = np.arange(len(row))
    x, y, a = np.empty((len(row), width), np.uint8), np.empty(len(row)), 0
    for value in values:
        part, _, label = _unpack(value.as_py(), width)
        to = place[a:a + len(part)]
        x[to], y[to], a = part, label, a + len(part)
    return x, np.sort(row), y


def _binned(df: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Blocks of rows (``data``: packed numbers, labels and bins) of (row, label, features)."""
    width = len(cuts)
    sent = df.sparkSession.sparkContext.broadcast(cuts)

    def run(batches):
        held, count = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                value = part.column("x").flatten().to_numpy().reshape(part.num_rows, width)
                x = np.empty(value.shape, np.uint8)
                for f, own in enumerate(sent.value):
                    x[:, f] = np.searchsorted(own, value[:, f], side="left")
                held.append((x, part.column("row").to_numpy(), part.column("label").to_numpy()))
                count += part.num_rows
                if count >= BLOCK_ROWS:
                    yield blocks(held)
                    held, count = [], 0
        if held:
            yield blocks(held)

    def blocks(held):
        return pa.RecordBatch.from_arrays([pa.array([_pack(*(np.concatenate(c) for c in zip(*held)))], pa.binary())], ["data"])

    rows = df.select("row", F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x"))
    return rows.mapInArrow(run, "data binary")


def _cuts(df: DataFrame, n: int, width: int, seed: int) -> list[np.ndarray]:
    """Each feature's limits, from about ``SAMPLE_ROWS`` rows; at most 31 numbers a feature come to the driver."""
    sample = df if n <= SAMPLE_ROWS else df.sample(SAMPLE_ROWS / n, seed)
    values = sample.select(F.posexplode(vector_to_array("features")).alias("feature", "value"))

    def each(table: pa.Table) -> pa.Table:
        value = table.column("value").to_numpy()
        found = limits(value[value != 0], int((value == 0).sum()))
        return pa.table({"feature": table.column("feature")[:1], "cuts": pa.array([found.tolist()], pa.list_(pa.float64()))})

    found = values.groupBy("feature").applyInArrow(each, "feature int, cuts array<double>").collect()
    cuts = {r.feature: np.array(r.cuts, float) for r in found}
    return [cuts.get(f, np.zeros(0)) for f in range(width)]


# ------------------------------------------------------------------ the top of the trees


@dataclass
class Shape:
    """Features looked at in a node, least rows of a leaf, greatest depth."""
    some: int
    least: float
    depth: int


@dataclass
class Top:
    """The upper nodes of one tree; the open ones' subtrees are grown apart."""
    nodes: list[list] = field(default_factory=list)     # feature, bin, left, p
    open: dict[int, tuple] = field(default_factory=dict)  # node -> path, depth, rows, positives

    def array(self) -> np.ndarray:
        return np.array([tuple(v) for v in self.nodes], NODE)


def _top(rows: DataFrame, trees: int, width: int, shape: Shape, seed: int) -> list[Top]:
    """Split every node of more than ``LOCAL_ROWS`` rows."""
    spark = rows.sparkSession

    def sums(batches):
        count = np.zeros((trees, 2))
        for batch in batches:
            for value in batch.column("data"):
                _, row, y = _unpack(value.as_py(), width)
                for t in range(trees):
                    w = weights(row, t, seed)
                    count[t] += w.sum(), w @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(trees), pa.int32()), pa.array(count[:, 0]), pa.array(count[:, 1])],
                                         ["tree", "n", "y"])

    tops = [Top() for _ in range(trees)]
    for r in rows.mapInArrow(sums, "tree int, n double, y double").groupBy("tree").agg(
            F.sum("n").alias("n"), F.sum("y").alias("y")).collect():
        tops[r.tree].nodes.append([-1, 0, 0, r.y / r.n if r.n else 0.5])
        tops[r.tree].open[0] = (int(_root(r.tree, seed)[0]), 0, r.n, r.y)
    some = min(shape.some, width)
    while True:
        big = [(t, k) for t, top in enumerate(tops) for k, (_, depth, n, y) in top.open.items()
               if n > LOCAL_ROWS and 0 < y < n and depth < shape.depth][:max(1, PASS_CELLS // (2 * some * BINS))]
        if not big:
            return tops
        asked: dict[int, list[int]] = {}
        for t, k in big:
            asked.setdefault(t, []).append(k)
        sent = spark.sparkContext.broadcast({t: (tops[t].array(), ks, np.array([tops[t].open[k][0] for k in ks], np.uint64))
                                             for t, ks in asked.items()})

        def histograms(batches):
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for value in batch.column("data"):
                    x, row, y = _unpack(value.as_py(), width)
                    for t, (nodes, ks, path) in sent.value.items():
                        w, at = weights(row, t, seed), leaves(nodes, x)
                        slot = np.full(len(nodes), -1)
                        slot[ks] = np.arange(len(ks))
                        own = np.flatnonzero((slot[at] >= 0) & (w > 0))
                        if t not in held:
                            held[t] = np.zeros((2, len(ks), some, BINS), np.int32)
                        features = choices(path, width, shape.some)
                        for a in range(0, len(own), max(1, STEP_CELLS // some)):
                            part = own[a:a + max(1, STEP_CELLS // some)]
                            n, ones = _rows(_histograms(x, part, w[part] + w[part] * y[part] * 2.0**26, slot[at[part]], features))
                            held[t][0] += n.astype(np.int32)
                            held[t][1] += ones.astype(np.int32)
            for t, value in held.items():
                for j, k in enumerate(sent.value[t][1]):
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([k], pa.int32()),
                                                      pa.array([value[:, j].tobytes()], pa.binary())], ["tree", "node", "value"])

        def pick(table: pa.Table) -> pa.Table:
            total = np.zeros(2 * some * BINS)
            for value in table.column("value"):
                total += np.frombuffer(value.as_buffer(), np.int32)
            n, y = total.reshape(2, 1, some, BINS)
            gain, place, cut, nl, yl = best_splits(n + y * 2.0**26, shape.least)
            t, k = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
            _, ks, path = sent.value[t]
            feature = choices(path[[ks.index(k)]], width, shape.some)[0, place[0]]
            return pa.table({"tree": [t], "node": [k], "gain": gain, "feature": [int(feature)], "cut": cut, "n": nl, "y": yl}).cast(
                pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("gain", pa.float64()), ("feature", pa.int32()),
                           ("cut", pa.int32()), ("n", pa.float64()), ("y", pa.float64())]))

        found = rows.mapInArrow(histograms, "tree int, node int, value binary").groupBy("tree", "node").applyInArrow(
            pick, "tree int, node int, gain double, feature int, cut int, n double, y double").collect()  # a row a node
        for r in found:
            top = tops[r.tree]
            path, depth, n, y = top.open.pop(r.node)
            if r.gain <= 0:
                continue
            left = len(top.nodes)
            top.nodes[r.node][:3] = r.feature, r.cut, left
            for way, (nc, yc) in zip(_below(np.array([path], np.uint64)), ((r.n, r.y), (n - r.n, y - r.y))):
                top.open[len(top.nodes)] = (int(way[0]), depth + 1, nc, yc)
                top.nodes.append([-1, 0, 0, yc / max(nc, 1)])
        sent.unpersist()


# ------------------------------------------------------------------ model


class ForestModel:
    """Subtrees (tree, node, batch, nodes) in the checkpoint folder, the trees' tops, and the limits of the bins."""

    def __init__(self, rows: DataFrame, tops: list[np.ndarray], cuts: list[np.ndarray]):
        self.rows, self.tops, self.cuts = rows, tops, cuts

    def transform(self, df: DataFrame) -> DataFrame:
        from litsift.models.classifiers import with_class

        spark = df.sparkSession
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        width, trees = len(self.cuts), len(self.tops)
        held = df.withColumn("_row", F.monotonically_increasing_id()).checkpoint()
        rows = _binned(held.select(F.col("_row").alias("row"), F.lit(0.0).alias("label"), "features"), self.cuts) \
            .withColumn("number", F.monotonically_increasing_id()).checkpoint()
        batches = self.rows.groupBy("batch").agg(F.collect_list(F.struct("tree", "node", "nodes")).alias("grown"))
        sent = spark.sparkContext.broadcast(self.tops)

        def score(pairs):
            number, row, total = None, None, None
            for pair in pairs:
                for block, data, grown in zip(*(pair.column(c) for c in ("number", "data", "grown"))):
                    if block.as_py() != number:  # a block meets its batches one after the other
                        if number is not None:
                            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(total)], ["row", "p"])
                        number, (x, row, _) = block.as_py(), _unpack(data.as_py(), width)
                        total = np.zeros(len(x))
                    tree, at = -1, None
                    for own in sorted(grown.as_py(), key=lambda g: g["tree"]):
                        if own["tree"] != tree:
                            tree, at = own["tree"], leaves(sent.value[own["tree"]], x)
                        nodes, here = np.frombuffer(own["nodes"], NODE), np.flatnonzero(at == own["node"])
                        if len(here):
                            total[here] += nodes["p"][leaves(nodes, x[here])]
            if number is not None:
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(total)], ["row", "p"])

        found = rows.crossJoin(batches.checkpoint()).mapInArrow(score, "row long, p double").groupBy("row").agg(
            (F.sum("p") / F.lit(float(trees))).alias("p_positive"))
        return with_class(held.join(found.withColumnRenamed("row", "_row"), "_row").drop("_row"))


def fit(df: DataFrame, trees: int, some: int | None, least: int, depth: int, seed: int) -> ForestModel:
    """A forest on (features, label); ``some`` features a node (all without it)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    held = df.select(F.monotonically_increasing_id().alias("row"), "label", "features").checkpoint()
    n, width = held.agg(F.count(F.lit(1)), F.max(F.size(vector_to_array("features")))).first()
    if not n:
        raise ValueError("no rows to fit on")
    shape = Shape(min(some or width, width), least, depth)
    cuts = _cuts(held, n, width, seed)
    rows = _binned(held, cuts).checkpoint()
    batches = max(1, -(-trees // BATCH_TREES))
    whole = n * 1.05 <= LOCAL_ROWS
    if whole:
        tops = [np.array([(-1, 0, 0, 0.0)], NODE)] * trees
        own = {(t, 0): (int(_root(t, seed)[0]), 0) for t in range(trees)}
        sent = spark.sparkContext.broadcast(own)
        dealt = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))).withColumn("node", F.lit(0))
    else:
        found = _top(rows, trees, width, shape, seed)
        tops = [top.array() for top in found]
        own = {(t, k): (v[0], v[1]) for t, top in enumerate(found) for k, v in top.open.items()}
        sent = spark.sparkContext.broadcast((own, tops))

        def deal(parts):
            own, tops = sent.value
            for part in parts:
                for value in part.column("data"):
                    x, row, y = _unpack(value.as_py(), width)
                    for t, nodes in enumerate(tops):
                        at, w = leaves(nodes, x), weights(row, t, seed)
                        for k in np.unique(at[w > 0]).tolist():
                            if (t, k) in own:
                                here = np.flatnonzero((at == k) & (w > 0))
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array([_pack(x[here], row[here], y[here])], pa.binary()), pa.array([t], pa.int32()),
                                     pa.array([k], pa.int32())], ["data", "part", "node"])

        dealt = rows.mapInArrow(deal, "data binary, part int, node int")

    def under(table: pa.Table) -> pa.Table:
        x, row, y = _gathered(table.column("data"), width)
        part, node = table.column("part")[0].as_py(), table.column("node")[0].as_py()
        paths = sent.value if whole else sent.value[0]
        out = {"tree": [], "nodes": []}
        for t in range(part, trees, batches) if whole else [part]:
            path, at = paths[t, node]
            out["tree"].append(t)
            out["nodes"].append(grow(x, y, weights(row, t, seed), np.array([path], np.uint64), at, shape).tobytes())
        return pa.table({"tree": pa.array(out["tree"], pa.int32()), "node": pa.array([node] * len(out["tree"]), pa.int32()),
                         "nodes": pa.array(out["nodes"], pa.binary())})

    grown = dealt.groupBy("part", "node").applyInArrow(under, "tree int, node int, nodes binary")
    if not whole:  # a top's node that was not split, and one without rows, is a leaf
        leaf = [(t, k, np.array([(-1, 0, 0, top[k]["p"])], NODE).tobytes()) for t, top in enumerate(tops)
                for k in range(len(top)) if top[k]["feature"] < 0 and (t, k) not in own]
        grown = grown.unionByName(spark.createDataFrame(leaf, "tree int, node int, nodes binary"))
    return ForestModel(grown.withColumn("batch", F.col("tree") % batches).checkpoint(), tops, cuts)


class ForestSpec:
    """A forest of deep trees (:mod:`litsift.models.forest`)."""

    def __init__(self, num_trees: int, all_features: bool = False, least: int = 1, depth: int = 30, seed: int = 42):
        self.num_trees, self.all_features, self.least, self.depth, self.seed = num_trees, all_features, least, depth, seed

    def fit(self, df: DataFrame) -> ForestModel:
        width = df.select(F.size(vector_to_array("features")).alias("d")).first()
        some = None if self.all_features or width is None else math.ceil(math.sqrt(width["d"]))
        return fit(df, self.num_trees, some, self.least, self.depth, self.seed)


def save_parts(model: ForestModel, path: str) -> dict:
    """Write a forest's subtrees; what is left for its description is returned."""
    model.rows.write.mode("overwrite").parquet(path + "/rows")
    return {"cuts": [c.tolist() for c in model.cuts], "tops": [[list(v) for v in top.tolist()] for top in model.tops]}


def load_parts(spark, path: str, meta: dict) -> ForestModel:
    tops = [np.array([tuple(v) for v in top], NODE) for top in meta["tops"]]
    return ForestModel(spark.read.parquet(path + "/rows"), tops, [np.array(c, float) for c in meta["cuts"]])
