"""Hard-negative mining over rotated one-bit codes.

Each vector is turned by ``TURNS`` fixed random rotations of its length, and only the signs are
kept: its code. The code, turned back, is a direction near the vector's own; stored beside it are
the vector's length, the direction's length and the cosine of the angle between both (the
alignment). An anchor's turned vector is cut to ``PLANES`` bits a component, so its product with
a code is a sum of popcounts. What the popcounts leave open is bounded: the cut by the sum of the
absolute rests, the part of the vector beside the code's direction by Cauchy and Schwarz. So
every score lies in an interval that is certain, and only pairs whose interval can reach the
wanted scores are scored on the integer components. No result depends on the code.

The index of all rows is written once. Anchors are a stated query set: they are read in blocks of
``BLOCK`` and sent to where the index is. Each task keeps a short list for each anchor, first of
its nearest rows of the same label (positives), then of the highest rows of other labels in each
positive's window (negatives), and the lists are merged by anchor. No label or anchor gathers
rows in one task beyond these lists.

Rows without id, label or vector, with an empty vector or with a null or non-finite component
take no part, nor do those with a component so large that an inner product could leave a long
(beyond the root of 2^62 / length). Only vectors of one length meet. A row that repeats an id is
a row of its own; "other rows" than an anchor are those with another id. A repeated anchor row
gives its results again. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, prepare

#: Rotations of a code: so many bits for each component.
TURNS = 4
#: Bits of an anchor's turned components.
PLANES = 6
#: Anchors sent to the executors at once, on average.
BLOCK = 4096
#: Rows of the index and anchors that are compared at once, and pairs that are scored at once.
ROWS, ANCHORS, PAIRS = 1024, 256, 1 << 15

_INDEX = "id long, label long, parts array<long>, code binary, size double, spread double, aligned double"


def rotations(length: int) -> np.ndarray:
    """The rows of ``TURNS`` rotations, one below the other; the same for every task."""
    out = []
    for turn in range(TURNS):
        q, r = np.linalg.qr(np.random.default_rng((length, turn)).standard_normal((length, length)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out)


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as words of 64."""
    pad = -bits.shape[-1] % 64
    bits = np.concatenate([bits, np.zeros((*bits.shape[:-1], pad), bool)], -1)
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (words), lengths of the vectors and of the codes' directions, and alignments."""
    turn = rotations(vectors.shape[1])
    vectors = vectors.astype(np.float64)
    turned = vectors @ turn.T
    bits = turned >= 0
    direction = np.where(bits, 1.0, -1.0) @ turn
    size, spread = np.linalg.norm(vectors, axis=1), np.linalg.norm(direction, axis=1)
    scale = np.where(size > 0, size, 1.0) * np.where(spread > 0, spread, 1.0)
    aligned = np.clip((vectors * direction).sum(1) / scale, 0.0, 1.0)
    return _pack(bits), size, spread, aligned


class Anchors:
    """A block of anchors of one vector length, ready to meet codes."""

    def __init__(self, number: np.ndarray, ids: np.ndarray, label: np.ndarray, parts: np.ndarray):
        self.number, self.ids, self.label, self.parts = number, ids, label, parts
        vectors = parts.astype(np.float64)
        self.size = np.linalg.norm(vectors, axis=1)
        turned = (vectors / np.where(self.size > 0, self.size, 1.0)[:, None]) @ rotations(parts.shape[1]).T
        self.low = turned.min(1)
        self.step = np.maximum(turned.max(1) - self.low, 1e-12) / (2**PLANES - 1)
        whole = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.rest = np.abs(turned - self.low[:, None] - whole * self.step[:, None]).sum(1)
        self.total, self.bits = whole.sum(1), turned.shape[1]
        self.planes = np.stack([_pack((whole >> j & 1).astype(bool)) for j in range(PLANES)])

    def interval(self, pick: np.ndarray, code: np.ndarray, size: np.ndarray, spread: np.ndarray,
                 aligned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the inner products of rows (down) and picked anchors (across)."""
        pop = np.zeros((len(code), len(pick)), np.int64)
        for j in range(PLANES):
            plane = self.planes[j][pick]
            same = np.zeros(pop.shape, np.uint16)
            for w in range(code.shape[1]):
                same += np.bitwise_count(code[:, w, None] & plane[None, :, w])
            pop += same.astype(np.int64) << j
        ones = np.bitwise_count(code).sum(1, dtype=np.int64)
        product = self.low[pick] * (2 * ones - self.bits)[:, None] + self.step[pick] * (2 * pop - self.total[pick])
        # the cosine of the anchor and the code's direction, as an interval; of codes that cancel out nothing is known
        spread = np.where(spread > 0, spread, 1.0)
        off = self.rest[pick][None, :] / spread[:, None] + 1e-9
        cosine = product / spread[:, None]
        down, up = np.clip(cosine - off, -1.0, 1.0), np.clip(cosine + off, -1.0, 1.0)
        near = aligned[:, None]
        side = np.sqrt(1.0 - near * near)
        at = np.where(up < near, up, down)
        high = np.where((down <= near) & (near <= up), 1.0, near * at + side * np.sqrt(1.0 - at * at))
        at = np.where(down > -near, down, up)
        low = np.where((down <= -near) & (-near <= up), -1.0, near * at - side * np.sqrt(1.0 - at * at))
        scale = size[:, None] * self.size[pick]
        slack = 1e-7 * scale + 0.5
        return low * scale - slack, high * scale + slack

    def scores(self, rows: np.ndarray, row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """The integer inner products of pairs."""
        out = np.empty(len(row), np.int64)
        for a in range(0, len(row), PAIRS):
            b = slice(a, a + PAIRS)
            out[b] = np.einsum("ij,ij->i", rows[row[b]], self.parts[anchor[b]])
        return out


class Lists:
    """The best ``k`` (score, id) of each of ``n`` keys, higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.key, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        #: What a score must reach to enter a key's list.
        self.least = np.full(n, -np.inf)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(key):
            return
        key, score, ids = (np.concatenate(x) for x in ((self.key, key), (self.score, score), (self.ids, ids)))
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        last = rank == self.k - 1
        self.least[key[last]] = score[last]
        keep = rank < self.k
        self.key, self.score, self.ids = key[keep], score[keep], ids[keep]


# ------------------------------------------------------------------ tasks


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of the index of one vector length: ids, labels, components, codes, sizes, spreads, alignments."""
    for batch in batches:
        length = np.diff(batch.column("parts").offsets.to_numpy())
        for own in np.unique(length):
            same = batch.filter(pa.array(length == own))
            for a in range(0, same.num_rows, ROWS):
                part = same.slice(a, ROWS)
                parts = part.column("parts").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, own)
                code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint64).reshape(part.num_rows, -1)
                yield (part.column("id").to_numpy(), part.column("label").to_numpy(), parts, code,
                       *(part.column(c).to_numpy() for c in ("size", "spread", "aligned")))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "label", "parts", "code", "size", "spread", "aligned"]
    for batch in batches:
        length = np.diff(batch.column("parts").offsets.to_numpy())
        for own in np.unique(length):
            same = batch.filter(pa.array(length == own))
            for a in range(0, same.num_rows, ROWS):
                part = same.slice(a, ROWS)
                parts = part.column("parts").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, own)
                code, *numbers = encode(parts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"), part.column("parts"),
                     pa.array([c.tobytes() for c in code], pa.binary()), *map(pa.array, numbers)], names)


def _blocks(rows: list) -> dict[int, Anchors]:
    """The anchors of a block by their vectors' length."""
    lengths: dict[int, list] = {}
    for r in rows:
        lengths.setdefault(len(r[3]), []).append(r)
    return {n: Anchors(np.array([r[0] for r in own], np.int64), np.array([r[1] for r in own], np.int64),
                       np.array([r[2] for r in own], np.int64), np.array([r[3] for r in own], np.int64))
            for n, own in lengths.items()}


def _nearest(batches: Iterator[pa.RecordBatch], sent, k: int) -> Iterator[pa.RecordBatch]:
    """Each anchor's best ``k`` rows of its label in this task: (anchor, id, score)."""
    blocks = _blocks(sent.value)
    lists = {n: Lists(len(own.ids), k) for n, own in blocks.items()}
    for ids, label, parts, code, size, spread, aligned in _chunks(batches):
        own, held = blocks.get(parts.shape[1]), lists.get(parts.shape[1])
        if own is None:
            continue
        for value in np.intersect1d(label, own.label):
            rows, every = np.flatnonzero(label == value), np.flatnonzero(own.label == value)
            for a in range(0, len(every), ANCHORS):
                pick = every[a:a + ANCHORS]
                low, high = own.interval(pick, code[rows], size[rows], spread[rows], aligned[rows])
                other = ids[rows][:, None] != own.ids[pick]
                least = held.least[pick]
                if len(rows) >= k:  # so many rows surely reach the k-th highest lower bound
                    low[~other] = -np.inf
                    least = np.maximum(least, np.partition(low, len(rows) - k, axis=0)[len(rows) - k])
                r, c = np.nonzero(other & (high >= least))
                score = own.scores(parts, rows[r], pick[c])
                held.add(pick[c], score, ids[rows[r]])
    for n, held in lists.items():
        yield pa.RecordBatch.from_arrays([pa.array(blocks[n].number[held.key]), pa.array(held.ids), pa.array(held.score)],
                                         ["anchor", "id", "score"])


def _hardest(batches: Iterator[pa.RecordBatch], sent, windows, slots: int, k: int) -> Iterator[pa.RecordBatch]:
    """For each anchor and positive, the best ``k`` rows of other labels in its window: (anchor, slot, id, score)."""
    blocks = _blocks(sent.value)
    lists = {n: Lists(len(own.ids) * slots, k) for n, own in blocks.items()}
    limits = {}
    for n, own in blocks.items():
        low, high = np.full((len(own.ids), slots), np.inf), np.full((len(own.ids), slots), -np.inf)
        place = {x: i for i, x in enumerate(own.number.tolist())}
        for anchor, slot, floor, ceiling in windows.value:
            if anchor in place:
                low[place[anchor], slot], high[place[anchor], slot] = floor, ceiling
        limits[n] = low, high
    for ids, label, parts, code, size, spread, aligned in _chunks(batches):
        own, held = blocks.get(parts.shape[1]), lists.get(parts.shape[1])
        if own is None:
            continue
        floor, ceiling = limits[parts.shape[1]]
        for a in range(0, len(own.ids), ANCHORS):
            pick = np.arange(a, min(a + ANCHORS, len(own.ids)))
            low, high = own.interval(pick, code, size, spread, aligned)
            least = np.maximum(floor[pick], held.least.reshape(-1, slots)[pick])
            some = np.zeros(low.shape, bool)
            for s in range(slots):
                some |= (high >= least[:, s]) & (low <= ceiling[pick, s])
            r, c = np.nonzero(some & (label[:, None] != own.label[pick]))
            score = own.scores(parts, r, pick[c])
            for s in range(slots):
                fits = (score >= least[c, s]) & (score <= ceiling[pick[c], s])
                held.add(pick[c[fits]] * slots + s, score[fits], ids[r[fits]])
    for n, held in lists.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks[n].number[held.key // slots]), pa.array((held.key % slots).astype(np.int32)),
             pa.array(held.ids), pa.array(held.score)], ["anchor", "slot", "id", "score"])


# ------------------------------------------------------------------ the operator


def whole(components: Column, unit: int = 256) -> Column:
    """A vector's integer components; null if it takes no part."""
    scaled = F.transform(components, lambda x: F.floor(x.cast("double") * unit))
    # a null or non-finite component, or one too large, makes the test null or false
    fits = F.forall(components, lambda x: F.coalesce(
        F.abs(x.cast("double")) * unit <= F.floor(F.sqrt(F.lit(2.0**62) / F.size(components))), F.lit(False)))
    return F.when(fits & (F.size(components) > 0), scaled)


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """Negatives for each anchor and positive of (id, label, parts, anchor): ``parts`` whole numbers, ``anchor`` boolean.

    Returns (anchor_id, positive_id, rank, negative_id, positive_score, negative_score,
    positive_rank). A negative's score is ``least`` to ``most`` hundredths of its positive's.
    """
    spark = vectors.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "hardneg")
    rows = vectors.filter("id is not null and label is not null and parts is not null")
    rows = rows.select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("parts").cast("array<long>"), "anchor")
    index = scratch.keep(rows.drop("anchor").mapInArrow(_encode, _INDEX), "index")
    anchors = scratch.keep(rows.filter("anchor").select(F.monotonically_increasing_id().alias("number"), "id", "label",
                                                        "parts"), "anchors")
    blocks = max(1, -(-anchors.count() // BLOCK))
    out = scratch.path("found")
    by_score = [F.col("score").desc(), F.col("id")]
    for k in range(blocks):
        own = anchors.filter(F.pmod(F.xxhash64("number"), F.lit(blocks)) == k)
        sent = spark.sparkContext.broadcast([tuple(r) for r in own.collect()])  # a block at a time
        near = index.mapInArrow(lambda b, sent=sent: _nearest(b, sent, positives), "anchor long, id long, score long")
        ranked = F.row_number().over(Window.partitionBy("anchor").orderBy(*by_score))
        near = near.select("*", ranked.alias("rank")).filter(F.col("rank") <= positives)
        near = scratch.keep(near, f"positives-{k}").join(own.select(F.col("number").alias("anchor"), F.col("id").alias(
            "anchor_id")), "anchor")
        near = near.select("anchor", "anchor_id", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"),
                           F.col("score").alias("positive_score"))
        # at most `positives` rows for each anchor of the block
        windows = spark.sparkContext.broadcast([
            (r.anchor, r.slot, -(-r.positive_score * least // 100), r.positive_score * most // 100)
            for r in near.select("anchor", "slot", "positive_score").collect()])
        hard = index.mapInArrow(lambda b, sent=sent, windows=windows: _hardest(b, sent, windows, positives, negatives),
                                "anchor long, slot int, id long, score long")
        ranked = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(*by_score))
        hard = hard.select("*", ranked.alias("rank")).filter(F.col("rank") <= negatives)
        hard.join(near, ["anchor", "slot"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"), (F.col("slot") + 1).alias("positive_rank")) \
            .write.mode("append").parquet(out)
        sent.unpersist()
        windows.unpersist()
    return spark.read.schema("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
                             "negative_score long, positive_rank int").parquet(out)


def op13_onebit_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to ten hard negatives for each of the five nearest rows of every hundredth vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(rows.select(F.col("vec_id").alias("id"), label.alias("label"), whole(F.col("embedding")).alias("parts"),
                            (F.col("vec_id") % 100 == 0).alias("anchor")))
