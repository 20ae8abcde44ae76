"""MinHash near-dedup with SetSketch registers.

Every shingle emits a Poisson process of points for ``REGISTERS`` registers; a register
keeps the least point of all shingles, truncated to a power of ``BASE``. Registers merge by
their maximum and are locality-sensitive: bands of equal register values give candidates.
A candidate's similarity is first estimated jointly from the counts of larger, smaller and
equal registers by maximum likelihood, then verified on the two full shingle sets.

Texts with equal sets are one class from the start. In a bucket the members are first
compared with one pivot, not with one another. Only where a bucket then holds several
components, members with so many shingles of their own that no link is possible go, and
the pairs between components that are left are compared in blocks of bounded size. So a
group of thousands of near copies of one text costs a few comparisons a member, no pair of
one component is compared or emitted, and no link between two members of a bucket is lost
that would join two components.

Null and empty texts have no shingles and are linked with nothing. Rows of equal text are
one class. A null id never names a component: its class takes the least id that is not
null; without one it is linked with no other class and its component is null. Rows that repeat an id with other texts are
separate texts under one id. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

REGISTERS, BAND = 125, 5
#: Ratio of neighbouring register values, and the rate of points of one shingle in one register.
BASE, RATE = 1.1, 20.0
#: Standard errors that an estimate may lie below the threshold before its pair is dropped.
MARGIN = 5.0
#: Bytes of sets in one block of a bucket that is compared pair by pair.
BLOCK_BYTES = 8 << 20
_SHINGLE_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Each row's sorted distinct hashes of ``width`` consecutive lower-cased words.

    A row of fewer words, but not none, has its whole sequence as the only shingle.
    """
    flat = common.LOWER[flat]
    starts, ends, first = common.find_words(flat, offsets)
    words = common.mix(common.word_hashes(flat, starts, ends))
    counts = np.diff(first)
    number = np.maximum(counts - width + 1, (counts > 0).astype(np.int64))
    cuts = np.concatenate([[0], np.cumsum(number)])
    row = np.repeat(np.arange(len(counts)), number)
    begin = first[row] + np.arange(cuts[-1]) - cuts[row]
    end = np.minimum(begin + width, first[row + 1])
    hashes = common.range_hash(words, begin, end, _SHINGLE_BASE)
    return [np.unique(hashes[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist())]


def registers(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """The registers of each set, as rows of m values; 0 throughout for an empty set."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.zeros((len(sets), m), np.uint16)
    todo, reach = np.flatnonzero(sizes), math.log(m * 1000.0)
    while len(todo):
        n = sizes[todo]
        least = np.full(len(todo) * m, np.inf)
        limit = reach / (RATE * n)
        shingle = np.concatenate([sets[i] for i in todo])
        row = np.repeat(np.arange(len(todo)), n)
        point = np.zeros(len(shingle))
        turn = 0
        while len(shingle):
            turn += 1
            draw = common.mix(shingle, turn)
            uniform = ((draw >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40
            point = point - np.log(uniform) / (RATE * m)
            live = point <= limit[row]
            shingle, row, point, draw = shingle[live], row[live], point[live], draw[live]
            place = ((draw & np.uint64(0xFFFFFF)) * np.uint64(m)) >> np.uint64(24)
            np.minimum.at(least, row * m + place.astype(np.int64), point)
        least = least.reshape(-1, m)
        full = np.isfinite(least).all(1)
        out[todo[full]] = np.maximum(np.floor(1.0 - np.log(least[full]) / math.log(BASE)), 0)
        todo, reach = todo[~full], reach * 2
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A hash of each band's number and register values: one row of keys for each sketch."""
    bands = regs.shape[1] // BAND
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(regs), 1))
    split = regs[:, :bands * BAND].reshape(len(regs), bands, BAND).astype(np.uint64)
    for k in range(BAND):
        key = common.mix(key * np.uint64(0xD6E8FEB86659FD93) + split[:, :, k], k)
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of pairs of sketches with known set sizes.

    By the register counts D+ (a larger), D- and D0 (equal), whose probabilities are
    p(u - vJ), p(v - uJ) and the rest, with p(x) = -log_b(1 - x (b - 1) / b) and u, v the
    shares of the two sizes.
    """
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE)

    up, down = chance(u - v * grid), chance(v - u * grid)
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = [np.where(d > 0, d * np.log(p), 0.0)
                 for d, p in ((more, up), (less, down), (same, np.maximum(1 - up - down, 0)))]
    best = np.argmax(sum(terms), axis=1)
    return grid[np.arange(len(best)), best]


def _digest(own: np.ndarray) -> tuple[int, int]:
    both = np.frombuffer(hashlib.md5(own.tobytes()).digest(), np.int64)
    return int(both[0]), int(both[1])


def _sketches(source: DataFrame, width: int) -> DataFrame:
    """(id, n, d1, d2, regs, keys) of every row; d1 and d2 are the digest of the whole set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                sets = shingle_sets(*common.raw(part.column("text")), width)
                regs = registers(sets)
                keys = band_keys(regs)
                filled = np.fromiter(map(len, sets), np.int64, len(sets))
                digests = np.array([_digest(s) for s in sets], np.int64).reshape(-1, 2)
                ends = np.concatenate([[0], np.cumsum(np.where(filled > 0, keys.shape[1], 0))])
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array(filled), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys[filled > 0].reshape(-1))),
                ], ["id", "n", "d1", "d2", "regs", "keys"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(common.task(run), f"id {kind}, n long, d1 long, d2 long, regs binary, keys array<long>")


def _full_sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, n, regs, members): the whole set of the text that each node stands for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                sets = shingle_sets(*common.raw(part.column("text")), width)
                right = np.array([_digest(s)[0] == n for s, n in zip(sets, part.column("node").to_pylist())], bool)
                yield pa.RecordBatch.from_arrays([
                    part.column("node"), part.column("n"), part.column("regs"),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ], ["node", "n", "regs", "members"]).filter(pa.array(right))

    return texts.mapInArrow(common.task(run), "node long, n long, regs binary, members binary")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with den * |a & b| >= num * |a | b|."""
    at = num / den
    floor = at - MARGIN * math.sqrt(at * (1 - at) / REGISTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                n_a, n_b = (part.column(c).to_numpy() for c in ("n_a", "n_b"))
                keep = den * np.minimum(n_a, n_b) >= num * np.maximum(n_a, n_b)
                regs = [np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                        for c in ("regs_a", "regs_b")]
                keep[keep] = estimate(regs[0][keep], regs[1][keep], n_a[keep], n_b[keep]) >= floor
                for i in np.flatnonzero(keep):
                    a, b = (np.frombuffer(part.column(c)[i].as_py(), np.uint64) for c in ("set_a", "set_b"))
                    keep[i] = _enough(a, b, num, den)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    def side(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"),
                           F.col("regs").alias(f"regs_{name}"), F.col("members").alias(f"set_{name}"))

    return pairs.join(side("b"), "b").join(side("a"), "a").select(
        "a", "b", "n_a", "n_b", "regs_a", "regs_b", "set_a", "set_b").mapInArrow(common.task(run), "a long, b long")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, n, most, comp, blocks) of the buckets that hold several components.

    ``blocks`` is how many parts of about BLOCK_BYTES a bucket's sets are compared in.
    """
    known = members.join(labels, "node", "left").select("key", "node", "n", "most",
                                                        F.coalesce("comp", "node").alias("comp"))
    several = known.groupBy("key").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"),
        F.ceil(F.sum("n") * 8 / BLOCK_BYTES).cast("long").alias("blocks")).filter("low < high")
    return known.join(several.select("key", "blocks"), "key")


def _joined(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between different components of a bucket, enough to join all that are linked.

    A bucket's sets meet block by block, so no task holds more than two blocks. A pair that
    shares several buckets is looked at in the first of its bands only.
    """
    at = num / den
    floor = at - MARGIN * math.sqrt(at * (1 - at) / REGISTERS)

    def run(table: pa.Table) -> pa.Table:
        _, first = np.unique(table.column("node").to_numpy(), return_index=True)
        table = table.take(pa.array(first)).combine_chunks()
        node, comp, n, most, block = (table.column(c).to_numpy() for c in ("node", "comp", "n", "most", "block"))
        regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("members").to_pylist()]
        keys, key = band_keys(regs), table.column("key")[0].as_py()
        two = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        root = {c: c for c in comp.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out: list[tuple[int, int]] = []
        for i in range(len(node)):
            j = np.arange(i + 1, len(node))
            shared = np.minimum(most[i], most[j])
            j = j[(comp[j] != comp[i]) & ((block[j] != block[i]) | (not two))
                  & (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j]))
                  & (den * shared >= num * (n[i] + n[j] - shared))]
            same = keys[j] == keys[i]
            j = j[keys[j, same.argmax(1)] == key] if len(j) else j
            if not len(j):
                continue
            likely = estimate(np.broadcast_to(regs[i], (len(j), REGISTERS)), regs[j],
                              np.full(len(j), n[i]), n[j])
            for k in j[np.argsort(-likely)][:int((likely >= floor).sum())].tolist():
                a, b = find(int(comp[i])), find(int(comp[k]))
                if a != b and _enough(sets[i], sets[k], num, den):
                    root[a] = b
                    out.append((int(node[i]), int(node[k])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    own = members.withColumn("block", F.expr("pmod(node, blocks)"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    own = own.select("key", "node", "n", "most", "comp", "block", F.least("block", "other").alias("low"),
                     F.greatest("block", "other").alias("high"))
    return own.join(sets.select("node", "regs", "members"), "node").groupBy("key", "low", "high").applyInArrow(
        run, "a long, b long")


def _enough(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether den * |a & b| >= num * |a | b|, for sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return den * both >= num * (len(a) + len(b) - both)


def _linkable(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(key, node, n, most) of the members that may have a link.

    ``most`` is the number of a set's shingles that another member's set holds, too. No
    intersection is larger, so a set with den * most < num * n has no link.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "members", 1 << 20):
                flat, offsets = common.raw(part.column("members"))
                node = np.repeat(part.column("node").to_numpy(), np.diff(offsets) // 8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node), pa.array(flat.copy().view(np.int64))], ["node", "shingle"])

    own = sets.join(members.select("node").distinct(), "node", "left_semi").select("node", "n", "members")
    shingles = own.select("node", "members").mapInArrow(common.task(run), "node long, shingle long")
    alone = shingles.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other")).filter(
        "node = other").groupBy("node").agg(F.count("*").alias("alone"))
    most = own.select("node", "n").distinct().join(alone, "node", "left").select(
        "node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("most")).filter(
        den * F.col("most") >= num * F.col("n"))
    return members.select("key", "node").join(most, "node")


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Two texts are linked if den * (shingles in both) >= num * (shingles in either);
    component_id is the least id that links lead to.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    scratch = common.Scratch(spark, "setsketch")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = scratch.keep(_sketches(source, width), "rows")
    n_rows = rows.count()
    classes = scratch.keep(
        rows.filter("n > 0").groupBy(F.col("d1").alias("node"), "d2")
        .agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("regs").alias("regs"),
             F.first("keys").alias("keys")).drop("d2"), "classes", n_rows)

    banded = classes.select("node", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    members = scratch.keep(banded.join(shared, "key").select("key", "node", "low"), "members", n_rows)
    wanted = members.select("node").distinct().join(classes.select("node", "id", "n", "regs"), "node")
    sets = scratch.keep(_full_sets(source.join(wanted, "id").select("node", "n", "regs", "text"), width), "sets")

    near = members.filter("node <> low")
    links = scratch.keep(_verified(near.select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(),
                                   sets, num, den), "links-0")
    labels = components(links, scratch, "labels-0")
    known = near.join(labels, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    several = known.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least < most")
    still = _linkable(known.join(several, "key").select("key", "node"), sets, num, den)
    still = scratch.keep(_open(still, labels), "open", n_rows)
    more = scratch.keep(_joined(still, sets, num, den), "links-1")
    if more.limit(1).count():
        labels = components(links.union(more), scratch, "labels-1")

    named = classes.select("node", "id").join(labels, "node", "left").select(
        "node", "id", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = named.join(least, "comp").select(F.col("node").alias("d1"), "component_id")
    out = rows.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("d1")).alias("d1"))
    out = out.join(named, "d1", "left").select(
        F.col("id").alias(id_col), "n_shingles",
        F.when(F.col("d1").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out


def op10_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component at 85 of 100 shared three-word shingles."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85, 100)
    return found.withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
