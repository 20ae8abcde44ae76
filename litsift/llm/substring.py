"""Substring dedup by level-wise doubling of repeated windows.

The levels are the final window's length and its halves down to ``LEAST`` words, from the shortest
up (13, 25, 50). At a level every final window stands for the window of that length inside it with the
least hash: equal final windows choose equal ones, so a final window can repeat only if its
chosen window does. Windows that stand in two different texts survive; the final windows that chose
them, and these alone, go on to the next level of twice the length, until none is left or the
final length is reached, whose windows are compared by a hash of 128 bits. Longer repeats are unions of
final windows. How many windows come to each level and survive it is kept (:func:`survivors`).

A window that very many texts share is looked up where its rows are, others by a shuffle.

A whole text that equals one with a smaller id is settled by its digest, without windows.

A word is removed if a window over it also starts in a document with a smaller id; all
windows are judged on the input. Null and empty texts have no words. Rows that repeat an id
don't remove each other's words unless a smaller id has them. A null id is no smaller id,
and nothing is smaller than it, so its words stay. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words of a final window.
WINDOW = 50
#: Words of the shortest level's windows, at least.
LEAST = 12
#: Windows of at least one in so many rows are broadcast; there can't be more of them than that.
HOT = 4096
_BASES = tuple(np.uint64(b) for b in (0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
_EMPTY = hashlib.sha256(b"").hexdigest()


def word_runs(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Mixed word hashes of a slice, each row's first word, and each row's words."""
    flat, offsets = common.raw(part.column("text"))
    starts, ends, first = common.find_words(flat, offsets)
    data = flat.tobytes()
    split = [data[a:b].split() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
    return common.mix(common.word_hashes(flat, starts, ends)), first, split


def levels(window: int) -> list[int]:
    """The lengths of a window's levels: each half of the next, rounded up."""
    out = [window]
    while -(-out[0] // 2) >= LEAST:
        out.insert(0, -(-out[0] // 2))
    return out


def chosen(words: np.ndarray, first: np.ndarray, window: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Final windows' first words, for each the first word of its window of least hash, and these windows' hashes."""
    starts = [np.arange(a, b - window + 1) for a, b in zip(first.tolist(), first[1:].tolist()) if b - a >= window]
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    begin = np.arange(len(words) - length + 1)
    hashes = common.range_hash(words, begin, begin + length, _BASES[0])
    value, place, span, width = hashes, begin, 1, window - length + 1
    while span < width:  # the least of ``span`` windows, the first of equal ones
        step = min(span, width - span)
        left, right = value[:-step], value[step:]
        place = np.where(right < left, place[step:], place[:-step])
        value = np.minimum(left, right)
        span += step
    return starts, place[starts], hashes


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _long(digest: str, part: int) -> int:
    return int.from_bytes(bytes.fromhex(digest[16 * part:16 * part + 16]), "big", signed=True)


def _shortest(source: DataFrame, window: int) -> DataFrame:
    """(id, n, digest, d1, d2, grams, places) of every row: the windows chosen at the first level."""
    length = levels(window)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                words, first, split = word_runs(part)
                _, place, hashes = chosen(words, first, window, length)
                place = np.unique(place)
                cuts = np.searchsorted(place, first).astype(np.int32)
                row = np.searchsorted(first, place, "right") - 1
                digests = [_digest(w) for w in split]
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array(np.diff(first)), pa.array(digests, pa.string()),
                    pa.array([_long(d, 0) for d in digests], pa.int64()),
                    pa.array([_long(d, 1) for d in digests], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(hashes[place].view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array((place - first[row]).astype(np.int32))),
                ], ["id", "n", "digest", "d1", "d2", "grams", "places"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(
        common.task(run), f"id {kind}, n long, digest string, d1 long, d2 long, grams array<long>, places array<int>")


def _live(part: pa.RecordBatch, window: int, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mixed words, each row's first word, and the final windows whose choice at the level before survived."""
    words, first, _ = word_runs(part)
    start, place, _ = chosen(words, first, window, before)
    places = part.column("places")
    live = np.zeros(len(words) + 1, bool)
    counts = np.diff(places.offsets.to_numpy())
    live[np.repeat(first[:-1], counts) + places.flatten().to_numpy()] = True
    return words, first, start[live[place]]


def _longer(texts: DataFrame, window: int, before: int, length: int) -> DataFrame:
    """(id, d1, d2, grams, places): the windows of ``length`` that the live final windows choose."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                words, first, start = _live(part, window, before)
                every, place, hashes = chosen(words, first, window, length)
                place = np.unique(place[np.searchsorted(every, start)])
                cuts = pa.array(np.searchsorted(place, first).astype(np.int32))
                row = np.searchsorted(first, place, "right") - 1
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), part.column("d1"), part.column("d2"),
                    pa.ListArray.from_arrays(cuts, pa.array(hashes[place].view(np.int64))),
                    pa.ListArray.from_arrays(cuts, pa.array((place - first[row]).astype(np.int32))),
                ], ["id", "d1", "d2", "grams", "places"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(common.task(run), f"id {kind}, d1 long, d2 long, grams array<long>, places array<int>")


def _final(texts: DataFrame, window: int, before: int) -> DataFrame:
    """(id, d1, h1, h2, starts): the live final windows of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                words, first, start = _live(part, window, before)
                both = [common.range_hash(words, start, start + window, b).view(np.int64) for b in _BASES[1:]]
                cuts = pa.array(np.searchsorted(start, first).astype(np.int32))
                row = np.searchsorted(first, start, "right") - 1
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), part.column("d1"),
                    *(pa.ListArray.from_arrays(cuts, pa.array(h)) for h in both),
                    pa.ListArray.from_arrays(cuts, pa.array((start - first[row]).astype(np.int32))),
                ], ["id", "d1", "h1", "h2", "starts"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(common.task(run), f"id {kind}, d1 long, h1 array<long>, h2 array<long>, starts array<int>")


def _surviving(rows: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """(id, d1, d2, places) of the texts with windows that another text has as well."""
    each = rows.select("id", "d1", "d2", F.explode(F.arrays_zip("grams", "places")).alias("x"))
    each = each.select("id", "d1", "d2", "x.grams", "x.places")
    twice = each.groupBy("grams").agg(F.min("d1").alias("low"), F.max("d1").alias("high"), F.count(F.lit(1)).alias("n"))
    twice = scratch.keep(twice.filter("low < high").select("grams", "n"), name)
    return common.lookup(each, twice, "grams", "n", HOT).groupBy("id", "d1", "d2").agg(
        F.array_sort(F.collect_set("places")).alias("places"))


def _kept(texts: DataFrame, window: int) -> DataFrame:
    """(id, d1, spans, digest): merged spans of the removed windows and the digest of the other words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                spans, digests = [], []
                for text, starts in zip(part.column("text").to_pylist(), part.column("starts").to_pylist()):
                    own, merged = text.encode().split(), []
                    for s in sorted(starts):
                        if merged and s <= merged[-1]:
                            merged[-1] = s + window
                        else:
                            merged += (s, s + window)
                    spans.append(merged)
                    stay = [0, *merged, len(own)]
                    digests.append(_digest([w for a, b in zip(stay[::2], stay[1::2]) for w in own[a:b]]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("d1"), pa.array(spans, pa.list_(pa.int64())),
                     pa.array(digests, pa.string())], ["id", "d1", "spans", "digest"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(common.task(run), f"id {kind}, d1 long, spans array<long>, digest string")


def _texts(source: DataFrame, window: int, scratch: common.Scratch) -> tuple[DataFrame, DataFrame, list[int]]:
    """Every row's digests, the texts with final windows left after all levels but the last, and the levels.

    Each level's windows are in the table ``level-<length>``, and those that survived in ``found-<length>``.
    """
    steps = levels(window)
    rows = scratch.keep(_shortest(source, window), f"level-{steps[0]}")
    classes = rows.filter(F.col("n") >= window).groupBy("d1", "d2").agg(F.min("id").alias("least"))
    alive = _surviving(rows, scratch, f"found-{steps[0]}") if len(steps) > 1 else rows.select("id", "d1", "d2", "places")
    # a text that equals one with a smaller id needs no windows of its own from here on
    alive = alive.join(classes, ["d1", "d2"]).filter(~_larger("id", "least")).select("id", "d1", "d2", "places")
    texts = source.join(alive, "id").filter(_first_long(F.col("text")) == F.col("d1"))
    texts = scratch.keep(texts.select("id", "d1", "d2", "text", "places"), "texts-0")
    for k, length in enumerate(steps[1:-1], 1):
        own = scratch.keep(_longer(texts, window, steps[k - 1], length), f"level-{length}")
        alive = _surviving(own, scratch, f"found-{length}").select("id", "d1", F.col("places").alias("left"))
        texts = scratch.keep(texts.join(alive, ["id", "d1"]).select("id", "d1", "d2", "text", F.col("left").alias("places")),
                             f"texts-{k}")
    return rows, texts, steps


def survivors(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, int, int]]:
    """(length, windows looked at, windows that two texts share) of each level but the last."""
    spark = docs.sparkSession
    common.prepare(spark)
    scratch = common.Scratch(spark, "substring")
    steps = _texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), window, scratch)[2]
    out = []
    for length in steps[:-1]:
        own, found = (spark.read.parquet(scratch.path(f"{name}-{length}")) for name in ("level", "found"))
        out.append((length, own.agg(F.sum(F.size("grams"))).first()[0] or 0, found.agg(F.sum("n")).first()[0] or 0))
    return out


def repeated(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, kept_sha256) of every row.

    ``spans`` are the merged word ranges to remove, starts and ends in turn; the digest is of
    the other words joined by one space.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    scratch = common.Scratch(spark, "substring")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows, texts, steps = _texts(source, window, scratch)
    classes = rows.filter(F.col("n") >= window).groupBy("d1", "d2").agg(F.min("id").alias("least"))

    windows = scratch.keep(_final(texts, window, steps[-2] if len(steps) > 1 else window), "windows")
    windows = windows.select("id", "d1", F.explode(F.arrays_zip("h1", "h2", "starts")).alias("x"))
    windows = windows.select("id", "d1", "x.h1", "x.h2", "x.starts")
    owners = windows.groupBy("h1", "h2").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n"))
    owners = scratch.keep(owners.filter("low < high").select("h1", "h2", "low", "n"), "owners")
    gone = common.lookup(windows, owners, ["h1", "h2"], "n", HOT).filter("low < id").groupBy("id", "d1").agg(
        F.collect_set("starts").alias("starts"))
    cut = _kept(texts.select("id", "d1", "text").join(gone, ["id", "d1"]), window).dropDuplicates(["id", "d1"])

    out = rows.select("id", "n", "digest", "d1", "d2").join(classes, ["d1", "d2"], "left")
    out = out.join(cut.withColumnRenamed("digest", "left_digest"), ["id", "d1"], "left")
    copy = (F.col("n") >= window) & _larger("id", "least")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_words"),
        F.when(copy, F.array(F.lit(0).cast("long"), "n")).otherwise(
            F.coalesce("spans", F.array().cast("array<long>"))).alias("spans"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("left_digest", "digest")).alias("kept_sha256"))


def _larger(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) > F.col(b), F.lit(False))


def _first_long(text: Column) -> Column:
    """d1 of a text, as the row's digest has it."""
    words = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.conv(F.substring(F.sha2(words, 256), 1, 16), 16, -10).cast("long")


def op8_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, how many of them are removed, and the digest of the rest."""
    found = repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (s, x) -> s + x)")
    return found.select("doc_id", "n_words", removed.alias("n_removed"), "kept_sha256")
