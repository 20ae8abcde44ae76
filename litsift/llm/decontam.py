"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of one task, cut by bytes. Its words become symbols: those
that occur in a test phrase get their own, every other word is the same gap, and runs of
known words too short to hold any phrase go, as nothing can be found in them. Over the
symbols stand a suffix array (prefix doubling on unresolved groups), its Burrows-Wheeler
transform in a wavelet matrix with popcount ranks, and sampled suffix positions. All test
phrases are searched backward together; the occurrences' places come from walks to the next
sample, and each document's hits are merged into removal spans.

The test phrases are a stated query set. They are read on the driver in blocks of about
``BLOCK_BYTES`` of text (a longer item is a block of its own), one pass over the documents for
each. A pass adds its spans to those of the pass before, whose result it reads from a written
table, so one block is broadcast at a time.

Null or empty documents have no words and no hits; null or empty items have no phrases. An
item without an id marks words but is never listed. Repeated items or rows count as they
stand, an item_id once. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words of a test phrase; an item of fewer words is one phrase.
PHRASE_WORDS = 10
#: Bytes of benchmark text sent to the executors at once.
BLOCK_BYTES = 16 << 20
#: Bytes of documents in one shard; one longer document is a shard of its own.
SHARD_BYTES = 2 << 20
#: Every so many positions of a shard's symbols have their suffix's place kept.
SAMPLE = 8

#: Bytes outside words become spaces; A-Z become lower case.
_CLEAN = bytearray(common.LOWER.tobytes())
for _b in [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]:
    _CLEAN[_b] = 0x20
_CLEAN = bytes(_CLEAN)
_CLEANED = np.frombuffer(_CLEAN, np.uint8)
_GAPS = np.arange(256) == 0x20


def words(text: bytes) -> list[bytes]:
    """The lower-cased runs of digits, letters and characters beyond ASCII."""
    return text.translate(_CLEAN).split()


class Phrases:
    """The distinct test phrases of one block of items, as rows of symbols."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        self.symbol: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            own = [self.symbol.setdefault(w, len(self.symbol) + 2) for w in words((text or "").encode())]
            for k in range(max(1, len(own) - PHRASE_WORDS + 1) if own else 0):
                owners = found.setdefault(tuple(own[k:k + PHRASE_WORDS]), set())
                if item_id is not None:
                    owners.add(item_id)
        self.lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.rows = np.zeros((len(found), PHRASE_WORDS), np.int64)
        for i, phrase in enumerate(found):
            self.rows[i, PHRASE_WORDS - len(phrase):] = phrase
        names = sorted({x for owners in found.values() for x in owners})
        number = {x: i for i, x in enumerate(names)}
        self.names = np.array(names, object)
        self.owner_cuts = np.cumsum([0, *map(len, found.values())])
        self.owners = np.array([number[x] for owners in found.values() for x in sorted(owners)], np.int64)
        self.shortest = int(self.lengths.min()) if len(found) else 0
        vocabulary = list(self.symbol)
        self.flat = np.frombuffer(b"".join(vocabulary), np.uint8)
        self.ends = np.cumsum(np.fromiter(map(len, vocabulary), np.int64, len(vocabulary)))
        self.starts = self.ends - np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))
        for odd in range(1, 1000, 2):  # a base under which no two of the words have the same hash
            self.base = np.uint64(0x9E3779B97F4A7C55 + 2 * odd)
            hashes = common.word_hashes(self.flat, self.starts, self.ends, self.base)
            self.order = np.argsort(hashes)
            self.hashes = hashes[self.order]
            if (self.hashes[1:] != self.hashes[:-1]).all():
                break

    def symbols(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The symbol of each word of a cleaned text, 1 for those of no phrase.

        A word is looked up by its hash, and its bytes are compared with those of the word found.
        """
        out = np.ones(len(starts), np.int64)
        if not len(self.hashes) or not len(starts):
            return out
        hashes = common.word_hashes(flat, starts, ends, self.base)
        slot = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = self.order[slot]
        same = np.flatnonzero((self.hashes[slot] == hashes) & (self.ends[found] - self.starts[found] == ends - starts))
        for a in range(0, len(same), 1 << 15):
            part = same[a:a + (1 << 15)]
            size = ends[part] - starts[part]
            first = np.cumsum(size) - size
            step = np.arange(int(size.sum())) - np.repeat(first, size)
            equal = flat[np.repeat(starts[part], size) + step] == self.flat[np.repeat(self.starts[found[part]], size) + step]
            part = part[np.logical_and.reduceat(equal, first)]
            out[part] = found[part] + 2
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the sorted suffixes; the shorter of two that agree comes first."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    head = np.concatenate([[True], np.diff(text[order]) != 0]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    step = 1
    while True:
        alone = head & np.concatenate([head[1:], [True]]) if n else head
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return order
        at = order[slots]
        nxt = at + step
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)], -1)
        first = rank[at]
        by = np.lexsort((second, first))
        order[slots] = at[by]
        first, second = first[by], second[by]
        new = np.concatenate([[True], (np.diff(first) != 0) | (np.diff(second) != 0)])
        head[slots] = new
        rank[at[by]] = slots[np.flatnonzero(new)[np.cumsum(new) - 1]]
        step *= 2


class Bits:
    """A bit vector with constant-time ranks: counts before each word of 64, and popcounts."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros(-len(bits) % 64 + 64, bool)
        self.words = np.packbits(np.concatenate([bits, pad]), bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int64)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word = i >> 6
        low = self.words[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class FmIndex:
    """Backward search and location over one shard's symbols (all of them 1 or more)."""

    def __init__(self, symbols: np.ndarray):
        self.text = text = np.concatenate([symbols, [0]]).astype(np.int64)
        order = suffix_array(text)
        last = text[order - 1]
        self.sigma = int(text.max()) + 1
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self.levels: list[tuple[int, Bits, int]] = []
        row = last
        for bit in range(max(1, (self.sigma - 1).bit_length()) - 1, -1, -1):
            ones = (row >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(ones), int(len(row) - ones.sum())))
            row = np.concatenate([row[~ones], row[ones]])
        self.base = np.full(self.sigma, 0, np.int64)
        seen, first = np.unique(row, return_index=True)
        self.base[seen] = first
        sampled = order % SAMPLE == 0
        self.sampled, self.places = Bits(sampled), order[sampled]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before position i."""
        for bit, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where(symbol >> bit & 1 == 1, zeros + ones, i - ones)
        return i - self.base[symbol]

    def search(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each right-aligned phrase."""
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(self.text))
        width = rows.shape[1]
        live = np.flatnonzero((rows < self.sigma).all(1))
        dead = np.ones(len(rows), bool)
        dead[live] = False
        for k in range(width - 1, -1, -1):
            live = live[(low[live] < high[live])]
            now = live[lengths[live] >= width - k]
            symbol = rows[now, k]
            seen = self.starts[symbol + 1] > self.starts[symbol]
            dead[now[~seen]] = True
            high[now[~seen]] = low[now[~seen]]
            now, symbol = now[seen], symbol[seen]
            low[now] = self.starts[symbol] + self.rank(symbol, low[now])
            high[now] = self.starts[symbol] + self.rank(symbol, high[now])
        high[dead] = low[dead]
        return low, np.maximum(low, high)

    def locate(self, slots: np.ndarray) -> np.ndarray:
        """The text position of each suffix, by steps back to a sampled one."""
        out, steps = np.empty(len(slots), np.int64), 0
        left = np.arange(len(slots))
        while len(left):
            hit = self.sampled.get(slots)
            out[left[hit]] = self.places[self.sampled.rank(slots[hit])] + steps
            left, slots = left[~hit], slots[~hit]
            if len(left):
                symbol = self._symbol(slots)
                slots = self.starts[symbol] + self.rank(symbol, slots)
            steps += 1
        return out

    def _symbol(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for bit, bits, zeros in self.levels:
            one, ones = bits.get(i), bits.rank(i)
            out |= one.astype(np.int64) << bit
            i = np.where(one, zeros + ones, i - ones)
        return out


def find(symbols: np.ndarray, cuts: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all occurrences in a shard's words, and the number of each phrase.

    ``symbols`` are the words' symbols (1: in no phrase), ``cuts`` the first word of each document.
    """
    none = np.zeros(0, np.int64)
    if not phrases.shortest or not len(symbols):
        return none, none, none
    known = symbols > 1
    turn = np.zeros(len(symbols) + 1, bool)
    turn[1:-1] = known[1:] != known[:-1]
    turn[cuts] = True
    turn[0] = turn[-1] = True
    edges = np.flatnonzero(turn)
    begin, stop = edges[:-1], edges[1:]
    use = known[begin] & (stop - begin >= phrases.shortest)
    begin, stop = begin[use], stop[use]
    if not len(begin):
        return none, none, none
    size = stop - begin + 1  # and a gap after each run
    start = np.cumsum(size) - size
    place = np.repeat(begin - start, size) + np.arange(size.sum())
    text = symbols[np.minimum(place, len(symbols) - 1)]
    text[start + size - 1] = 1
    index = FmIndex(text)
    low, high = index.search(phrases.rows, phrases.lengths)
    number = np.repeat(np.arange(len(low)), high - low)
    first = np.cumsum(high - low) - (high - low)
    slots = np.arange(len(number)) - first[number] + low[number]
    at = place[index.locate(slots)]
    return at, at + phrases.lengths[number], number


def _shard(part: pa.RecordBatch, phrases: Phrases) -> tuple[list[int], list[list[int]], list[list[str]]]:
    """For each document of a shard: words, merged spans (flat starts and ends), items."""
    flat, offsets = common.raw(part.column("text"))
    flat = _CLEANED[flat]
    first, last, cuts = common.find_words(flat, offsets, _GAPS)
    counts = np.diff(cuts)
    symbols = phrases.symbols(flat, first, last)
    del flat, first, last
    start, end, number = find(symbols, cuts[:-1], phrases)
    change = np.zeros(len(symbols) + 2, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    hit = np.cumsum(change)[:len(symbols) + 1] > 0
    turn = np.zeros(len(symbols) + 1, bool)
    turn[1:] = hit[1:] != hit[:-1]
    turn[0] = hit[0]
    turn[cuts[(cuts > 0) & (cuts < len(symbols))]] |= hit[cuts[(cuts > 0) & (cuts < len(symbols))]]
    opens = np.flatnonzero(turn & hit)
    row = np.searchsorted(cuts, opens, "right") - 1
    closed = np.append(np.flatnonzero(turn), len(symbols))
    shut = np.minimum(closed[np.searchsorted(closed, opens, "right")], cuts[row + 1])
    spans: list[list[int]] = [[] for _ in counts]
    for r, a, b in zip(row.tolist(), (opens - cuts[row]).tolist(), (shut - cuts[row]).tolist()):
        spans[r] += (a, b)
    items: list[set[str]] = [set() for _ in counts]
    pairs = np.unique(np.stack([np.searchsorted(cuts, start, "right") - 1, number]), axis=1)
    for r, p in pairs.T.tolist():
        items[r].update(phrases.names[phrases.owners[phrases.owner_cuts[p]:phrases.owner_cuts[p + 1]]])
    return counts.tolist(), spans, [sorted(x) for x in items]


def _merged(a: list[int], b: list[int]) -> list[int]:
    """The union of two sorted lists of spans, overlapping and touching ones joined."""
    out: list[int] = []
    for start, end in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += (start, end)
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[bool, list[tuple[str | None, str | None]]]]:
    """The items in blocks of about BLOCK_BYTES of text, dealt by row, and whether more follow."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    if blocks > 1:
        items = common.Scratch(items.sparkSession, "items").keep(
            items.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))), "items")
    for k in range(blocks):
        own = items if blocks == 1 else items.filter(F.col("block") == k)
        yield k + 1 < blocks, [(r.item, r.text) for r in own.collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text, n_words, spans, items) of every row of ``docs``.

    ``spans`` are the merged word ranges to remove, as starts and ends in turn; ``items`` the
    ids, as strings, of the benchmark items with an occurring phrase.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = out.schema["id"].dataType.simpleString()
    schema = f"id {kind}, text string, n_words long, spans array<long>, items array<string>"
    out = out.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("spans"),
                     F.array().cast("array<string>").alias("items"))
    scratch, turn = common.Scratch(spark, "decontam"), 0
    for more, block in _blocks(benchmark, item_col, item_text):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(sent.value)
            for batch in batches:
                for part in common.slices(batch, "text", SHARD_BYTES):
                    counts, spans, items = _shard(part, phrases)
                    old_spans, old_items = part.column("spans").to_pylist(), part.column("items").to_pylist()
                    spans = [_merged(a, b) if a else b for a, b in zip(old_spans, spans)]
                    items = [sorted({*a, *b}) if a else b for a, b in zip(old_items, items)]
                    yield pa.RecordBatch.from_arrays([
                        part.column("id"), part.column("text"), pa.array(counts, pa.int64()),
                        pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())),
                    ], ["id", "text", "n_words", "spans", "items"])

        out = out.mapInArrow(common.task(run), schema)
        if more:
            out = scratch.keep(out, str(turn))
            sent.unpersist()
            if turn:
                scratch.drop(str(turn - 1))
            turn += 1
    return out.withColumnsRenamed({"id": id_col, "text": text_col})


def hit_words() -> Column:
    """The number of words in ``spans``."""
    return F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (s, x) -> s + x)")


def op3_fm_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, words hit by benchmark phrases, and the items they come from."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                          spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = hit_words()
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
