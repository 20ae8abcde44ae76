"""Language ID by prediction by partial matching.

For each language a byte context tree of up to ``ORDER`` bytes holds how often each byte
followed each context. A byte's code length under a language is that of its longest known
context; a byte not seen there pays the context's escape (method C: kinds / (count + kinds))
and is coded by the next shorter one, at last uniformly over the byte values. The counts are frozen,
so each (context, byte) has one code length per language, and a text's exact code lengths are
sums of table entries. The counts are sent to the tasks, which lay them out as tables.

The trees are fitted on a bounded sample of the distinct labelled texts, ``FIT_ROWS`` a
language, chosen by a hash of the text; the contexts of a language's table are its own ``CONTEXTS``
most frequent of each length, the others back off to their suffix. Every language is learned, and
its table doesn't depend on the others: languages are scored ``BLOCK`` at a time, and the code
lengths of all blocks compared.

A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing
is labelled. Ties go to the first language by name. Repeated rows are predicted one by one;
a null id is carried through and counts as held out only by its remainder, so it is null.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER = 3
#: Distinct labelled texts of each language that are fitted, at most (in expectation).
FIT_ROWS = 1500
#: Contexts of each length that a language's table holds.
CONTEXTS = 6000
#: Languages whose tables (at most 19 MB each) a task holds at once.
BLOCK = 8
UNKNOWN = "und"


def _counts(texts: DataFrame) -> DataFrame:
    """(lang, code, n): how often each byte follows the ORDER bytes before it (fewer at a text's start)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", 1 << 20):
                langs = part.column("lang").to_pylist()
                flat, offsets = common.raw(part.column("text"))
                for lang in sorted(set(langs)):
                    codes = [_codes(flat[offsets[i]:offsets[i + 1]]) for i, x in enumerate(langs) if x == lang]
                    code, n = np.unique(np.concatenate(codes), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n)], ["lang", "code", "n"])

    return texts.mapInArrow(common.task(run), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _codes(data: np.ndarray) -> np.ndarray:
    """For each byte its value and the ORDER bytes before it, each plus 1 and 0 before the start."""
    wide = np.concatenate([np.zeros(ORDER, np.int64), data.astype(np.int64) + 1])
    code = np.zeros(len(data), np.int64)
    for k in range(ORDER + 1):
        code = code * 257 + wide[k:k + len(data)]
    return code


class Model:
    """Frozen context trees of a block of languages, laid out as tables of code lengths.

    Each language has its own contexts and its own table, the same whatever languages stand
    beside it. ``state`` leads from the bytes before a byte to the longest context that any of
    them knows, and ``rows`` from there to each language's row.
    """

    def __init__(self, languages: list[str], codes: list[np.ndarray], counts: list[np.ndarray],
                 contexts: int = CONTEXTS):
        self.languages = languages
        seen = np.unique(np.concatenate([c % 257 for c in codes] + [np.zeros(1, np.int64)]))
        # bytes get small numbers: 0 before the start, 1 for a byte never seen, then the seen ones
        self.number = np.ones(256, np.int64)
        seen = seen[seen > 0] - 1
        self.number[seen] = np.arange(len(seen)) + 2
        size = self.size = len(seen) + 2
        renumber = np.ones(257, np.int64)
        renumber[0], renumber[1:] = 0, self.number
        place = [np.stack([renumber[c // 257**(ORDER - k) % 257] for k in range(ORDER + 1)]) for c in codes]
        flat = [sum(p[k] * size**(ORDER - k) for k in range(ORDER + 1)) for p in place]
        known = [np.zeros(1, np.int64) for _ in languages]
        tables = [[self._coded(np.zeros(1, np.int64), 0, code, n, np.full((1, size), 1 / 256))]
                  for code, n in zip(flat, counts)]
        first = [1 for _ in languages]
        every, row = np.zeros(1, np.int64), np.zeros((1, len(languages)), np.int32)
        rows, state, base = [row], np.zeros(size**ORDER, np.int32), 1
        for order in range(1, ORDER + 1):
            for k, (code, n) in enumerate(zip(flat, counts)):
                context, at = np.unique(code // size % size**order, return_inverse=True)
                kept = np.sort(context[np.lexsort((context, -np.bincount(at, n)))[:contexts]])
                parent = kept % size**(order - 1)
                at = np.minimum(np.searchsorted(known[k], parent), max(len(known[k]) - 1, 0))
                ok = known[k][at] == parent if len(known[k]) else np.zeros(len(kept), bool)
                known[k] = kept[ok]
                tables[k].append(self._coded(kept[ok], order, code, n, tables[k][-1][at[ok]]))
            shorter, every = every, np.unique(np.concatenate(known))
            row = row[np.searchsorted(shorter, every % size**(order - 1))]
            for k, own in enumerate(known):
                row[np.searchsorted(every, own), k] = first[k] + np.arange(len(own))
                first[k] += len(own)
            rows.append(row)
            state.reshape(-1, size**order)[:, every] = base + np.arange(len(every))
            base += len(every)
        self.state = state
        self.rows = np.ascontiguousarray(np.concatenate(rows).T)
        self.tables = [-np.log2(np.concatenate(t)).astype(np.float32).ravel() for t in tables]

    def _coded(self, contexts: np.ndarray, order: int, code: np.ndarray, n: np.ndarray,
               shorter: np.ndarray) -> np.ndarray:
        """Probability of each byte in each context, given those of the shorter context."""
        if not len(contexts):
            return shorter.copy()
        context, symbol = code // self.size % self.size**order, code % self.size
        at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
        use = contexts[at] == context
        own = np.bincount(at[use] * self.size + symbol[use], n[use], len(contexts) * self.size)
        own = own.reshape(len(contexts), self.size)
        total, kinds = own.sum(1, keepdims=True), (own > 0).sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            coded = np.where(own > 0, own / (total + kinds), kinds / (total + kinds) * shorter)
        return np.where(total > 0, coded, shorter)

    def lengths(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        rows = len(offsets) - 1
        out = np.zeros((rows, len(self.languages)))
        step = 1 << 20
        for a in range(0, len(flat), step):
            b = min(a + step, len(flat))
            before = np.zeros(b - a, np.int64)
            symbols = self.number[flat[max(a - ORDER, 0):b]]
            pad = ORDER - (a - max(a - ORDER, 0))
            wide = np.concatenate([np.zeros(pad, np.int64), symbols])
            lo, hi = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
            starts = offsets[lo:hi]
            for k in range(ORDER):  # the byte ORDER - k places back, or 0 before the text's start
                value = wide[k:k + b - a].copy()
                for back in range(ORDER - k):
                    edge = starts + back
                    value[edge[(edge >= a) & (edge < b)] - a] = 0
                before = before * self.size + value
            state, symbol = self.state[before], wide[ORDER:]
            cuts = np.unique(np.clip(starts, a, b) - a)
            cuts = cuts[cuts < b - a]
            row = np.searchsorted(offsets, cuts + a, "right") - 1
            for k, table in enumerate(self.tables):
                bits = table[self.rows[k][state] * self.size + symbol]
                out[row, k] += np.add.reduceat(bits, cuts, dtype=np.float64)
        return out


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> list[Broadcast] | None:
    """Learn from the rows with a text and a language: blocks of languages by name, with their counts. None without any."""
    spark = labelled.sparkSession
    common.prepare(spark)
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(
        F.col("lang").isNotNull() & (F.length("text") > 0))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n"))
    sizes = {r.lang: r.n for r in sizes.collect()}
    if not sizes:
        return None
    often = {k: FIT_ROWS / n for k, n in sizes.items() if n > FIT_ROWS}
    share = F.lit(1.0)
    if often:
        share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in often.items() for x in kv]), F.col("lang")), share)
    draw = (F.xxhash64("text").bitwiseAND(F.lit((1 << 40) - 1))) / F.lit(float(1 << 40))
    counts = common.Scratch(spark, "langid").keep(_counts(rows.filter(draw < share).dropDuplicates()), "counts")
    names, blocks = sorted(sizes), []
    for i in range(0, len(names), BLOCK):
        part = counts.filter(F.col("lang").isin(names[i:i + BLOCK])).toArrow()
        lang = part.column("lang").to_numpy()
        code, n = part.column("code").to_numpy(), part.column("n").to_numpy()
        own = sorted(set(lang))
        if own:
            blocks.append(spark.sparkContext.broadcast((own, [code[lang == k] for k in own], [n[lang == k] for k in own])))
    return blocks or None


def predict(docs: DataFrame, model: list[Broadcast] | None, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits, n_bytes): score is the language's share of the likelihood."""
    common.prepare(docs.sparkSession)
    blocks = model or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = None
        for batch in batches:
            parts = list(common.slices(batch, "text"))
            raws = [common.raw(part.column("text")) for part in parts]
            best = [np.full(part.num_rows, np.inf) for part in parts]
            total = [np.zeros(part.num_rows) for part in parts]
            names = [np.full(part.num_rows, UNKNOWN, object) for part in parts]
            for block in blocks:  # one block's tables at a time; the only block's stay for the task
                if built is None or len(blocks) > 1:
                    built = None
                    built = Model(*block.value)
                for i, (flat, offsets) in enumerate(raws):
                    bits = built.lengths(flat, offsets)
                    least = np.minimum(best[i], bits.min(1))
                    total[i] = total[i] * np.exp2(least - best[i]) + np.exp2(least[:, None] - bits).sum(1)
                    better = least < best[i]
                    names[i][better] = np.array(built.languages, object)[bits.argmin(1)[better]]
                    best[i] = least
            for i, part in enumerate(parts):
                ok = np.array([t is not None and any(map(str.isalpha, t)) for t in part.column("text").to_pylist()], bool)
                ok &= bool(blocks)
                names[i][~ok] = UNKNOWN
                score = np.divide(1.0, total[i], out=np.zeros(len(ok)), where=ok)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(names[i], pa.string()), pa.array(score),
                     pa.array(best[i] if blocks else np.zeros(len(ok))), pa.array(np.diff(raws[i][1]))],
                    ["id", "lang_pred", "score", "bits", "n_bytes"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(common.task(run), f"id {kind}, lang_pred string, score double, bits double, n_bytes long"
                             ).withColumnRenamed("id", id_col)


def held_out() -> Column:
    """Whether a document is kept from fitting: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op5_ppm_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, fit(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
