"""The most frequent terms of a corpus without a shuffle of all distinct terms.

Each task keeps a summary of a bounded number of counters: when there are more, the next
largest count is taken off all of them, and what was taken off is the summary's error. Summaries
add up, and so do their errors: a term's true count is at least the sum of its counters and at most
that plus the sum of all errors. Terms that could be among the first ``k`` by these bounds are counted
exactly in a second pass. A term that isn't among them is below the k-th counter by its upper bound, so none is
missed: the bounds are the certificate. Where the error leaves too many candidates, the summaries
are made anew with more counters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litsift.session import ensure_checkpoint_dir, ship_package

#: Counters of a task's summary for each term asked for, and candidates at most that are counted exactly.
COUNTERS, CANDIDATES = 40, 20


@dataclass
class Certificate:
    """Why no term is missing: all others are at most ``others``, the k-th of the terms found at least ``kth``."""
    counters: int
    error: int
    candidates: int
    others: int
    kth: int


def reduced(term: np.ndarray, n: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A summary cut to so many counters, and what was taken off each."""
    if len(n) <= counters:
        return term, n, 0
    off = int(np.partition(n, len(n) - counters - 1)[len(n) - counters - 1])
    keep = n > off
    return term[keep], n[keep] - off, off


def _summaries(tokens: DataFrame, counters: int) -> DataFrame:
    """(term, n) counters of each task, and its error under a null term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, n, error = np.zeros(0, object), np.zeros(0, np.int64), 0
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.column(0).slice(a, 256).flatten()
                found = pc.value_counts(part.drop_null())
                both = pa.table({"term": pa.concat_arrays([pa.array(term, pa.string()), found.field("values").cast(pa.string())]),
                                 "n": pa.concat_arrays([pa.array(n, pa.int64()), found.field("counts")])})
                both = both.group_by("term").aggregate([("n", "sum")])
                term, n, off = reduced(both.column("term").to_numpy(), both.column("n_sum").to_numpy(), counters)
                error += off
        yield pa.RecordBatch.from_arrays([pa.array([None, *term], pa.string()), pa.array([error, *n], pa.int64())], ["term", "n"])

    return tokens.mapInArrow(run, "term string, n long")


def heavy_terms(tokens: DataFrame, k: int, col: str = "tokens", counters: int | None = None) -> tuple[DataFrame, Certificate]:
    """(term, n, term_rank) of the ``k`` most frequent terms of an array column, ties by term, and the certificate."""
    spark = tokens.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    tokens = tokens.select(F.col(col).alias("t"))
    counters = counters or COUNTERS * k
    while True:
        sums = _summaries(tokens, counters).groupBy("term").agg(F.sum("n").alias("n")).checkpoint()
        error = sums.filter("term is null").agg(F.sum("n")).first()[0] or 0
        sums = sums.filter("term is not null")
        top = sums.orderBy(F.desc("n")).limit(k).agg(F.min("n").alias("kth"), F.count(F.lit(1)).alias("found")).first()
        # fewer terms than asked for: all that any summary holds may be wanted, and all are held if nothing was taken off
        kth = top.kth if top.found == k else 0
        could = sums.filter(F.col("n") + F.lit(error) >= F.lit(kth))
        n_could = could.count()
        if error == 0 or (kth > error and n_could <= CANDIDATES * k):
            break
        counters *= 4
    words = could if error else sums.orderBy(F.desc("n"), F.asc("term")).limit(k)
    exact = tokens.select(F.explode("t").alias("term")).join(F.broadcast(words.select("term")), "term") \
        .groupBy("term").agg(F.count(F.lit(1)).alias("n"))  # CANDIDATES * k words at most
    best = exact.orderBy(F.desc("n"), F.asc("term")).limit(k)
    best = best.withColumn("term_rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("term"))))
    # a term without a counter was seen at most `error` times, one that is no candidate less than `kth` times
    return best, Certificate(counters, error, n_could, max(error, kth - 1) if error else kth, kth)
