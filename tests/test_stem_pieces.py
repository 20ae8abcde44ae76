"""The stemmer reads a batch a piece at a time and keeps rows, nulls and order."""

import pyarrow as pa
from pyspark.sql import functions as F

from litsift.functions import text
from litsift.functions.stem import stem


def rows(n):
    return [None if i % 7 == 0 else [None if j % 5 == 4 else f"running{i}s" for j in range(i % 4)] for i in range(n)]


def stemmed(rows):
    return [None if r is None else [stem(t) for t in r] for r in rows]


def test_a_large_batch_comes_back_in_pieces():
    own = rows(3 * text.PIECE + 5)
    kind = pa.list_(pa.string())
    # a slice of a longer array, and an empty batch
    batches = [pa.array([["first"], *own], kind).slice(1), pa.array([], kind)]
    got = list(text.stem_tokens.func(iter(batches)))
    assert [len(x) for x in got] == [text.PIECE] * 3 + [5]
    assert [r for x in got for r in x.to_pylist()] == stemmed(own)


def test_rows_stay_beside_their_tokens(spark):
    own = list(enumerate(rows(2000)))
    df = spark.createDataFrame(own, "i int, t array<string>").coalesce(1)
    got = df.select("i", text.stem_tokens("t").alias("a"), text.stem_words(F.concat(F.lit("nearly"), F.col("i").cast("string"))).alias("b"))
    for r in got.collect():
        assert r.a == stemmed([own[r.i][1]])[0] and r.b == stem(f"nearly{r.i}")
