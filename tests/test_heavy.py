from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from litsift.operators import heavy


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=60), min_size=1, max_size=5), st.integers(1, 12))
def test_bounds_of_added_summaries(parts, counters):
    sums, error = Counter(), 0
    for part in parts:
        term, n, off = np.zeros(0, object), np.zeros(0, np.int64), 0
        for x in range(0, len(part), 7):
            both = Counter(dict(zip(term.tolist(), n.tolist())))
            both.update(part[x:x + 7])
            term, n, more = heavy.reduced(np.array(list(both), object), np.array(list(both.values()), np.int64), counters)
            assert len(term) <= counters
            off += more
        sums.update(dict(zip(term.tolist(), n.tolist())))
        error += off
    for x, n in Counter(v for part in parts for v in part).items():
        assert sums[x] <= n <= sums[x] + error


@pytest.mark.parametrize("counters", [None, 8, 2])
def test_exact_top_terms(spark, counters):
    draw = np.random.default_rng(1)
    docs = [[f"w{min(int(z), 3000)}" for z in draw.zipf(1.3, int(draw.integers(0, 60)))] for _ in range(400)] + [[], None]
    df = spark.createDataFrame([(d,) for d in docs], "tokens array<string>").repartition(5)
    counts = Counter(t for d in docs for t in d or ())
    want = [(t, n, i) for i, (t, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:20], 1)]
    got, proof = heavy.heavy_terms(df, 20, counters=counters)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == want
    assert proof.error == 0 or proof.kth > proof.error
    if counters == 2:
        assert proof.counters > 2  # the first summaries were too small


def test_ties_few_terms_and_no_rows(spark):
    df = spark.createDataFrame([(["b", "a", "c"],), (["c", "a", "b"],)], "tokens array<string>")
    assert [tuple(r) for r in heavy.heavy_terms(df, 2)[0].orderBy("term_rank").collect()] == [("a", 2, 1), ("b", 2, 2)]
    assert heavy.heavy_terms(df, 9)[0].count() == 3
    assert heavy.heavy_terms(df.limit(0), 3)[0].count() == 0


def test_no_shuffle_of_all_terms(spark):
    docs = [([f"rare{i}x{j}" for j in range(30)] + ["often"] * 5 + ["also"] * 4,) for i in range(300)]
    df = spark.createDataFrame(docs, "tokens array<string>").repartition(3)
    got, proof = heavy.heavy_terms(df, 2, counters=50)
    assert [r.term for r in got.orderBy("term_rank").collect()] == ["often", "also"]
    assert 0 < proof.error < proof.kth and proof.candidates <= 40 and proof.counters == 50
