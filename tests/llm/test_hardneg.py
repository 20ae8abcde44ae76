import math
import random

import duckdb
import numpy as np
import pytest

from litsift.llm import hardneg
from litsift.llm.queries import ORACLES

SF = "/root/testdata/sf0.01"


def plain(table):
    """What the contract asks for of (vec_id, embedding, label) rows, pair by pair."""
    rows = []
    for vec_id, vector, label in table:
        if vec_id is None or label is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        rows.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in vector]))
    out = []
    for a in rows:
        if a[0] % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in rows if len(a[2]) == len(b[2])]
        scored.sort()
        for score, positive, _ in [s for s in scored if s[2] == a[1] and s[1] != a[0]][:5]:
            fits = [s for s in scored if s[2] != a[1] and 30 * -score <= 100 * -s[0] <= 90 * -score][:10]
            out += [(a[0], positive, k, s[1], -score, -s[0]) for k, s in enumerate(fits, 1)]
    return sorted(out)


def query(spark, tmp_path, table, extra=""):
    path = str(tmp_path / "sf")
    spark.createDataFrame(table, "vec_id long, embedding array<float>, label int" + extra).write.parquet(f"{path}/embeddings.parquet")
    got = hardneg.op13_onebit_negatives(spark, path)
    assert got.columns[:6] == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r)[:6] for r in got.collect())


def cloud(n, length, seed, spread=0.35):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((4, length))
    out = []
    for i in range(n):
        v = centres[i % 4] + spread * draw.standard_normal(length)
        out.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(draw.integers(3))))
    return out


@pytest.mark.parametrize("length", [1, 3, 17, 64, 100])
def test_against_all_pairs(spark, tmp_path, length):
    table = cloud(900, length, length)
    assert query(spark, tmp_path, table) == plain(table)


def test_small_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK", 2)
    table = cloud(700, 8, 1)
    assert query(spark, tmp_path, table) == plain(table)


def test_awkward_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    table = cloud(400, 5, 2) + cloud(150, 6, 3) + [
        (100, None, 1), (101, [0.5, None, 0.1, 0.2, 0.3], 1), (200, [nan] * 5, 2), (300, [inf, 0.0, 0.0, 0.0, 0.0], 1),
        (None, [0.1] * 5, 1), (1000, [0.1] * 5, None), (1100, [], 1), (1200, [0.0] * 5, 1), (1300, [-0.5] * 5, 2)]
    table += [(2000 + i // 3, [0.25, 0.5, 0.0, 0.125, -0.25], i % 2) for i in range(60)]  # ties and repeated ids
    table = [(*r, 1.0, "x") for r in table]
    assert query(spark, tmp_path, table, ", score double, parts string") == plain([r[:3] for r in table])


def test_one_hot_vector_and_label(spark, tmp_path):
    table = [(i, [1.0, 0.5, 0.25], 3) for i in range(600)] + [(1000 + i, [0.5, 0.25, 0.125 * (i % 3)], i % 4) for i in range(300)]
    assert query(spark, tmp_path, table) == plain(table)


def test_empty_table(spark, tmp_path):
    assert query(spark, tmp_path, []) == []


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(ORACLES["op13_onebit_negatives"]).fetchall()
    got = hardneg.op13_onebit_negatives(spark, SF).collect()
    assert want and sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("length", [1, 2, 5, 64, 130])
def test_every_interval_holds_its_score(length):
    draw = np.random.default_rng(length)
    rows = draw.integers(-300, 300, (400, length))
    rows[:5] = 0
    rows[5:9] = rows[20]
    code, *numbers = hardneg.encode(rows)
    own = hardneg.Anchors(np.arange(60), np.arange(60), np.zeros(60, int), rows[:60])
    low, high = own.interval(np.arange(60), code, *numbers)
    scores = rows @ rows[:60].T
    assert ((low <= scores) & (scores <= high)).all()
    if length >= 64:  # and is of use: far narrower than all that is possible
        scale = np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(rows[:60], axis=1)
        assert np.median((high - low)[9:, 9:] / (2 * scale[9:, 9:])) < 0.5


def test_lists_keep_the_best():
    random.seed(1)
    held, every = hardneg.Lists(4, 3), []
    for _ in range(20):
        new = [(random.randrange(4), random.randrange(6), random.randrange(50)) for _ in range(9)]
        every += new
        held.add(*(np.array(x) for x in zip(*new)))
    want = [x for k in range(4) for x in sorted((e for e in every if e[0] == k), key=lambda e: (-e[1], e[2]))[:3]]
    assert list(zip(held.key.tolist(), held.score.tolist(), held.ids.tolist())) == want
