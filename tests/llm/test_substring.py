import hashlib
import random

import pytest

from litsift.llm import substring

from .rows import ROWS, documents


def brute(rows, window):
    least = {}
    for doc_id, text in rows:
        own = (text or "").encode().split()
        for i in range(len(own) - window + 1):
            key = tuple(own[i:i + window])
            if doc_id is not None:
                least[key] = min(least.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        own = (text or "").encode().split()
        gone = set()
        for i in range(len(own) - window + 1):
            if doc_id is not None and least[tuple(own[i:i + window])] < doc_id:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(own) if i not in gone)
        out.append((str(doc_id), len(own), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.n_words, sum(r.spans[1::2]) - sum(r.spans[::2]), r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("window", [50, 24, 4])
def test_passages_against_brute_force(spark, window):
    draw = random.Random(window)
    passage = [[draw.choice("abcdefghij") + str(k) for k in range(draw.randrange(2, 80))] for _ in range(12)]
    rows = [(draw.randrange(60), " ".join(w for _ in range(draw.randrange(1, 5)) for w in draw.choice(passage)))
            for _ in range(70)] + [r[:2] for r in ROWS if r[0] != 6] + [(70, "a " * 120), (71, "a " * 60 + "b"), (72, "a\x0bb\x1cc " * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(substring.repeated(docs, window)) == brute(rows, window)


def test_awkward_rows(spark):
    assert result(substring.repeated(documents(spark))) == brute([r[:2] for r in ROWS], 50)
    assert substring.repeated(documents(spark).limit(0)).count() == 0


def test_levels():
    assert substring.levels(50) == [13, 25, 50] and substring.levels(7) == [7] and substring.levels(100) == [13, 25, 50, 100]


def test_fewer_windows_come_to_each_level(spark):
    draw = random.Random(8)
    shared = [[draw.choice("abcdefgh") + str(draw.randrange(30)) for _ in range(n)] for n in (14, 14, 30, 30, 60, 90)]
    rows = []
    for i in range(60):
        own = [f"w{i}x{k}" for k in range(60)]
        rows.append((i, " ".join(own[:30] + shared[i % 6] + own[30:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    (a, first, kept), (b, second, last) = substring.survivors(docs)
    assert (a, b) == (13, 25) and first > kept > 0 and second < first and second > last > 0
    assert result(substring.repeated(docs)) == brute(rows, 50)


@pytest.mark.parametrize("hot", [1, 1 << 40])
def test_a_passage_that_most_texts_share(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, f"{i} start {passage} end {i} " + " ".join(f"{i}x{k}" for k in range(i % 9 * 10))) for i in range(80)]
    assert result(substring.repeated(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 50)
