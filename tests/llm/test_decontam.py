import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from litsift.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    """Per document: words, hit positions, item ids."""
    phrases = {}
    for item, text in items:
        own = split(text)
        for k in range(max(1, len(own) - 9) if own else 0):
            phrases.setdefault(tuple(own[k:k + 10]), set()).add(item)
    out = []
    for text in docs:
        own, hit, found = split(text), set(), set()
        for phrase, owners in phrases.items():
            for i in range(len(own) - len(phrase) + 1):
                if tuple(own[i:i + len(phrase)]) == phrase:
                    hit.update(range(i, i + len(phrase)))
                    found |= owners - {None}
        out.append((len(own), sorted(hit), sorted(found)))
    return out


def spread(flat):
    assert all(a < b for a, b in zip(flat, flat[1:]))
    return [i for a, b in zip(flat[::2], flat[1::2]) for i in range(a, b)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60))
def test_suffix_array_and_index_agree_with_scans(symbols):
    text = np.array(symbols)
    assert decontam.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: symbols[i:])
    index = decontam.FmIndex(text)
    rows, lengths = [], []
    for n in (1, 2, 3):
        for start in range(0, len(symbols), 2):
            phrase = symbols[start:start + n]
            rows.append([0] * (3 - len(phrase)) + phrase)
            lengths.append(len(phrase))
    rows.append([0, 0, 9])
    lengths.append(1)
    low, high = index.search(np.array(rows), np.array(lengths))
    for row, n, a, b in zip(rows, lengths, low, high):
        phrase = row[3 - n:]
        want = [i for i in range(len(symbols)) if symbols[i:i + n] == phrase]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


DOCS = [
    (1, "a b c d e f g h i j k l m", "x"), (1, "a b c d e f g h i j k l m", "x"), (2, None, None), (3, "", "x"),
    (4, "  ... !!", "x"), (None, "q A-B-C-D-E-F-G-H-I-J z", "x"), (5, "short one here short one", "x"),
    (6, "é ö 世界 two " + "a b c d e f g h i j " * 400, "x"), (7, "a b c d e f g h i", "x"), (8, "j", None),
    (9, "w0 " * 30 + " ".join(f"t{i}" for i in range(25)), "x"),
]
ITEMS = [(10, "A b c d e f g h i j k"), (2, "short one"), (3, None), (4, "..."), (None, "世界"),
         (7, " ".join(f"t{i}" for i in range(25))), (7, " ".join(f"t{i}" for i in range(25))), (11, "w0 " * 12)]


@pytest.mark.parametrize("block", [16 << 20, 40])
def test_documents_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, spans string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.contamination(docs, items).collect()
    want = brute([d[1] for d in DOCS], [(None if i is None else str(i), t) for i, t in ITEMS])
    have = sorted((str(r.doc_id), r.n_words, spread(r.spans), list(r.items)) for r in got)
    assert have == sorted((str(d[0]), *w) for d, w in zip(DOCS, want))


def test_many_shards_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, items string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    one = sorted(map(str, decontam.contamination(docs, items).collect()))
    monkeypatch.setattr(decontam, "SHARD_BYTES", 30)
    assert sorted(map(str, decontam.contamination(docs.coalesce(1), items).collect())) == one
    assert decontam.contamination(docs.limit(0), items).count() == 0
    assert all(not r.spans and not r["items"] for r in decontam.contamination(docs, items.limit(0)).collect())


def test_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(rows, brute(
        [r.text for r in rows], [(str(i.item_id), i.text) for i in items.collect()]))}
    got = decontam.op3_fm_decontam(spark, sf).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in got} == {
        d: (n, len(h), len(f)) for d, (n, h, f) in want.items()}
    assert any(r.contaminated for r in got)
