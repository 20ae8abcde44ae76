import math
from collections import Counter

import numpy as np
import pytest

from litsift.llm import langid

from .rows import ROWS, documents


def brute(texts, order):
    """Code length of a text under plain recursive PPM with escape C, from (context, byte) counts."""
    counts = {}
    for text in texts:
        data = (None,) * order + tuple(text.encode())  # what stands before a text is a context, too
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts.setdefault(data[i - k:i], Counter())[data[i]] += 1

    def chance(context, byte):
        shorter = (lambda: chance(context[1:], byte)) if context else (lambda: 1 / 256)
        own = counts.get(context)
        if not own:
            return shorter()
        total = sum(own.values()) + len(own)
        return own[byte] / total if own[byte] else len(own) / total * shorter()

    def length(data):
        data = (None,) * order + tuple(data)
        return -sum(math.log2(chance(data[i - order:i], data[i])) for i in range(order, len(data)))

    return length


def test_code_lengths_are_those_of_plain_ppm(spark):
    texts = {"aa": ["abracadabra abra", "cad cad"], "bb": ["zyx zyx yxz abz", "é ü zz"]}
    codes = {k: np.unique(np.concatenate([langid._codes(np.frombuffer(t.encode(), np.uint8)) for t in own]),
                          return_counts=True) for k, own in texts.items()}
    model = langid.Model(["aa", "bb"], [codes["aa"][0], codes["bb"][0]], [codes["aa"][1], codes["bb"][1]])
    trial = ["abra", "zyx abz", "a", "qqé~ü zy", "", "cadabra" * 30]
    flat = np.frombuffer("".join(trial).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(t.encode()) for t in trial]])
    got = model.lengths(flat, offsets)
    for k, lang in enumerate(("aa", "bb")):
        length = brute(texts[lang], langid.ORDER)
        for i, text in enumerate(trial):
            # contexts that begin at a text's start aren't told from longer ones with the same bytes
            assert got[i, k] == pytest.approx(length(text.encode()), rel=2e-4, abs=0.02 * max(1, len(text)))


def test_awkward_rows_and_no_labels(spark):
    docs = documents(spark)
    model = langid.fit(docs)
    got = langid.predict(docs, model).collect()
    assert len(got) == len(ROWS)
    by_text = {(r.doc_id): r for r in got}
    for doc_id in (3, 4, 5, 9):
        assert by_text[doc_id].lang_pred == "und" and by_text[doc_id].score == 0
    assert by_text[1].lang_pred == "en" and 0 < by_text[1].score <= 1
    assert langid.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op5_ppm_langid(spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out").collect()
    assert len(got) > 100
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


def test_every_language_is_learned_and_none_changes_another(spark):
    rows = []
    for i in range(70):
        letters = [chr(0x4E00 + 40 * i + k) for k in range(20)]
        rows += [(j + 10 * i, " ".join("".join(letters[(a * b + j) % 20] for b in range(4)) for a in range(12)), f"l{i:02}")
                 for j in range(2 if i < 68 else 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    few = docs.filter("lang in ('l00', 'l69')")
    alone = {r.doc_id: r.bits for r in langid.predict(few, langid.fit(few)).collect()}
    assert alone and all(got[i].bits == bits for i, bits in alone.items())


def test_contexts_of_a_language_are_its_own():
    texts = {"aa": "abcabdabeabf " * 3, "bb": "the quick brown fox jumps over the lazy dog " * 50}
    own = {k: np.unique(langid._codes(np.frombuffer(t.encode(), np.uint8)), return_counts=True) for k, t in texts.items()}
    flat = np.frombuffer(b"abc abd quick", np.uint8)
    both = langid.Model(["aa", "bb"], *zip(own["aa"], own["bb"]), 5).lengths(flat, np.array([0, 13]))
    for k, lang in enumerate(own):
        alone = langid.Model([lang], [own[lang][0]], [own[lang][1]], 5).lengths(flat, np.array([0, 13]))
        assert alone[0, 0] == both[0, k]
