import random
import re

import numpy as np
import pytest

from litsift.llm import setsketch
from litsift.llm.common import Scratch
from litsift.llm.components import components

from .rows import ROWS, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(own[i:i + width]) for i in range(max(1, len(own) - width + 1))} if own else set()


def brute(rows, width, num, den):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((str(doc_id), len(sets[i]), min(own) if own and sets[i] else doc_id))
    return sorted(out, key=str)


def test_estimate_is_near_the_truth():
    draw = np.random.default_rng(1)
    for n, share in ((300, 0.85), (300, 0.5), (40, 0.8)):
        both = int(round(share * 2 * n / (1 + share)))
        seen = []
        for _ in range(60):
            pool = draw.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
            regs = setsketch.registers([np.sort(pool[:n]), np.sort(pool[n - both:])])
            seen.append(setsketch.estimate(regs[:1], regs[1:], np.array([n]), np.array([n]))[0])
        assert abs(np.mean(seen) - both / (2 * n - both)) < 0.04


def test_registers_merge_by_maximum():
    draw = np.random.default_rng(2)
    pool = draw.integers(0, 2**63, 500, dtype=np.uint64)
    a, b, union = setsketch.registers([pool[:300], pool[200:], pool])
    # a union reaches less far, so rare registers that only it had to widen for may differ
    assert (np.maximum(a, b) == union).mean() > 0.99


@pytest.mark.parametrize("block", [8 << 20, 2000])
def test_links_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(setsketch, "BLOCK_BYTES", block)
    draw = random.Random(9)
    rows = []
    for family in range(6):
        text = [f"f{family}w{draw.randrange(400)}" for _ in range(draw.randrange(30, 160))]
        for _ in range(14):
            copy = list(text)
            for _ in range(draw.randrange(0, 6)):
                copy[draw.randrange(len(copy))] = f"x{draw.randrange(9)}"
            rows.append((draw.randrange(300), " ".join(copy)))
    rows = list(dict(rows).items())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.n_shingles, r.component_id) for r in
                  setsketch.near_duplicates(docs, 3, 85, 100).collect()), key=str)
    assert got == brute(rows, 3, 85, 100)
    assert len({r[2] for r in got}) < len(rows)


def test_awkward_rows(spark):
    got = sorted(((str(r.doc_id), r.n_shingles, r.component_id) for r in
                  setsketch.near_duplicates(documents(spark), 3, 85, 100).collect()), key=str)
    lost = [("None", 24, None)]  # a text that stands without an id only is linked with no other
    assert [r for r in got if r not in lost] == brute([r[:2] for r in ROWS if r[0] is not None], 3, 85, 100)
    assert [r for r in got if r in lost] == lost
    assert setsketch.near_duplicates(documents(spark).limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(8, 40)] + [(900, 950), (950, 901), (5, 5)]
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()
    want = {**{i: 100 for i in range(100, 141)}, **{k: 7 for k in range(7, 40)}, 900: 900, 901: 900, 950: 900}
    assert {r.node: r.comp for r in got} == want
