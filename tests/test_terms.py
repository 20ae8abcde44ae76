import math
import random

import pytest
from pyspark.sql import functions as F

from litsift.operators import terms


def brute_wilcox_z(x, y):
    """R wilcox.test(x, y, exact=FALSE, correct=TRUE) statistic, by explicit mid-ranks."""
    allv = sorted(x + y)
    ranks = {}
    i = 0
    while i < len(allv):
        j = i
        while j < len(allv) and allv[j] == allv[i]:
            j += 1
        ranks[allv[i]] = (i + 1 + j) / 2.0
        i = j
    n1, n0 = len(x), len(y)
    w = sum(ranks[v] for v in x) - n1 * (n1 + 1) / 2
    ties = {}
    for v in allv:
        ties[v] = ties.get(v, 0) + 1
    tsum = sum(t ** 3 - t for t in ties.values())
    n = n1 + n0
    sigma = math.sqrt(n1 * n0 / 12 * ((n + 1) - tsum / (n * (n - 1))))
    d = w - n1 * n0 / 2
    corr = 0.5 * (1 if d > 0 else -1 if d < 0 else 0)
    return w, (d - corr) / sigma


def test_rank_sum_closed_form_matches_brute_force(spark):
    rnd = random.Random(5)
    docs = [(f"d{i}", 1.0 if i % 3 else 0.0) for i in range(60)]
    rows = []
    for t in ["alpha", "beta", "gamma"]:
        for pmid, lab in docs:
            if rnd.random() < 0.6:
                rows.append((pmid, t, rnd.choice([0.1, 0.2, 0.3, 0.5]) * (1.5 if lab and t == "alpha" else 1)))
    lt = spark.createDataFrame(rows, "pmid string, term string, tfidf double").join(
        spark.createDataFrame(docs, "pmid string, label double"), "pmid")
    tdf = spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "term string")
    sizes = spark.createDataFrame([(sum(1 for _, l in docs if l), sum(1 for _, l in docs if not l))],
                                  "n1 long, n0 long")
    out = {r["term"]: r for r in terms.term_rank_sum(lt, tdf, sizes).collect()}
    for t in ["alpha", "beta", "gamma"]:
        vals = {p: v for p, tt, v in rows if tt == t}
        x = [vals.get(p, 0.0) for p, l in docs if l]
        y = [vals.get(p, 0.0) for p, l in docs if not l]
        w, z = brute_wilcox_z(x, y)
        assert out[t]["w_stat"] == pytest.approx(w)
        assert out[t]["z"] == pytest.approx(z)
        assert out[t]["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    order = sorted(out.values(), key=lambda r: r["p_rank"])
    zs = [abs(r["z"]) for r in order]
    assert zs == sorted(zs, reverse=True)


def test_signif(spark):
    from litsift.functions.numeric import signif
    df = spark.createDataFrame([(0.123456,), (1234.0,), (0.0,), (-0.0456,)], "x double")
    got = [r[0] for r in df.select(signif("x", 2)).collect()]
    assert got == pytest.approx([0.12, 1200.0, 0.0, -0.046])


def test_tfidf_formula(spark):
    from litsift.functions.text import STOP_WORDS
    train = spark.createDataFrame([("1", "cell cell gene", 1.0), ("2", "gene the", 0.0),
                                   ("3", "the of", 0.0)], "pmid string, abstract string, label double")
    tt = terms.TermTable(train, stem=False)
    rows = {(r["pmid"], r["term"]): r for r in tt.tfidf.collect()}
    assert rows[("1", "cell")]["tf"] == pytest.approx(2 / 3)
    assert rows[("1", "cell")]["idf"] == pytest.approx(math.log(1 + 3 / 1))
    assert rows[("2", "gene")]["tf"] == pytest.approx(1.0)
    assert "the" in STOP_WORDS and ("3", "the") not in rows


def test_repeated_ids_are_documents_of_their_own(spark):
    train = spark.createDataFrame([("1", "cell cell gene", 1.0), ("1", "cell", 0.0), ("2", "gene gene gene", 0.0)],
                                  "pmid string, abstract string, label double")
    tt = terms.TermTable(train, stem=False)
    counts = {(r["term"], r["label"]): r["n"] for r in tt.labelled_counts().groupBy("term", "label").agg(
        F.sum("n").alias("n")).collect()}
    assert counts == {("cell", 1.0): 2, ("cell", 0.0): 1, ("gene", 1.0): 1, ("gene", 0.0): 3}
    tf = sorted((r["pmid"], r["term"], round(r["tf"], 9)) for r in tt.tfidf.collect())
    assert tf == [("1", "cell", 0.666666667), ("1", "cell", 1.0), ("1", "gene", 0.333333333), ("2", "gene", 1.0)]


def test_terms_do_not_shuffle_on_documents(spark):
    train = spark.createDataFrame([("1", "cell cell gene", 1.0)], "pmid string, abstract string, label double")
    plan = terms.TermTable(train, stem=False).labelled_tfidf()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(pmid" not in plan


def test_p_values(spark):
    from litsift.functions.numeric import student_t_two_sided_p, two_sided_p

    def integral(f, a, b, n=20000):
        h = (b - a) / n
        return h / 3 * sum((1 if i in (0, n) else 4 if i % 2 else 2) * f(a + i * h) for i in range(n + 1))

    cases = [(t, v) for t in (0.0, 0.3, -1.7, 4.2, 9.0) for v in (1.0, 2.5, 17.3, 400.0)]
    df = spark.createDataFrame(cases, "t double, v double")
    for r in df.select("t", "v", student_t_two_sided_p("t", "v").alias("p"), two_sided_p("t").alias("z")).collect():
        c = math.exp(math.lgamma((r.v + 1) / 2) - math.lgamma(r.v / 2)) / math.sqrt(r.v * math.pi)
        body = integral(lambda x: c * (1 + x * x / r.v) ** (-(r.v + 1) / 2), 0, abs(r.t))
        assert r.p == pytest.approx(1 - 2 * body, abs=1e-9)
        body = integral(lambda x: math.exp(-x * x / 2) / math.sqrt(2 * math.pi), 0, abs(r.t))
        assert r.z == pytest.approx(1 - 2 * body, abs=1e-9)
