import hashlib
import random

from pyspark.sql import functions as F

from litsift.llm import fingerprints

from .rows import ROWS, documents


def edited(rows):
    """(doc_id, text, edited text) with the next row by descending id, then text (null first)."""
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[0], r[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(known):
        text, after = text or "", known[(i + 1) % len(known)][1] or ""
        half = len(text) // 2
        out.append((str(doc_id), len(text), text[:len(text) - half] + after[:half]))
    for doc_id, text in rows:
        if doc_id is None:
            out.append(("None", len(text or ""), (text or "")[:len(text or "") - len(text or "") // 2]))
    return sorted((d, n, hashlib.sha256(e.encode()).hexdigest()) for d, n, e in out)


def have(df):
    return sorted((str(r.doc_id), r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest()) for r in df.collect())


def test_edited_texts(spark):
    assert have(fingerprints.edits(documents(spark, "body string, sketch string"))) == edited([r[:2] for r in ROWS])
    draw = random.Random(1)
    rows = [(draw.randrange(-50, 3000), "é" * draw.randrange(9) + str(i)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert have(fingerprints.edits(docs)) == edited(rows)
    one = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    assert fingerprints.edits(one).first().edited == "abab"
    assert fingerprints.edits(docs.limit(0)).count() == 0


def test_sketches(spark):
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words), " ".join(words[:1500]), " ".join(words[1000:]), "A b", "a  B ", "c", "", " \n"]
    df = fingerprints.with_sketch(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "s")
    rows = df.select("s", fingerprints.fingerprint("s").alias("f")).collect()
    assert rows[0].s.n == 2996 and rows[3].s.n == 1 and rows[6].s.n == 0
    assert abs(len(rows[0].s.kept) / 2996 - 1 / fingerprints.SCALE) < 0.03
    assert rows[3].f == rows[4].f and rows[6].f == rows[7].f and rows[3].f != rows[5].f
    # merged halves are the sketch of the whole, but for the shingles across the cut
    both = df.limit(3).agg(*[F.element_at(F.collect_list("s"), i).alias(x) for i, x in ((1, "a"), (2, "b"), (3, "c"))])
    r = both.select("a", fingerprints.merged(F.col("b"), F.col("c")).alias("m"), fingerprints.likeness("a", "b").alias("ab"),
                    fingerprints.likeness("b", "c").alias("bc"), fingerprints.likeness("a", "a").alias("aa")).first()
    assert r.m == r.a.kept and r.ab == 1 and r.aa == 1 and abs(r.bc - 1 / 3) < 0.12


def test_plan_is_native(spark):
    plan = fingerprints.op1_scaled_sketch(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
