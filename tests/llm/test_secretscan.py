import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from litsift.llm import secretscan

from .rows import ROWS, documents

PATTERNS = [
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]
TEXTS = [
    "password=abc", "PassWord : 'abcdef' é token=secret=abcdefgh", "password:token: abcdef", "apikey=aaaaaa api_key=bbbbbb",
    "AKIA" + "A" * 16 + " AKIA" + "B" * 15 + " xAKIAAKIA" + "C" * 12, "0123456789abcdef01234567 " + "a" * 23 + "g" + "b" * 24,
    "\U0001F600 secret \"= 'a.b/c+d=e-f_g' \U0001F600 " + "f" * 30, "token=" + "0f" * 20, "tokén=abcdefgh toKen=xxxxxxxx",
    "q8Zt3LmP0xVb7RkW2yNc5HsJ and Zt3LmP0xVb7RkW2yNc5HsJq9-example-key", "internationalizationandlocalization",
]


def base(text):
    out = []
    for k, (kind, pattern, ok) in enumerate(PATTERNS):
        out += [(m.start(), k, m.end(), kind) for m in pattern.finditer(text or "") if ok(m)]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def highest(text):
    out = 0
    for i in range(len(text) - secretscan.WINDOW + 1):
        counts = Counter(text[i:i + secretscan.WINDOW])
        out = max(out, -sum(c / secretscan.WINDOW * math.log2(c / secretscan.WINDOW) for c in counts.values()))
    return out


def test_base_spans_against_python(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS, *[r[1] for r in ROWS]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit(1))
    got = {r.doc_id: [f"{secretscan.KINDS[x.kind]}:{x.start}:{x.stop}" for x in r.found]
           for r in secretscan.scan(docs).collect()}
    for i, text in rows:
        assert [x for x in got[i] if not x.startswith("entropy")] == base(text)
    assert any(x.startswith("entropy:0:24") for x in got[9])
    assert not any("entropy:29" in x for x in got[9]) and not got[10]


def test_entropy_of_windows(spark):
    texts = ["a" * 24, "ab" * 20, "q8Zt3LmP0xVb7RkW2yNc5HsJ", "0123456789abcdef" * 3, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaq8Zt3LmP0xVb7RkW2yNc"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", secretscan.highest_entropy(F.col("text")).alias("bits")).collect():
        assert abs(r.bits - highest(r.text)) < 1e-9


def test_redaction_and_plan(spark):
    docs = documents(spark)
    scanned = secretscan.scan(docs)
    out = {r.doc_id: r.clean for r in scanned.withColumn(
        "clean", secretscan.redact(F.col("text"), F.col("found"))).collect()}
    assert out[11] == "[SECRET]\" [SECRET]" and out[3] is None and out[4] == "" and out[2] == ROWS[2][1]
    plan = scanned._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert secretscan.scan(docs.limit(0)).count() == 0


def test_allowed_fragments_excuse_themselves_only(spark):
    key, uuid = "q8Zt3LmP0xVb7RkW2yNc5HsJd4Gf9TaXe6UoMi1K", "123e4567-e89b-12d3-a456-426614174000"
    secret = [f"{uuid}/{key}", f"{key}_{uuid}", f"sample-{key}", f"sample-{key[:24]}", f"{key}-example-key", f"{key}AAAAAAAA{key}",
              f"0123456789{key}", "b3BlbnNzaC1rZXktdjEAAAAABG5vbmUAAAAEbm9uZQAAAAAAAAABAAAAMwAAAAtzc2gtZW"]
    fine = [uuid, f"{uuid}_{uuid}", f"{uuid}/internationalization-and-localization", "A" * 40,
            "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "changeme-changeme-changeme-123"]
    docs = spark.createDataFrame(list(enumerate(secret + fine)), "doc_id long, text string")
    got = {r.doc_id: [(secretscan.KINDS[x.kind], x.start, x.stop) for x in r.found]
           for r in secretscan.scan(docs).collect()}
    for i, text in enumerate(secret):
        assert got[i] == [("entropy", 0, len(text))], text
    assert not any(got[i] for i in range(len(secret), len(secret + fine)))


def plain_spans(text):
    """All spans of a text by plain loops: base ones, then runs of each class that are secrets."""
    kept = [(m.start(), k, m.end()) for k, (_, pattern, ok) in enumerate(PATTERNS) for m in pattern.finditer(text) if ok(m)]
    base_spans, found = list(kept), {}
    for name, (pattern, limit) in secretscan.CLASSES.items():
        found[name] = []
        for m in re.finditer(pattern, text):
            pieces, end = [], 0
            for f in re.finditer(secretscan.FRAGMENTS, m[0]):
                pieces.append(m[0][end:f.start()])
                end = f.end()
            pieces.append(m[0][end:])
            if any(re.search(a, "".join(pieces)) for a in secretscan.ALLOWED):
                continue
            if any(highest(p) >= limit - 1e-9 for p in pieces if len(p) >= secretscan.WINDOW) and not any(
                    a < m.end() and m.start() < b for a, _, b in base_spans):
                found[name].append((m.start(), len(PATTERNS), m.end()))
    first, second = found.values()
    first = [x for x in first if not any(a < x[2] and x[0] < b for a, _, b in second)]
    return sorted(base_spans + first + second)


def plain_redacted(text, spans):
    out, at = [], 0
    for start, _, stop in spans:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, stop)
    return "".join(out) + text[at:]


def test_all_spans_and_redaction_against_plain_loops(spark):
    draw = random.Random(4)
    parts = ["password=", "secret: ", "token='", "AKIA", "ABCDEFGHIJKLMNOP", "é ", "\n", "example", "AAAAAAAAA", " ",
             "123e4567-e89b-12d3-a456-426614174000", "-", "/"]
    texts = list(TEXTS)
    for _ in range(300):
        own = []
        for _ in range(draw.randrange(1, 9)):
            own.append(draw.choice(parts) if draw.random() < 0.6 else "".join(
                draw.choice(draw.choice(["0123456789abcdef", secretscan._ALPHABET, "ab"])) for _ in range(draw.randrange(1, 70))))
        texts.append("".join(own))
    texts.append(" ".join("0123456789abcdef0123456%x" % (i % 16) + "token=abcdef" * (i % 3) for i in range(1500)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = secretscan.scan(df).withColumn("clean", secretscan.redact(F.col("text"), F.col("found"))).collect()
    for r in got:
        want = plain_spans(texts[r.doc_id])
        assert [(x.start, x.kind, x.stop) for x in r.found] == want, texts[r.doc_id]
        assert r.clean == plain_redacted(texts[r.doc_id], want)
    assert sum(any(x.kind == 3 for x in r.found) for r in got) > 50


def test_long_runs_and_many_matches_take_linear_time(spark):
    draw = random.Random(5)
    run = "".join(draw.choice(secretscan._ALPHABET[:64]) for _ in range(1 << 20))
    many = "token=abcdef " * 100_000
    df = spark.createDataFrame([(0, run), (1, many)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in secretscan.scan(df).select("doc_id", F.size("found").alias("n"), F.length(
        secretscan.redact(F.col("text"), F.col("found"))).alias("left")).collect()}
    assert (got[0].n, got[0].left) == (1, 8) and (got[1].n, got[1].left) == (100_000, 900_000)
    assert time.perf_counter() - began < 90
