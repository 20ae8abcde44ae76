"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Only DataFrame functions run here, row by row and without a shuffle. A kind's matches come
from ``regexp_extract_all`` and their places from running sums over the lengths of the pieces
between them.

Candidates are runs of one character class. A window of ``WINDOW`` characters slides over
each. The counts of its characters are kept from step to step, packed into a few numbers; a step
changes those of the character that comes and the one that goes, and the sum of c * log2(c)
over the counts c by these two. Fragments that the
allow-list knows are cut out first, and only what is left is judged. A candidate with a window
left whose entropy reaches its class's limit is a secret as a whole, unless a base span
overlaps it. All of this is linear in a text's length, but for a logarithm where spans are
looked up among others.

Null and empty texts hold nothing. Repeated rows are scanned one by one; a null id is
carried through. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds, in their order. A run of fewer characters than asked for
#: is dropped afterwards only for ``assign``; the others can't match differently for it.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
ASSIGN_CHARS = 6

WINDOW = 24
#: Candidate runs of each character class, and the bits a character from which one is a secret.
CLASSES = {"hexadecimal": (r"[0-9A-Fa-f]{24,}", 3.0), "token": (r"[A-Za-z0-9+/_=-]{24,}", 3.8)}
#: Fragments that are no secrets: identifiers, placeholders, rows of one character or of the alphabet. They
#: are cut out of a candidate. A placeholder joined to its end takes one character along, so that a single
#: window before "-example" is none.
FRAGMENTS = "|".join([
    r"(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})",
    r"(?:[A-Za-z0-9][+/_=-])?(?i:example|sample|dummy|placeholder|changeme)", r"(.)\1{7,}",
    r"(?i:0123456789|abcdefghij)",
])
#: Candidates that are no secrets if all that is left of them is like this: words, numbers.
ALLOWED = [r"^[A-Za-z+/_=-]*$", r"^[0-9+/_=-]*$"]
KINDS = [*BASE, "entropy"]
_FOUND = "array<struct<start:int,kind:int,stop:int,text:string>>"


#: Elements that a running sum is taken over at once.
_BLOCK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(values: Column, zero: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What the elements before each one come to, from block to block and then within a block."""
    def extended(start: Column, block: Column) -> Column:
        return F.aggregate(block, F.array(start), lambda a, x: F.concat(a, F.array(join(F.element_at(a, -1), x))))

    def blocks(own: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / _BLOCK).cast("int")),
                           lambda b: F.slice(own, b * _BLOCK + 1, F.lit(_BLOCK)))

    def each(parts: Column) -> Column:
        tops = F.transform(parts, lambda k: F.aggregate(k, zero, join))
        return _let(extended(zero, tops), lambda starts: F.flatten(F.transform(
            parts, lambda k, b: F.slice(extended(F.get(starts, b), k), F.lit(1), F.size(k)))))

    return _let(values, lambda own: F.when(F.size(own) > 0, _let(blocks(own), each)))


def _placed(kind: int, matches: str, pieces: str) -> Column:
    """The matches of one kind with their places; ``pieces`` stand between them."""
    gaps = F.zip_with(matches, F.slice(pieces, F.lit(1), F.size(matches)),
                      lambda m, p: F.struct(F.length(p).alias("gap"), (F.length(p) + F.length(m)).alias("all")))

    def spans(steps: Column) -> Column:
        ends = _before(F.transform(steps, lambda x: x["all"]), F.lit(0), lambda a, x: a + x)
        return _let(ends, lambda at: F.transform(matches, lambda m, i: F.struct(
            (F.get(at, i) + F.get(steps, i)["gap"]).alias("start"), F.lit(kind).alias("kind"),
            (F.get(at, i) + F.get(steps, i)["all"]).alias("stop"), m.alias("text"))))

    return F.when(F.size(matches) > 0, _let(gaps, spans)).otherwise(F.array().cast(_FOUND))


#: The characters of all classes. Their counts in a window, of ``_BITS`` bits each, are packed into whole numbers.
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_BITS, _PACK = 5, 12
_WORDS = -(-len(_ALPHABET) // _PACK)


def highest_entropy(text: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits a character, of the windows (of up to 31 characters) of a string.

    The string is made of characters of the classes, and of as many as the window has or more.
    """
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    names = [f"w{k}" for k in range(_WORDS)]

    def count(at: Column, place: Column) -> Column:
        word = F.get(F.array(*[at[n] for n in names]), F.floor(place / _PACK).cast("int"))
        return F.call_function("shiftright", word, place % _PACK * _BITS).bitwiseAND(F.lit(2**_BITS - 1)).cast("int")

    def one(place: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), place % _PACK * _BITS)

    def over(places: Column) -> Column:
        def step(at: Column, i: Column) -> Column:
            comes, goes = F.get(places, i - 1), F.get(places, i - 1 - window)
            full, same = i > window, F.coalesce(F.get(places, i - 1 - window) == F.get(places, i - 1), F.lit(False))
            out = count(at, goes)
            more = count(at, comes) - F.when(same, F.lit(1)).otherwise(F.lit(0))
            total = (at["total"] + F.when(full, F.get(weight, out - 1) - F.get(weight, out)).otherwise(0.0)
                     + F.get(weight, more + 1) - F.get(weight, more))
            bits = F.when(i >= window, F.lit(math.log2(window)) - total / window).otherwise(0.0)
            words = [(at[n] + F.when(F.floor(comes / _PACK) == k, one(comes)).otherwise(F.lit(0).cast("long"))
                      - F.when(full & (F.floor(goes / _PACK) == k), one(goes)).otherwise(F.lit(0).cast("long"))).alias(n)
                     for k, n in enumerate(names)]
            return F.struct(total.alias("total"), F.greatest(at["best"], bits).alias("best"), *words)

        zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("best"), *[F.lit(0).cast("long").alias(n) for n in names])
        return F.aggregate(F.sequence(F.lit(1), F.size(places)), zero, step, lambda at: at["best"])

    return _let(F.transform(F.split(text, ""), lambda c: F.instr(F.lit(_ALPHABET), c) - 1), over)


def _is_secret(found: Column, limit: float) -> Column:
    pieces = F.split(found["text"], FRAGMENTS, -1)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | F.array_join(pieces, "").rlike(pattern)
    high = F.exists(pieces, lambda p: F.when(F.length(p) >= WINDOW, highest_entropy(p) >= limit).otherwise(False))
    return F.when(allowed, F.lit(False)).otherwise(high)


def _cover(spans: Column) -> Column:
    """Spans by their start, each with how far it and those before it reach."""
    def reach(own: Column) -> Column:
        before = _before(F.transform(own, lambda x: x["stop"]), F.lit(0), lambda a, x: F.greatest(a, x))
        return _let(before, lambda at: F.transform(own, lambda x, i: F.struct(
            x["start"].alias("start"), F.greatest(F.get(at, i), x["stop"]).alias("reach"))))

    return _let(F.array_sort(spans), reach)


def _apart(found: Column, cover: str) -> Column:
    """Whether no span of a cover overlaps the one found: bisection for the last that starts before its end."""
    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        less = F.get(F.col(cover), middle)["start"] < found["stop"]
        open_ = at["low"] < at["high"]
        return F.struct(F.when(open_ & less, middle + 1).otherwise(at["low"]).alias("low"),
                        F.when(open_ & ~less, middle).otherwise(at["high"]).alias("high"))

    turns = F.sequence(F.lit(1), F.ceil(F.log2(F.size(cover) + 1.0)).cast("int") + 1)
    last = F.aggregate(turns, F.struct(F.lit(0).alias("low"), F.size(cover).alias("high")), halve, lambda at: at["low"])
    return F.coalesce(F.get(F.col(cover), last - 1)["reach"] <= found["start"], F.lit(True))


def _new_secrets(name: str, cover: str, limit: float) -> Column:
    return F.filter(name, lambda x: _apart(x, cover) & _is_secret(x, limit))


def _of_kind(kind: int) -> Column:
    return F.filter("found", lambda x: x["kind"] == kind)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, found): each row's spans as (start, kind, stop, text), by start and kind.

    Places count code points, the end is exclusive; kind is a number in ``KINDS``.
    """
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("original"))
    out = out.withColumn("body", F.coalesce("original", F.lit("")))
    patterns = {**BASE, **{name: pattern for name, (pattern, _) in CLASSES.items()}}
    out = out.select("*", *[F.regexp_extract_all("body", F.lit(p), F.lit(0)).alias(f"m_{k}")
                            for k, p in patterns.items()])
    out = out.select("*", *[F.when(F.size(f"m_{k}") > 0, F.split("body", p, -1)).alias(f"p_{k}")
                            for k, p in patterns.items()])
    number = {k: min(i, len(BASE)) for i, k in enumerate(patterns)}
    out = out.select("id", "original", *[_placed(number[k], f"m_{k}", f"p_{k}").alias(k) for k in patterns])
    out = out.withColumn("assign", F.filter(
        "assign", lambda x: F.length(F.regexp_extract(x["text"], ASSIGN, 2)) >= ASSIGN_CHARS))
    out = out.withColumn("base", F.concat(*BASE))
    out = out.withColumn("cover", _cover(F.col("base")))
    for name, (_, limit) in CLASSES.items():
        out = out.withColumn(name, _new_secrets(name, "cover", limit))
    # a run of hexadecimal digits inside a token that is a secret itself adds nothing
    first, second = CLASSES
    out = out.withColumn("cover", _cover(F.col(second)))
    out = out.withColumn(first, F.filter(first, lambda x: _apart(x, "cover")))
    return out.select(F.col("id").alias(id_col), F.col("original").alias(text_col),
                      F.array_sort(F.concat("base", *CLASSES)).alias("found"))


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, overlapping ones together, replaced by a mark."""
    def pieces(chars: Column) -> Column:
        before = _before(F.transform(found, lambda x: x["stop"]), F.lit(0), lambda a, x: F.greatest(a, x))

        def cut(at: Column) -> Column:
            kept = F.transform(found, lambda x, i: F.when(x["start"] >= F.get(at, i), F.concat(F.array_join(
                F.slice(chars, F.get(at, i) + 1, x["start"] - F.get(at, i)), ""), F.lit(mark))).otherwise(F.lit("")))
            end = F.greatest(F.element_at(at, -1), F.element_at(found, -1)["stop"])
            return F.concat(F.array_join(kept, ""), F.array_join(F.slice(chars, end + 1, F.size(chars)), ""))

        return _let(before, cut)

    return F.when(F.size(found) > 0, _let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), pieces)).otherwise(text)


def _listed(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def op6_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts of base secrets, their digest, and all spans."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(_of_kind(i)).cast("long").alias(f"n_{k}")
              for i, k in enumerate(BASE)]
    base = F.filter("found", lambda x: x["kind"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"),
                        _listed(F.col("found")).alias("spans"))
