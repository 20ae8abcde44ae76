"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every distinct hash of five consecutive words (lower case, split at white
space) that lies below a fixed share of the hash range, 1 in ``SCALE``. So sketches merge by
union, and the share of one sketch's hashes in another estimates containment, however
unequal the two documents are. The likeness of two fingerprints is the containment of the
one with fewer hashes. Only DataFrame functions run here.

A text of fewer words has its whole sequence as the only shingle. Null and empty texts have
no shingles. A fingerprint also carries a hash of all words, which alone decides when a
sketch is empty: likeness is then 1 for equal words and 0 otherwise.

The next document of an edited text is found by descending id in ranges of ids, with each
range's largest id sent along to the range above. Rows that repeat an id follow one another
by text (null first). A row with a null id has no next document: nothing follows its first
half, and its likeness to the next is 0. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHINGLE = 5
SCALE = 8
#: Ranges of ids for each shuffle partition.
RANGES = 4
_LIMIT = -(1 << 63) + (1 << 64) // SCALE
_WHITE = " \t\n\u000b\f\r"


def with_sketch(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with ``out``: struct(n, whole, kept) of a text column that isn't null."""
    trimmed = F.btrim(F.lower(text_col), F.lit(_WHITE))
    df = df.withColumn("_w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+", -1)))
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).drop("_w")
    size = F.size("_h")
    shingles = F.when(size >= SHINGLE, F.transform(
        F.sequence(F.lit(0), size - SHINGLE),
        lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(SHINGLE)])))
    shingles = shingles.when(size > 0, F.array(F.xxhash64("_h"))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_s", shingles)
    return df.withColumn(out, F.struct(
        F.size("_s").alias("n"), F.xxhash64("_h").alias("whole"),
        F.array_sort(F.array_distinct(F.filter("_s", lambda h: h < _LIMIT))).alias("kept"))).drop("_h", "_s")


def fingerprint(sketch: str) -> Column:
    """A sketch as text: scale, shingles, hash of all words, kept hashes in hexadecimal."""
    s = F.col(sketch)
    return F.concat_ws("|", F.lit(str(SCALE)), s["n"].cast("string"), F.hex(s["whole"]),
                       F.array_join(F.transform(s["kept"], lambda h: F.hex(h)), ","))


def merged(a: Column, b: Column) -> Column:
    """The kept hashes of the union of two documents' shingles."""
    return F.array_sort(F.array_union(a["kept"], b["kept"]))


def likeness(a: str, b: str) -> Column:
    """Estimated containment, 0 to 1, of the document with fewer kept hashes in the other."""
    a, b = F.col(a), F.col(b)
    least = F.least(F.size(a["kept"]), F.size(b["kept"]))
    return F.when(least > 0, F.size(F.array_intersect(a["kept"], b["kept"])) / least).otherwise(
        (a["whole"] == b["whole"]).cast("double")).cast("double")


def _range_number(column: Column, bounds: list[int], base: int = 0) -> Column:
    """The number of bounds that are not above the value, by a balanced tree of comparisons."""
    if not bounds:
        return F.lit(base)
    mid = len(bounds) // 2
    return F.when(column < bounds[mid], _range_number(column, bounds[:mid], base)).otherwise(
        _range_number(column, bounds[mid + 1:], base + mid + 1))


def with_next(docs: DataFrame, id_col: str, text_col: str, columns: list[str]) -> DataFrame:
    """``docs`` with ``next``: a struct of ``columns`` of the document that follows by descending id.

    After the last comes the first. Null for a null id.
    """
    spark = docs.sparkSession
    parts = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(id_col).filter(F.col(id_col).isNotNull())
    cuts = ids.agg(F.percentile_approx(id_col, [k / parts for k in range(1, parts)], 20 * parts)).first()[0]
    number = _range_number(F.col(id_col), sorted(set(cuts or [])))
    ends = sorted(ids.groupBy(number.alias("r")).agg(F.max(id_col).alias("top")).collect())
    if not ends:
        return docs.withColumn("next", F.struct(*columns)).withColumn("next", F.when(F.lit(False), F.col("next")))
    # the largest id of each range also ends the range above; that of the last ends the first
    sent = {top: above for (_, top), above in zip(ends, [r for r, _ in ends[1:]] + [ends[0][0]])}
    goes = F.create_map(*[F.lit(x) for pair in sent.items() for x in pair])[F.col(id_col)]
    ghost = F.struct(goes.alias("r"), F.lit(True).alias("ghost"))
    places = F.array_compact(F.array(F.struct(number.alias("r"), F.lit(False).alias("ghost")),
                                     F.when(F.col(id_col).isin(list(sent)), ghost)))
    rows = docs.filter(F.col(id_col).isNotNull()).withColumn("_at", F.explode(places))
    order = Window.partitionBy("_at.r").orderBy(F.col("_at.ghost"), F.col(id_col).desc(), F.asc_nulls_first(text_col))
    rows = rows.withColumn("next", F.lead(F.struct(*columns)).over(order)).filter(~F.col("_at.ghost")).drop("_at")
    lost = docs.filter(F.col(id_col).isNull())
    return rows.unionByName(lost, allowMissingColumns=True)


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited, sketch, edited_sketch, next_sketch) of every row.

    In the edited text the last half of the code points (rounded down) gives way to the first
    as many, or all, of the next document.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    own = with_next(with_sketch(own, "body", "sketch"), "id", "body", ["body", "sketch"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    own = own.withColumn("n_chars", F.length("body").cast("long"))
    own = own.select("id", "n_chars", "sketch", F.col("next.sketch").alias("next_sketch"), F.concat(
        F.substring("body", F.lit(1), F.col("n_chars").cast("int") - half),
        F.coalesce(F.substring(F.col("next.body"), F.lit(1), half), F.lit(""))).alias("edited"))
    return with_sketch(own, "edited", "edited_sketch").withColumnRenamed("id", id_col)


def op1_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and the likeness to that and to the next document."""
    found = edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("sketch").alias("fingerprint"),
        fingerprint("edited_sketch").alias("edited_fingerprint"), likeness("sketch", "edited_sketch").alias("near_edited"),
        F.coalesce(likeness("sketch", "next_sketch"), F.lit(0.0)).alias("near_next"))
