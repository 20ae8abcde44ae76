"""Boolean and phrase search over an index of an article table.

The index has a row for each term of each article record, with the term's positions, and lies in
folders by a bucket of the term: a search reads the buckets of its own terms only, and of these the
row groups that hold them. The rows found are grouped by record and the query is a filter over them,
so a term that most articles hold is spread over all tasks.

Queries: words, "phrases in quotes", AND, OR, NOT (in any case, also in square brackets) and round
brackets. Words beside one another are joined by AND; NOT binds first, then AND, then OR. Words are
those of the text recipe (:data:`litsift.functions.text.TOKEN_PATTERN`), stop words included, matched whole;
a word of a query that holds several of them is a phrase. No phrase runs from title to abstract.

A record is one row of the article table: one whose text fits is a hit for its id. A null title or
abstract has no words. Articles without an id are not indexed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litsift.functions.text import tokenize
from litsift.session import ship_package

#: Folders of the index.
BUCKETS = 64

_LEXEME = re.compile(r"""\s*(?:(?P<quote>"[^"]*")|(?P<bracket>[()])|\[(?P<op>and|or|not)\]|(?P<word>[^\s()"]+))""", re.IGNORECASE)
#: The words of a query: as those of a text (letters, digits, an apostrophe inside).
_WORDS = re.compile(r"[^\W_]+(?:'[^\W\d_]+)*")


@dataclass(frozen=True)
class Words:
    """One word, or several that follow one another."""
    words: tuple[str, ...]

    def leaves(self) -> list["Words"]:
        return [self]


@dataclass(frozen=True)
class Join:
    """``and``, ``or`` or ``not`` over parts."""
    kind: str
    parts: tuple

    def leaves(self) -> list[Words]:
        return [leaf for part in self.parts for leaf in part.leaves()]


def parse(query: str) -> Words | Join:
    """The tree of a query; ``ValueError`` for one that is empty or not well formed."""
    items, at = [], 0
    while query[at:].strip():
        m = _LEXEME.match(query, at)
        if not m:
            raise ValueError(f"cannot read the query from {query[at:]!r}")
        at = m.end()
        if m["bracket"]:
            items.append(m["bracket"])
        elif m["op"] or (m["word"] or "").lower() in ("and", "or", "not"):
            items.append((m["op"] or m["word"]).lower())
        else:
            words = tuple(_WORDS.findall((m["quote"] or m["word"]).lower()))
            if words:
                items.append(Words(words))
    tree, rest = _either(items)
    if rest:
        raise ValueError(f"unexpected {rest[0]!r} in the query {query!r}")
    return tree


def _either(items: list):
    parts, items = _all(items)
    found = [parts]
    while items and items[0] == "or":
        part, items = _all(items[1:])
        found.append(part)
    return (found[0] if len(found) == 1 else Join("or", tuple(found))), items


def _all(items: list):
    part, items = _one(items)
    found = [part]
    while items and items[0] not in ("or", ")"):
        part, items = _one(items[1:] if items[0] == "and" else items)
        found.append(part)
    return (found[0] if len(found) == 1 else Join("and", tuple(found))), items


def _one(items: list):
    if not items:
        raise ValueError("the query ends where a word is expected")
    first, rest = items[0], items[1:]
    if first == "not":
        part, rest = _one(rest)
        return Join("not", (part,)), rest
    if first == "(":
        part, rest = _either(rest)
        if not rest or rest[0] != ")":
            raise ValueError("a bracket is not closed")
        return part, rest[1:]
    if not isinstance(first, Words):
        raise ValueError(f"unexpected {first!r} where a word is expected")
    return first, rest


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record, pmid, term, places) of (record, pmid, a, b), record by record: a record's words need no shuffle."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            place, row, words = [], [], []
            sizes = pc.list_value_length(part.column("a")).to_numpy(zero_copy_only=False).astype(np.int64)
            for name, shift in (("a", np.zeros_like(sizes)), ("b", sizes + 1)):  # a place is left free between title and abstract
                own = part.column(name)
                many = pc.list_value_length(own).to_numpy(zero_copy_only=False).astype(np.int64)
                first = np.cumsum(many) - many
                row.append(np.repeat(np.arange(len(many)), many))
                place.append(np.arange(many.sum()) + np.repeat(shift - first, many))
                words.append(own.flatten())
            row, place = np.concatenate(row), np.concatenate(place)
            if not len(row):
                continue
            coded = pa.concat_arrays(words).dictionary_encode()
            code = coded.indices.to_numpy()
            order = np.lexsort((place, code, row))
            row, code, place = row[order], code[order], place[order]
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])]))
            places = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)).astype(np.int32)), pa.array(place.astype(np.int32)))
            own = pa.array(row[new])
            yield pa.RecordBatch.from_arrays([part.column("record").take(own), part.column("pmid").take(own),
                                              coded.dictionary.take(pa.array(code[new])), places], ["record", "pmid", "term", "places"])


def placed(rows: DataFrame) -> DataFrame:
    """(record, pmid, term, places) of records' words (record, pmid, a, b)."""
    return rows.mapInArrow(_postings, "record long, pmid string, term string, places array<int>")


def build_index(articles: DataFrame, path: str) -> None:
    """Write the index of (pmid, title, abstract) below ``path``."""
    ship_package(articles.sparkSession)
    rows = articles.filter(F.col("pmid").isNotNull()).select(
        F.col("pmid").cast("string").alias("pmid"), tokenize("title").alias("a"), tokenize("abstract").alias("b"), F.monotonically_increasing_id().alias("record"))
    rows.select("record", "pmid").write.mode("overwrite").parquet(f"{path}/records")
    placed(rows).withColumn("bucket", (F.crc32("term") % BUCKETS).cast("int")).repartition("bucket", F.pmod(F.xxhash64("record"), F.lit(8))) \
        .sortWithinPartitions("bucket", "term", "record").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def _holds(leaf: Words, place: dict[str, Column]) -> Column:
    """Whether a record has the words one after the other."""
    first = place[leaf.words[0]]
    if len(leaf.words) == 1:
        return first.isNotNull()
    starts = first
    for k, word in enumerate(leaf.words[1:], 1):
        starts = F.array_intersect(starts, _moved(place[word], k))
    return F.coalesce(F.size(starts) > 0, F.lit(False))


def _truth(node: Words | Join, of) -> Column | bool:
    if isinstance(node, Words):
        return of(node)
    parts = [_truth(p, of) for p in node.parts]
    if node.kind == "not":
        return (not parts[0]) if isinstance(parts[0], bool) else ~parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if node.kind == "and" else (out | p)
    return out


def search_index(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(pmid) of the articles that fit a query, from the index below ``path``."""
    tree = parse(query)
    words = sorted({w for leaf in tree.leaves() for w in leaf.words})
    found = spark.read.schema("record long, pmid string, term string, places array<int>, bucket int").parquet(f"{path}/terms").filter(
        F.col("bucket").isin(sorted({_bucket(w) for w in words})) & F.col("term").isin(words))
    found = found.groupBy("record", "pmid").agg(*[F.max(F.when(F.col("term") == w, F.col("places"))).alias(f"w{i}")
                                                  for i, w in enumerate(words)])
    if _truth(tree, lambda leaf: False):  # a record with none of the words fits as well
        found = spark.read.schema("record long, pmid string").parquet(f"{path}/records").join(found.drop("pmid"), "record", "left")
    place = {w: F.col(f"w{i}") for i, w in enumerate(words)}
    return found.filter(_truth(tree, lambda leaf: _holds(leaf, place))).select("pmid").distinct()
