import random
import re

import pytest

from litsift.functions.text import TOKEN_PATTERN
from litsift.sources import boolean


def words_of(text):
    return re.findall(TOKEN_PATTERN.replace(r"[\p{L}\p{N}]", r"[^\W_]").replace(r"\p{L}", r"[^\W\d_]"), (text or "").lower())


def fits(node, title, abstract):
    """Whether a record fits, by plain scans."""
    if isinstance(node, boolean.Words):
        n = len(node.words)
        return any(tuple(own[i:i + n]) == node.words for own in (words_of(title), words_of(abstract)) for i in range(len(own)))
    got = [fits(p, title, abstract) for p in node.parts]
    return not got[0] if node.kind == "not" else all(got) if node.kind == "and" else any(got)


RECORDS = [("1", "T cell memory", "The CD8 T cell and its memory."), ("2", "B cells", "don't mix B cell and T cell"),
           ("3", None, "cell T"), ("4", "memory T", None), ("4", "cell", None), ("5", None, None), (None, "T cell", "x"),
           ("6", "Ünlü CELL", "T cell, T cell; t-cell (CD8)."), ("7", "cell", "the the the the cell")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    draw = random.Random(3)
    more = [(str(100 + i), " ".join(draw.choices("abcdef", k=3)), " ".join(draw.choices("abcdef", k=8))) for i in range(120)]
    path = str(tmp_path_factory.mktemp("index"))
    boolean.build_index(spark.createDataFrame(RECORDS + more, "pmid string, title string, abstract string"), path)
    return path, RECORDS + more


@pytest.mark.parametrize("query", [
    "cell", "T cell", '"T cell"', '"t CELL" AND cd8', "cell [AND] memory", "memory OR mix", "cell AND NOT memory", "NOT cell",
    "not (memory or cell) or cd8", "don't", "t-cell", '"cell t"', '"the the the"', '"memory the"', "ünlü", "absentword",
    '"a b"', '"a b c"', "a NOT b", "(a OR b) AND (c OR NOT d)", '"a b" OR "b a" AND NOT "c d"', 'NOT "a b" NOT "b a" f', "NOT NOT a"])
def test_against_scans(spark, index, query):
    path, records = index
    want = {p for p, t, a in records if p is not None and fits(boolean.parse(query), t, a)}
    got = [r.pmid for r in boolean.search_index(spark, path, query).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("query", ["", "  ", "AND", "a AND", "OR a", "(a", "a)", "()", "NOT", "a AND OR b", '"" ...'])
def test_bad_queries(query):
    with pytest.raises(ValueError):
        boolean.parse(query)


def test_only_matching_parts_of_the_index_are_read(spark, index):
    plan = boolean.search_index(spark, index[0], '"a b" AND NOT c')._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "bucket#" in plan.split("PartitionFilters")[1][:200]
    assert "In(term" in plan.split("PushedFilters")[1][:300]


def test_empty_table(spark, tmp_path):
    boolean.build_index(spark.createDataFrame([], "pmid string, title string, abstract string"), str(tmp_path / "i"))
    with pytest.raises(Exception):
        spark.read.parquet(str(tmp_path / "none"))
    assert boolean.search_index(spark, str(tmp_path / "i"), "a or not b").count() == 0


def test_postings_of_a_record_need_no_shuffle(spark):
    rows = spark.createDataFrame([(1, "x", ["t", "cell", "t"], ["cell", "t"]), (2, "y", [], []), (3, "z", [], ["t"])],
                                 "record long, pmid string, a array<string>, b array<string>")
    found = boolean.placed(rows)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.record, r.pmid, r.term, r.places) for r in found.collect()) == [
        (1, "x", "cell", [1, 4]), (1, "x", "t", [0, 2, 5]), (3, "z", "t", [1])]
