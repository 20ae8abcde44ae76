"""Article XML records -> article rows.

A file of ``<PubmedArticle>`` records is split on the closing tag by the text
source (``lineSep``), so records are read in parallel splits like lines. Each record is parsed
once, in Arrow batches: one walk over its tags collects every field. The built-in XML source is not
used: it turns mixed content (``On <i>CD8</i> cells``) into nested fields, while the text of a
node with all that is in it stays whole here ("On CD8 cells"), and abstract parts are joined.

Of a field that occurs more than once the first counts; keywords are all kept. A field that
doesn't occur is null, one without text is empty. A record that is not well formed has nulls and
is marked in ``malformed`` of the wide rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsift.session import ship_package

RECORD_TAG = "PubmedArticle"
# Where each field sits in a record (first match wins).
PATHS = {
    "pmid": "PubmedArticle/MedlineCitation/PMID",
    "title": "PubmedArticle/MedlineCitation/Article/ArticleTitle",
    "abstract": "PubmedArticle/MedlineCitation/Article/Abstract",
    "year": "PubmedArticle/PubmedData/History/PubMedPubDate/Year",
    "month": "PubmedArticle/PubmedData/History/PubMedPubDate/Month",
    "day": "PubmedArticle/PubmedData/History/PubMedPubDate/Day",
    "journal": "PubmedArticle/MedlineCitation/Article/Journal/Title",
    "jabbrv": "PubmedArticle/MedlineCitation/Article/Journal/ISOAbbreviation",
    "doi": "PubmedArticle/PubmedData/ArticleIdList/ArticleId",
}
KEYWORDS = "PubmedArticle/MedlineCitation/KeywordList/Keyword"
NARROW = ["pmid", "year", "title", "abstract"]
WIDE = ["pmid", "doi", "title", "abstract", "year", "month", "day", "journal", "jabbrv"]
_FIELD = {path: name for name, path in PATHS.items()}


class _Walk:
    """One walk over a record's tags; ``found`` holds the text of each field."""

    def __init__(self, record: str):
        self.found: dict[str, str] = {}
        self.keywords: list[str] = []
        self._path: list[str] = []
        self._open: tuple[int, str, list[str]] | None = None  # depth, field and text of the node being read
        parser = expat.ParserCreate()
        parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler = self._start, self._end
        parser.CharacterDataHandler = self._text
        try:
            parser.Parse(record, True)
            self.malformed = False
        except expat.ExpatError:
            self.found, self.keywords, self.malformed = {}, [], True

    def _start(self, name: str, attributes: dict[str, str]) -> None:
        self._path.append(name)
        if self._open:
            return
        path = "/".join(self._path)
        field = "keyword" if path == KEYWORDS else _FIELD.get(path)
        if field == "doi" and attributes.get("IdType") != "doi":
            return
        if field and field not in self.found:
            self._open = (len(self._path), field, [])

    def _text(self, data: str) -> None:
        if self._open:
            self._open[2].append(data)

    def _end(self, name: str) -> None:
        if self._open and self._open[0] == len(self._path):
            _, field, text = self._open
            if field == "keyword":
                self.keywords.append("".join(text))
            else:
                self.found[field] = "".join(text)
            self._open = None
        self._path.pop()


def parse_records(records: DataFrame, col: str = "xml", wide: bool = False) -> DataFrame:
    """One article row per XML record string: (pmid, year, title, abstract), or all fields if ``wide``."""
    ship_package(records.sparkSession)
    names = WIDE if wide else NARROW
    schema = ", ".join(f"{n} string" for n in names) + (", keywords array<string>, malformed boolean" if wide else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                walks = [_Walk(x or "") for x in batch.column(0).slice(a, 1024).to_pylist()]
                columns = [pa.array([w.found.get(n) for w in walks], pa.string()) for n in names]
                if wide:
                    columns += [pa.array([w.keywords for w in walks], pa.list_(pa.string())),
                                pa.array([w.malformed for w in walks], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, [*names, "keywords", "malformed"] if wide else names)

    return records.select(col).mapInArrow(run, schema)


def read_xml_articles(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """Read files of ``<PubmedArticle>`` records (optionally wrapped in a set element)."""
    close = f"</{RECORD_TAG}>"
    raw = spark.read.option("lineSep", close).text(path)
    # the record's opening tag, not a wrapping <PubmedArticleSet>
    start = F.regexp_instr(F.col("value"), F.lit(f"<{RECORD_TAG}[\\s>]"))
    recs = (raw.select(F.col("value"), start.alias("_s")).where(F.col("_s") > 0)
            .select(F.concat(F.expr("substring(value, _s)"), F.lit(close)).alias("xml")))
    return parse_records(recs, wide=wide)


def _escaped(c):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


def _element(name: str, body, attributes: str = ""):
    return F.concat(F.lit(f"<{name}{attributes}>"), body, F.lit(f"</{name}>"))


def to_xml_records(articles: DataFrame) -> DataFrame:
    """Render article rows as XML record strings (escaped text).

    (pmid, year, title, abstract) are needed; doi, month, day, journal, jabbrv and keywords are
    rendered if there are such columns. A null field is left out, but for pmid, title and year.
    """
    def field(tag: str, name: str, attributes: str = ""):
        if name not in articles.columns:
            return F.lit("")
        return F.coalesce(_element(tag, _escaped(F.col(name)), attributes), F.lit(""))

    abstract = F.coalesce(_element("Abstract", _element("AbstractText", _escaped(F.col("abstract")))), F.lit(""))
    keywords = F.lit("")
    if "keywords" in articles.columns:
        keywords = _element("KeywordList", F.array_join(F.transform("keywords", lambda k: _element("Keyword", _escaped(k))), ""))
    journal = F.lit("")
    if "journal" in articles.columns:
        journal = _element("Journal", F.concat(field("Title", "journal"), field("ISOAbbreviation", "jabbrv")))
    article = F.concat(journal, _element("ArticleTitle", _escaped(F.col("title"))), abstract)
    cited = _element("MedlineCitation", F.concat(
        _element("PMID", _escaped(F.col("pmid"))), _element("Article", article), keywords))
    history = _element("History", _element("PubMedPubDate", F.concat(
        _element("Year", _escaped(F.col("year"))), field("Month", "month"), field("Day", "day"))))
    ids = F.lit("")
    if "doi" in articles.columns:
        ids = _element("ArticleIdList", F.concat(field("ArticleId", "pmid", ' IdType="pubmed"'), field("ArticleId", "doi", ' IdType="doi"')))
    return articles.select(_element(RECORD_TAG, F.concat(cited, _element("PubmedData", F.concat(history, ids)))).alias("xml"))
