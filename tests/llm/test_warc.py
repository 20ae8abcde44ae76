import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from litsift.llm import warc
from litsift.llm.common import Scratch

BIG = "<p>" + "é long page " * 20
ROWS = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (2, "http://a/2", BIG), (3, None, BIG), (None, "http://n/", BIG),
        (4, "http://s/", "short"), (5, "http://s/2", "short"), (6, "http://e/", None), (7, "http://e/\r\nX: 1", ""),
        (9, "u", BIG + "9"), (9, "u", BIG + "9"), (None, "m", BIG + "m"), (None, "m", BIG + "m"),
        (10, "http://ü/", "y" * 300000), (11, "http://ü/b", "\r\n\r\nWARC/1.1\r\n" * 30)]


def write(spark, rows, name):
    pages = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, offset long, digest string")
    scratch = Scratch(spark, name)
    return scratch.path("a"), scratch.keep(warc.write(warc.assign(pages.repartition(3)), scratch.path("a")), "i")


def test_round_trip(spark):
    folder, index = write(spark, ROWS, "w")
    assert index.count() == len(ROWS)
    got = warc.read(index, folder).collect()
    least = {}
    for page, _, html in ROWS:
        if len((html or "").encode()) >= 100 and page is not None:
            least[html] = min(page, least.get(html, page))
    want = []
    for page, url, html in ROWS:
        data = (html or "").encode()
        again = html in least and page != least[html]
        want.append((str(page), str(url), "revisit" if again else "response", str(least[html] if again else None),
                     hashlib.sha256(data).hexdigest(), None if again else data))
    have = [(str(r.page_id), str(r.url), r.record_type, str(r.refers_to), r.payload_digest,
             None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)


def test_selected_records_and_standard_members(spark, monkeypatch):
    monkeypatch.setattr(warc, "GAP_BYTES", 10)
    folder, index = write(spark, ROWS, "s")
    picked = index.filter(F.col("page_id").isin(1, 4, 10))
    assert sorted(r.page_id for r in warc.read(picked, folder).collect()) == [1, 4, 10]
    row = picked.filter("page_id = 1").first()
    with open(f"{folder.removeprefix('file:')}/{row.file}", "rb") as f:
        whole = gzip.decompress(f.read())
    n = index.filter(F.col("file") == row.file).count()
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: ") and whole.count(b"WARC-Record-ID: ") == n
    assert whole.count(b"\r\nX: 1\r\n") == 0


def test_query_and_empty_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in warc.op9_warc(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        assert (got[r.page_id].payload_bytes, got[r.page_id].payload_digest) == (
            len(r.html.encode()), hashlib.sha256(r.html.encode()).hexdigest())
    scratch = Scratch(spark, "none")
    index = scratch.keep(warc.write(warc.assign(pages.limit(0)), scratch.path("a")), "i")
    assert warc.read(index, scratch.path("a")).count() == 0


@pytest.mark.parametrize("kind", ["string", "int", "date"])
def test_ids_of_any_type(spark, kind):
    pages = spark.createDataFrame([(1, "u1", BIG), (2, "u2", BIG), (3, "u3", "x"), (None, None, BIG)], "page_id int, url string, html string")
    ids = {"string": F.concat(F.lit("page "), F.col("page_id")), "int": F.col("page_id"),
           "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("page_id"))}[kind]
    scratch = Scratch(spark, "ids")
    index = scratch.keep(warc.write(warc.assign(pages.withColumn("page_id", ids)), scratch.path("a")), "i")
    got = {r.url: r for r in warc.read(index, scratch.path("a")).collect()}
    assert got["u2"].refers_to == got["u1"].page_id == got[None].refers_to and got["u1"].refers_to is None
    assert dict(warc.read(index, scratch.path("a")).dtypes)["refers_to"] == kind


@pytest.mark.parametrize("hot", [1, 1 << 40])
def test_one_payload_on_most_pages(spark, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT", hot)
    rows = [(i, f"u{i}", BIG if i % 3 else BIG + str(i % 6)) for i in range(60)]
    assigned = warc.assign(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    least = {h: min(i for i, _, x in rows if x == h) for _, _, h in rows}
    assert len(assigned) == 60
    assert all(r.refers_to == (None if r.page_id == least[r.html] else least[r.html]) for r in assigned)
