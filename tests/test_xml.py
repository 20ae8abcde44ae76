from litsift.sources.xml import read_xml_articles

GOLDEN = """<?xml version="1.0" ?>
<!DOCTYPE PubmedArticleSet>
<PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID Version="1">101</PMID><Article>
<ArticleTitle>On <i>CD8</i> cells</ArticleTitle>
<Abstract><AbstractText Label="A">Part one.</AbstractText><AbstractText Label="B"> Part two.</AbstractText></Abstract>
</Article></MedlineCitation><PubmedData><History>
<PubMedPubDate PubStatus="received"><Year>2011</Year></PubMedPubDate>
<PubMedPubDate PubStatus="accepted"><Year>2012</Year></PubMedPubDate>
</History></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>102</PMID><Article><ArticleTitle>No abstract</ArticleTitle>
</Article></MedlineCitation><PubmedData><History><PubMedPubDate><Year>2019</Year></PubMedPubDate></History></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><Article><ArticleTitle>No id</ArticleTitle>
<Abstract><AbstractText>Text.</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>
</PubmedArticleSet>
"""


def test_xml_records(spark, tmp_path):
    p = tmp_path / "a.xml"
    p.write_text(GOLDEN)
    rows = read_xml_articles(spark, str(p)).collect()
    assert len(rows) == 3
    by_title = {r["title"]: r for r in rows}
    a = by_title["On CD8 cells"]
    assert a["pmid"] == "101" and a["year"] == "2011" and a["abstract"] == "Part one. Part two."
    b = by_title["No abstract"]
    assert b["abstract"] is None and b["year"] == "2019"
    c = by_title["No id"]
    assert c["pmid"] is None and c["year"] is None and c["abstract"] == "Text."


WIDE = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><Journal><Title>Journal of A &amp; B</Title>
<ISOAbbreviation>J. A B</ISOAbbreviation></Journal><ArticleTitle>T<sub>1</sub> &#233; <b>x<i>y</i></b></ArticleTitle>
<Abstract><AbstractText>One.</AbstractText></Abstract></Article><KeywordList><Keyword>k<i>1</i></Keyword><Keyword>k2</Keyword></KeywordList>
</MedlineCitation><PubmedData><History><PubMedPubDate><Year>2001</Year><Month>2</Month><Day/></PubMedPubDate>
<PubMedPubDate><Year>1999</Year><Month>3</Month></PubMedPubDate></History><ArticleIdList><ArticleId IdType="pubmed">7</ArticleId>
<ArticleId IdType="doi">10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>8</PMID><Article><ArticleTitle>not <b>well</ArticleTitle></Article></MedlineCitation></PubmedArticle>
</PubmedArticleSet>"""


def test_wide_records(spark, tmp_path):
    (tmp_path / "w.xml").write_text(WIDE)
    a, b = sorted(read_xml_articles(spark, str(tmp_path / "w.xml"), wide=True).collect(), key=lambda r: r.malformed)
    assert a.asDict() == {"pmid": "7", "doi": "10.1/x", "title": "T1 \u00e9 xy", "abstract": "One.", "year": "2001", "month": "2",
                          "day": "", "journal": "Journal of A & B", "jabbrv": "J. A B", "keywords": ["k1", "k2"], "malformed": False}
    assert b.malformed and b.pmid is None and b.keywords == []


def test_one_parse_a_record(spark):
    from litsift.sources import xml

    plan = xml.parse_records(spark.createDataFrame([("<a/>",)], "xml string"))._jdf.queryExecution().executedPlan().toString()
    assert "xpath" not in plan and plan.count("MapInArrow") == 1
    rows = [(None,), ("",), ("<PubmedArticle/>",)]
    got = xml.parse_records(spark.createDataFrame(rows, "xml string"), wide=True).collect()
    assert [r.malformed for r in got] == [True, True, False] and all(r.pmid is None for r in got)
