from pyspark.sql import functions as F

from litsift.operators import corpus, rank, sampling


def test_parse_ids_and_blank(spark):
    df = spark.createDataFrame([("a", "123, 456\n789"), ("b", "   "), ("c", "")], "s string, t string")
    got = sorted((r["s"], r["pmid"]) for r in corpus.parse_ids(df, "t", keep=["s"]).collect())
    assert got == [("a", "123"), ("a", "456"), ("a", "789")]


def test_chunk_len_rule(spark):
    df = spark.createDataFrame([(n,) for n in [1, 399, 400, 799, 800, 1000, 5000]], "n long")
    got = [r[0] for r in df.select(corpus.batch_chunk_len(F.col("n"))).collect()]
    # smallest K with floor(N/K) < 400, chunk = floor(N/K)
    exp = []
    for n in [1, 399, 400, 799, 800, 1000, 5000]:
        k = 1
        while n // k >= 400:
            k += 1
        exp.append(n // k)
    assert got == exp


def test_id_in_both_classes_gives_two_rows(spark):
    pos = spark.createDataFrame([("1",), ("2",)], "pmid string")
    neg = spark.createDataFrame([("2",)], "pmid string")
    tbd = spark.createDataFrame([("3",)], "pmid string")
    idx = corpus.build_index(pos, neg, tbd)
    arts = spark.createDataFrame([("1", "2001", "t1", "x"), ("2", "2002", "t2", "y"),
                                  ("3", "2003", "t3", None), ("3", "2003", "t3", None)],
                                 "pmid string, year string, title string, abstract string")
    lab = corpus.assemble_corpus(idx, arts)
    got = sorted((r["pmid"], r["class"]) for r in lab.collect())
    assert got == [("1", 1), ("2", 0), ("2", 1)]


def test_ranked_list_properties(spark):
    rows = [(str(i), "2000", f"t{i}", "Positive" if i % 3 == 0 else "Negative", (i % 7) / 7)
            for i in range(60)]
    pred = spark.createDataFrame(rows, "pmid string, year string, title string, pred_class string, "
                                       "p_positive double")
    out = rank.ranked_list(pred).toPandas()
    r = out[rank.COL_RANK]
    assert sorted(r) == list(range(1, 61))
    out = out.sort_values(rank.COL_RANK)
    labels = list(out[rank.COL_LABEL])
    assert labels == sorted(labels, key=lambda x: x != "Positive")
    assert out[rank.COL_ARTICLE].iloc[0].startswith('<a href="http://www.ncbi.nlm.nih.gov/pubmed/')


def test_folds_near_equal(spark):
    df = spark.createDataFrame([(str(i),) for i in range(103)], "pmid string")
    sizes = [r["count"] for r in sampling.assign_folds(df, 5, 42).groupBy("fold").count().collect()]
    assert sorted(sizes) == [20, 20, 21, 21, 21]


def test_check_inputs():
    import pytest
    corpus.check_inputs("1,2", "", "", "allergy", "3", "")
    with pytest.raises(ValueError):
        corpus.check_inputs("1,2", "", "", "", "3", "")


def test_table_sink_round_trip(spark, tmp_path):
    from litsift.sources.files import write_table
    df = spark.createDataFrame([(100, 1.5), (200, 2.5)], "n_docs long, seconds double")
    write_table(df, str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert sorted(map(tuple, back.collect())) == [(100, 1.5), (200, 2.5)]


def test_term_search_and_empty_query(spark):
    import pytest
    from litsift.sources.search import term_search
    arts = spark.createDataFrame([("5", "2001", "Mast cells", "IgE binding to mast cells"),
                                  ("3", "2002", "Orbit", "A comet orbit"),
                                  ("9", "2003", "Mast", None)],
                                 "pmid string, year string, title string, abstract string")
    got = [r["pmid"] for r in term_search(arts, "mast AND cells").collect()]
    assert got == ["5"]
    assert [r["pmid"] for r in term_search(arts, "mast", max_hits=1).collect()] == ["5"]
    with pytest.raises(ValueError):
        term_search(arts, "quasar", check_empty=True)
    u = corpus.category_union(spark.createDataFrame([("1",)], "pmid string"),
                              term_search(arts, "comet"))
    assert sorted(r["pmid"] for r in u.collect()) == ["1", "3"]


def test_odd_values_do_not_end_a_job(spark):
    from litsift.operators import corpus, rank, terms
    from litsift.sources.search import parse_query, term_search
    years = spark.createDataFrame([("1", "n/a"), ("2", "2019"), ("3", None), ("4", "2021")], "pmid string, year string")
    assert [r.pmid for r in corpus.year_filter(years).collect()] == ["2"]
    art = spark.createDataFrame([("x1", "2000", "<script>&\"", "T cell CD8"), ("2", "2001", None, "T CELL")],
                                "pmid string, year string, title string, abstract string")
    index = spark.createDataFrame([("9", 1)], "pmid string, class int")
    row = corpus.coverage(index, art).first()
    assert (row.n_index, row.n_retrieved, row.pct_retrieved, row.pct_with_abstract) == (1, 0, 0.0, None)
    ranked = rank.ranked_list(art.selectExpr("*", "'Positive' pred_class", "0.5D p_positive")).collect()
    assert any("&lt;script&gt;&amp;&quot;" in r["Article"] for r in ranked) and len(ranked) == 2
    for query in ("T cell [AND] CD8", "t cell and cd8", "T cell And CD8"):
        assert parse_query(query) == ["t cell", "cd8"]
        assert [r.pmid for r in term_search(art, query).collect()] == ["x1"]
    assert parse_query("brand [and] sand") == ["brand", "sand"]
    counts = spark.createDataFrame([("1", "a", 2, 1.0)], "pmid string, term string, n long, label double")
    names = spark.createDataFrame([("a",)], "term string")
    sizes = spark.createDataFrame([(1, 0)], "n1 long, n0 long")
    assert terms.class_term_means(counts, names, sizes).first().mean_neg is None
    welch = terms.welch_terms(counts.withColumn("tfidf", counts.n * 1.0), names, sizes, with_p=False).first()
    assert welch.t is None and welch.df is None
