"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Each query builds its stand-in input from the given tables (:mod:`fixtures`) and
runs the library operator on the whole of it.  Doubles are rounded to 6 places in
the output (and in the matching oracle SQL) so engines compare equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litsift.functions.text import analyze, remove_stopwords, tokenize
from litsift.operators import corpus, evaluate, heavy, rank, sampling, terms
from litsift.plans import fixtures as fx
from litsift.session import ensure_checkpoint_dir, ship_package
from litsift.sources import boolean, files
from litsift.sources.search import term_search

# Fixed values used by the registered queries.
SEARCH_QUERY = "the [AND] ing"
QUERY_CATEGORY_TERMS = "with AND from"
SEARCH_RETMAX = 100
BOOLEAN_QUERY = '(threea OR "of the" with) [AND] NOT (from OR "to the") OR NOT the'
PHRASE_QUERY = '"of the" and that'


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 places."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`"), 6).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


class Ctx:
    """Stand-in inputs of one scale factor, built lazily from the given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship_package(spark)
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.docs = fx.load(spark, sf_dir, "documents")
        self.labels = fx.load(spark, sf_dir, "labels")

    @property
    def articles(self):
        return fx.articles(self.docs)

    @property
    def index(self):
        return fx.article_index(self.docs, self.labels)

    @property
    def labelled(self):
        """The labelled corpus. Not cached: it holds whole texts, and most queries read it once."""
        return corpus.assemble_corpus(self.index, self.articles)

    @property
    def train(self):
        return corpus.split_train(self.labelled)

    @property
    def test(self):
        return corpus.split_test(self.labelled)

    @property
    def scored(self):
        return fx.scored(self.labels)

    @property
    def truth(self):
        return fx.truth(self.labels)

    def term_table(self, stem: bool = False) -> terms.TermTable:
        return terms.TermTable(self.train, stem=stem)

    def test_predictions(self):
        """Scored rows of the held-out ids with their true class, keyed by display name."""
        pred = self.scored.drop("class")
        return evaluate.model_names(corpus.attach_truth(pred, self.truth))

    def ranked_input(self):
        t = self.test.select("pmid", "year", "title")
        j = t.join(fx.rank_scores(t.select("pmid").distinct()), "pmid")
        return j.withColumn("pred_class", F.when(F.col("p_positive") >= 0.5, "Positive")
                            .otherwise("Negative"))


# ---------------------------------------------------------------- corpus

def q_id_list_parse(spark, sf):
    c = Ctx(spark, sf)
    return corpus.parse_ids(fx.id_text(c.docs), "id_text", keep=["source", "block"])


def q_term_search(spark, sf):
    c = Ctx(spark, sf)
    return term_search(c.articles, SEARCH_QUERY, check_empty=True)


def q_term_search_retmax(spark, sf):
    """A search that asks for the lowest ids only."""
    return term_search(Ctx(spark, sf).articles, SEARCH_QUERY, max_hits=SEARCH_RETMAX)


def _searched(spark, sf, query):
    """Articles indexed, then searched through the index."""
    path = files.scratch_path(spark, "index")
    boolean.build_index(Ctx(spark, sf).articles, path)
    return boolean.search_index(spark, path, query)


def q_term_search_boolean(spark, sf):
    return _searched(spark, sf, BOOLEAN_QUERY)


def q_term_search_phrase(spark, sf):
    return _searched(spark, sf, PHRASE_QUERY)


def q_category_union(spark, sf):
    c = Ctx(spark, sf)
    ids = c.index.where(F.col("class") == 1).select("pmid")
    return corpus.category_union(ids, term_search(c.articles, QUERY_CATEGORY_TERMS))


def q_build_index(spark, sf):
    c = Ctx(spark, sf)
    idx = c.index
    return corpus.build_index(idx.where("class = 1"), idx.where("class = 0"),
                              idx.where("class = 2"))


def q_retrieve_by_id(spark, sf):
    c = Ctx(spark, sf)
    return corpus.retrieve_by_id(c.articles, c.index)


def q_batch_plan(spark, sf):
    return corpus.batch_plan(Ctx(spark, sf).index)


def q_index_retrieved(spark, sf):
    c = Ctx(spark, sf)
    return corpus.index_retrieved(c.index, c.articles)


def q_missing_abstracts(spark, sf):
    c = Ctx(spark, sf)
    return corpus.missing_abstracts(corpus.retrieve_by_id(c.articles, c.index))


def q_drop_missing(spark, sf):
    c = Ctx(spark, sf)
    fetched = corpus.retrieve_by_id(c.articles, c.index)
    return corpus.drop_missing(fetched, corpus.missing_abstracts(fetched))


def q_labelled_articles(spark, sf):
    return Ctx(spark, sf).labelled


def q_coverage(spark, sf):
    c = Ctx(spark, sf)
    return r6(corpus.coverage(c.index, c.articles))


def q_class_counts(spark, sf):
    return corpus.class_counts(Ctx(spark, sf).labelled)


def q_split_train(spark, sf):
    return Ctx(spark, sf).train


def q_split_test(spark, sf):
    return Ctx(spark, sf).test


def _curated_split(c: Ctx) -> DataFrame:
    cur = fx.curated_sets(c.docs, c.labels)
    return sampling.stratified_split(cur, "class", 0.8, seed=1353)


def q_stratified_split(spark, sf):
    return _curated_split(Ctx(spark, sf)).select("pmid", "class", "split")


def q_year_filter(spark, sf):
    c = Ctx(spark, sf)
    return corpus.year_filter(fx.curated_sets(c.docs, c.labels)) \
        .select("pmid", "year", "class")


def q_recode_labels(spark, sf):
    sp = _curated_split(Ctx(spark, sf))
    tr = sp.where("split = 'train'").drop("split")
    ho = sp.where("split = 'test'").drop("split")
    return corpus.recode_labels(tr, ho).select("pmid", "year", "class")


def q_truth_labels(spark, sf):
    c = Ctx(spark, sf)
    positives = c.labels.where("quality = 1").select(F.col("doc_id").cast("string").alias("pmid"))
    return corpus.truth_labels(c.test, positives)


def q_attach_truth(spark, sf):
    c = Ctx(spark, sf)
    return r6(corpus.attach_truth(c.scored, c.truth))


def q_prefix_split(spark, sf):
    return sampling.prefix_split(Ctx(spark, sf).train.select("pmid", "class")) \
        .select("pmid", "class", "split")


def q_balance_classes(spark, sf):
    return sampling.balance_classes(Ctx(spark, sf).train.select("pmid", "class"))


def q_head_per_class(spark, sf):
    return sampling.head_per_class(Ctx(spark, sf).train.select("pmid", "class"), 100)


def q_assign_folds(spark, sf):
    return sampling.assign_folds(Ctx(spark, sf).train.select("pmid", "class"), 5, 42,
                                 tie=["class"])


def q_corpus_guard(spark, sf):
    return corpus.corpus_guard(Ctx(spark, sf).labelled)


# ---------------------------------------------------------------- text

def q_tokenize(spark, sf):
    t = Ctx(spark, sf).train.select("pmid", tokenize(F.col("abstract")).alias("t"))
    return t.select("pmid", F.size("t").alias("n_tokens"),
                    F.array_join("t", " ").alias("tokens"))


def q_remove_stopwords(spark, sf):
    t = Ctx(spark, sf).train.select("pmid", remove_stopwords(tokenize(F.col("abstract"))).alias("t"))
    return t.select("pmid", F.size("t").alias("n_tokens"),
                    F.array_join("t", " ").alias("tokens"))


def q_stem_tokens(spark, sf):
    t = Ctx(spark, sf).train.select("pmid", analyze(F.col("abstract"), stem=True).alias("t"))
    return t.select("pmid", F.size("t").alias("n_tokens"),
                    F.array_join("t", " ").alias("tokens"))


def q_term_counts(spark, sf):
    return Ctx(spark, sf).term_table().counts


def q_top_tokens(spark, sf):
    """The vocabulary through bounded summaries and an exact recount."""
    train = Ctx(spark, sf).train.select(analyze(F.col("abstract"), stem=False).alias("tokens")).checkpoint()
    return heavy.heavy_terms(train, terms.MAX_TOKENS)[0]


def q_doc_freq(spark, sf):
    return terms.doc_freq(Ctx(spark, sf).term_table().vcounts)


def q_tfidf(spark, sf):
    return r6(Ctx(spark, sf).term_table().tfidf)


def q_alpha_terms(spark, sf):
    return terms.alpha_terms(Ctx(spark, sf).term_table().vocab.select("term"))


# ---------------------------------------------------------------- term statistics

def _means(tt):
    return terms.class_term_means(tt.labelled_counts(), tt.terms, tt.class_sizes)


def _ranked(tt, with_p=True):
    return terms.term_rank_sum(tt.labelled_tfidf(), tt.terms, tt.class_sizes, with_p=with_p)


def q_class_term_means(spark, sf):
    return r6(_means(Ctx(spark, sf).term_table()))


def q_fold_change(spark, sf):
    return r6(terms.fold_change(_means(Ctx(spark, sf).term_table())))


def q_term_rank_sum(spark, sf):
    return r6(_ranked(Ctx(spark, sf).term_table()))


def q_term_dictionary(spark, sf):
    return terms.term_dictionary(_ranked(Ctx(spark, sf).term_table()))


def q_fc_split_terms(spark, sf):
    tt = Ctx(spark, sf).term_table()
    m = _means(tt)
    all_docs = terms.class_term_means(tt.labelled_counts().withColumn("label", F.lit(1.0)),
                                      tt.terms, tt.class_sizes.select(
                                          (F.col("n1") + F.col("n0")).alias("n1"),
                                          F.lit(1).alias("n0")))
    all_docs = all_docs.select("term", F.col("mean_pos").alias("mean_all"))
    return r6(terms.fc_split_terms(_ranked(tt), all_docs, terms.fold_change(m)))


def q_term_weights(spark, sf):
    tt = Ctx(spark, sf).term_table()
    return r6(terms.term_weights(_ranked(tt), _means(tt)))


def q_cloud_terms(spark, sf):
    tt = Ctx(spark, sf).term_table()
    return r6(terms.cloud_terms(terms.term_weights(_ranked(tt), _means(tt))))


def q_welch_terms(spark, sf):
    tt = Ctx(spark, sf).term_table()
    return r6(terms.welch_terms(tt.labelled_tfidf(), tt.terms, tt.class_sizes))


def q_normalize_terms(spark, sf):
    tt = Ctx(spark, sf).term_table()
    return r6(terms.normalize_terms(tt.labelled_tfidf(), tt.terms, tt.n_docs))


# ---------------------------------------------------------------- evaluation

def q_confusion_metrics(spark, sf):
    return r6(evaluate.confusion_metrics(Ctx(spark, sf).scored, ["model_name", "fold"])
              .drop("recall", "f_score"))


def q_f_score(spark, sf):
    return r6(evaluate.confusion_metrics(Ctx(spark, sf).scored, ["model_name"])
              .select("model_name", "precision", "recall", "f_score"))


def q_f_score_by_class(spark, sf):
    return r6(evaluate.f_by_class(Ctx(spark, sf).scored, ["model_name"]))


def q_metric_names(spark, sf):
    s = evaluate.metric_summary(evaluate.fold_metrics(Ctx(spark, sf).scored))
    return r6(evaluate.metric_names(evaluate.model_names(s)))


def q_auc_by_fold(spark, sf):
    return r6(evaluate.auc(Ctx(spark, sf).scored, ["model_name", "fold"]))


def q_roc_curve_folds(spark, sf):
    return r6(evaluate.roc_curve(Ctx(spark, sf).scored, ["model_name", "fold"]))


def q_unnest_metrics(spark, sf):
    return r6(evaluate.fold_metrics(Ctx(spark, sf).scored))


def q_metric_summary(spark, sf):
    return r6(evaluate.metric_summary(evaluate.fold_metrics(Ctx(spark, sf).scored)))


def q_model_select(spark, sf):
    s = evaluate.metric_summary(evaluate.fold_metrics(Ctx(spark, sf).scored))
    return r6(evaluate.model_select(s, "roc_auc"))


def q_mean_auc(spark, sf):
    return r6(evaluate.mean_auc(evaluate.fold_metrics(Ctx(spark, sf).scored)))


def q_model_names(spark, sf):
    m = Ctx(spark, sf).scored.select("model_name").distinct()
    return evaluate.model_names(m)


def q_auc_by_model(spark, sf):
    return r6(evaluate.auc_by_model(Ctx(spark, sf).test_predictions()))


def q_roc_curve(spark, sf):
    return r6(evaluate.roc_curve(Ctx(spark, sf).test_predictions(), ["Model"]))


def q_spec_at_sens(spark, sf):
    return r6(evaluate.spec_at_sens(Ctx(spark, sf).test_predictions()))


def q_spec_at_least_sens(spark, sf):
    """Specificity at >= 95% sensitivity (the documented intent of the 95% rule)."""
    return r6(evaluate.spec_at_sens(Ctx(spark, sf).test_predictions(), rule="at_least"))


def q_roc_markers(spark, sf):
    best = evaluate.spec_at_sens(Ctx(spark, sf).test_predictions())
    return r6(evaluate.roc_markers(best))


def q_model_summary(spark, sf):
    tp = Ctx(spark, sf).test_predictions()
    return evaluate.model_summary(evaluate.spec_at_sens(tp), evaluate.auc_by_model(tp))


def q_compare_models(spark, sf):
    tp = Ctx(spark, sf).test_predictions()
    return r6(evaluate.compare_models(evaluate.auc_by_model(tp),
                                      evaluate.roc_curve(tp, ["Model"])))


def q_ranked_list(spark, sf):
    return rank.ranked_list(Ctx(spark, sf).ranked_input())


def q_resort_list(spark, sf):
    ranked = rank.ranked_list(Ctx(spark, sf).ranked_input())
    return rank.resort_list(ranked, [(rank.COL_YEAR, True), rank.COL_ARTICLE])


SQL_QUERIES = {
    "id_list_parse": q_id_list_parse,
    "term_search": q_term_search,
    "term_search_retmax": q_term_search_retmax,
    "term_search_boolean": q_term_search_boolean,
    "term_search_phrase": q_term_search_phrase,
    "category_union": q_category_union,
    "build_index": q_build_index,
    "retrieve_by_id": q_retrieve_by_id,
    "batch_plan": q_batch_plan,
    "index_retrieved": q_index_retrieved,
    "missing_abstracts": q_missing_abstracts,
    "drop_missing": q_drop_missing,
    "labelled_articles": q_labelled_articles,
    "coverage": q_coverage,
    "class_counts": q_class_counts,
    "split_train": q_split_train,
    "split_test": q_split_test,
    "stratified_split": q_stratified_split,
    "year_filter": q_year_filter,
    "recode_labels": q_recode_labels,
    "truth_labels": q_truth_labels,
    "attach_truth": q_attach_truth,
    "prefix_split": q_prefix_split,
    "balance_classes": q_balance_classes,
    "head_per_class": q_head_per_class,
    "assign_folds": q_assign_folds,
    "corpus_guard": q_corpus_guard,
    "tokenize": q_tokenize,
    "remove_stopwords": q_remove_stopwords,
    "term_counts": q_term_counts,
    "top_tokens": q_top_tokens,
    "doc_freq": q_doc_freq,
    "tfidf": q_tfidf,
    "alpha_terms": q_alpha_terms,
    "class_term_means": q_class_term_means,
    "fold_change": q_fold_change,
    "term_rank_sum": q_term_rank_sum,
    "term_dictionary": q_term_dictionary,
    "fc_split_terms": q_fc_split_terms,
    "term_weights": q_term_weights,
    "cloud_terms": q_cloud_terms,
    "welch_terms": q_welch_terms,
    "normalize_terms": q_normalize_terms,
    "confusion_metrics": q_confusion_metrics,
    "f_score": q_f_score,
    "f_score_by_class": q_f_score_by_class,
    "metric_names": q_metric_names,
    "auc_by_fold": q_auc_by_fold,
    "roc_curve_folds": q_roc_curve_folds,
    "unnest_metrics": q_unnest_metrics,
    "metric_summary": q_metric_summary,
    "model_select": q_model_select,
    "mean_auc": q_mean_auc,
    "model_names": q_model_names,
    "auc_by_model": q_auc_by_model,
    "roc_curve": q_roc_curve,
    "spec_at_sens": q_spec_at_sens,
    "spec_at_least_sens": q_spec_at_least_sens,
    "roc_markers": q_roc_markers,
    "model_summary": q_model_summary,
    "compare_models": q_compare_models,
    "ranked_list": q_ranked_list,
    "resort_list": q_resort_list,
}

ROWS_ONLY_QUERIES = {
    "stem_tokens": q_stem_tokens,
}
