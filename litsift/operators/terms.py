"""Term features and term statistics in long form ``(pmid, term, ...)``.

The document-term matrix is never densified or pivoted: zeros are handled in closed
form (a zero block is one tie group of known size).  A document's counts over the vocabulary
are made in its own row, with its label and length, so no step shuffles on the document
and a repeated id stays two documents.  Statistics are keyed by term; every aggregate is map-side
combined.
"""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litsift.functions.numeric import Z_CRIT_05, signif, two_sided_p, student_t_two_sided_p
from litsift.functions.text import analyze
from litsift.operators.prefix import grouped_cumsum
from litsift.operators.scalars import with_scalars
from litsift.session import ensure_checkpoint_dir

# Fixed value: vocabulary size of the reference's token filter.
MAX_TOKENS = 500


# ---------------------------------------------------------------- document side

def doc_tokens(docs: DataFrame, text_col: str = "abstract", stem: bool = True,
               key: str = "pmid") -> DataFrame:
    """(pmid, tokens) after tokenise, stop words and (optionally) stemming."""
    return docs.select(key, analyze(F.col(text_col), stem=stem).alias("tokens"))


def term_counts(tokens: DataFrame, key: str = "pmid") -> DataFrame:
    """(pmid, term, n): integer count of each token in each document."""
    return (tokens.select(key, F.explode("tokens").alias("term"))
            .groupBy(key, "term").agg(F.count(F.lit(1)).alias("n")))


def top_tokens(counts: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(term, n, term_rank): the ``max_tokens`` most frequent terms, ties by term text.

    The global top-k is a bounded ``TakeOrderedAndProject`` after a combined aggregate.
    """
    totals = counts.groupBy("term").agg(F.sum("n").alias("n"))
    top = totals.orderBy(F.desc("n"), F.asc("term")).limit(max_tokens)
    w = Window.orderBy(F.desc("n"), F.asc("term"))  # over <= max_tokens rows
    return top.withColumn("term_rank", F.row_number().over(w))


def doc_freq(long: DataFrame) -> DataFrame:
    """(term, df): documents containing each vocabulary term; ``long`` has one row per document and term."""
    return long.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def count_vectors(tokens: DataFrame, vocab: list[str], col: str = "tokens") -> DataFrame:
    """``tokens`` with ``term_at`` and ``term_n``, each row's counts over a vocabulary, and their sum ``doc_len``."""
    if not vocab:
        return tokens.select("*", F.array().cast("array<int>").alias("term_at"), F.array().cast("array<double>")
                             .alias("term_n"), F.lit(0.0).alias("doc_len")).drop(col)
    counted = CountVectorizerModel.from_vocabulary(vocab, inputCol=col, outputCol="_counts").transform(tokens)
    counted = counted.withColumn("_counts", F.unwrap_udt("_counts"))
    return counted.select(*[c for c in tokens.columns if c != col], F.col("_counts.indices").alias("term_at"),
                          F.col("_counts.values").alias("term_n"),
                          F.aggregate("_counts.values", F.lit(0.0), lambda a, x: a + x).alias("doc_len"))


class TermTable:
    """Long-form term matrix of a labelled training set, built once and shared.

    ``train`` needs (pmid, abstract, label) with label 1.0 = Positive.  Tokens are written once to the
    session's checkpoint folder: the vocabulary and the counts read them there.
    """

    def __init__(self, train: DataFrame, stem: bool = True, max_tokens: int = MAX_TOKENS,
                 alpha_only: bool = True):
        ensure_checkpoint_dir(train.sparkSession)
        toks = train.select("pmid", "label", analyze(F.col("abstract"), stem=stem).alias("tokens")).checkpoint()
        self.alpha_only = alpha_only
        self.docs = toks.select("pmid", "label")
        self.counts = term_counts(toks.select("pmid", "tokens"))
        totals = toks.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        self.vocab = top_tokens(totals, max_tokens)
        words = [r["term"] for r in self.vocab.orderBy("term_rank").collect()]  # at most max_tokens
        names = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
        self.vcounts = count_vectors(toks, words).select("pmid", "label", "doc_len", F.inline(F.arrays_zip(
            "term_at", "term_n"))).select("pmid", "label", "doc_len", F.get(names, "term_at").alias("term"),
                                          F.col("term_n").cast("long").alias("n"))
        self.n_docs = self.docs.agg(F.count(F.lit(1)).alias("n_docs"))
        terms = self.vocab.select("term")
        self.terms = alpha_terms(terms) if alpha_only else terms
        self.class_sizes = self.docs.agg(
            F.sum(F.when(F.col("label") == 1.0, 1).otherwise(0)).alias("n1"),
            F.sum(F.when(F.col("label") == 1.0, 0).otherwise(1)).alias("n0"))

    @property
    def labelled(self) -> DataFrame:
        """(pmid, label, term, n, tf, idf, tfidf): tf = n / kept tokens of the document, idf = ln(1 + N/df).

        N counts every training document, also those left with no vocabulary token. The
        document frequencies are one row a term (<= 500) and are broadcast.
        """
        out = with_scalars(self.vcounts.join(F.broadcast(doc_freq(self.vcounts)), "term"), self.n_docs)
        out = out.withColumn("tf", F.col("n") / F.col("doc_len")).withColumn(
            "idf", F.log(F.lit(1.0) + F.col("n_docs") / F.col("df")))
        return out.select("pmid", "label", "term", "n", "tf", "idf", (F.col("tf") * F.col("idf")).alias("tfidf"))

    @property
    def tfidf(self) -> DataFrame:
        return self.labelled.drop("label")

    def _own_terms(self, df: DataFrame) -> DataFrame:
        return alpha_terms(df) if self.alpha_only else df

    def labelled_tfidf(self) -> DataFrame:
        return self._own_terms(self.labelled)

    def labelled_counts(self) -> DataFrame:
        return self._own_terms(self.vcounts.select("pmid", "label", "term", "n"))


def alpha_terms(terms: DataFrame, col: str = "term") -> DataFrame:
    """Terms holding at least one letter a-z (case-insensitive)."""
    return terms.where(F.col(col).rlike("(?i)[a-z]"))


# ---------------------------------------------------------------- class statistics

def class_term_means(lcounts: DataFrame, terms: DataFrame, class_sizes: DataFrame,
                     value: str = "n") -> DataFrame:
    """(term, mean_pos, mean_neg): per-class column means with zeros included."""
    sums = lcounts.groupBy("term").agg(
        F.sum(F.when(F.col("label") == 1.0, F.col(value)).otherwise(0)).alias("s1"),
        F.sum(F.when(F.col("label") == 1.0, 0).otherwise(F.col(value))).alias("s0"))
    return (with_scalars(terms.select("term").join(sums, "term", "left"), class_sizes)
            .select("term",
                    F.try_divide(F.coalesce(F.col("s1"), F.lit(0)), F.col("n1")).alias("mean_pos"),
                    F.try_divide(F.coalesce(F.col("s0"), F.lit(0)), F.col("n0")).alias("mean_neg")))


def fold_change(means: DataFrame) -> DataFrame:
    """(mean_pos + 1) / (mean_neg + 1) on count means."""
    return means.withColumn("fold_change",
                            (F.col("mean_pos") + 1) / (F.col("mean_neg") + 1))


def term_rank_sum(ltfidf: DataFrame, terms: DataFrame, class_sizes: DataFrame,
                  value: str = "tfidf", with_p: bool = True) -> DataFrame:
    """Two-sided Wilcoxon rank-sum test per term, positive vs negative documents.

    Normal approximation with tie correction and continuity correction, as R's
    ``wilcox.test(exact = FALSE)``.  Zero entries form one tie block of size
    ``z = n - nnz``; non-zero values are ranked through running counts over distinct
    (term, value) pairs, computed by :func:`grouped_cumsum` so a term present in
    most documents is still spread over many tasks.

    Output: term, n_nonzero, w_stat, z, p_rank (1 = smallest p; ties by term; NULL z
    last) and, with ``with_p``, p_value.
    """
    vals = (ltfidf.where(F.col(value) != 0)
            .groupBy("term", F.col(value).alias("v"))
            .agg(F.sum(F.when(F.col("label") == 1.0, 1).otherwise(0)).alias("c_pos"),
                 F.count(F.lit(1)).alias("c")))
    cum = grouped_cumsum(vals, ["term"], "v", ["c"], ascending=True)
    per_val = cum.select("term", "c_pos", "c", (F.col("c_cum") - F.col("c")).alias("less"))
    agg = per_val.groupBy("term").agg(
        F.sum("c").alias("nnz"), F.sum("c_pos").alias("nnz_pos"),
        F.sum(F.col("c_pos") * (F.col("less") + (F.col("c") + 1) / 2.0)).alias("r_nz"),
        F.sum(F.pow(F.col("c"), 3) - F.col("c")).alias("ties_nz"))
    base = with_scalars(terms.select("term").join(agg, "term", "left"), class_sizes)
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    nnz = F.coalesce(F.col("nnz"), F.lit(0)).cast("double")
    z0 = n - nnz
    z1 = n1 - F.coalesce(F.col("nnz_pos"), F.lit(0))
    r1 = z1 * (z0 + 1) / 2.0 + F.coalesce(F.col("r_nz"), F.lit(0.0)) + \
        F.coalesce(F.col("nnz_pos"), F.lit(0)) * z0
    w_stat = r1 - n1 * (n1 + 1) / 2.0
    ties = F.pow(z0, 3) - z0 + F.coalesce(F.col("ties_nz"), F.lit(0.0))
    var = n1 * n0 / 12.0 * ((n + 1) - ties / (n * (n - 1)))
    d = w_stat - n1 * n0 / 2.0
    zstat = F.when(var > 1e-12, (d - F.signum(d) * 0.5) / F.sqrt(var))
    out = base.select("term", nnz.cast("long").alias("n_nonzero"),
                      w_stat.alias("w_stat"), zstat.alias("z"))
    w = Window.orderBy(F.abs(F.col("z")).desc_nulls_last(), F.col("term"))  # <= 500 rows
    out = out.withColumn("p_rank", F.row_number().over(w))
    if with_p:
        out = out.withColumn("p_value", two_sided_p(F.col("z")))
    return out


def significant(z_col: str = "z"):
    """p < 0.05 expressed on z: |z| > 1.959964 (NULL z is not significant)."""
    return F.coalesce(F.abs(F.col(z_col)) > F.lit(Z_CRIT_05), F.lit(False))


def term_dictionary(ranked: DataFrame, max_terms: int = 100) -> DataFrame:
    """Significant-term cut, then name order.

    With more than ``max_terms`` terms at p < 0.05, keep that many best terms;
    otherwise keep the best ``max_terms`` (all when fewer).  Input: term_rank_sum output.
    """
    n_sig = ranked.agg(F.sum(F.when(significant(), 1).otherwise(0)).alias("n_sig"))
    keep = F.when(F.col("n_sig") > max_terms, F.col("n_sig")).otherwise(F.lit(max_terms))
    return (with_scalars(ranked, n_sig).where(F.col("p_rank") <= keep)
            .select("term").orderBy("term"))


def fc_split_terms(ranked: DataFrame, count_means_all: DataFrame, fc: DataFrame,
                   top: int = 25) -> DataFrame:
    """The ``top`` best terms (p order) on each side of fold change 1 with their mean count.

    ``count_means_all``: (term, mean_all) over all training documents.  Side 'up'
    has fc > 1, 'down' fc < 1; fc = 1 is in neither.
    """
    j = ranked.select("term", "p_rank").join(fc.select("term", "fold_change"), "term") \
        .join(count_means_all, "term")
    side = F.when(F.col("fold_change") > 1, F.lit("up")) \
        .when(F.col("fold_change") < 1, F.lit("down"))
    j = j.withColumn("side", side).where(F.col("side").isNotNull())
    w = Window.partitionBy("side").orderBy("p_rank")
    return (j.withColumn("side_rank", F.row_number().over(w)).where(F.col("side_rank") <= top)
            .select("side", "side_rank", "term", "p_rank", "fold_change",
                    signif(F.col("mean_all"), 2).alias("mean_count")))


def term_weights(ranked: DataFrame, class_means: DataFrame, top: int = 50,
                 contrast: int = 10) -> DataFrame:
    """Class term weights of the ``top`` best terms (the word-cloud tables).

    Per class: mean count, 2 significant digits, divided by the class maximum over
    the ``top`` terms.  For the first ``contrast`` terms the larger side becomes 1 and
    the smaller the ratio of the two (both zero -> NULL on both sides).
    """
    best = ranked.where(F.col("p_rank") <= top).select("term", "p_rank") \
        .join(class_means, "term")
    best = best.select("term", "p_rank", signif(F.col("mean_pos"), 2).alias("sp"),
                       signif(F.col("mean_neg"), 2).alias("sn"))
    wall = Window.partitionBy()  # <= top rows
    best = best.select("term", "p_rank",
                       (F.col("sp") / F.max("sp").over(wall)).alias("pos"),
                       (F.col("sn") / F.max("sn").over(wall)).alias("neg"))
    first = F.col("p_rank") <= contrast
    both_zero = (F.col("pos") == 0) & (F.col("neg") == 0)
    pos_w = (F.when(~first, F.col("pos")).when(both_zero, F.lit(None))
             .when(F.col("pos") > F.col("neg"), F.lit(1.0))
             .otherwise(F.col("pos") / F.col("neg")))
    neg_w = (F.when(~first, F.col("neg")).when(both_zero, F.lit(None))
             .when(F.col("pos") > F.col("neg"), F.col("neg") / F.col("pos"))
             .otherwise(F.lit(1.0)))
    return best.select("term", "p_rank", pos_w.alias("pos_weight"), neg_w.alias("neg_weight"))


def cloud_terms(weights: DataFrame, min_freq: float = 0.05, max_words: int = 45) -> DataFrame:
    """Display cut per side: weight >= 0.05, at most 45 terms, heaviest first."""
    long = weights.select("term", F.lit("positive").alias("side"),
                          F.col("pos_weight").alias("weight")) \
        .unionByName(weights.select("term", F.lit("negative").alias("side"),
                                    F.col("neg_weight").alias("weight")))
    w = Window.partitionBy("side").orderBy(F.desc("weight"), F.asc("term"))
    return (long.where(F.col("weight") >= min_freq)
            .withColumn("display_rank", F.row_number().over(w))
            .where(F.col("display_rank") <= max_words))


def welch_terms(ltfidf: DataFrame, terms: DataFrame, class_sizes: DataFrame,
                top: int = 100, value: str = "tfidf", with_p: bool = True) -> DataFrame:
    """Welch two-sample t-test per term (zeros included), best ``top`` terms by |t|."""
    s = ltfidf.groupBy("term").agg(
        F.sum(F.when(F.col("label") == 1.0, F.col(value)).otherwise(0.0)).alias("s1"),
        F.sum(F.when(F.col("label") == 1.0, F.col(value) ** 2).otherwise(0.0)).alias("q1"),
        F.sum(F.when(F.col("label") == 1.0, 0.0).otherwise(F.col(value))).alias("s0"),
        F.sum(F.when(F.col("label") == 1.0, 0.0).otherwise(F.col(value) ** 2)).alias("q0"))
    b = with_scalars(terms.select("term").join(s, "term", "left")
                     .na.fill(0.0, ["s1", "q1", "s0", "q0"]), class_sizes)
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    m1, m0 = F.try_divide(F.col("s1"), n1), F.try_divide(F.col("s0"), n0)
    # a class of one document has no variance: everything but the means is NULL then
    v1 = F.try_divide(F.col("q1") - n1 * m1 * m1, n1 - 1)
    v0 = F.try_divide(F.col("q0") - n0 * m0 * m0, n0 - 1)
    se2 = F.try_divide(v1, n1) + F.try_divide(v0, n0)
    t = F.when(se2 > 1e-18, (m1 - m0) / F.sqrt(se2))
    dfw = F.when(se2 > 1e-18, se2 * se2 / ((v1 / n1) ** 2 / (n1 - 1) + (v0 / n0) ** 2 / (n0 - 1)))
    out = b.select("term", m1.alias("mean_pos"), m0.alias("mean_neg"), t.alias("t"),
                   dfw.alias("df"))
    w = Window.orderBy(F.abs(F.col("t")).desc_nulls_last(), F.col("term"))  # <= 500 rows
    out = out.withColumn("t_rank", F.row_number().over(w)).where(F.col("t_rank") <= top)
    if with_p:
        out = out.withColumn("p_value", student_t_two_sided_p(F.col("t"), F.col("df")))
    return out


def normalize_terms(ltfidf: DataFrame, terms: DataFrame, n_docs: DataFrame,
                    value: str = "tfidf") -> DataFrame:
    """Per-term mean and sample sd over all documents (zeros folded in) for standardising."""
    s = ltfidf.groupBy("term").agg(F.sum(value).alias("s"), F.sum(F.col(value) ** 2).alias("q"))
    b = with_scalars(terms.select("term").join(s, "term", "left").na.fill(0.0, ["s", "q"]),
                     n_docs)
    n = F.col("n_docs").cast("double")
    mean = F.col("s") / n
    var = (F.col("q") - n * mean * mean) / (n - 1)
    sd = F.sqrt(F.greatest(var, F.lit(0.0)))
    return b.select("term", mean.alias("mean"), sd.alias("sd"),
                    F.when(sd > 0, -mean / sd).alias("zero_score"))
