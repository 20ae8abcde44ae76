"""DuckDB SQL for every SQL-expressible registered query (the correctness oracle).

Stand-in inputs are the same views as :mod:`litsift.plans.fixtures`, written as
CTEs over the pre-registered ``documents`` and ``labels`` views.  Doubles are
rounded to 6 places like the Spark side.
"""

from __future__ import annotations

from litsift.functions.text import STOP_WORDS, TOKEN_PATTERN, sql_string_list
from litsift.operators import rank
from litsift.plans.fixtures import SCORE_MODELS
from litsift.plans.queries import SEARCH_RETMAX

_STOP = "[" + sql_string_list(STOP_WORDS) + "]"
_PAT = TOKEN_PATTERN.replace("'", "''")
_MODELS = " UNION ALL ".join(f"SELECT '{m}' AS model_name, {w} AS w, {n} AS steps" for m, w, n in SCORE_MODELS)
#: The terms that SEARCH_QUERY and QUERY_CATEGORY_TERMS stand for.
SEARCH_TERMS, CATEGORY_TERMS = ["the", "ing"], ["with", "from"]

#: Intervals of Simpson's rule over a density, for p-values without a distribution function.
_PARTS = 2000


def _simpson(density: str, upper: str) -> str:
    """Integral from 0 to ``upper`` of ``density``, an expression of ``x``."""
    at = f"({upper} * k / {_PARTS}.0)"
    weight = f"CASE WHEN k = 0 OR k = {_PARTS} THEN 1.0 WHEN k % 2 = 1 THEN 4.0 ELSE 2.0 END"
    return (f"list_sum(list_transform(range(0, {_PARTS + 1}), lambda k: {weight} * ({density.replace('$x', at)})))"
            f" * {upper} / {3 * _PARTS}.0")


#: Two-sided p of a standard normal z (0 beyond the integration's reach) and of Student's t.
_P_NORMAL = ("CASE WHEN z IS NOT NULL THEN greatest(1 - 2 * " + _simpson("exp(-$x * $x / 2) / sqrt(2 * pi())", "least(abs(z), 12.0)")
             + ", 0.0) END")
_P_STUDENT = ("CASE WHEN t IS NOT NULL AND dfw > 0 THEN greatest(1 - 2 * exp(lgamma((dfw + 1) / 2) - lgamma(dfw / 2)) / sqrt(dfw * pi()) * "
              + _simpson("power(1 + $x * $x / dfw, -(dfw + 1) / 2)", "abs(t)") + ", 0.0) END")


# name -> (dependencies, body)
_CTES: dict[str, tuple[list[str], str]] = {
    # documents to be classified, on the training rows' recipe: a value for each term of the vocabulary
    "tdense": (["test", "vocab", "dfreq", "ndocs"], f"""
        SELECT r, pmid, list(x ORDER BY term) AS x, sum(x) AS total, sum(x * x) AS square, count(*) FILTER (x <> 0) AS n_terms
        FROM (SELECT d.r, d.pmid, v.term,
                     CASE WHEN c.n IS NULL THEN 0.0 ELSE CAST(c.n AS DOUBLE) / l.n * ln(1 + CAST(nd.n_docs AS DOUBLE) / f.df) END AS x
              FROM (SELECT row_number() OVER () AS r, pmid, abstract FROM test) d CROSS JOIN vocab v CROSS JOIN ndocs nd
              JOIN dfreq f ON f.term = v.term
              LEFT JOIN (SELECT r, term, count(*) AS n FROM (SELECT r, unnest(list_filter(regexp_extract_all(lower(abstract), '{_PAT}'), lambda t: NOT list_contains({_STOP}, t))) AS term
                                FROM (SELECT row_number() OVER () AS r, abstract FROM test)) GROUP BY r, term) c ON c.r = d.r AND c.term = v.term
              LEFT JOIN (SELECT r, count(*) AS n FROM (SELECT r, unnest(list_filter(regexp_extract_all(lower(abstract), '{_PAT}'), lambda t: NOT list_contains({_STOP}, t))) AS term
                                FROM (SELECT row_number() OVER () AS r, abstract FROM test)) WHERE term IN (SELECT term FROM vocab) GROUP BY r) l ON l.r = d.r)
        GROUP BY r, pmid"""),
    "fold5": (["train"], """
        SELECT class, CAST(ntile(5) OVER (ORDER BY md5(concat(pmid, ':', '42')), class) AS INTEGER) AS fold FROM train"""),
    "fold_null": (["fold5"], """
        SELECT fold, CAST(count(*) FILTER (hit AND class = 'Positive') AS DOUBLE) AS tp,
               CAST(count(*) FILTER (hit AND class <> 'Positive') AS DOUBLE) AS fp,
               CAST(count(*) FILTER (NOT hit AND class <> 'Positive') AS DOUBLE) AS tn,
               CAST(count(*) FILTER (NOT hit AND class = 'Positive') AS DOUBLE) AS fn
        FROM (SELECT a.fold, a.class, o.p >= 0.5 AS hit FROM fold5 a JOIN (
                SELECT x.fold, avg(CASE WHEN b.class = 'Positive' THEN 1.0 ELSE 0.0 END) AS p
                FROM (SELECT DISTINCT fold FROM fold5) x JOIN fold5 b ON b.fold <> x.fold GROUP BY x.fold) o ON o.fold = a.fold)
        GROUP BY fold"""),
    # training documents likewise
    "dense": (["tok", "vocab", "vcounts", "dfreq", "ndocs"], """
        SELECT d.r, d.pmid, d.label, list(CASE WHEN c.n IS NULL THEN 0.0 ELSE CAST(c.n AS DOUBLE) / l.n
                                            * ln(1 + CAST(nd.n_docs AS DOUBLE) / f.df) END ORDER BY v.term) AS x
        FROM tok d CROSS JOIN vocab v CROSS JOIN ndocs nd JOIN dfreq f ON f.term = v.term
        LEFT JOIN vcounts c ON c.r = d.r AND c.term = v.term
        LEFT JOIN (SELECT r, sum(n) AS n FROM vcounts GROUP BY r) l ON l.r = d.r
        GROUP BY d.r, d.pmid, d.label"""),
    "articles": ([], """
        SELECT CAST(doc_id AS VARCHAR) AS pmid, CAST(2000 + doc_id % 25 AS VARCHAR) AS year,
               split_part(text, chr(10), 1) AS title,
               CASE WHEN doc_id % 17 = 0 THEN NULL ELSE text END AS abstract
        FROM documents WHERE lang = 'en'
        UNION ALL
        SELECT CAST(doc_id AS VARCHAR), CAST(2000 + doc_id % 25 AS VARCHAR),
               split_part(text, chr(10), 1), NULL
        FROM documents WHERE lang = 'en' AND doc_id % 29 = 0"""),
    "article_index": ([], """
        SELECT CAST(d.doc_id AS VARCHAR) AS pmid,
               CAST(CASE WHEN l.doc_id IS NULL OR d.doc_id % 5 = 0 THEN 2 ELSE l.quality END
                    AS INTEGER) AS class
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
        UNION ALL
        SELECT CAST(doc_id + 10000000 AS VARCHAR), CAST(2 AS INTEGER)
        FROM documents WHERE doc_id % 50 = 0"""),
    "truth": ([], """
        SELECT CAST(doc_id AS VARCHAR) AS pmid,
               CASE WHEN quality = 1 THEN 'Positive' ELSE 'Negative' END AS class
        FROM labels WHERE doc_id % 5 = 0"""),
    "scored": ([], f"""
        SELECT model_name, CAST(1 + doc_id % 5 AS INTEGER) AS fold, CAST(doc_id AS VARCHAR) AS pmid,
               CASE WHEN quality = 1 THEN 'Positive' ELSE 'Negative' END AS class,
               CAST(((w * CAST(quality AS BIGINT) * 65535 + (100 - w) * noise) * steps) // 6553500 AS DOUBLE)
                 / steps AS p_positive
        FROM (SELECT l.doc_id, l.quality, m.model_name, m.w, m.steps,
                     CAST('0x' || substr(md5(concat(l.doc_id, ':', m.model_name)), 1, 4) AS BIGINT) AS noise
              FROM labels l CROSS JOIN ({_MODELS}) m)"""),
    "fetched": (["articles", "article_index"], """
        SELECT pmid, year, title, abstract FROM articles
        WHERE pmid IN (SELECT pmid FROM article_index)"""),
    "idx_ret": (["article_index", "fetched"], """
        SELECT * FROM article_index WHERE pmid IN (SELECT pmid FROM fetched)"""),
    "missing": (["fetched"], """
        SELECT pmid FROM fetched GROUP BY pmid HAVING bool_and(abstract IS NULL)"""),
    "clean": (["fetched", "missing"], """
        SELECT * FROM fetched WHERE pmid NOT IN (SELECT pmid FROM missing)"""),
    "idx_clean": (["idx_ret", "missing"], """
        SELECT * FROM idx_ret WHERE pmid NOT IN (SELECT pmid FROM missing)"""),
    "labelled": (["clean", "idx_clean"], """
        SELECT c.pmid, c.year, c.title, c.abstract, i.class
        FROM clean c JOIN idx_clean i ON c.pmid = i.pmid"""),
    "train": (["labelled"], """
        SELECT pmid, year, title, abstract,
               CASE WHEN class = 1 THEN 'Positive' ELSE 'Negative' END AS class,
               CASE WHEN class = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label
        FROM labelled WHERE class < 2 AND pmid IS NOT NULL AND abstract IS NOT NULL"""),
    "test": (["labelled"], """
        SELECT * FROM labelled WHERE class = 2 AND pmid IS NOT NULL AND abstract IS NOT NULL"""),
    "tok": (["train"], f"""
        SELECT row_number() OVER () AS r, pmid, label,
               list_filter(regexp_extract_all(lower(abstract), '{_PAT}'),
                           lambda t: NOT list_contains({_STOP}, t)) AS tokens
        FROM train"""),
    "counts": (["tok"], """
        SELECT r, pmid, label, term, count(*) AS n
        FROM (SELECT r, pmid, label, unnest(tokens) AS term FROM tok) GROUP BY r, pmid, label, term"""),
    "vocab": (["counts"], """
        SELECT term, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY term
        ORDER BY n DESC, term LIMIT 500"""),
    "vcounts": (["counts", "vocab"], """
        SELECT c.r, c.pmid, c.label, c.term, c.n FROM counts c JOIN vocab v ON c.term = v.term"""),
    "ndocs": (["train"], "SELECT count(*) AS n_docs FROM train"),
    "dfreq": (["vcounts"], "SELECT term, count(*) AS df FROM vcounts GROUP BY term"),
    "tfidf": (["vcounts", "dfreq", "ndocs"], """
        SELECT v.pmid, v.label, v.term, v.n,
               CAST(v.n AS DOUBLE) / sum(v.n) OVER (PARTITION BY v.r) AS tf,
               ln(1 + CAST(nd.n_docs AS DOUBLE) / f.df) AS idf,
               CAST(v.n AS DOUBLE) / sum(v.n) OVER (PARTITION BY v.r)
                 * ln(1 + CAST(nd.n_docs AS DOUBLE) / f.df) AS tfidf
        FROM vcounts v JOIN dfreq f ON v.term = f.term CROSS JOIN ndocs nd"""),
    "terms": (["vocab"], """
        SELECT term FROM vocab WHERE regexp_matches(term, '[a-zA-Z]')"""),
    "csizes": (["train"], """
        SELECT CAST(sum(CASE WHEN label = 1.0 THEN 1 ELSE 0 END) AS BIGINT) AS n1,
               CAST(sum(CASE WHEN label = 1.0 THEN 0 ELSE 1 END) AS BIGINT) AS n0 FROM train"""),
    "ltfidf": (["tfidf", "terms"], """
        SELECT x.* FROM tfidf x JOIN terms USING (term)"""),
    "lcounts": (["vcounts", "terms"], """
        SELECT x.* FROM vcounts x JOIN terms USING (term)"""),
    "means": (["lcounts", "terms", "csizes"], """
        SELECT t.term,
               CAST(coalesce(s.s1, 0) AS DOUBLE) / c.n1 AS mean_pos,
               CAST(coalesce(s.s0, 0) AS DOUBLE) / c.n0 AS mean_neg
        FROM terms t
        LEFT JOIN (SELECT term,
                          sum(CASE WHEN label = 1.0 THEN n ELSE 0 END) AS s1,
                          sum(CASE WHEN label = 1.0 THEN 0 ELSE n END) AS s0
                   FROM lcounts GROUP BY term) s ON t.term = s.term
        CROSS JOIN csizes c"""),
    "ranksum": (["ltfidf", "terms", "csizes"], """
        SELECT term, n_nonzero, w_stat, z,
               CAST(row_number() OVER (ORDER BY abs(z) DESC NULLS LAST, term) AS INTEGER)
                 AS p_rank
        FROM (
          SELECT term, CAST(nnz AS BIGINT) AS n_nonzero, w_stat,
                 CASE WHEN var > 1e-12 THEN (d - sign(d) * 0.5) / sqrt(var) END AS z
          FROM (
            SELECT term, nnz, w_stat, w_stat - n1 * n0 / 2.0 AS d,
                   n1 * n0 / 12.0 * ((n1 + n0 + 1)
                     - (power(z0, 3) - z0 + ties_nz) / ((n1 + n0) * (n1 + n0 - 1))) AS var
            FROM (
              SELECT t.term, CAST(c.n1 AS DOUBLE) AS n1, CAST(c.n0 AS DOUBLE) AS n0,
                     CAST(coalesce(a.nnz, 0) AS DOUBLE) AS nnz,
                     c.n1 + c.n0 - coalesce(a.nnz, 0) AS z0,
                     coalesce(a.ties_nz, 0) AS ties_nz,
                     (c.n1 - coalesce(a.nnz_pos, 0)) * (c.n1 + c.n0 - coalesce(a.nnz, 0) + 1) / 2.0
                       + coalesce(a.r_nz, 0)
                       + coalesce(a.nnz_pos, 0) * (c.n1 + c.n0 - coalesce(a.nnz, 0))
                       - c.n1 * (c.n1 + 1) / 2.0 AS w_stat
              FROM terms t
              LEFT JOIN (
                SELECT term, sum(c) AS nnz, sum(c_pos) AS nnz_pos,
                       sum(c_pos * (less + (c + 1) / 2.0)) AS r_nz,
                       sum(power(c, 3) - c) AS ties_nz
                FROM (
                  SELECT term, c, c_pos,
                         sum(c) OVER (PARTITION BY term ORDER BY v
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - c AS less
                  FROM (SELECT term, tfidf AS v, count(*) AS c,
                               sum(CASE WHEN label = 1.0 THEN 1 ELSE 0 END) AS c_pos
                        FROM ltfidf WHERE tfidf <> 0 GROUP BY term, tfidf))
                GROUP BY term) a ON t.term = a.term
              CROSS JOIN csizes c)))"""),
    "weights": (["ranksum", "means"], """
        SELECT term, p_rank,
               CASE WHEN p_rank > 10 THEN pos
                    WHEN pos = 0 AND neg = 0 THEN NULL
                    WHEN pos > neg THEN 1.0 ELSE pos / neg END AS pos_weight,
               CASE WHEN p_rank > 10 THEN neg
                    WHEN pos = 0 AND neg = 0 THEN NULL
                    WHEN pos > neg THEN neg / pos ELSE 1.0 END AS neg_weight
        FROM (SELECT term, p_rank, sp / max(sp) OVER () AS pos, sn / max(sn) OVER () AS neg
              FROM (SELECT r.term, r.p_rank, {signif_pos} AS sp, {signif_neg} AS sn
                    FROM ranksum r JOIN means m ON r.term = m.term WHERE r.p_rank <= 50))"""),
    "test_pred": (["scored", "truth"], """
        SELECT s.model_name, s.fold, s.pmid, s.p_positive, t.class,
               CASE s.model_name {model_case} ELSE s.model_name END AS Model
        FROM scored s JOIN truth t ON s.pmid = t.pmid"""),
    "ranked_in": (["test"], """
        SELECT pmid, year, title, p_positive,
               CASE WHEN p_positive >= 0.5 THEN 'Positive' ELSE 'Negative' END AS pred_class
        FROM (SELECT pmid, year, title,
                     CAST((CAST('0x' || substr(md5(concat(pmid, ':rank')), 1, 4) AS BIGINT) * 10000) >> 16
                          AS DOUBLE) / 10000.0 AS p_positive
              FROM test)"""),
    "ranked": (["ranked_in"], """
        SELECT concat('{link_prefix}', pmid, '{link_middle}',
                      replace(replace(replace(replace(coalesce(title, 'NA'), '&', '&amp;'), '<', '&lt;'),
                                      '>', '&gt;'), '"', '&quot;'), '{link_suffix}') AS "{col_article}",
               year AS "{col_year}", pred_class AS "{col_label}",
               row_number() OVER (ORDER BY CASE WHEN pred_class = 'Positive' THEN 0 ELSE 1 END,
                                  p_positive DESC, CAST(pmid AS BIGINT), pmid)
                 AS "{col_rank}",
               pmid AS "{col_pmid}"
        FROM ranked_in"""),
}


def _signif(x: str) -> str:
    return (f"CASE WHEN {x} = 0 THEN 0.0 ELSE round({x} / power(10.0, floor(log10(abs({x}))) - 1))"
            f" * power(10.0, floor(log10(abs({x}))) - 1) END")


def _model_case() -> str:
    from litsift.operators.evaluate import MODEL_NAMES
    return " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MODEL_NAMES.items())


def _fill(body: str) -> str:
    for name in ("LINK_PREFIX", "LINK_MIDDLE", "LINK_SUFFIX", "COL_ARTICLE", "COL_YEAR", "COL_LABEL", "COL_RANK",
                 "COL_PMID"):
        body = body.replace("{" + name.lower() + "}", getattr(rank, name))
    return (body.replace("{signif_pos}", _signif("m.mean_pos"))
            .replace("{signif_neg}", _signif("m.mean_neg"))
            .replace("{model_case}", _model_case()))


def with_ctes(names: list[str], body: str) -> str:
    """``WITH`` clause holding ``names`` and their dependencies in order, then ``body``."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in _CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({_fill(_CTES[n][1])})" for n in order)
    return f"WITH {ctes}\n{body}"


def _search(terms: list[str]) -> str:
    where = " AND ".join(f"lower(concat_ws(' ', title, abstract)) LIKE '%{t}%'" for t in terms)
    return f"SELECT DISTINCT pmid FROM articles WHERE {where}"


def _r(x: str, alias: str | None = None) -> str:
    return f"round({x}, 6) AS {alias or x}"


_CONF = """
    SELECT {g}, tp, fp, tn, fn,
           CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END AS sens,
           CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) END AS spec,
           CASE WHEN tp + fp + tn + fn > 0 THEN CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) END
             AS accuracy,
           CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) END AS precision,
           CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END
             AS f_score
    FROM (SELECT {g},
                 CAST(sum(CASE WHEN class = 'Positive' AND p_positive >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
                 CAST(sum(CASE WHEN class <> 'Positive' AND p_positive >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
                 CAST(sum(CASE WHEN class <> 'Positive' AND p_positive < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
                 CAST(sum(CASE WHEN class = 'Positive' AND p_positive < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fn
          FROM {src} WHERE class IS NOT NULL AND p_positive IS NOT NULL GROUP BY {g})"""

_AUC = """
    SELECT {g}, CASE WHEN n1 > 0 AND n0 > 0 THEN u / (CAST(n1 AS DOUBLE) * n0) END AS auc
    FROM (SELECT {g}, sum(n_pos * (neg_less + 0.5 * n_neg)) AS u, sum(n_pos) AS n1,
                 sum(n_neg) AS n0
          FROM (SELECT {g}, n_pos, n_neg,
                       sum(n_neg) OVER (PARTITION BY {g} ORDER BY score
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                         - n_neg AS neg_less
                FROM (SELECT {g}, p_positive AS score,
                             sum(CASE WHEN class = 'Positive' THEN 1 ELSE 0 END) AS n_pos,
                             sum(CASE WHEN class = 'Positive' THEN 0 ELSE 1 END) AS n_neg
                      FROM {src} WHERE class IS NOT NULL AND p_positive IS NOT NULL
                      GROUP BY {g}, p_positive))
          GROUP BY {g})"""

_ROC_COUNTS = """
    SELECT {g}, score AS threshold, tp, fp, P, N FROM (
      SELECT {g}, score,
             sum(n_pos) OVER (PARTITION BY {g} ORDER BY score DESC
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
             sum(n_neg) OVER (PARTITION BY {g} ORDER BY score DESC
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
             sum(n_pos) OVER (PARTITION BY {g}) AS P, sum(n_neg) OVER (PARTITION BY {g}) AS N
      FROM (SELECT {g}, p_positive AS score,
                   sum(CASE WHEN class = 'Positive' THEN 1 ELSE 0 END) AS n_pos,
                   sum(CASE WHEN class = 'Positive' THEN 0 ELSE 1 END) AS n_neg
            FROM {src} WHERE class IS NOT NULL AND p_positive IS NOT NULL
            GROUP BY {g}, p_positive))
    WHERE P > 0 AND N > 0"""


def _roc(g: str, src: str) -> str:
    rc = _ROC_COUNTS.format(g=g, src=src)
    return f"""
    SELECT {g}, round(threshold, 6) AS threshold, round(specificity, 6) AS specificity,
           round(sensitivity, 6) AS sensitivity FROM (
      SELECT {g}, threshold, 1.0 - CAST(fp AS DOUBLE) / N AS specificity,
             CAST(tp AS DOUBLE) / P AS sensitivity FROM ({rc})
      UNION ALL SELECT DISTINCT {g}, '-Infinity'::DOUBLE, 0.0, 1.0 FROM ({rc})
      UNION ALL SELECT DISTINCT {g}, 'Infinity'::DOUBLE, 1.0, 0.0 FROM ({rc}))"""


def _fold_metrics(src: str = "scored") -> str:
    g = "model_name, fold"
    conf = _CONF.format(g=g, src=src)
    auc = _AUC.format(g=g, src=src)
    return f"""
    SELECT model_name, fold, metric, estimate FROM (
      SELECT c.model_name, c.fold, c.sens, c.spec, c.accuracy, c.precision, a.auc AS roc_auc
      FROM ({conf}) c FULL JOIN ({auc}) a ON c.model_name = a.model_name AND c.fold = a.fold)
    UNPIVOT INCLUDE NULLS (estimate FOR metric IN (roc_auc, sens, spec, accuracy, precision))"""


def _spec_at_sens(cond: str = "1000 * tp > 945 * P AND 1000 * tp < 955 * P") -> str:
    rc = _ROC_COUNTS.format(g="Model", src="test_pred")
    return f"""
    SELECT Model, max_spec, printf('Specificity = %.3f', max_spec) AS spec_label FROM (
      SELECT Model, max(1.0 - CAST(fp AS DOUBLE) / N) AS max_spec FROM (
        SELECT Model, tp, fp, P, N FROM ({rc})
        UNION ALL SELECT DISTINCT Model, P, N, P, N FROM ({rc}))
      WHERE {cond}
      GROUP BY Model)"""


def _auc_by_model() -> str:
    a = _AUC.format(g="Model", src="test_pred")
    return f"""SELECT Model, auc, printf('AUC = %.3f', auc) AS label_auc
               FROM ({a}) WHERE auc IS NOT NULL"""


def _stratified(prop_num: int = 800, seed: int = 1353) -> str:
    return f"""
    SELECT c.*, CASE WHEN rk <= floor(n_class * {prop_num} / 1000) THEN 'train' ELSE 'test' END
             AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY class
                                       ORDER BY md5(concat(pmid, ':', '{seed}')), pmid) AS rk,
                 count(*) OVER (PARTITION BY class) AS n_class
          FROM curated) c"""


_CURATED = """
    SELECT a.pmid, a.year, a.title, a.abstract,
           CASE WHEN l.quality = 1 THEN 'yes' ELSE 'no' END AS class
    FROM articles a JOIN labels l ON a.pmid = CAST(l.doc_id AS VARCHAR)
    WHERE a.abstract IS NOT NULL"""


def _with_curated(body: str) -> str:
    sql = with_ctes(["articles"], "SELECT 1")
    head = sql[: sql.rindex("\nSELECT 1")]
    return f"{head},\ncurated AS ({_CURATED})\n{body}"


def _counts_fold_change() -> str:
    return "SELECT term, mean_pos, mean_neg, (mean_pos + 1) / (mean_neg + 1) AS fold_change FROM means"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["id_list_parse"] = """
        WITH id_text AS (
          SELECT source, CAST(floor(doc_id / 50) AS BIGINT) AS block,
                 array_to_string(list_sort(list(CAST(doc_id AS VARCHAR) ||
                     CASE WHEN doc_id % 3 = 0 THEN chr(10) ELSE ', ' END)), '') AS id_text
          FROM documents GROUP BY source, CAST(floor(doc_id / 50) AS BIGINT))
        SELECT source, block, unnest(regexp_extract_all(id_text, '\\d+')) AS pmid
        FROM id_text WHERE nullif(trim(id_text), '') IS NOT NULL"""
    q["term_search"] = with_ctes(["articles"], _search(SEARCH_TERMS))
    q["term_search_retmax"] = with_ctes(["articles"], f"""
        SELECT pmid FROM ({_search(SEARCH_TERMS)}) ORDER BY CAST(pmid AS BIGINT), pmid LIMIT {SEARCH_RETMAX}""")
    has = "contains(w, ' {0} ')".format  # words of a title and an abstract between blanks, a bar between both
    records = f"""
        SELECT pmid, ' ' || array_to_string(regexp_extract_all(lower(coalesce(title, '')), '{_PAT}'), ' ') || ' | '
               || array_to_string(regexp_extract_all(lower(coalesce(abstract, '')), '{_PAT}'), ' ') || ' ' AS w FROM articles"""
    q["term_search_boolean"] = with_ctes(["articles"], f"""
        SELECT DISTINCT pmid FROM ({records})
        WHERE (({has('threea')} OR ({has('of the')} AND {has('with')})) AND NOT ({has('from')} OR {has('to the')}))
           OR NOT {has('the')}""")
    q["term_search_phrase"] = with_ctes(["articles"], f"""
        SELECT DISTINCT pmid FROM ({records}) WHERE {has('of the')} AND {has('that')}""")
    q["category_union"] = with_ctes(["articles", "article_index"], f"""
        SELECT pmid FROM article_index WHERE class = 1
        UNION ALL SELECT pmid FROM ({_search(CATEGORY_TERMS)})""")
    q["build_index"] = with_ctes(["article_index"], """
        SELECT pmid, class FROM article_index WHERE class = 1 UNION ALL
        SELECT pmid, class FROM article_index WHERE class = 0 UNION ALL
        SELECT pmid, class FROM article_index WHERE class = 2""")
    q["retrieve_by_id"] = with_ctes(["fetched"], "SELECT * FROM fetched")
    q["batch_plan"] = with_ctes(["article_index"], """
        SELECT CAST(batch_id AS BIGINT) AS batch_id, count(*) AS n_ids,
               string_agg(pmid, ',' ORDER BY rn) AS ids
        FROM (SELECT pmid, rn, floor((rn - 1) / len) AS batch_id
              FROM (SELECT pmid, row_number() OVER (ORDER BY CASE class WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END,
                                                     CAST(pmid AS BIGINT), pmid) AS rn,
                           floor(count(*) OVER () / (floor(count(*) OVER () / 400) + 1)) AS len
                    FROM article_index))
        GROUP BY batch_id""")
    q["index_retrieved"] = with_ctes(["idx_ret"], "SELECT pmid, class FROM idx_ret")
    q["missing_abstracts"] = with_ctes(["missing"], "SELECT pmid FROM missing")
    q["drop_missing"] = with_ctes(["clean"], "SELECT pmid, year, title, abstract FROM clean")
    q["labelled_articles"] = with_ctes(["labelled"], "SELECT * FROM labelled")
    q["coverage"] = with_ctes(["article_index", "idx_ret", "clean"], """
        SELECT n_index, n_retrieved, n_with_abstract,
               round(round_even(CAST(n_retrieved AS DOUBLE) / n_index, 4) * 100, 6) AS pct_retrieved,
               round(round_even(CAST(n_with_abstract AS DOUBLE) / n_retrieved, 4) * 100, 6)
                 AS pct_with_abstract
        FROM (SELECT (SELECT count(*) FROM article_index) AS n_index,
                     (SELECT count(*) FROM idx_ret) AS n_retrieved,
                     (SELECT count(*) FROM clean WHERE pmid IN (SELECT pmid FROM idx_ret))
                       AS n_with_abstract)""")
    q["class_counts"] = with_ctes(["labelled"],
                                  "SELECT class, count(*) AS n FROM labelled GROUP BY class")
    q["split_train"] = with_ctes(["train"], "SELECT * FROM train")
    q["split_test"] = with_ctes(["test"], "SELECT * FROM test")
    q["stratified_split"] = _with_curated(
        f"SELECT pmid, class, split FROM ({_stratified()})")
    q["year_filter"] = _with_curated(
        "SELECT pmid, year, class FROM curated WHERE CAST(year AS INTEGER) < 2020")
    q["recode_labels"] = _with_curated(f"""
        SELECT pmid, year, CAST(CASE WHEN split = 'test' THEN 2 WHEN class = 'yes' THEN 1 ELSE 0 END
                                AS INTEGER) AS class
        FROM ({_stratified()})""")
    q["truth_labels"] = with_ctes(["test"], """
        SELECT t.pmid, CASE WHEN p.pmid IS NOT NULL THEN 'Positive' ELSE 'Negative' END AS class
        FROM test t LEFT JOIN (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS pmid FROM labels
                               WHERE quality = 1) p ON t.pmid = p.pmid""")
    q["attach_truth"] = with_ctes(["scored", "truth"], """
        SELECT s.pmid, s.model_name, s.fold, round(s.p_positive, 6) AS p_positive, t.class
        FROM scored s JOIN truth t ON s.pmid = t.pmid""")
    q["prefix_split"] = with_ctes(["train"], """
        SELECT pmid, class, CASE WHEN rk <= floor(n * 4 / 5) THEN 'train' ELSE 'test' END AS split
        FROM (SELECT pmid, class,
                     row_number() OVER (PARTITION BY class ORDER BY CAST(pmid AS BIGINT), pmid) AS rk,
                     count(*) OVER (PARTITION BY class) AS n
              FROM train)""")
    q["balance_classes"] = with_ctes(["train"], """
        SELECT pmid, class FROM (
          SELECT pmid, class,
                 row_number() OVER (PARTITION BY class ORDER BY md5(concat(pmid, ':', '42')), pmid) AS rk
          FROM train)
        WHERE rk <= (SELECT min(n) FROM (SELECT count(*) AS n FROM train GROUP BY class))""")
    q["head_per_class"] = with_ctes(["train"], """
        SELECT pmid, class FROM (
          SELECT pmid, class,
                 row_number() OVER (PARTITION BY class ORDER BY CAST(pmid AS BIGINT), pmid) AS rk
          FROM train) WHERE rk <= 100""")
    q["assign_folds"] = with_ctes(["train"], """
        SELECT pmid, class,
               CAST(ntile(5) OVER (ORDER BY md5(concat(pmid, ':', '42')), class) AS INTEGER) AS fold
        FROM train""")
    q["corpus_guard"] = with_ctes(["labelled"], """
        SELECT class, n, CASE WHEN class < 2 AND n < 20 THEN 'fewer than 20 articles' END AS warning
        FROM (SELECT class, count(*) AS n FROM labelled GROUP BY class)""")
    q["tokenize"] = with_ctes(["train"], f"""
        SELECT pmid, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS tokens
        FROM (SELECT pmid, regexp_extract_all(lower(abstract), '{_PAT}') AS t FROM train)""")
    q["remove_stopwords"] = with_ctes(["tok"], """
        SELECT pmid, CAST(len(tokens) AS INTEGER) AS n_tokens,
               array_to_string(tokens, ' ') AS tokens FROM tok""")
    q["term_counts"] = with_ctes(["counts"], "SELECT pmid, term, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY pmid, term")
    q["top_tokens"] = with_ctes(["vocab"], """
        SELECT term, n, CAST(row_number() OVER (ORDER BY n DESC, term) AS INTEGER) AS term_rank
        FROM vocab""")
    q["doc_freq"] = with_ctes(["dfreq"], "SELECT term, df FROM dfreq")
    q["tfidf"] = with_ctes(["tfidf"], f"""
        SELECT pmid, term, n, {_r('tf')}, {_r('idf')}, {_r('tfidf')} FROM tfidf""")
    q["alpha_terms"] = with_ctes(["terms"], "SELECT term FROM terms")
    q["class_term_means"] = with_ctes(["means"], f"""
        SELECT term, {_r('mean_pos')}, {_r('mean_neg')} FROM means""")
    q["fold_change"] = with_ctes(["means"], f"""
        SELECT term, {_r('mean_pos')}, {_r('mean_neg')}, {_r('fold_change')}
        FROM ({_counts_fold_change()})""")
    q["term_rank_sum"] = with_ctes(["ranksum"], f"""
        SELECT term, n_nonzero, {_r('w_stat')}, {_r('z')}, p_rank, round({_P_NORMAL}, 6) AS p_value FROM ranksum""")
    q["term_dictionary"] = with_ctes(["ranksum"], """
        SELECT term FROM ranksum
        WHERE p_rank <= (SELECT CASE WHEN n_sig > 100 THEN n_sig ELSE 100 END FROM
                         (SELECT sum(CASE WHEN abs(z) > 1.959963984540054 THEN 1 ELSE 0 END) AS n_sig
                          FROM ranksum))""")
    q["fc_split_terms"] = with_ctes(["ranksum", "means", "lcounts", "terms", "csizes"], f"""
        SELECT side, side_rank, term, p_rank, {_r('fold_change')},
               round({_signif('mean_all')}, 6) AS mean_count
        FROM (SELECT side, term, p_rank, fold_change, mean_all,
                     CAST(row_number() OVER (PARTITION BY side ORDER BY p_rank) AS INTEGER) AS side_rank
              FROM (SELECT r.term, r.p_rank, f.fold_change, a.mean_all,
                           CASE WHEN f.fold_change > 1 THEN 'up'
                                WHEN f.fold_change < 1 THEN 'down' END AS side
                    FROM ranksum r JOIN ({_counts_fold_change()}) f ON r.term = f.term
                    JOIN (SELECT t.term, CAST(coalesce(s.s, 0) AS DOUBLE) / (c.n1 + c.n0) AS mean_all
                          FROM terms t LEFT JOIN (SELECT term, sum(n) AS s FROM lcounts GROUP BY term) s
                            ON t.term = s.term CROSS JOIN csizes c) a ON r.term = a.term)
              WHERE side IS NOT NULL)
        WHERE side_rank <= 25""")
    q["term_weights"] = with_ctes(["weights"], f"""
        SELECT term, p_rank, {_r('pos_weight')}, {_r('neg_weight')} FROM weights""")
    q["cloud_terms"] = with_ctes(["weights"], """
        SELECT term, side, round(weight, 6) AS weight, display_rank FROM (
          SELECT term, side, weight,
                 CAST(row_number() OVER (PARTITION BY side ORDER BY weight DESC, term) AS INTEGER)
                   AS display_rank
          FROM (SELECT term, 'positive' AS side, pos_weight AS weight FROM weights
                UNION ALL SELECT term, 'negative', neg_weight FROM weights)
          WHERE weight >= 0.05)
        WHERE display_rank <= 45""")
    q["welch_terms"] = with_ctes(["ltfidf", "terms", "csizes"], f"""
        SELECT term, round(m1, 6) AS mean_pos, round(m0, 6) AS mean_neg, round(t, 6) AS t,
               round(dfw, 6) AS df, t_rank, round({_P_STUDENT}, 6) AS p_value FROM (
          SELECT term, m1, m0, t, dfw,
                 CAST(row_number() OVER (ORDER BY abs(t) DESC NULLS LAST, term) AS INTEGER) AS t_rank
          FROM (SELECT term, m1, m0,
                       CASE WHEN se2 > 1e-18 THEN (m1 - m0) / sqrt(se2) END AS t,
                       CASE WHEN se2 > 1e-18 THEN se2 * se2 / (power(v1 / n1, 2) / (n1 - 1)
                                                          + power(v0 / n0, 2) / (n0 - 1)) END AS dfw
                FROM (SELECT term, n1, n0, m1, m0, v1, v0, v1 / n1 + v0 / n0 AS se2
                      FROM (SELECT term, n1, n0, s1 / n1 AS m1, s0 / n0 AS m0,
                                   (q1 - n1 * (s1 / n1) * (s1 / n1)) / (n1 - 1) AS v1,
                                   (q0 - n0 * (s0 / n0) * (s0 / n0)) / (n0 - 1) AS v0
                            FROM (SELECT t.term, CAST(c.n1 AS DOUBLE) AS n1, CAST(c.n0 AS DOUBLE) AS n0,
                                         coalesce(s.s1, 0.0) AS s1, coalesce(s.q1, 0.0) AS q1,
                                         coalesce(s.s0, 0.0) AS s0, coalesce(s.q0, 0.0) AS q0
                                  FROM terms t LEFT JOIN (
                                    SELECT term,
                                           sum(CASE WHEN label = 1.0 THEN tfidf ELSE 0.0 END) AS s1,
                                           sum(CASE WHEN label = 1.0 THEN tfidf * tfidf ELSE 0.0 END) AS q1,
                                           sum(CASE WHEN label = 1.0 THEN 0.0 ELSE tfidf END) AS s0,
                                           sum(CASE WHEN label = 1.0 THEN 0.0 ELSE tfidf * tfidf END) AS q0
                                    FROM ltfidf GROUP BY term) s ON t.term = s.term
                                  CROSS JOIN csizes c)))))
        WHERE t_rank <= 100""")
    q["normalize_terms"] = with_ctes(["ltfidf", "terms", "ndocs"], """
        SELECT term, round(mean, 6) AS mean, round(sd, 6) AS sd,
               round(CASE WHEN sd > 0 THEN -mean / sd END, 6) AS zero_score FROM (
          SELECT term, mean, sqrt(greatest((q - n * mean * mean) / (n - 1), 0.0)) AS sd FROM (
            SELECT t.term, CAST(nd.n_docs AS DOUBLE) AS n,
                   coalesce(s.s, 0.0) / nd.n_docs AS mean, coalesce(s.q, 0.0) AS q
            FROM terms t LEFT JOIN (SELECT term, sum(tfidf) AS s, sum(tfidf * tfidf) AS q
                                    FROM ltfidf GROUP BY term) s ON t.term = s.term
            CROSS JOIN ndocs nd))""")
    q["features_plain"] = with_ctes(["tdense"], f"""
        SELECT pmid, CAST(n_terms AS INTEGER) AS n_terms, {_r('total', 'tfidf_sum')},
               round(square, 6) AS tfidf_square FROM tdense""")
    q["model_nb_plain"] = with_ctes(["tdense", "dense"], """
        SELECT 'nb' AS model_name, pmid, round(p, 6) AS p_positive,
               CASE WHEN p >= 0.5 THEN 'Positive' ELSE 'Negative' END AS pred_class
        FROM (SELECT r, pmid, 1 / (1 + exp(-greatest(least(max(base) + sum(odds), 700.0), -700.0))) AS p
              FROM (SELECT t.r, t.pmid, s.base,
                           -ln(v1) / 2 - power(t.v - m1, 2) / (2 * v1) + ln(v0) / 2 + power(t.v - m0, 2) / (2 * v0) AS odds
                    FROM (SELECT r, pmid, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM tdense) t
                    JOIN (SELECT i, base, m1, m0, greatest(q1 - m1 * m1, 0) + eps AS v1, greatest(q0 - m0 * m0, 0) + eps AS v0
                          FROM (SELECT *, 1e-9 * max(q - m * m) OVER () AS eps,
                                       ln(n1 / n) - ln(n0 / n) AS base
                                FROM (SELECT i, avg(v) AS m, avg(v * v) AS q, CAST(count(*) AS DOUBLE) AS n,
                                             avg(v) FILTER (label = 1) AS m1, avg(v * v) FILTER (label = 1) AS q1,
                                             avg(v) FILTER (label = 0) AS m0, avg(v * v) FILTER (label = 0) AS q0,
                                             CAST(count(*) FILTER (label = 1) AS DOUBLE) AS n1,
                                             CAST(count(*) FILTER (label = 0) AS DOUBLE) AS n0
                                      FROM (SELECT label, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM dense)
                                      GROUP BY i))) s ON s.i = t.i)
              GROUP BY r, pmid)""")
    q["model_knn_plain"] = with_ctes(["tdense", "dense"], """
        SELECT 'knn' AS model_name, pmid, round(p, 6) AS p_positive,
               CASE WHEN p >= 0.5 THEN 'Positive' ELSE 'Negative' END AS pred_class
        FROM (SELECT r, pmid, sum(label / (d + 1e-9)) / sum(1 / (d + 1e-9)) AS p
              FROM (SELECT t.r, t.pmid, s.label, round(list_distance(t.x, s.x), 9) AS d,
                           row_number() OVER (PARTITION BY t.r ORDER BY round(list_distance(t.x, s.x), 9), s.label) AS k
                    FROM tdense t CROSS JOIN dense s)
              WHERE k <= 5 GROUP BY r, pmid)""")
    q["cross_validate_null"] = with_ctes(["fold_null"], """
        SELECT 'null' AS model_name, fold, metric, round(estimate, 6) AS estimate FROM (
          SELECT fold, 'roc_auc' AS metric, CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN 0.5::DOUBLE END AS estimate FROM fold_null
          UNION ALL SELECT fold, 'sens', tp / nullif(tp + fn, 0) FROM fold_null
          UNION ALL SELECT fold, 'spec', tn / nullif(tn + fp, 0) FROM fold_null
          UNION ALL SELECT fold, 'accuracy', (tp + tn) / (tp + tn + fp + fn) FROM fold_null
          UNION ALL SELECT fold, 'precision', tp / nullif(tp + fp, 0) FROM fold_null)
        WHERE estimate IS NOT NULL""")
    q["study_draws"] = with_ctes(["train"], """
        SELECT CAST(draw AS INTEGER) AS draw, class,
               row_number() OVER (PARTITION BY draw, class ORDER BY md5(concat(pmid, ':', draw))) AS rank,
               count(*) OVER (PARTITION BY draw, class) AS n, pmid
        FROM train CROSS JOIN (SELECT unnest(range(42, 52)) AS draw)""")
    q["learning_curve_null"] = with_ctes(["train"], """
        SELECT CAST(size AS INTEGER) AS size, CAST(10 AS BIGINT) AS n_draws, CASE WHEN t1 > 0 AND t0 > 0 THEN 0.5::DOUBLE END AS mean_auc,
               CASE WHEN t1 > 0 AND t0 > 0 THEN 0.0::DOUBLE END AS sd_auc, round(t1 / (t1 + t0), 6) AS mean_accuracy, 0.0::DOUBLE AS sd_accuracy
        FROM (SELECT t1, t0, unnest(range(10, least(n1 - n1 // 5, n0 - n0 // 5) // 10 * 10 + 1, 10)) AS size
              FROM (SELECT n1, n0, CAST(n1 // 5 AS DOUBLE) AS t1, CAST(n0 // 5 AS DOUBLE) AS t0
                    FROM (SELECT count(*) FILTER (class = 'Positive') AS n1, count(*) FILTER (class <> 'Positive') AS n0 FROM train)))""")
    conf_f = _CONF.format(g="model_name, fold", src="scored")
    q["confusion_metrics"] = with_ctes(["scored"], f"""
        SELECT model_name, fold, tp, fp, tn, fn, {_r('sens')}, {_r('spec')}, {_r('accuracy')},
               {_r('precision')} FROM ({conf_f})""")
    conf_m = _CONF.format(g="model_name", src="scored")
    q["f_score"] = with_ctes(["scored"], f"""
        SELECT model_name, {_r('precision')}, {_r('sens', 'recall')}, {_r('f_score')}
        FROM ({conf_m})""")
    q["f_score_by_class"] = with_ctes(["scored"], f"""
        SELECT model_name, 'Positive' AS class, {_r('f_score')} FROM ({conf_m})
        UNION ALL
        SELECT model_name, 'Negative',
               round(CASE WHEN 2 * tn + fp + fn > 0 THEN CAST(2 * tn AS DOUBLE) / (2 * tn + fp + fn) END, 6)
        FROM ({conf_m})""")
    q["auc_by_fold"] = with_ctes(["scored"], f"""
        SELECT model_name, fold, {_r('auc')} FROM ({_AUC.format(g='model_name, fold', src='scored')})""")
    q["roc_curve_folds"] = with_ctes(["scored"], _roc("model_name, fold", "scored"))
    fm = _fold_metrics()
    q["unnest_metrics"] = with_ctes(["scored"], f"""
        SELECT model_name, fold, metric, round(estimate, 6) AS estimate FROM ({fm})""")
    summ = f"""
        SELECT model_name, metric,
               CASE WHEN count(estimate) = count(*) THEN avg(estimate) END AS mean,
               count(*) AS n_folds
        FROM ({fm}) GROUP BY model_name, metric"""
    q["metric_summary"] = with_ctes(["scored"], f"""
        SELECT model_name, metric, round(mean, 6) AS mean, n_folds FROM ({summ})""")
    q["metric_names"] = with_ctes(["scored"], f"""
        SELECT model_name, metric, round(mean, 6) AS mean, n_folds,
               CASE model_name {_model_case()} ELSE model_name END AS Model,
               CASE metric WHEN 'roc_auc' THEN 'AUC' WHEN 'sens' THEN 'Sensitivity' WHEN 'spec' THEN 'Specificity'
                           WHEN 'accuracy' THEN 'Accuracy' WHEN 'precision' THEN 'Precision' END AS metric_name
        FROM ({summ})""")
    q["model_select"] = with_ctes(["scored"], f"""
        SELECT model_name, metric, round(mean, 6) AS mean, n_folds FROM ({summ})
        WHERE metric = 'roc_auc' AND mean IS NOT NULL
        ORDER BY mean DESC, model_name LIMIT 1""")
    q["mean_auc"] = with_ctes(["scored"], f"""
        SELECT model_name, round(mean_auc, 6) AS mean_auc,
               printf('AUC = %.3f', mean_auc) AS label_auc
        FROM (SELECT model_name, avg(estimate) AS mean_auc FROM ({fm})
              WHERE metric = 'roc_auc' AND estimate IS NOT NULL GROUP BY model_name)""")
    q["model_names"] = with_ctes(["scored"], f"""
        SELECT model_name, CASE model_name {_model_case()} ELSE model_name END AS Model
        FROM (SELECT DISTINCT model_name FROM scored)""")
    q["auc_by_model"] = with_ctes(["test_pred"], f"""
        SELECT Model, round(auc, 6) AS auc, label_auc FROM ({_auc_by_model()})""")
    q["roc_curve"] = with_ctes(["test_pred"], _roc("Model", "test_pred"))
    q["spec_at_sens"] = with_ctes(["test_pred"], f"""
        SELECT Model, round(max_spec, 6) AS max_spec, spec_label FROM ({_spec_at_sens()})""")
    q["spec_at_least_sens"] = with_ctes(["test_pred"], f"""
        SELECT Model, round(max_spec, 6) AS max_spec, spec_label
        FROM ({_spec_at_sens("100 * tp >= 95 * P")})""")
    q["roc_markers"] = with_ctes(["test_pred"], f"""
        SELECT Model, round(max_spec, 6) AS x, y
        FROM ({_spec_at_sens()}) CROSS JOIN (SELECT 0.0::DOUBLE AS y UNION ALL SELECT 0.95::DOUBLE)""")
    q["model_summary"] = with_ctes(["test_pred"], f"""
        SELECT s.Model, s.spec_label, a.label_auc
        FROM ({_spec_at_sens()}) s JOIN ({_auc_by_model()}) a ON s.Model = a.Model""")
    q["compare_models"] = with_ctes(["test_pred"], f"""
        SELECT * FROM ({_roc('Model', 'test_pred')})
        WHERE Model IN (SELECT Model FROM (SELECT Model FROM ({_auc_by_model()})
                                           ORDER BY auc DESC, Model LIMIT 3)
                        UNION SELECT Model FROM (SELECT Model FROM ({_auc_by_model()})
                                                 ORDER BY auc ASC, Model LIMIT 3))""")
    q["xml_articles_wide"] = """
        SELECT CAST(doc_id AS VARCHAR) AS pmid, CASE WHEN doc_id % 13 <> 0 THEN '10.1000/<' || doc_id || '>' END AS doi,
               'On ' || coalesce(lang, '-') || ' & ' || doc_id AS title,
               CASE WHEN doc_id % 17 <> 0 THEN regexp_replace(coalesce(text, ''), '[^\\x20-\\x7E]', ' ', 'g') END AS abstract,
               CAST(2000 + doc_id % 25 AS VARCHAR) AS year, CAST(1 + doc_id % 12 AS VARCHAR) AS month,
               CAST(1 + doc_id % 28 AS VARCHAR) AS day, source AS journal, substr(source, 1, 3) || '.' AS jabbrv,
               concat_ws(';', lang, 'n<' || doc_id) AS keywords, false AS malformed FROM documents"""
    q["xml_articles"] = with_ctes(["articles"], "SELECT pmid, year, title, abstract FROM articles")
    q["csv_articles"] = _with_curated("SELECT pmid, year, title, abstract, class FROM curated")
    q["id_file_scan"] = with_ctes(["article_index"],
                                  "SELECT pmid FROM article_index WHERE class = 1")
    q["model_null"] = with_ctes(["train", "test"], """
        SELECT 'null' AS model_name, pmid, round(p, 6) AS p_positive,
               CASE WHEN p >= 0.5 THEN 'Positive' ELSE 'Negative' END AS pred_class
        FROM test CROSS JOIN (SELECT avg(label) AS p FROM train)""")
    q["model_save_load"] = with_ctes(["train", "test"], """
        SELECT pmid, round(p, 6) AS p_positive,
               CASE WHEN p >= 0.5 THEN 'Positive' ELSE 'Negative' END AS pred_class
        FROM test CROSS JOIN (SELECT avg(label) AS p FROM train)""")
    q["table_sink"] = with_ctes(["scored"], """
        SELECT model_name, fold, pmid, class, round(p_positive, 6) AS p_positive FROM scored""")
    q["runtime_trend"] = """
        SELECT round(regr_slope(seconds, n_docs), 6) AS slope, round(regr_intercept(seconds, n_docs), 6) AS intercept,
               count(*) AS n_runs
        FROM (SELECT count(*) AS n_docs, sum(value) AS seconds FROM events GROUP BY user_id)"""
    q["ranked_list"] = with_ctes(["ranked"], "SELECT * FROM ranked")
    q["resort_list"] = with_ctes(["ranked"], _fill("""
        SELECT *, row_number() OVER (ORDER BY CASE WHEN "{col_label}" = 'Positive' THEN 0 ELSE 1 END,
               "{col_year}" DESC NULLS LAST, "{col_article}" NULLS LAST, "{col_rank}") AS position
        FROM ranked"""))
    return q
