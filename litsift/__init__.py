"""litsift: document triage (rank a literature collection by relevance) on Spark.

Layout
------
- ``sources``   readers: parquet tables, id lists, XML records, CSV, term search
- ``functions`` column expressions and small per-row helpers (tokenise, stem, signif, p-values)
- ``operators`` DataFrame -> DataFrame operators (corpus, sampling, terms, evaluation, ranking, PCA)
- ``models``    feature estimator, classifiers, cross-validation
- ``plans``     end-to-end workflows, test fixtures derived from the given tables, query registry
- ``streaming`` scoring new articles as they arrive with a fitted model
"""

__version__ = "0.1.0"
