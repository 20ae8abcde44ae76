"""Search-term source over a local article table (stands in for the remote search)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_AND = re.compile(r"\s+(?:\[and\]|and)\s+", re.IGNORECASE)


def parse_query(query: str) -> list[str]:
    """'a [AND] b' or 'a and b' -> ['a', 'b'] (any case; lower-cased, blanks dropped)."""
    parts = [p.strip().lower() for p in _AND.split(f" {query} ")]
    return [p for p in parts if p]


def term_search(articles: DataFrame, query: str, max_hits: int | None = None,
                check_empty: bool = False) -> DataFrame:
    """Ids of articles whose title + abstract contain every term (case-insensitive).

    All of them, or with ``max_hits`` the lowest ids (a bounded top-k, not a sort of the
    whole table).  With ``check_empty`` an empty hit set raises ``ValueError``.
    """
    terms = parse_query(query)
    if not terms:
        raise ValueError("empty query")
    hay = F.lower(F.concat_ws(" ", F.col("title"), F.col("abstract")))
    cond = None
    for t in terms:
        c = hay.contains(t)
        cond = c if cond is None else (cond & c)
    hits = articles.where(cond).select("pmid").distinct()
    if max_hits is not None:
        hits = hits.orderBy(F.col("pmid").try_cast("long"), F.col("pmid")).limit(max_hits)
    if check_empty and hits.limit(1).count() == 0:
        raise ValueError(f"The query {query!r} was unsuccessful. Try another query.")
    return hits
