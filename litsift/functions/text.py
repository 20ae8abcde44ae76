"""Text column expressions: tokenise, stop-word removal, stemming.

All but stemming are JVM-side SQL expressions (whole-stage codegen). Stemming is an
Arrow UDF: tokens are dictionary-encoded in Arrow, some rows at a time, and only the distinct
ones are stemmed in Python (memoised per worker); it runs in the scan stage, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litsift.functions.stem import stem as _stem_word

# Fixed value: a word is a run of letters/digits, optionally followed by
# apostrophe-letter groups ("don't", "cd8").  Lower-cased first; punctuation dropped.
TOKEN_PATTERN = r"[\p{L}\p{N}]+(?:'\p{L}+)*"

# The Snowball English stop-word list (the default list of the
# reference's stop-word step), in its published order.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your",
    "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her",
    "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs",
    "themselves", "what", "which", "who", "whom", "this", "that", "these", "those",
    "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "would", "should", "could", "ought",
    "i'm", "you're", "he's", "she's", "it's", "we're", "they're", "i've", "you've",
    "we've", "they've", "i'd", "you'd", "he'd", "she'd", "we'd", "they'd", "i'll",
    "you'll", "he'll", "she'll", "we'll", "they'll", "isn't", "aren't", "wasn't",
    "weren't", "hasn't", "haven't", "hadn't", "doesn't", "don't", "didn't", "won't",
    "wouldn't", "shan't", "shouldn't", "can't", "cannot", "couldn't", "mustn't",
    "let's", "that's", "who's", "what's", "here's", "there's", "when's", "where's",
    "why's", "how's", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further",
    "then", "once", "here", "there", "when", "where", "why", "how", "all", "any",
    "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor",
    "not", "only", "own", "same", "so", "than", "too", "very",
]


def tokenize(text: Column | str) -> Column:
    """Lower-case words of a text column as ``array<string>``; NULL text -> empty array."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))),
                                F.lit(TOKEN_PATTERN), F.lit(0))


def remove_stopwords(tokens: Column | str, stop_words: list[str] | None = None) -> Column:
    """Drop stop words from a token array, keeping order and repeats (never array_except)."""
    col = F.col(tokens) if isinstance(tokens, str) else tokens
    # isin with many literals is planned as a hash-set lookup (InSet)
    words = list(stop_words or STOP_WORDS)
    return F.filter(col, lambda t: ~t.isin(words))


#: Rows of token arrays that are stemmed at once. Spark's batches (10,000 rows or 64 MB) are read a piece at a time, so
#: what a worker holds beside its batch doesn't grow with them.
PIECE = 512


def _stem_piece(tokens: pa.ListArray) -> pa.ListArray:
    """Stem every token of every array.

    The tokens are dictionary-encoded in Arrow (C++), only the distinct ones go through the Python stemmer
    (memoised per worker), and the stems are gathered back by index -- per-token work never runs in Python.
    """
    flat = tokens.flatten()
    enc = pc.dictionary_encode(flat)
    stems = pa.array([_stem_word(t) for t in enc.dictionary.to_pylist()], type=flat.type)
    values = stems.take(enc.indices)
    offsets = pc.subtract(tokens.offsets, tokens.offsets[0])
    return pa.ListArray.from_arrays(offsets, values, type=tokens.type,
                                    mask=tokens.is_null() if tokens.null_count else None)


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Stem every token of every array, ``PIECE`` rows at a time."""
    for tokens in batches:
        if isinstance(tokens, pa.ChunkedArray):
            tokens = tokens.combine_chunks()
        for a in range(0, len(tokens), PIECE):
            yield _stem_piece(tokens.slice(a, PIECE))


def stem_words(words: Column | str) -> Column:
    """Stem a string column (one word per row)."""
    col = F.col(words) if isinstance(words, str) else words
    return stem_tokens(F.array(col))[0]


def analyze(text: Column | str, stem: bool = True,
            stop_words: list[str] | None = None) -> Column:
    """Tokenise -> stop words -> (optionally) stem: the recipe's text steps."""
    toks = remove_stopwords(tokenize(text), stop_words)
    return stem_tokens(toks) if stem else toks


def sql_string_list(values: list[str]) -> str:
    """Render a list of strings as a SQL list literal body ('a', 'b', ...)."""
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
