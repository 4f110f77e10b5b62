"""Tokens of facts and queries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.functions.porter2 import stem

#: A term is a maximal run of letters, decimal digits and symbols such as emoji.
TERM = r"[\p{L}\p{Nd}\p{So}]+"

# The English function words that are neither indexed nor searched. Negations are kept as terms.
# They are taken from the stop words of the Snowball project: Copyright (c) 2001, Dr Martin Porter, and (c) 2002,
# Richard Boulton, under the 3-clause BSD licence, whose terms and disclaimer of warranty go with this list.
STOP_WORDS = frozenset(
    """
    a about above after again against all am an and any are as at be because been before being below between both
    but by could did do does doing down during each few for from further had has have having he her here hers herself
    him himself his how i if in into is it its itself me more most my myself of off on once only or other ought our
    ours ourselves out over own same she should so some such than that the their theirs them themselves then there
    these they this those through to too under until up very was we were what when where which while who whom why
    with would you your yours yourself yourselves
    """.split()
)


def terms(text: Column) -> Column:
    """Lower-cased terms in order, repeats kept; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def without_stop_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*sorted(STOP_WORDS)))


def term_list(text: str) -> list[str]:
    """The same for a query's text, on the driver."""
    out, run = [], []
    for c in text.lower():
        if c.isalpha() or c.isdecimal() or _symbol(c):
            run.append(c)
        elif run:
            out.append("".join(run))
            run = []
    return [*out, "".join(run)] if run else out


def _symbol(c: str) -> bool:
    import unicodedata

    return unicodedata.category(c) == "So"


def query_terms(text: str, stemmed: bool = True) -> list[str]:
    kept = [t for t in term_list(text) if t not in STOP_WORDS]
    return [stem(t) for t in kept] if stemmed else kept


def stemmed(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the array ``column`` of tokens stemmed. Each different token of a batch is stemmed once, so Python's part follows the vocabulary, not the text."""
    at, names = df.columns.index(column), df.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = b.column(at)
            coded = tokens.flatten().dictionary_encode()
            stems = pa.array([stem(t) for t in coded.dictionary.to_pylist()], pa.string())
            lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offsets = pa.array([0, *lengths.cumsum().tolist()], pa.int32())
            new = pa.ListArray.from_arrays(offsets, stems.take(coded.indices))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], new, *b.columns[at + 1 :]], names)

    return df.mapInArrow(run, df.schema)
