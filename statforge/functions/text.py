"""Text expressions: normalisation, tokens and n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import require

#: Words of two letters or more, with letters of any script.
WORDS = r"[\p{L}\p{M}\p{N}_]{2,}"


#: Bytes of text that are decoded at once.
SLICE = 1 << 20


def nfkd(text: Column) -> Column:
    """Compatibility decomposition; no built-in has it.  Plain ASCII passes through."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return decomposed(texts)

    return run(text)


def decomposed(texts: pa.Array) -> pa.Array:
    """A slice of about ``SLICE`` bytes is decoded at a time, if it isn't plain ASCII; the rest stays in Arrow's buffers."""
    parts, first, held = [], 0, 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()):
        held += size
        if held >= SLICE or i + 1 == len(texts):
            part = texts.slice(first, i + 1 - first)
            if not pc.all(pc.string_is_ascii(part), min_count=0).as_py():
                part = pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKD", t) for t in part.to_pylist()], texts.type)
            parts.append(part)
            first, held = i + 1, 0
    return pa.concat_arrays(parts) if parts else texts


def prepared(text: Column, lower: bool = True, normalise: bool = True) -> Column:
    """Normalised first, then lower case."""
    out = nfkd(text) if normalise else text
    return F.lower(out) if lower else out


def tokens(text: Column, pattern: str = WORDS) -> Column:
    """All matches of the pattern; null gives none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def ngrams(words: Column, least: int = 1, most: int = 1) -> Column:
    """At each word the runs of ``least`` to ``most`` words that begin there, joined by blanks."""
    require(0 < least <= most, "n-gram lengths must be positive and in order")
    if (least, most) == (1, 1):
        return words
    none = F.array().cast("array<string>")

    def grams(own: Column) -> Column:
        size = F.size(own)

        def at(i: Column) -> Column:
            return F.transform(F.sequence(F.lit(least), F.least(F.lit(most), size - i)), lambda n: F.concat_ws(" ", F.slice(own, i + 1, n)))

        return F.when(size < least, none).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), size - least), at)))

    # bound to a variable, the words are found once and not once an n-gram
    return F.transform(F.array(words), grams)[0]


def tokens_by(function: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """A tokenizer of the user's own, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(function(t)) if t is not None else [])

    return run
