"""Vectors as columns: dot product, norm, cosine; and the deterministic text embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def embed_text(text: Column, dimension: int = 768) -> Column:
    """A stand-in for an embedding model: each word of a text adds or takes one at a place that its hash names; then scaled to length one.

    Texts in which that leaves nothing, null and empty ones too, have a single one at the place that their own hash names.
    """
    number = lambda x, at: F.conv(F.substring(x, at, 8), 16, 10).cast("bigint")
    one = lambda v, f: F.get(F.transform(F.array(v), f), F.lit(0))
    every = lambda found: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), found)
    whole = F.coalesce(text, F.lit(""))
    # Twice its place, and one more if it takes away: each word is hashed once, whatever the dimension.
    odd = lambda x: F.contains(F.lit("13579bdf"), F.substring(x, 16, 1)).cast("int")
    marks = F.transform(F.transform(tokens(whole), lambda w: F.md5(w)), lambda h: (number(h, 1) % dimension).cast("int") * 2 + odd(h))

    def counted(marks: Column) -> Column:
        # One more of each mark, so that the sorted marks' runs are one for each, in order.
        def runs(s: Column) -> Column:
            begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
            return one(F.concat(begins, F.array(F.size(s))), lambda b: every(lambda d: (2 * F.get(b, 2 * d + 1) - F.get(b, 2 * d) - F.get(b, 2 * d + 2)).cast("double")))

        return one(F.sort_array(F.concat(marks, F.sequence(F.lit(0), F.lit(2 * dimension - 1)))), runs)

    def single() -> Column:
        return one(number(F.md5(whole), 1) % dimension, lambda own: every(lambda d: F.when(d == own, 1.0).otherwise(0.0)))

    # Arrays of one element, so that each step is computed once.
    first = one(counted(marks), lambda v: F.when(norm(v) > 0, v).otherwise(single()))
    return one(first, lambda v: one(norm(v), lambda n: F.transform(v, lambda y: y / n)))


#: Embedding providers by name: a function from a text column and a dimension to a vector column.
PROVIDERS = {"hashed-words": embed_text}


def model_version(provider: str, dimension: int) -> str:
    return f"{provider}@{dimension}d"
