"""Vector expressions: cosine distance and the built-in hashed bag-of-words embedding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimals of distances as shown, and as ranked: enough to tell any two neighbours apart that
# double precision does, and few enough that the order of summing does not show.
DISTANCE_DECIMALS = 6
RANKED_DECIMALS = 12


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity in double precision; null when either vector has no length.

    Runs outside code generation; the search operators use matrix products instead and
    this form is their check.
    """
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms > 0, 1 - dot(a, b) / norms)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda t: t != "")


def token_buckets(text: Column, dim: int) -> Column:
    """The hash bucket of every token, in text order."""
    head = lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint")
    return F.transform(tokens(text), lambda t: F.pmod(head(t), F.lit(dim)).cast("int"))


def bucket_counts(dim: int):
    """Arrow helper: bucket lists to L2-normalised count vectors.

    Marked nondeterministic so that a filter on the vector is not pushed below it, which
    would run it twice.
    """

    @F.pandas_udf("array<float>")
    def to_vector(buckets: pd.Series) -> pd.Series:
        sizes = np.array([0 if row is None else len(row) for row in buckets], dtype=np.int64)
        if not sizes.any():
            return pd.Series([None] * len(buckets), dtype=object)
        flat = np.concatenate([row for row, n in zip(buckets, sizes) if n]).astype(np.int64)
        at = np.repeat(np.arange(len(buckets)), sizes) * dim + flat
        counts = np.bincount(at, minlength=len(buckets) * dim).reshape(-1, dim).astype(np.float64)
        norms = np.sqrt(np.einsum("ij,ij->i", counts, counts))
        units = (counts / np.where(norms > 0, norms, 1)[:, None]).astype(np.float32)
        return pd.Series([u if n else None for u, n in zip(units, sizes)], dtype=object)

    return to_vector.asNondeterministic()


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """Text to a unit vector of hashed token counts; a text without letters has no vector."""
    return bucket_counts(dim)(token_buckets(text, dim))
