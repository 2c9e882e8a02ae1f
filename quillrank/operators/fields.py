"""Several columns in one index: fused into one token stream, or kept apart as weighted fields."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.querylang import Query, QueryError, parse
from .scoring import Bm25, Part, score_parts


def fused(*columns: Column) -> Column:
    """One token stream, columns in order; null columns are skipped."""
    return F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in columns])


def rank_fields(docs: DataFrame, fields: dict[str, Column], query: str | Query, weights: list[float] | None = None, params: Bm25 | None = None, normalize=None) -> DataFrame:
    """Sum over the fields of weight times BM25 with the field's own document frequencies and the combined length."""
    names = list(fields)
    weights = [1.0] * len(names) if weights is None else weights
    if len(weights) != len(names) or not all(math.isfinite(w) and w >= 0 for w in weights):
        raise ValueError("field weights must be finite and not negative, one for each field")
    q = query if isinstance(query, Query) else parse(query, normalize)
    if not q.simple or q.prefixes or q.phrases:
        raise QueryError("a query over fields takes plain terms only")
    terms = dict(Counter(q.terms))
    return score_parts(docs, [Part(fields[n], terms, float(w)) for n, w in zip(names, weights, strict=True)], params or Bm25())
