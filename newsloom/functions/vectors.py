"""Vector and set similarities as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import col


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 for empty vectors, vectors of different lengths and vectors of length 0."""
    n = norm(a) * norm(b)
    usable = (F.size(col(a)) == F.size(col(b))) & (n > 0)
    return F.coalesce(F.when(usable, dot(a, b) / n), F.lit(0.0))


def json_vector(c: Column | str, dim: int) -> Column:
    """A JSON list of exactly ``dim`` finite numbers, not all zero, as doubles; null for anything else."""
    v = F.from_json(F.when(col(c).rlike(r"^\s*\[[-+0-9eE.,\s]*\]\s*$"), col(c)), "array<double>")
    usable = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.when(usable, v)


def jaccard(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(col(a), col(b))), F.size(F.array_union(col(a), col(b)))), F.lit(0.0))


def containment(a: Column | str, b: Column | str) -> Column:
    """Shared entries over the smaller set's."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(col(a), col(b))), F.least(F.size(F.array_distinct(col(a))), F.size(F.array_distinct(col(b))))), F.lit(0.0))


def id_of(*parts: Column | str, length: int = 24, sep: str = "|") -> Column:
    """A stable id of some columns; nulls count as empty."""
    return F.substring(F.sha2(F.concat_ws(sep, *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), 256), 1, length)
