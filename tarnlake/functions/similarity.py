"""Similarity and vector functions: Column to Column, JVM only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CAP = 0.95  # of type and predicate similarity: equal sets are not the same entity


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0, within [-1, 1]; vectors of other lengths are an error."""
    checked = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different dimension")).cast("double"))
    c = F.try_divide(dot(a, b), norm(a) * norm(b))
    return checked.otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0)))))


def embedding_similarity(a: Column, b: Column, function: str = "NORM_COS") -> Column:
    """0 where either side has no embedding."""
    c = cosine(a, b)
    by = {"NORM_COS": (c + 1) / 2, "ABS_COS": F.abs(c), "ANG_COS": 1 - F.acos(c) / F.lit(3.141592653589793)}
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(by[function])


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def weighted_jaccard(a: Column, b: Column, weights: Column) -> Column:
    """weights: map of element to weight; elements without a weight of 0 or more are skipped."""
    weigh = lambda s: F.aggregate(s, F.lit(0.0), lambda t, x: t + F.greatest(F.coalesce(weights[x], F.lit(0.0)), F.lit(0.0)))
    return F.coalesce(F.try_divide(weigh(F.array_intersect(a, b)), weigh(F.array_union(a, b))), F.lit(0.0))


def capped(similarity: Column) -> Column:
    return F.least(F.lit(CAP), similarity)


def l1_normalise(v: Column) -> Column:
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), total), F.lit(0.0)))


def weighted_euclid(a: Column, b: Column, w: Column) -> Column:
    parts = F.zip_with(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), w, lambda d, x: d * x)
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))


def hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (~x.eqNullSafe(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def log2(x: Column) -> Column:
    return F.log2(x)


def uri_text(uri: Column) -> Column:
    """Last path segment, underscores as spaces."""
    return F.replace(F.element_at(F.split(uri, "/"), -1), F.lit("_"), F.lit(" "))


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def is_url(text: Column) -> Column:
    return F.contains(text, F.lit("http"))


def is_decimal(text: Column) -> Column:
    return text.try_cast("double").isNotNull()


def plain_http(uri: Column) -> Column:
    return F.replace(uri, F.lit("https://"), F.lit("http://"))
