"""Distances between two points or two array columns as built-in expressions, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, z: s + z)


def _centred(a: Column) -> Column:
    mean = F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    return F.transform(a, lambda v: v - mean)


def squared_euclidean(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda u, v: (u - v) * (u - v))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def cityblock(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda u, v: F.abs(u - v))


def chebychev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda u, v: F.abs(u - v)))


def minkowski(a: Column, b: Column, p: float = 3.0) -> Column:
    return F.pow(_sum(a, b, lambda u, v: F.pow(F.abs(u - v), F.lit(float(p)))), F.lit(1.0 / p))


def standardized(a: Column, b: Column, variances: list[float]) -> Column:
    """Euclidean over components divided by their standard deviation."""
    scaled = F.zip_with(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.array(*[F.lit(float(v)) for v in variances]), lambda d, v: d / v)
    return F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda s, z: s + z))


def mahalanobis(a: Column, b: Column, inverse_covariance: list[list[float]]) -> Column:
    diff = F.zip_with(a, b, lambda u, v: u - v)
    rows = [F.aggregate(F.zip_with(diff, F.array(*[F.lit(float(x)) for x in row]), lambda d, c: d * c), F.lit(0.0), lambda s, z: s + z) for row in inverse_covariance]
    return F.sqrt(_sum(diff, F.array(*rows), lambda u, v: u * v))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine of the angle; NULL if a vector has no length."""
    norm = F.sqrt(_sum(a, a, lambda u, v: u * v)) * F.sqrt(_sum(b, b, lambda u, v: u * v))
    return F.when(norm > 0, 1 - _sum(a, b, lambda u, v: u * v) / norm)


def correlation(a: Column, b: Column) -> Column:
    return cosine(_centred(a), _centred(b))


def spearman(a: Column, b: Column) -> Column:
    """Correlation distance of the ranks; ties share their mean rank."""

    def ranks(v: Column) -> Column:
        return F.transform(v, lambda x: F.size(F.filter(v, lambda y: y < x)) + (F.size(F.filter(v, lambda y: y == x)) + 1) / 2.0)

    return correlation(ranks(a), ranks(b))


def hamming_share(a: Column, b: Column) -> Column:
    """Share of components that differ."""
    return _sum(a, b, lambda u, v: F.when(u != v, 1.0).otherwise(0.0)) / F.size(a)


def hamming_bits(a: Column, b: Column) -> Column:
    """Differing bits of packed integer words."""
    return F.aggregate(F.zip_with(a, b, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, z: s + z)


def jaccard(a: Column, b: Column) -> Column:
    """Share of components that differ among those of which one isn't zero; 0 if none."""
    either = _sum(a, b, lambda u, v: F.when((u != 0) | (v != 0), 1.0).otherwise(0.0))
    return F.when(either > 0, _sum(a, b, lambda u, v: F.when(((u != 0) | (v != 0)) & (u != v), 1.0).otherwise(0.0)) / either).otherwise(F.lit(0.0))


METRICS: dict[str, Callable[..., Column]] = {
    "squared_euclidean": squared_euclidean,
    "euclidean": euclidean,
    "cityblock": cityblock,
    "chebychev": chebychev,
    "minkowski": minkowski,
    "seuclidean": standardized,
    "mahalanobis": mahalanobis,
    "cosine": cosine,
    "correlation": correlation,
    "spearman": spearman,
    "hamming": hamming_share,
    "hamming_bits": hamming_bits,
    "jaccard": jaccard,
}


def distance(metric: str | Callable[..., Column], a: Column, b: Column, **options) -> Column:
    """A registered metric by name, or any function of two columns."""
    return (METRICS[metric] if isinstance(metric, str) else metric)(a, b, **options)
