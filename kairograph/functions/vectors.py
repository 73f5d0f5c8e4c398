"""Element-wise vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    # the norm is evaluated once: inside the lambda it would be for every component
    return F.zip_with(a, F.array_repeat(F.greatest(norm(a), F.lit(EPS)), F.size(a)), lambda x, n: x / n)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def truncate(a: Column, size: int) -> Column:
    return F.slice(a, 1, size)


def sum_vectors(a: Column) -> Column:
    """Element-wise sum of an array of vectors; null where it is empty."""
    return F.when(F.size(a) > 0, F.aggregate(F.slice(a, 2, F.size(a)), F.element_at(a, 1), add))


def time_encoding(delta: Column, weights: Column, biases: Column) -> Column:
    """cos(w * delta + b) for each pair of weight and bias."""
    return F.zip_with(weights, biases, lambda w, b: F.cos(w * delta + b))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (1.0 + F.exp(-x))
