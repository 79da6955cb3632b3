"""Arithmetic on array columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import _col


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def sigmoid(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(x)))


def logistic(vector: Column | str, weights: Sequence[float], bias: float = 0.0) -> Column:
    """Sigmoid of the vector's product with fixed weights."""
    literal = F.array(*[F.lit(float(w)) for w in weights])
    return sigmoid(dot(vector, literal) + F.lit(float(bias)))


def log_sum_exp(values: Column | str) -> Column:
    v = F.transform(_col(values), lambda x: x.cast("double"))
    top = F.array_max(v)
    return top + F.log(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))


def uniform_of(*key: Column) -> Column:
    """A repeatable number in (0, 1) drawn from the md5 of the key."""
    digest = F.md5(F.concat_ws(":", *[k.cast("string") for k in key]))
    bits = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(4294967296.0)


def seeded_normal(key: Column, dim: int, seed: int) -> Column:
    """``dim`` standard normal numbers, the same for the same key and seed."""

    def one(k: Column) -> Column:
        u1 = uniform_of(F.lit(seed), key, k, F.lit("a"))
        u2 = uniform_of(F.lit(seed), key, k, F.lit("b"))
        return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)

    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), one)


def seeded_uniform(key: Column, dim: int, seed: int, reach: float = 0.05) -> Column:
    """``dim`` numbers spread evenly over ``(-reach, reach)``."""

    def one(k: Column) -> Column:
        return (uniform_of(F.lit(seed), key, k) * 2.0 - 1.0) * F.lit(float(reach))

    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), one)
