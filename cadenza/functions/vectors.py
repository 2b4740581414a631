"""Feature-vector functions over ``array<double>`` columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# How the scalar features are scaled into the unified vector.
TEMPO_SCALE = 200.0
SCALAR_SCALE = 10.0


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once.

    Inside the lambda of ``transform`` a plain expression is evaluated again for
    every element, which makes dividing a vector by its norm quadratic.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector is left as it is."""
    doubles = v.cast("array<double>")
    return bind(norm(doubles), lambda n: F.transform(doubles, lambda x: F.when(n > 0, x / n).otherwise(x)))


def average(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)


def assemble(mfcc, chroma, contrast, tempo, energy, zcr, valence) -> Column:
    """The unified vector: three pooled blocks, then the four scaled scalars."""
    return unit(F.concat(
        mfcc, chroma, contrast,
        F.array(tempo / TEMPO_SCALE, energy * SCALAR_SCALE, zcr * SCALAR_SCALE, valence * SCALAR_SCALE),
    ))


def from_text(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def to_text(v: Column) -> Column:
    return F.to_json(v)


def vector_key(v: Column) -> Column:
    """A fixed-width key equal for equal vectors (a sha-256 of the values)."""
    return F.sha2(F.to_json(v), 256)
