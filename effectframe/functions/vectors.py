"""Expressions over ``array<float>`` vectors, evaluated inside the JVM.

Sums run in double; results which are vectors are ``array<float>``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from effectframe.constants import NOISE_STD_EPSILON, NORM_EPSILON


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A value captured by a lambda is computed again for every element; bound to a
    lambda variable it is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def total(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def l2_norm(vec: Column) -> Column:
    squares = F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def population_std(vec: Column) -> Column:
    def spread(v: Column, mean: Column) -> Column:
        return F.aggregate(
            v,
            F.lit(0.0),
            lambda acc, x: acc + (x.cast("double") - mean) * (x.cast("double") - mean),
        )

    return let(
        vec,
        lambda v: let(total(v) / F.size(v), lambda m: F.sqrt(spread(v, m) / F.size(v))),
    )


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("float") - y.cast("float"))


def l2_normalize(vec: Column) -> Column:
    """``v / (|v| + 1e-8)``."""

    def divided(v: Column, n: Column) -> Column:
        return F.transform(v, lambda x: (x.cast("double") / n).cast("float"))

    return let(vec, lambda v: let(l2_norm(v) + F.lit(NORM_EPSILON), lambda n: divided(v, n)))


def effect_vector(ref: Column, alt: Column) -> Column:
    """Unit vector from the reference embedding to the alternate one."""
    return l2_normalize(subtract(alt, ref))


def concat_blocks(blocks: Sequence[Column]) -> Column:
    return F.concat(*blocks)


def slice_block(vec: Column, start: int, length: int) -> Column:
    """``length`` elements from 0-based ``start``."""
    return F.slice(vec, start + 1, length)


def scale(vec: Column, factor: float | Column) -> Column:
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    return let(f, lambda k: F.transform(vec, lambda x: (x.cast("double") * k).cast("float")))


def zero_all(vec: Column) -> Column:
    return F.transform(vec, lambda x: F.lit(0.0).cast("float"))


def zero_ranges(vec: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    """Zero the 0-based half-open ranges; bounds outside the vector are clamped."""
    kept = [(max(0, int(s)), int(e)) for s, e in ranges if int(e) > int(s) and int(e) > 0]
    if not kept:
        return vec

    def blank(x: Column, i: Column) -> Column:
        inside = F.lit(False)
        for start, end in kept:
            inside = inside | ((i >= start) & (i < end))
        return F.when(inside, F.lit(0.0).cast("float")).otherwise(x)

    return F.transform(vec, blank)


PRIME = (1 << 31) - 1


def _start(key: Column, seed: int) -> Column:
    """Two numbers below ``PRIME`` from the digest of seed and key, where a row's draws start."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))
    head = lambda at: F.conv(F.substring(digest, at, 12), 16, 10).cast("long") % F.lit(PRIME)
    return F.struct(head(1).alias("a"), head(17).alias("b"))


def _uniform(start: Column, index: Column) -> Column:
    """Uniform in (0, 1): two squarings modulo a prime, in integers any engine has."""
    prime = F.lit(PRIME)
    first = (start + index.cast("long") * 48271) % prime
    second = (first * first + index.cast("long") + 1) % prime
    third = (second * 69621 + start) % prime
    return ((third * third + 7) % prime + 0.5) / F.lit(float(PRIME))


def gaussian(start: Column, index: Column) -> Column:
    """Standard normal number by the Box-Muller transform of two draws."""
    radius = F.sqrt(-2.0 * F.ln(_uniform(start["a"], index)))
    return radius * F.cos(F.lit(2.0) * F.pi() * _uniform(start["b"], index))


def add_noise(
    vec: Column, key: Column, seed: int, std: float | None = None, alpha: float = 0.0
) -> Column:
    """Additive noise with absolute ``std``, else ``alpha`` times the vector's own spread."""
    sigma = F.lit(float(std)) if std is not None else F.lit(float(alpha)) * (
        population_std(vec) + F.lit(NOISE_STD_EPSILON)
    )
    return let(
        F.struct(sigma.alias("sigma"), _start(key, seed).alias("start")),
        lambda s: F.transform(
            vec, lambda x, i: (x.cast("double") + s["sigma"] * gaussian(s["start"], i)).cast("float")
        ),
    )


def pure_noise(vec: Column, key: Column, seed: int, std: float = 1.0) -> Column:
    return let(
        _start(key, seed),
        lambda s: F.transform(vec, lambda x, i: (F.lit(float(std)) * gaussian(s, i)).cast("float")),
    )


def signal_to_noise(before: Column, after: Column) -> Column:
    noise = F.zip_with(after, before, lambda a, b: a.cast("double") - b.cast("double"))
    return (population_std(before) + 1e-8) / (population_std(noise) + 1e-8)


def is_finite(x: Column) -> Column:
    """Whether an element is a number: neither null nor NaN nor an infinity."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))


def all_finite(vec: Column) -> Column:
    """False for a null vector."""
    return F.coalesce(F.forall(vec, is_finite), F.lit(False))


def finite_share(vec: Column) -> Column:
    return F.size(F.filter(vec, is_finite)) / F.size(vec)


def finite_min(vec: Column) -> Column:
    return F.array_min(F.filter(vec, is_finite))


def finite_max(vec: Column) -> Column:
    return F.array_max(F.filter(vec, is_finite))
