"""Real spherical harmonics, for columns and for arrays alike, and what bounds they set."""

from __future__ import annotations

import math
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def basis(degree: int, x: Any, y: Any, z: Any) -> list:
    """The (degree + 1)^2 real harmonics at a unit direction, by degree l and then order m from -l to l.

    x, y and z are columns, arrays or numbers. The sign is that of (-1)^m. From Legendre's recurrence in z and the powers of
    x + iy.
    """
    zero = x * 0.0
    legendre: dict[tuple[int, int], Any] = {}
    for m in range(degree + 1):
        legendre[m, m] = zero + float(math.prod(range(1, 2 * m, 2)))
        for n in range(m + 1, degree + 1):
            before = legendre.get((n - 2, m), zero)
            legendre[n, m] = (z * (2.0 * n - 1) * legendre[n - 1, m] - before * float(n + m - 1)) * (1.0 / (n - m))
    power = [(zero + 1.0, zero)]
    for _ in range(degree):
        c, s = power[-1]
        power.append((x * c - y * s, x * s + y * c))
    out = []
    for n in range(degree + 1):
        for m in range(-n, n + 1):
            k = abs(m)
            size = math.sqrt((2 * n + 1) / (4 * math.pi) * math.factorial(n - k) / math.factorial(n + k)) * (math.sqrt(2) if m else 1.0) * (-1) ** k
            out.append(legendre[n, k] * power[k][m < 0] * size)
    return out


def degree_of(coefficients: int) -> int:
    """The degree of so many coefficients without the constant one: 0, 3, 8 or 15."""
    degree = math.isqrt(coefficients + 1) - 1
    if (degree + 1) ** 2 != coefficients + 1 or degree > 3:
        raise ValueError("harmonics without the constant have 0, 3, 8 or 15 coefficients")
    return degree


def design(coefficients: int, samples: int = 32) -> np.ndarray:
    """A row for each of some directions spread evenly over the sphere: 1 and the harmonics from degree 1 on."""
    i = np.arange(max(samples, 2 * (coefficients + 1))) + 0.5
    z = 1 - 2 * i / len(i)
    turn = i * math.pi * (3 - math.sqrt(5))
    ring = np.sqrt(np.maximum(1 - z * z, 0))
    return np.column_stack([np.ones(len(i)), *basis(degree_of(coefficients), ring * np.cos(turn), ring * np.sin(turn), z)[1:]])


def greatest_logit(opacity: Column, coefficients: Column, n: int) -> Column:
    """No direction sees a larger logit of opacity than this.

    By the addition theorem the part of one degree is at most the length of its coefficients times sqrt((2 l + 1) / 4 pi).
    """
    out = opacity
    for degree in range(1, degree_of(n) + 1):
        own = F.slice(coefficients, degree * degree, 2 * degree + 1)
        length = F.sqrt(F.aggregate(own, F.lit(0.0), lambda s, c: s + c * c))
        out = out + length * math.sqrt((2 * degree + 1) / (4 * math.pi))
    return out


def invisible_giant(scales: list[Column], opacity: Column, coefficients: Column, n: int, most_scale: float, least_opacity: float) -> Column:
    """Whether a splat (log scales, logit of opacity) is larger than a scale and fainter than an opacity from everywhere."""
    faint = greatest_logit(opacity, coefficients, n) < math.log(least_opacity / (1 - least_opacity))
    return (F.greatest(*scales) > math.log(most_scale)) & faint
