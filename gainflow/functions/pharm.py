"""Closed-form pharmacology as column expressions; NULL means "not modelled" and stays NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Gains never fall below the floor; a specification's gains stay under the ceiling.
FLOOR, CEILING = 0.05, 10.0
#: Half-constant of the saturating shape, scales of the coefficient ensemble, and the shapes.
SATURATING_K = 0.25
COEFFICIENTS = (0.5, 0.75, 1.0, 1.25, 1.5)
SHAPES = ("linear", "saturating", "weak_biphasic", "default_biphasic", "strong_biphasic")


def hill(c: Column, half: Column, n: Column) -> Column:
    """C^n / (v^n + C^n); 0 at no dose, NULL without a value; a negative dose or a value not above 0 is an error."""
    bad = (c < 0) | (half <= 0)
    value = F.when(c == 0, F.lit(0.0)).otherwise(F.pow(c, n) / (F.pow(half, n) + F.pow(c, n)))
    return F.when(half.isNull() | c.isNull(), F.lit(None).cast("double")).when(bad, F.raise_error(F.lit("dose below 0 or value not above 0")).cast("double")).otherwise(value)


def inverse_hill(effect: Column, half: Column, n: Column) -> Column:
    return half * F.pow(effect / (1 - effect), 1 / n)


def competitive(c: Column, kd: Column, rival: Column, rival_kd: Column, n: Column) -> Column:
    """Occupancy under competition: the apparent constant grows by the rival's dose ratio."""
    return hill(c, kd * (1 + rival / rival_kd), n)


def schild_shift(rival: Column, kb: Column) -> Column:
    return 1 + rival / kb


def operational(c: Column, ka: Column, tau: Column, n: Column) -> Column:
    top = F.pow(tau * c, n)
    return F.when(tau <= 0, F.lit(0.0)).otherwise(top / (F.pow(c + ka, n) + top))


def hill4(x: Column, top: Column, bottom: Column, ic50: Column, slope: Column) -> Column:
    """Four-parameter logistic in log10 dose, its exponent held within 60."""
    e = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), slope * (F.log10(x) - F.log10(ic50))))
    return bottom + (top - bottom) / (1 + F.pow(F.lit(10.0), e))


def bateman(t: Column, c0: Column, ka: Column, ke: Column) -> Column:
    """Absorption and elimination; where the rates meet, their common limit."""
    return F.when(F.abs(ka - ke) < 1e-9, c0 * ka * t * F.exp(-ke * t)).otherwise(c0 * ka / (ka - ke) * (F.exp(-ke * t) - F.exp(-ka * t)))


def bliss(effects: Column) -> Column:
    """1 - product of (1 - effect) over an array."""
    return 1 - F.aggregate(effects, F.lit(1.0), lambda a, x: a * (1 - x))


def biphasic(t: Column) -> Column:
    return 1 + 0.4 * t - 1.6 * t * t


def shaped(shape: Column, t: Column, sign: Column, a: Column, b: Column, coef: Column) -> Column:
    """Gain under one of SHAPES, held between FLOOR and CEILING; monotone rules take a as their quadratic reference."""
    aa, bb = a * coef, b * coef
    ref = F.when(b > 0, b).otherwise(a) * coef
    line = 1 + sign * aa * t
    g = (
        F.when(shape == "linear", line)
        .when(shape == "saturating", 1 + sign * aa * (1 + SATURATING_K) * t / (SATURATING_K + t))
        .when(shape == "weak_biphasic", line - 0.5 * ref * t * t)
        .when(shape == "default_biphasic", line - bb * t * t)
        .otherwise(line - 2 * ref * t * t)
    )
    return F.greatest(F.lit(FLOOR), F.least(F.lit(CEILING), g))


def generic_multiplier(theta: Column, direction: Column, directed: bool = True) -> Column:
    """One number for all of a network in place of its pharmacology: 1 + theta where the net drive rises, else 1 - theta above the floor; 1 without theta."""
    down = F.greatest(F.lit(FLOOR), 1 - theta)
    return F.when(theta.isNull(), F.lit(1.0)).otherwise(F.when(direction > 0, 1 + theta).otherwise(down) if directed else down)


def is_placeholder(value: Column, param_type: Column, tier: Column) -> Column:
    """A row that stands for missing evidence: no value, no known type, or a tier that says so."""
    return value.isNull() | F.coalesce(param_type == "unknown", F.lit(True)) | F.coalesce(tier == "class_placeholder", F.lit(False))


def is_estimate(value: Column, direction: Column, tier: Column) -> Column:
    """A row whose value may move: there is one, it acts in some direction, and its tier isn't a placeholder's."""
    return value.isNotNull() & F.coalesce(direction != "none", F.lit(False)) & ~F.coalesce(tier == "class_placeholder", F.lit(False))


def log_gamma(x: Column) -> Column:
    """Of a number of 1 or more: Stirling's series eight further on, less the logarithms of the steps."""
    z = x + 8
    inner = 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    steps = sum((F.ln(x + i) for i in range(1, 8)), F.ln(x))
    return (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + inner - steps
