"""Normal distribution, histogram binning and colour maps as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import div

# The published AS241 (PPND16) coefficients, highest degree first.
AS241_CENTRAL_NUM = (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
                     13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608)
AS241_CENTRAL_DEN = (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
                     5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0)
AS241_MIDDLE_NUM = (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177,
                    1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055,
                    4.6303378461565452959, 1.42343711074968357734)
AS241_MIDDLE_DEN = (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966,
                    0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494,
                    2.05319162663775882187, 1.0)
AS241_TAIL_NUM = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386,
                  0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358,
                  5.4637849111641143699, 6.6579046435011037772)
AS241_TAIL_DEN = (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5,
                  7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531,
                  0.59983220655588793769, 1.0)

# Abramowitz & Stegun 7.1.26, highest degree first, then the argument scale.
ERF_7126 = (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592, 0.0)
ERF_7126_P = 0.3275911

# The ten-term Chebyshev-fitted erfc (about 1.2e-7 relative), highest degree first.
ERFC_CHEB = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806,
             0.09678418, 0.37409196, 1.00002368, -1.26551223)

# Categorical palette, the grey of negative keys, and the scalar ramp.
PALETTE = ((77, 121, 168), (242, 142, 44), (225, 87, 89), (118, 183, 178), (89, 161, 79), (237, 201, 73),
           (176, 122, 161), (255, 157, 167), (156, 117, 95), (186, 176, 172), (78, 121, 110), (212, 166, 106))
GREY = (128, 128, 128)
RAMP = ((68, 1, 84), (59, 82, 139), (33, 145, 140), (94, 201, 98), (253, 231, 37))


def horner(x, coefficients):
    acc = coefficients[0]
    for c in coefficients[1:]:
        acc = x * acc + c
    return acc


def inverse_normal_cdf(p: Column) -> Column:
    """Standard normal quantile; infinite at 0 and 1, NaN outside [0, 1]."""
    q = p - 0.5
    r0 = F.lit(0.180625) - q * q
    central = q * horner(r0, AS241_CENTRAL_NUM) / horner(r0, AS241_CENTRAL_DEN)
    tail = F.sqrt(-F.ln(F.greatest(F.when(q < 0, p).otherwise(1.0 - p), F.lit(5e-324))))
    r1, r2 = tail - 1.6, tail - 5.0
    far = F.when(tail <= 5.0, horner(r1, AS241_MIDDLE_NUM) / horner(r1, AS241_MIDDLE_DEN)).otherwise(
        horner(r2, AS241_TAIL_NUM) / horner(r2, AS241_TAIL_DEN))
    return (F.when((p < 0) | (p > 1) | F.isnan(p), F.lit(float("nan")))
            .when(p == 0, F.lit(float("-inf"))).when(p == 1, F.lit(float("inf")))
            .when(F.abs(q) <= 0.425, central).when(q < 0, -far).otherwise(far))


def erf_poly(x: Column) -> Column:
    ax = F.abs(x)
    t = 1.0 / (ax * ERF_7126_P + 1.0)
    y = 1.0 - horner(t, ERF_7126) * F.exp(-ax * ax)
    return F.when(x < 0, -y).otherwise(y)


def normal_cdf_poly(x: Column) -> Column:
    """Normal CDF used when rebalancing a population."""
    return (erf_poly(x / math.sqrt(2.0)) + 1.0) * 0.5


def erfc_cheb(x: Column) -> Column:
    ax = F.abs(x)
    t = 1.0 / (ax * 0.5 + 1.0)
    y = t * F.exp(-ax * ax + horner(t, ERFC_CHEB))
    return F.when(x < 0, 2.0 - y).otherwise(y)


def normal_cdf_cheb(x: Column) -> Column:
    """Normal CDF used for size-class shares."""
    return erfc_cheb(-x / math.sqrt(2.0)) * 0.5


def bin_index(value: Column, lo: Column, hi: Column, bins) -> Column:
    """Equal-width bin of a value on [lo, hi]; the last bin is closed."""
    width = (hi - lo) / bins
    raw = F.coalesce(F.floor(div(value - lo, width)), F.lit(0))
    return F.greatest(F.least(raw, F.lit(bins) - 1), F.lit(0)).cast("int")


def categorical_color(key: Column) -> Column:
    """[r, g, b] from the palette by key modulo its length; grey for negative keys."""
    table = F.array(*(F.array(*(F.lit(c) for c in rgb)) for rgb in PALETTE))
    return F.when(key < 0, F.array(*(F.lit(c) for c in GREY))).otherwise(
        F.element_at(table, (F.pmod(key, F.lit(len(PALETTE))) + 1).cast("int")))


def scalar_color(value: Column, lo: Column, hi: Column) -> Column:
    """[r, g, b] by linear interpolation between ramp stops."""
    t = F.when(hi > lo, F.greatest(F.lit(0.0), F.least(F.lit(1.0), div(value - lo, hi - lo)))).otherwise(F.lit(0.0))
    x = t * float(len(RAMP) - 1)
    i = F.least(F.floor(x), F.lit(len(RAMP) - 2)).cast("int")

    def channel(k: int) -> Column:
        stops = F.array(*(F.lit(float(s[k])) for s in RAMP))
        a, b = F.element_at(stops, i + 1), F.element_at(stops, i + 2)
        return F.round(a + (b - a) * (x - i)).cast("int")

    return F.array(channel(0), channel(1), channel(2))
