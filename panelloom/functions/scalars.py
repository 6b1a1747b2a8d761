"""Column expressions shared by all operators; everything stays on the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SQRT_YEAR = 252.0**0.5


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_ticker(c) -> Column:
    """Trimmed upper-case symbol with share-class dots written as dashes."""
    return F.translate(F.upper(F.trim(col(c))), ".", "-")


def finite(c) -> Column:
    """NULL for NaN and infinities, so that NULL is the only missing marker."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def slug(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def month_start(c) -> Column:
    return F.trunc(col(c), "MM")


def week_ending_friday(c) -> Column:
    return F.next_day(F.date_sub(col(c), 1), "FRI")


def compound(c) -> Column:
    """Compounded simple return of a group; missing values are skipped."""
    return F.coalesce(F.product(1 + col(c)), F.lit(1.0)) - 1


def is_close(a, b, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    a, b = col(a), col(b)
    near = F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
    return F.when(a.isNull() & b.isNull(), F.lit(True)).otherwise(F.coalesce(near, F.lit(False)))


def safe_div(a, b) -> Column:
    """a / b, NULL when the divisor is zero or missing."""
    b = col(b)
    return F.when(b != 0, col(a) / b)


def safe_corr(a, b) -> Column:
    """Correlation aggregate over complete pairs; NULL (not an error) without variation."""
    a, b = col(a), col(b)
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(x) * F.stddev_pop(y))


def clip(c, low: float, high: float) -> Column:
    return F.greatest(F.least(col(c), F.lit(high)), F.lit(low))


def dot(a, b) -> Column:
    """Inner product of two array<double> columns of equal length."""
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def all_present(c) -> Column:
    """True when no element of the array is NULL."""
    return F.forall(col(c), lambda x: x.isNotNull())


# Coefficients of Hart's rational approximation to the normal tail,
# as published by West (2005), "Better approximations to cumulative normal functions".
NORMAL_TAIL_TOP = (
    0.0352624965998911,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
NORMAL_TAIL_BOTTOM = (
    0.0883883476483184,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
NORMAL_SPLIT = 7.07106781186547
SQRT_TWO_PI = 2.506628274631
NORMAL_975 = 1.959963984540054


def normal_cdf(c) -> Column:
    """Standard normal distribution function, accurate to about 1e-15."""
    x = col(c)
    z = F.abs(x)
    top = reduce(lambda acc, k: acc * z + F.lit(k), NORMAL_TAIL_TOP, F.lit(0.0))
    bottom = reduce(lambda acc, k: acc * z + F.lit(k), NORMAL_TAIL_BOTTOM, F.lit(0.0))
    far = z
    for k in (0.65, 4.0, 3.0, 2.0, 1.0):
        far = z + F.lit(k) / far if k != 0.65 else z + F.lit(k)
    bell = F.exp(-z * z / 2)
    tail = (
        F.when(z > 37, F.lit(0.0))
        .when(z < NORMAL_SPLIT, bell * top / bottom)
        .otherwise(bell / far / F.lit(SQRT_TWO_PI))
    )
    return F.when(x > 0, 1 - tail).otherwise(tail)


def two_sided_p(t) -> Column:
    return 2 * (1 - normal_cdf(F.abs(col(t))))
