"""Row predicates and value repair for observations and quotes."""

from pyspark.sql import functions as F

from .timeutil import col

# Missing-data sentinel and plausible range in degrees F.
SENTINEL = -77.9
LOW, HIGH = -50.0, 150.0


def valid_temp(x):
    x = col(x)
    return F.coalesce((F.abs(x - SENTINEL) >= 0.1) & x.between(LOW, HIGH), F.lit(False))


def unflagged(flag):
    """Rows whose quality flag is false or unknown."""
    return ~F.coalesce(col(flag), F.lit(False))


def fahrenheit(x):
    """Kelvin 200-350 is converted, -50..150 is taken as Fahrenheit, else NULL."""
    x = col(x)
    return (F.when(x.between(200, 350), F.bround((x - 273.15) * 9 / 5 + 32, 2))
            .when(x.between(LOW, HIGH), F.bround(x, 2)))


def clip(x, lo, hi):
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(x)))
