"""Meteorological formulas."""

from pyspark.sql import functions as F

from .timeutil import col


def wet_bulb(temp_f, rh):
    """Stull's approximation, for relative humidity 0-100; fixed coefficients."""
    f, rh = col(temp_f), col(rh)
    c = (f - 32) * 5 / 9
    tw = (c * F.atan(0.151977 * F.sqrt(rh + 8.313659)) + F.atan(c + rh) - F.atan(rh - 1.676331)
          + 0.00391838 * F.pow(rh, 1.5) * F.atan(0.023101 * rh) - 4.686035)
    return F.when(rh.between(0, 100), tw * 9 / 5 + 32)


def wind_chill(temp_f, mph):
    """Weather-service wind chill; the air temperature above 50 F or below 3 mph."""
    f, w = col(temp_f), col(mph)
    p = F.pow(w, 0.16)
    return F.when((f > 50) | (w < 3), f).otherwise(35.74 + 0.6215 * f - 35.75 * p + 0.4275 * f * p)


def cloud_regime(x):
    x = col(x)
    return F.when(x < 20, 0).when(x < 70, 1).when(x.isNotNull(), 2)


def cloud_bins(x):
    """(-1,20], (20,70], (70,101] as clear, partly, overcast."""
    x = col(x)
    return (F.when((x > -1) & (x <= 20), "clear").when((x > 20) & (x <= 70), "partly")
            .when((x > 70) & (x <= 101), "overcast"))
