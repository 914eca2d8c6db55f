"""Column formulas built on earlier feature columns."""

from pyspark.sql import functions as F

from .timeutil import col


def _ln(x, cond):
    return F.when(cond, F.ln(x))


def engineered(c):
    """``c`` maps feature names to columns; results are NULL when an input is NULL."""
    gap, rate, err = c("obs_fcst_max_gap"), c("temp_rate_last_30min"), c("err_mean_sofar")
    std, rng, unc = c("temp_std_last_60min"), c("intraday_range_sofar"), c("expected_delta_uncertainty")
    mean, mstd, mrng = c("fcst_multi_mean"), c("fcst_multi_std"), c("fcst_multi_range")
    big = F.abs(mean) > 0.01
    return {
        "log_abs_obs_fcst_gap": F.ln(1 + F.abs(gap)),
        "log_temp_std_last_60min": _ln(0.1 + std, std >= 0),
        "log_intraday_range": _ln(1 + rng, rng >= 0),
        "log_expected_delta_uncertainty": _ln(unc, unc > 0),
        "temp_rate_last_30min_squared": rate * rate,
        "err_mean_sofar_squared": err * err,
        "obs_fcst_gap_squared": gap * gap,
        "fcst_multi_cv": F.when(big, mstd / F.abs(mean)),
        "fcst_multi_range_pct": F.when(big, mrng / F.abs(mean) * 100),
        "humidity_x_temp_rate": c("humidity_last_obs") * rate,
        "cloudcover_x_hour": c("cloudcover_last_obs") * c("hour"),
        "temp_ema_x_day_fraction": c("temp_ema_60min") * c("day_fraction"),
        "station_city_gap_x_fcst_gap": c("station_city_temp_gap") * gap,
    }


def interactions(c):
    mx, fmax, left = c("vc_max_f_sofar"), c("fcst_prev_max_f"), c("hours_to_event_close")
    since, sd = c("minutes_since_market_open"), c("fcst_prev_std_f")
    return {
        "temp_x_hours_remaining": mx * left,
        "gap_x_hours_remaining": c("obs_fcst_max_gap") * left,
        "temp_x_day_fraction": mx * c("day_fraction"),
        "fcst_obs_ratio": F.when(mx > 0, fmax / mx),
        "log_minutes_since_open": _ln(since.cast("double"), since > 0),
        "log_hours_to_close": _ln(left, left > 0),
        "temp_zscore_vs_forecast": F.when(sd > 0, (mx - c("fcst_prev_mean_f")) / sd),
    }


def derived_forecast(fmax, mx, fhour, hour):
    f, m = col(fmax), col(mx)
    return {"obs_fcst_max_gap": f - m, "above_fcst_flag": (m > f).cast("int"),
            "hours_until_fcst_max": F.when(col(fhour).isNotNull(), F.greatest(F.lit(0), col(fhour) - col(hour)))}


def regime(rate, since_max, hour):
    """Phase by 30-minute rate beyond 0.5 F/h, then recency of the maximum, then hour."""
    r, s, h = col(rate), col(since_max), col(hour)
    by_hour = F.when(h < 11, "heating").when(h <= 15, "plateau").when(h.isNotNull(), "cooling")
    by_max = F.when(s < 30, "plateau").when(s.isNotNull(), "cooling")
    phase = (F.when(r > 0.5, "heating").when(r < -0.5, "cooling")
             .when(r.isNotNull(), F.coalesce(by_max, by_hour)).otherwise(by_hour))
    known = r.isNotNull() | h.isNotNull()
    return {f"is_{p}_phase": F.when(known, F.coalesce(phase == p, F.lit(False)).cast("int"))
            for p in ("heating", "plateau", "cooling")}


def time_confidence(hours_open, is_event_day, mx, fmax):
    h = col(hours_open)
    conf = F.when(col(is_event_day) == 1, F.least(F.lit(1.0), F.greatest(F.lit(0.0), h - 24) / 10)).otherwise(
        F.least(F.lit(0.8), h / 30))
    w = 1.0 - conf
    gap = col(fmax) - col(mx)
    return {"obs_confidence": conf, "expected_delta_uncertainty": F.greatest(F.lit(2.0), 8.0 - h * 0.2),
            "fcst_importance_weight": w, "confidence_weighted_gap": gap * w,
            "remaining_upside": F.when(gap.isNotNull(), F.greatest(F.lit(0.0), gap)) * w}


def guidance(latest, previous, mean, std):
    """Revision, drift and z-score of guidance highs (rounded half-even)."""
    a, b, m, s = col(latest), col(previous), col(mean), col(std)
    return {"revision": F.bround(a - b, 2), "drift": F.bround(b - a, 2),
            "z": F.when(s >= 0.01, F.bround((a - m) / s, 3))}


# The settlement rules by name, in evaluation order.
RULES = ["max_round", "max_of_rounded", "ceil_max", "floor_max", "plateau_20min", "ignore_singletons", "c_first"]


def via_celsius(f):
    """Round in Celsius first, then convert back and round."""
    return F.bround(F.bround((col(f) - 32.0) * 5.0 / 9.0, 0) * 9.0 / 5.0 + 32.0, 0).cast("long")


def rule_disagreement(preds, truth=None):
    """Range, distinct count, disagreement flag and errors of rule predictions."""
    a = F.array(*[F.col(p).cast("long") for p in preds])
    a = F.filter(a, lambda x: x.isNotNull())
    out = {"range_pred": F.array_max(a) - F.array_min(a), "n_distinct": F.size(F.array_distinct(a)),
           "disagree": (F.size(F.array_distinct(a)) > 1).cast("int"),
           "agreement": F.greatest(F.lit(0.0), 1.0 - (F.array_max(a) - F.array_min(a)) / 3)}
    if truth is not None:
        out.update({f"err_{p}": F.col(p) - col(truth) for p in preds})
    return out


def consensus(preds):
    """Most common prediction; among equals the one seen first."""
    a = F.array(*[F.col(p).cast("long") for p in preds])
    n = lambda v: F.size(F.filter(a, lambda x: x == v))
    ranked = F.transform(a, lambda v, i: F.struct(n(v).alias("n"), (-i).alias("i"), v.alias("v")))
    return F.array_max(F.filter(ranked, lambda s: s["v"].isNotNull()))["v"]
