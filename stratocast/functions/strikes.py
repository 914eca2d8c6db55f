"""Ticker text, bracket labels and strike membership."""

from pyspark.sql import functions as F

from .timeutil import col


def parse_ticker(ticker, cities=None):
    """``SERIES-YYMMMDD-STRIKE`` to a struct of series, event_date, type, floor, cap.

    A ``B`` strike with decimals is 2 wide, without 4; ``T..LO`` is the low
    tail, ``T..`` the high tail.
    """
    t = col(ticker)
    part = F.split(t, "-", 3)
    series, d, k = part[0], part[1], part[2]
    num = lambda pat: F.nullif(F.regexp_extract(k, pat, 1), F.lit("")).cast("double")
    # to_date's pattern letters are case sensitive, so bring JAN to Jan first.
    day = F.to_date(F.try_to_timestamp(
        F.concat(F.substring(d, 1, 2), F.initcap(F.substring(d, 3, 3)), F.substring(d, 6, 2)), F.lit("yyMMMdd")))
    b = num(r"B(-?\d+(?:\.\d+)?)")
    kind = (F.when(k.startswith("B"), "between").when(k.endswith("LO"), "less")
            .when(k.startswith("T"), "greater"))
    floor = F.when(kind == "between", b).when(kind == "greater", num(r"T(-?\d+(?:\.\d+)?)"))
    cap = (F.when(kind == "between", b + F.when(k.contains("."), 2.0).otherwise(4.0))
           .when(kind == "less", num(r"T(-?\d+(?:\.\d+)?)LO")))
    return F.struct(series.alias("series"), day.alias("event_date"), kind.alias("strike_type"),
                    floor.alias("floor_s"), cap.alias("cap_s"))


def event_key(ticker):
    return F.substring_index(col(ticker), "-", 2)


def bracket_label(kind, floor, cap):
    n = lambda c: F.col(c).cast("long").cast("string")
    return (F.when(col(kind) == "less", F.concat(F.lit("<"), n(cap)))
            .when(col(kind) == "greater", F.concat(F.lit(">"), n(floor)))
            .otherwise(F.concat(n(floor), F.lit("-"), n(cap))))


def label_bounds(label):
    """(floor, cap) of ``<n``, ``>n`` or ``a-b``."""
    s = col(label)
    rest = F.substring(s, 2, 40).try_cast("double")
    floor = F.when(s.startswith("<"), None).when(s.startswith(">"), rest).otherwise(
        F.split(s, "-")[0].try_cast("double"))
    cap = F.when(s.startswith(">"), None).when(s.startswith("<"), rest).otherwise(
        F.get(F.split(s, "-"), 1).try_cast("double"))
    return floor, cap


def contains(kind, floor, cap, x, mode="integer"):
    """Does a bracket hold a value?

    integer    less <= cap, greater >= floor+1, between inclusive
    real       less < cap, less_or_equal <= cap, greater > floor,
               greater_or_equal >= floor, between inclusive
    half_open  floor <= x < cap with open tails
    left_open  floor < x <= cap, ranges only
    """
    k, lo, hi, x = col(kind), col(floor), col(cap), col(x)
    between = (k == "between") & x.between(lo, hi)
    if mode == "integer":
        return F.coalesce(between | ((k == "less") & (x <= hi)) | ((k == "greater") & (x >= lo + 1)), F.lit(False))
    if mode == "real":
        return F.coalesce(between, F.lit(False)) | F.coalesce(
            (k == "less") & (x < hi), F.lit(False)) | F.coalesce(
            (k == "less_or_equal") & (x <= hi), F.lit(False)) | F.coalesce(
            (k == "greater") & hi.isNull() & (x > lo), F.lit(False)) | F.coalesce(
            (k == "greater_or_equal") & (x >= lo), F.lit(False))
    if mode == "half_open":
        return F.coalesce(x >= lo, lo.isNull() & hi.isNotNull()) & F.coalesce(x < hi, F.lit(True))
    return F.coalesce((k == "between") & (x > lo) & (x <= hi), F.lit(False))


def type_priority(kind):
    """between, then low tails, then high tails."""
    k = col(kind)
    return (F.when(k == "between", 0).when(k.startswith("less"), 1).otherwise(2))
