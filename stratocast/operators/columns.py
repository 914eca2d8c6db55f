"""Column-set completion."""

from pyspark.sql import functions as F


def complete(df, wanted, zero=(), flag=None):
    """Add missing columns as typed NULLs, zero-fill groups, flag what was present."""
    have = set(df.columns)
    df = df.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in have})
    if flag:
        df = df.withColumns({f: F.col(c).isNotNull().cast("int") for f, c in flag.items()})
    return df.fillna(0, subset=list(zero)) if zero else df
