"""Typed parquet readers. Filters and column lists reach the scan through Catalyst."""

from pyspark.sql import functions as F

SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def read_table(spark, base, name):
    """One table of a lake directory; declared schemas skip inference."""
    r = spark.read
    if name in SCHEMAS:
        r = r.schema(SCHEMAS[name])
    return r.parquet(f"{base.rstrip('/')}/{name}.parquet")


def normalise_quotes(df):
    """Older exports name the closing quotes ``yes_bid``/``yes_ask``; rename when absent."""
    for old, new in (("yes_bid", "yes_bid_close"), ("yes_ask", "yes_ask_close")):
        if new not in df.columns and old in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def first_existing(df, *names):
    """Column of the first candidate name that the frame has."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    raise KeyError(f"none of {names} in {df.columns}")
