"""Registry of queries: a Spark plan and, where SQL can say it, an oracle.

A query declares its result columns once, as ``"city s, n i, x f"``; both the
Spark result and the oracle are projected through that list so that names and
types agree (s text, i integer, f double at six places (ties nudged up so that last-bit noise cannot split them),
h double at three places, d date text,
t timestamp text, u microseconds shown as timestamp text).
"""

import re

from pyspark.sql import functions as F

from ..functions.timeutil import from_us
from ..plans.tables import Tables
from .oracle_views import VIEWS

QUERIES = {}
ORACLE = {}
RAW_SQL = {}


def _columns(spec):
    return [tuple(c.split()) for c in spec.split(",")]


def _nudged(c, scale):
    """Nearest place, ties up; beyond whole numbers (NaN and infinity too) floor changes nothing, while Spark's would end at a long."""
    y = c.cast("double") * scale + 0.5001
    return F.when(F.abs(y) < float(1 << 53), F.floor(y)).otherwise(y) / F.lit(scale)


def _spark_project(df, cols):
    out = []
    for name, k in cols:
        c = F.col(name)
        if k == "i":
            c = c.cast("long")
        elif k == "f":
            c = _nudged(c, 1e6)
        elif k == "h":
            c = _nudged(c, 1e3)
        elif k == "d":
            c = F.date_format(c, "yyyy-MM-dd")
        elif k == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif k == "u":
            c = F.date_format(from_us(c), "yyyy-MM-dd HH:mm:ss")
        else:
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def _sql_project(sql, cols):
    f = {
        "i": "CAST({0} AS BIGINT)", "f": "floor(CAST({0} AS DOUBLE) * 1e6 + 0.5001e0) / 1e6 + 0.0e0",
        "h": "floor(CAST({0} AS DOUBLE) * 1e3 + 0.5001e0) / 1e3 + 0.0e0",
        "d": "strftime({0}, '%Y-%m-%d')", "t": "strftime({0}, '%Y-%m-%d %H:%M:%S')",
        "u": "strftime(make_timestamp({0}), '%Y-%m-%d %H:%M:%S')", "s": "CAST({0} AS VARCHAR)",
    }
    sel = ", ".join(f[k].format(n) + f" AS {n}" for n, k in cols)
    need, todo = [], [sql]
    while todo:
        for v in re.findall(r"\bv_[a-z0-9_]+\b", todo.pop()):
            if v in VIEWS and v not in need:
                need.append(v)
                todo.append(VIEWS[v])
    ctes = [f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in need]
    head = "WITH " + ",\n".join(ctes) + "\n" if ctes else ""
    return f"{head}SELECT {sel} FROM (\n{sql.strip()}\n)"


def query(name, spec, sql=None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""
    cols = _columns(spec)

    def wrap(fn):
        def run(spark, sf_dir):
            return _spark_project(fn(Tables(spark, sf_dir)), cols)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql:
            RAW_SQL[name] = sql
            ORACLE[name] = _sql_project(sql, cols)
        return fn

    return wrap
