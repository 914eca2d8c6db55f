"""Keyed merges of batches, as joins and hash aggregates over whole tables."""

from pyspark.sql import functions as F

from ..functions.timeutil import col


def latest(df, keys, version, *more):
    """Newest row per key. ``max_by`` combines map-side, so a key that holds a
    large share of all rows still reaches the reducer as one row per task."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(col(version), *[col(m) for m in more]))
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert_latest(base, updates, keys, version, *more):
    return latest(base.unionByName(updates, allowMissingColumns=True), keys, version, *more)


def upsert_precedence(base, updates, keys, value, source, final="cli"):
    """Full outer merge in which a preliminary source never replaces a final one."""
    u = updates.select(*keys, F.col(value).alias("_nv"), F.col(source).alias("_ns"))
    j = base.join(u, keys, "full")
    keep = (F.col(source) == final) & (F.col("_ns") != final) | F.col("_ns").isNull()
    keep = F.coalesce(keep, F.lit(False))
    return j.select(*keys, F.when(keep, F.col(value)).otherwise(F.col("_nv")).alias(value),
                    F.when(keep, F.col(source)).otherwise(F.col("_ns")).alias(source))


def append_if_absent(base, new, keys):
    return base.unionByName(new.join(base.select(*keys), keys, "left_anti"))


def incremental_append(existing, rebuilt, day):
    """Keep existing days, add only missing ones; differing columns force a rebuild."""
    if set(existing.columns) != set(rebuilt.columns):
        return rebuilt
    have = existing.select(day).distinct()
    return existing.unionByName(rebuilt.join(have, day, "left_anti"))


def replace_range(base, rebuilt, keys, pos):
    """Drop each key's rebuilt span from the base, then add the rebuilt rows."""
    span = rebuilt.groupBy(*keys).agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    kept = base.join(span, keys, "left").filter(
        F.col("_lo").isNull() | (F.col(pos) < F.col("_lo")) | (F.col(pos) > F.col("_hi")))
    return kept.select(*base.columns).unionByName(rebuilt.select(*base.columns))
