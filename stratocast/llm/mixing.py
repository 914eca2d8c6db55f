"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Every source gets a mean repetition rate: target weight x mixture size / rows of the
source. A document's number of copies is a Poisson variate of that rate, found by
inverting the distribution at a uniform number hashed from seed, part and doc_id, so
it is the same on every run, partitioning and retry. The document is exploded by that
number and the copies are dealt to partitions and ordered there by a second hash,
which is a global random order without a sampling pass.

Defined cases: a NULL source is a source of its own (its weight is given under NULL);
a NULL doc_id hashes as ``null`` and the md5 of its text; repeated rows of one doc_id get
equal counts; a source without a positive weight contributes nothing; NULL and empty texts
are rows like any other; an empty table gives an empty table; further columns pass
through and helper columns take names that the input does not use.
"""

from pyspark.sql import functions as F

from ..session import written
from .common import fresh

#: Rates above this are split into equal parts whose Poisson variates add up, so that
#: exp(-rate) never underflows and the cumulative table keeps a fixed length.
PART_RATE = 16.0
#: Sources up to which their table (under a kilobyte a row) is broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 10_000
#: Entries of the cumulative table; the tail beyond them is below 1e-30 at PART_RATE.
TERMS = 96


def uniform(seed, *parts):
    """A number in [0, 1) with 52 random bits from an md5 of the parts, as text."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_mix(docs, weights=None, size=None, seed=42, source="source", doc_id="doc_id", partitions=None):
    """``docs`` with every row repeated a Poisson number of times, in random order.

    ``weights``: DataFrame (source, weight), None for equal weights; ``size``: expected
    number of rows of the mixture (None: as many as ``docs``). Adds ``copy`` (from 1),
    ``rate`` and ``shuffle_key``; names that clash get an underscore.
    """
    rates, parts, cdf, key, copies = (fresh(docs.columns, c) for c in ("_rate", "_parts", "_cdf", "_src", "_copies"))
    rows = docs.groupBy(F.col(source).alias(key)).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        here = rows.withColumn("weight", F.lit(1.0))
    else:
        w = weights.select(F.col("source").alias("s"), F.col("weight").cast("double").alias("w")).where("w > 0 and w < double('infinity')")
        w = w.groupBy("s").agg(F.sum("w").alias("weight"))
        here = rows.join(w, F.col(key).eqNullSafe(F.col("s")), "left").drop("s")
    here = written(here, "mixing-sources")
    n_sources, n_rows, total = here.agg(F.count(F.lit(1)), F.sum("n"), F.sum("weight")).first()
    size = float(n_rows or 0) if size is None else float(size)
    table = here.where("weight is not null").withColumn(rates, F.col("weight") / F.lit(total or 1.0) * size / F.col("n"))
    table = table.withColumn(parts, F.greatest(F.lit(1), F.ceil(F.col(rates) / PART_RATE)).cast("int"))
    rate = F.col(rates) / F.col(parts)
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c")),
        lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * rate / k)).alias("c")),
    )
    table = table.select(F.col(key), F.col(rates), F.col(parts), terms["c"].alias(cdf))
    table = F.broadcast(table) if n_sources <= BROADCAST_SOURCES else table
    joined = docs.join(table, F.col(source).eqNullSafe(F.col(key)), "inner")

    text = F.col("text").cast("string") if "text" in docs.columns else F.lit("")
    identity = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))

    def drawn(part):
        u = uniform(seed, part, identity)
        return F.size(F.filter(F.col(cdf), lambda c: c <= u))  # the smallest k with u < CDF(k)

    n = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda acc, i: acc + drawn(i))
    copy, out_rate, order = (fresh(docs.columns, c) for c in ("copy", "rate", "shuffle_key"))
    out = joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(rates).alias(out_rate), F.posexplode(F.array_repeat(F.lit(0), n)).alias(copy, copies))
    out = out.withColumn(copy, F.col(copy) + 1).drop(copies)
    out = out.withColumn(order, F.md5(F.concat_ws(":", F.lit(f"order{seed}"), identity, F.col(copy).cast("string")).cast("binary")))
    dealt = out.repartition(F.col(order)) if partitions is None else out.repartition(partitions, F.col(order))
    return dealt.sortWithinPartitions(order)


ORACLE = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT source, 1.0 / (SELECT count(*) FROM n) * (SELECT sum(n) FROM n)::DOUBLE / n::DOUBLE AS rate FROM n),
s AS (SELECT source, rate, greatest(1, ceil(rate / 16.0)::INT) AS parts FROM t),
p AS (SELECT source, rate, parts, unnest(range(0, 97)) AS k FROM s),
q AS (SELECT source, k, exp(sum(CASE WHEN k = 0 THEN -rate / parts ELSE ln(rate / parts) - ln(k::DOUBLE) END) OVER (PARTITION BY source ORDER BY k)) AS pk FROM p),
c AS (SELECT source, k, sum(pk) OVER (PARTITION BY source ORDER BY k) AS cdf FROM q),
d AS (SELECT doc_id, d.source, i, ('0x' || substr(md5('42:' || i || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS u
      FROM documents d JOIN s ON d.source IS NOT DISTINCT FROM s.source, unnest(range(1, s.parts + 1)) AS x(i)),
m AS (SELECT doc_id, count(*) AS copies FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND c.cdf <= d.u GROUP BY doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, j.copy AS copy, md5('order42:' || d.doc_id || ':' || j.copy) AS shuffle_key
FROM documents d JOIN m ON d.doc_id = m.doc_id, unnest(range(1, m.copies + 1)) AS j(copy)
"""
