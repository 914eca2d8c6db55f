"""Helpers that the operators of this package share."""

import zlib

import pyarrow as pa
from pyspark.sql import functions as F


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id, n):
    """crc32 of the id as text, modulo ``n``; NULL where the id is NULL."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def held_out(doc_id, n, value):
    """Whether a row belongs to the held-out fold; a row without id never does."""
    return F.coalesce(remainder(doc_id, n) == value, F.lit(False))


def fresh(columns, base):
    """A column name that no column of the input has, whatever its case."""
    taken = {c.lower() for c in columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def sample(df, max_rows):
    """At most ``max_rows`` rows of (doc_id, ...) on the driver, by a hash of the id.

    The one thing that reaches the driver: a bounded training sample. Ids are picked
    first, so that no texts but the sample's move; of rows with one id the least stays.
    """
    ids = df.select("doc_id").where("doc_id is not null").withColumn("_h", F.xxhash64(F.col("doc_id"), F.lit(17)))
    return fetched(df, ids.orderBy("_h", "doc_id").limit(max_rows).select("doc_id").distinct())


def fetched(df, pick):
    """Rows of the picked ids, one per id, in an order that only depends on the ids."""
    rows = df.join(F.broadcast(pick), "doc_id")
    rest = F.struct(*[c for c in rows.columns if c != "doc_id"])
    rows = rows.groupBy("doc_id").agg(F.min(rest).alias("_r")).select("doc_id", "_r.*")
    return sorted(rows.toArrow().to_pylist(), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))


def labelled(docs, labels, label, max_rows, max_chars):
    """Training rows (doc_id, text, y) outside the held-out fold.

    A document with several labels takes the largest; rows whose id or label is NULL and
    texts over ``max_chars`` characters stay out of the sample (never out of scoring).
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    y = y.where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    y = y.where(remainder(F.col("doc_id"), 5) != 0)
    pick = y.withColumn("_h", F.xxhash64("doc_id", F.lit(17))).orderBy("_h", "doc_id").limit(max_rows).drop("_h")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return fetched(d.where(F.length("text") <= max_chars), pick)


def batches(iterator, max_bytes=16 << 20):
    """Cut Arrow batches so that a piece holds about ``max_bytes``, one row at least."""
    for b in iterator:
        step = max(1, b.num_rows * max_bytes // max(b.nbytes, 1)) if b.nbytes > max_bytes else max(1, b.num_rows)
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
    pa.default_memory_pool().release_unused()


def small_batches(spark, rows=1000):
    """Hand rows with texts to Python in Arrow batches of at most ``rows`` from now on.

    A session setting, as the job runs after the caller has returned; results do not depend on it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def record(schema, **columns):
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


class Adam:
    """Adam over a dict of numpy arrays."""

    def __init__(self, params, rate):
        import numpy as np
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads, rate=None):
        import numpy as np
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9 ** self.t), self.v[k] / (1 - 0.999 ** self.t)
            self.p[k] -= ((rate or self.rate) * m / (np.sqrt(v) + 1e-8)).astype(self.p[k].dtype)


def rewrite(docs, fn, max_bytes=8 << 20):
    """``docs`` with ``fn(texts) -> texts or None`` applied to column ``text``.

    A row whose result is None is dropped; all other columns pass through unchanged,
    but for ``n_chars``, which follows a changed text. NULL texts reach ``fn`` as "".
    """
    names = list(docs.columns)
    at = names.index("text")
    n_at = names.index("n_chars") if "n_chars" in names else None
    marker = object()

    def run(iterator):
        for b in batches(iterator, max_bytes):
            old = b.column(at).to_pylist()
            new = fn(["" if t is None else t for t in old], marker)
            keep = [i for i, t in enumerate(new) if t is not None]
            b = b.take(pa.array(keep, type=pa.int64()))
            columns = list(b.columns)
            if any(new[i] is not marker for i in keep):
                columns[at] = pa.array([old[i] if new[i] is marker else new[i] for i in keep], type=columns[at].type)
                if n_at is not None:
                    was = columns[n_at].to_pylist()
                    columns[n_at] = pa.array([was[j] if new[i] is marker else len(new[i]) for j, i in enumerate(keep)], type=columns[n_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
