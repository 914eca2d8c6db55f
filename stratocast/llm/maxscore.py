"""Exact top-k inner products by MaxScore over sharded, signed postings.

Components are integers, floor(64 x). A shard holds some thousand vectors; for each
dimension it has two posting lists, of the positive and of the negative values, each with
its largest magnitude as bound. A query meets, per
dimension, the list whose sign agrees with its own value: only those entries raise a
score, so their bounds add up to an upper bound. With the k-th best score so far as
threshold, the lists are split into non-essential ones, whose bounds together stay below
it, and essential ones, which alone are traversed. A vector absent from all of them cannot
compete; those found are probed in the other lists, largest bound first, for as long as
they can still compete. Falling contributions are added last. A first pass over a bounded
sample of candidates seeds the thresholds; results of shards are merged by Spark.

Every row is a candidate and nothing is capped; the rows whose id is divisible by the
stride are the queries, in groups. Shards and groups are numbered by partition and meet in
one task per pair, so no key holds more than one shard and one group. Defined
cases: vectors that are NULL, empty or hold NULL or non-finite components take no part,
likewise rows with NULL ids; an id that occurs repeatedly counts once (the smallest
vector in array order); vectors of differing length are compared over the shared
components (missing ones are 0); fewer than k candidates give fewer rows; ties go to
the smaller id; an empty table gives an empty result.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

#: Rows of a shard and queries of a group, least and most; rows of a shard that are searched at once.
SHARD_ROWS, QUERY_ROWS = (4096, 65536), (512, 32768)
PART = 4096
#: Candidates of the first pass.
SEEDS = 2048

HITS = pa.schema([("query_id", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])


def integers(vectors, vec_id="vec_id", embedding="embedding", scale=64):
    """Valid vectors as (vec_id, v array<long>), one row per id."""
    x = F.col(embedding)
    ok = F.size(x) > 0
    ok = ok & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull() & x.isNotNull()).where(F.coalesce(ok, F.lit(False)))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def narrow(values):
    """The same integers in the fewest bytes."""
    for t in (np.int8, np.int16, np.int32):
        if not values.size or (values.min() >= np.iinfo(t).min and values.max() <= np.iinfo(t).max):
            return values.astype(t)
    return values


def matrix(ids, lists):
    """Rows of a list column as a matrix, missing components 0, ordered by id."""
    length = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(ids), int(length.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1])[None] < length[:, None]] = lists.flatten().to_numpy()
    order = np.argsort(ids)
    return ids[order], narrow(out[order])


def packed(rows, n, prefix):
    """Rows dealt to ``n`` partitions, each one row: number, dims, bytes per value, ids, values."""
    names = [prefix + c for c in ("", "_dims", "_width", "_ids", "_values")]
    schema = pa.schema(list(zip(names, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))))

    def run(iterator):
        held = list(iterator)
        if sum(b.num_rows for b in held):
            t = pa.Table.from_batches(held)
            ids, values = matrix(t.column(0).to_numpy(), t.column(1).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(
                (TaskContext.get().partitionId(), values.shape[1], values.itemsize, ids.tobytes(), values.tobytes()), schema)], schema=schema)

    kinds = ("int", "int", "int", "binary", "binary")
    return rows.repartition(n).mapInArrow(run, ", ".join(f"{c} {k}" for c, k in zip(names, kinds)))


def unpacked(dims, width, ids, values):
    ids = np.frombuffer(ids, dtype=np.int64)
    return ids, np.frombuffer(values, dtype=f"i{width}").reshape(len(ids), dims).astype(np.int64)


class Shard:
    """Postings of some thousand vectors.

    List 2d holds the positive, list 2d + 1 the negative values of dimension d as magnitudes
    along the rows (dense vectors fill half of a list; 0 is no entry), ``bound`` its largest.
    Sums are taken in the narrowest type that holds them exactly for queries of components
    up to ``largest``.
    """

    def __init__(self, ids, values, n_dims, largest):
        self.ids = ids
        forward = np.zeros((len(ids), n_dims), dtype=np.int64)
        forward[:, :min(n_dims, values.shape[1])] = values[:, :n_dims]
        lists = np.empty((2 * n_dims, len(ids)), dtype=np.int64)
        lists[0::2], lists[1::2] = np.maximum(forward.T, 0), np.maximum(-forward.T, 0)
        self.bound = lists.max(1, initial=0)
        most = float(self.bound.sum()) * float(largest)
        self.kind = np.float32 if most < 2.0 ** 24 else np.float64 if most < 2.0 ** 53 else np.int64
        self.forward, self.lists = forward.astype(self.kind), lists.astype(self.kind)
        self.read = self.agreeing = 0

    def search(self, query, own, best, k):
        """(scores, ids) of candidates that may enter the top-k of ``query``, best first.

        ``best``: k-th score so far, None where there are fewer. ``own``: id to leave out.
        """
        dims = np.flatnonzero(query)
        lists, weight = 2 * dims + (query[dims] < 0), np.abs(query[dims])
        order = np.argsort(-weight * self.bound[lists], kind="stable")
        lists, weight = lists[order], weight[order]
        # rest[i]: what the lists from i on can add together.
        rest = np.append(np.cumsum((weight * self.bound[lists])[::-1])[::-1], 0)
        weight = weight.astype(self.kind)
        everyone = best is None or best <= 0  # vectors in no list compete as well
        split = len(lists) if everyone else int((rest[:-1] >= best).sum())
        self.read, self.agreeing = self.read + split, self.agreeing + len(lists)
        score = weight[:split] @ self.lists[lists[:split]]  # the essential lists alone
        rows = None if everyone else np.flatnonzero((score > 0) & (score + rest[split] >= best))
        for a in range(split, len(lists), 8):  # probes, largest bounds first
            b = min(a + 8, len(lists))
            if 2 * len(rows) > len(self.ids):  # most rows compete: along the lists
                score += weight[a:b] @ self.lists[lists[a:b]]
                rows = rows[score[rows] + rest[b] >= best]
            elif len(rows):
                score[rows] += weight[a:b] @ self.lists[lists[a:b, None], rows[None]]
                rows = rows[score[rows] + rest[b] >= best]
        rows = np.arange(len(self.ids)) if rows is None else rows
        score = self.forward[rows] @ query.astype(self.kind)  # with the falling contributions
        keep = (self.ids[rows] != own) & (True if best is None else score >= best)
        rows, score = rows[keep], score[keep]
        if len(rows) > k:  # no more than k, and what ties with the k-th
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[keep], score[keep]
        top = np.lexsort((self.ids[rows], -score))[:k]
        return score[top].astype(np.int64), self.ids[rows[top]]


def _merge(a, b, k):
    score, ids = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def seeds(vectors, n=SEEDS):
    """At most ``n`` candidates on the driver, by a hash of the id: (ids, values)."""
    t = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).toArrow()
    return matrix(t.column(0).to_numpy(), t.column(1).combine_chunks())


def tiles(n, stride, shard_rows, query_rows):
    """(shards, query groups): of the given sizes, else as few as bounded sizes allow, to copy little."""
    within = lambda x, bounds: min(max(math.ceil(x), bounds[0]), bounds[1])
    n_queries = max(1, math.ceil(n / stride))
    return math.ceil(n / (shard_rows or within(n / 64, SHARD_ROWS))), math.ceil(n_queries / (query_rows or within(n_queries / 2, QUERY_ROWS)))


def top_k(vectors, k=20, stride=20, shard_rows=None, query_rows=None):
    """Rows (query_id, rank, vec_id, score) of an integer table (vec_id, v)."""
    n_shards, n_groups = tiles(max(1, vectors.count()), stride, shard_rows, query_rows)
    number = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    shards = packed(vectors, n_shards, "shard").select("*", number(n_groups, "group"))
    groups = packed(vectors.where(F.col("vec_id") % stride == 0), n_groups, "group").select("*", number(n_shards, "shard"))
    pairs = groups.join(shards, ["shard", "group"]).repartition(min(20_000, n_shards * n_groups), "shard", "group")
    first_ids, first_values = seeds(vectors)

    def run(iterator):
        for batch in iterator:
            for r in range(batch.num_rows):
                row = {f: batch.column(f)[r].as_py() for f in batch.schema.names}
                own, queries = unpacked(row["group_dims"], row["group_width"], row["group_ids"], row["group_values"])
                ids, values = unpacked(row["shard_dims"], row["shard_width"], row["shard_ids"], row["shard_values"])
                best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in own]
                largest = np.abs(queries).max(initial=0)
                least = thresholds(queries, own, first_ids, first_values, k)
                for a in range(0, len(ids), PART):
                    part = Shard(ids[a:a + PART], values[a:a + PART], queries.shape[1], largest)
                    for i in range(len(own)):
                        here = int(best[i][0][-1]) if len(best[i][0]) == k else None
                        known = [x for x in (here, least[i]) if x is not None]
                        best[i] = _merge(best[i], part.search(queries[i], own[i], max(known, default=None), k), k)
                n = [len(b[0]) for b in best]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, n)), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best]))], schema=HITS)

    hits = pairs.mapInArrow(run, "query_id long, score long, vec_id long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def thresholds(queries, own, ids, values, k):
    """k-th best score among the first candidates per query, None where there are fewer."""
    n_dims = max(queries.shape[1], values.shape[1])
    wide = lambda x: np.pad(x.astype(np.int64), ((0, 0), (0, n_dims - x.shape[1])))
    queries, values, out = wide(queries), wide(values), []
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(values).max(initial=0)) * n_dims
    if most < 2.0 ** 53:
        queries, values = queries.astype(float), values.astype(float)
    for i in range(len(own)):
        score = (values @ queries[i])[ids != own[i]]
        out.append(int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else None)
    return out


ORACLE = """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
