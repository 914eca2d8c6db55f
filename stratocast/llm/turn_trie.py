"""Prefix trie of conversations with subtree totals by depth bands.

A node is a distinct sequence of first turns. Its key is the exclusive or of 128-bit hashes
of (position, role, text) over the sequence, a running aggregate: no conversation is
gathered anywhere, scans work on slices of it. Subtree totals are found by bands of fixed
height: a node explodes only to its ancestors within its band; the totals of band roots form
a tree that is shallower by the height, rolled up in the same way; completed totals then go
to the ancestors in the band above. A node makes at most twice ``height`` rows and a depth
of D takes log(D) / log(height) rounds.

Defined cases: NULL role or text is empty; turns are ordered by number, NULL first, equal
numbers by a hash of role and text, repeated rows count each; rows without conv_id take no
part; a conversation without turns ends at the root; an empty table has no nodes; further
columns do not take part.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators.chunked import chunked, prefix_scan, unchunk
from ..session import written
from .common import record

GROUP, HEADS = 20, 4
#: Turns of a slice, levels of a band, and conversation ids in one piece of an ends list.
SLICE, HEIGHT, PIECE = 1024, 16, 4096
KEY = ["k1", "k2"]


def words(text):
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def taken(conv):
    """Turns that a conversation takes over from the first of its group."""
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuilt(convs):
    """(conv, src, pos, h1, h2, n_words): a root row (src -1), taken turns (0) and own turns (1) of every conversation."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    t = convs.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
                     F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), role, text).alias("h2"), words(text).cast("long").alias("n_words"))
    # Copies of a turn are counted before anything is ordered.
    t = t.where("conv is not null").groupBy("conv", "turn", "h1", "h2", "n_words").agg(F.count(F.lit(1)).alias("m"))
    part = F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(1 << 60))).cast("long")
    t = prefix_scan(t, ["conv"], ["turn", "h1", "h2"], part, {"upto": ("sum", "m")})
    t = t.select("conv", F.explode(F.sequence(F.col("upto") - F.col("m") + 1, F.col("upto"))).alias("pos"), "h1", "h2", "n_words")
    t = written(t, "trie-turns")
    ids = t.groupBy("conv").agg(F.lit(1).alias("_")).select("conv", (F.col("conv") - F.col("conv") % GROUP).alias("first"), taken(F.col("conv")).alias("h"))
    heads = t.where((F.col("conv") % GROUP == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv", "first")
    heads = ids.join(heads, "first").where("pos <= h").select("conv", F.lit(0).alias("src"), "pos", "h1", "h2", "n_words")
    own = t.where(F.col("pos") > taken(F.col("conv"))).select("conv", F.lit(1).alias("src"), "pos", "h1", "h2", "n_words")
    zero = F.lit(0).cast("long")
    roots = ids.select("conv", F.lit(-1).alias("src"), zero.alias("pos"), zero.alias("h1"), zero.alias("h2"), zero.alias("n_words"))
    return roots.unionByName(heads).unionByName(own)


def paths(turns):
    """(conv, depth, k1, k2, p1, p2, n_words, ends): every prefix of every rebuilt conversation, with its parent's key."""
    part = F.when(F.col("src") < 1, 0).otherwise(1 + F.floor(F.col("pos") / SLICE)).cast("long")
    order = ["src", "pos"]
    d = chunked(turns, ["conv"], part)
    d = prefix_scan(d, ["conv"], order, "_c", {"depth": ("count", F.lit(1)), "_next": ("next", F.lit(1))}, inclusive=False)
    for i in (1, 2):
        d = d.withColumn(f"_x{i}", F.when(F.col("depth") > 0, F.xxhash64(F.lit(i), "depth", "h1", "h2")).otherwise(F.lit(0).cast("long")))
    d = unchunk(prefix_scan(d, ["conv"], order, "_c", {"k1": ("xor", "_x1"), "k2": ("xor", "_x2")}))
    up = [F.when(F.col("depth") > 0, F.col(f"k{i}").bitwiseXOR(F.col(f"_x{i}"))).alias(f"p{i}") for i in (1, 2)]
    return d.select("conv", "depth", *KEY, *up, "n_words", F.col("_next").isNull().alias("ends"))


def rollup(nodes, prefixes, sums, deepest, height=HEIGHT):
    """Subtree totals (k1, k2, *sums) of nodes (k1, k2, conv, depth, *sums).

    ``prefixes``: (conv, depth, k1, k2), whose rows lead from a node's ``conv`` to the keys of
    its ancestors; ``deepest``: the largest depth.
    """
    band = lambda d: F.floor(F.col(d) / height)
    up = prefixes.select(F.col("conv"), band("depth").alias("band"), F.col("depth").alias("above"), *KEY)
    add = [F.sum(s).alias(s) for s in sums]
    own = nodes.select("conv", "depth", *sums, band("depth").alias("band"))
    inner = own.join(up, ["conv", "band"]).where("above <= depth").groupBy(*KEY).agg(*add)
    if deepest < height:
        return inner
    inner = written(inner, "trie-bands")
    step = (F.col("depth") / height).cast("long").alias("depth")
    tops = nodes.where(F.col("depth") % height == 0).select(*KEY, "conv", "depth").join(inner, KEY).select(*KEY, "conv", step, *sums)
    tops = written(tops, "trie-tops")
    total = rollup(tops, prefixes.where(F.col("depth") % height == 0).select("conv", step, *KEY), sums, deepest // height, height)
    done = tops.select(*KEY, "conv", "depth").join(total, KEY).where("depth > 0")
    below = done.select("conv", (F.col("depth") - 1).alias("band"), *sums).join(up, ["conv", "band"]).groupBy(*KEY).agg(*add)
    return inner.unionByName(below).groupBy(*KEY).agg(*add)


def with_parent(nodes):
    """Nodes with their parent's conv_id. A parent of over 1/256 of all nodes, of which there
    are fewer than 256, is broadcast; all others are joined."""
    total = F.broadcast(nodes.agg(F.count(F.lit(1)).alias("_all")))
    parents = nodes.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv_id"), "n_children")
    parents = parents.join(total).withColumn("_large", F.col("n_children") * 256 > F.col("_all")).drop("n_children", "_all")
    large, small = (parents.where(c).drop("_large") for c in ("_large", "not _large"))
    near = nodes.join(F.broadcast(large), ["p1", "p2"], "left")
    rest = near.where("parent_conv_id is null and depth > 0").drop("parent_conv_id").join(small, ["p1", "p2"])
    return near.where("parent_conv_id is not null or depth = 0").unionByName(rest)


def ends_digest(prefixes):
    """(k1, k2, ends_sha256) of nodes at which conversations end.

    Ids are joined in pieces of a bounded range first; the pieces of a node are then
    streamed in order through one hash, which by its nature has no parallel form.
    """
    piece = F.floor(F.col("conv") / PIECE)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = prefixes.where("ends").groupBy(*KEY, piece.alias("piece")).agg(ids.alias("ids"))
    pieces = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids")
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])

    def run(iterator):
        key = state = None
        for b in iterator:
            out = []
            for k1, k2, text in zip(*[c.to_pylist() for c in b.columns]):
                if (k1, k2) == key:
                    state.update(b"," + text.encode())
                    continue
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256(text.encode())
            if out:
                yield record(schema, **dict(zip(schema.names, zip(*out))))
        if key:
            yield record(schema, k1=[key[0]], k2=[key[1]], ends_sha256=[state.hexdigest()])

    return pieces.mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def trie(convs, height=HEIGHT):
    """Nodes with keys: k1, k2, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    p = written(paths(rebuilt(convs)), "trie-paths")
    nodes = p.groupBy(*KEY, "depth", "p1", "p2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.any_value("n_words").alias("n_words"))
    nodes = written(nodes, "trie-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_words")})
    nodes = written(nodes, "trie-weighted")
    deepest = nodes.agg(F.max("depth")).first()[0]
    sums = ["n_leaves", "saved_tokens"]
    total = rollup(nodes, p.select("conv", "depth", *KEY), sums, deepest or 0, height)
    out = with_parent(nodes.drop(*sums)).join(total, KEY).join(ends_digest(p), KEY, "left")
    return out.select(*KEY, F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", *sums,
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def digest(convs):
    return trie(convs).drop(*KEY)


ORACLE = r"""
WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT DISTINCT c, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::UBIGINT) AS bytes FROM o),
h AS (SELECT c, c - c % 20 AS p, xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda a, x: list_reduce(list_prepend(xor(a, x), [1, 2, 3, 4, 5, 6, 7, 8]::UBIGINT[]), lambda y, z: xor(y >> 1, 3988292384::UBIGINT * (y & 1::UBIGINT)))), 4294967295::UBIGINT) % 4 AS h FROM b),
t AS (SELECT h.c, 0 AS s, o.i, role, text FROM h JOIN o ON o.c = h.p AND o.i <= h.h UNION ALL SELECT h.c, 1, o.i, role, text FROM h JOIN o ON o.c = h.c AND o.i > h.h),
d AS (SELECT c, row_number() OVER w AS depth, text, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w AS k FROM t WINDOW w AS (PARTITION BY c ORDER BY s, i)),
p AS (SELECT c, depth, md5(k) AS k, text FROM d UNION ALL SELECT c, 0, 'root', '' FROM h),
e AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY depth) AS pk, lead(k) OVER (PARTITION BY c ORDER BY depth) IS NULL AS ends FROM p),
n AS (SELECT k, any_value(pk) AS pk, any_value(depth) AS depth, min(c) AS c, count(*) AS n, any_value(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS w, sha256(coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '')) AS sha FROM e GROUP BY k),
x AS (SELECT n.*, q.c AS pc, (SELECT count(*) FROM n m WHERE m.pk = n.k) AS kids FROM n LEFT JOIN n q ON q.k = n.pk),
a AS (SELECT p.k, count(*) FILTER (x.kids = 0) AS leaves, sum((x.n - 1) * x.w) AS saved FROM x JOIN p ON p.c = x.c AND p.depth <= x.depth GROUP BY p.k)
SELECT x.c AS conv_id, x.depth, x.pc AS parent_conv_id, x.n AS n_convs, x.kids AS n_children, a.leaves AS n_leaves, a.saved::BIGINT AS saved_tokens, x.sha AS ends_sha256 FROM x JOIN a USING (k)
"""
