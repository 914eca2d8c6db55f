"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints within ``radius`` bits agree in at least ``blocks - radius`` of ``blocks``
slices of their bits. Each choice of that many slices is a route: fingerprints with
equal bits there come together, and no link is lost. Routes that hold more than
``limit`` fingerprints are split again by slices of their remaining bits until none
does or the remaining bits bound the group.

Inside a route the distinct fingerprints are sorted by Gray rank, so that neighbours
differ in few bits. Runs of eight become nodes: the bits that all members share are the
node's mask and pattern; runs of eight nodes become upper nodes. A search adds up
differences on the way down, counting in each node only bits not shared further up, and
drops a whole subtree once the sum exceeds the radius. The links of a route are reduced
to a spanning star per local component before they leave the task, so dense groups of
copies give no quadratic output; components are then joined globally.

Texts are read once and only (doc_id, fingerprint) is shuffled. Equal fingerprints are
one node, so exact copies are never paired. A fingerprint that no id carries links nothing. Defined cases: NULL or empty text, or white
space only: fingerprint zero, linked like any other; fewer words than a shingle: the
whole sequence; a NULL doc_id gets the component of its fingerprint and never names one
(NULL if no id is reachable); repeated rows are kept; an empty table gives no rows.
"""

import re
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from ..session import written
from .common import batches, record
from .components import components

SEED = 42
WORD = re.compile(rb"[^ \t-\r]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
FANOUT = 8


def hashes(text, shingle=3):
    """XXH64 of every word shingle of UTF-8 bytes, repeats included; none without words."""
    words = WORD.findall(text.translate(LOWER))
    if not words:
        return np.zeros(0, dtype=np.uint64)
    n = min(shingle, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(n))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=len(words) - n + 1)


def fingerprint(text, shingle=3):
    """64-bit SimHash of UTF-8 bytes; zero without words."""
    h = hashes(text, shingle)
    return majority(h) if len(h) else 0


def majority(h):
    """The bits set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i:i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def mixed(h, table):
    """Another 64-bit hash of the same shingles for a further table (table 0: unchanged)."""
    if table:
        h = h + np.uint64((0x9E3779B97F4A7C15 * table) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def fingerprints(docs, shingle=3, tables=1):
    """(doc_id, fp0, fp1, ...) of every whole text; a long holds the 64 bits of a table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    names = [f"fp{t}" for t in range(tables)]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names)])

    def run(iterator):
        for b in batches(iterator):
            fp = np.zeros((tables, b.num_rows), dtype=np.uint64)
            for i, text in enumerate(b.column(1).to_pylist()):
                h = hashes(text, shingle)
                if len(h):
                    fp[:, i] = [majority(mixed(h, t)) for t in range(tables)]
            yield record(schema, doc_id=b.column(0), **dict(zip(names, fp.view(np.int64))))

    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def slices(bits, n):
    """Masks of ``n`` nearly equal slices of the given bit positions."""
    cut = [sorted(bits)[len(bits) * i // n:len(bits) * (i + 1) // n] for i in range(n)]
    return [sum(1 << b for b in c) for c in cut]


def signed(mask):
    return mask - (1 << 64) if mask >> 63 else mask


def routes(bits, radius, blocks):
    """Masks of all choices of ``blocks - radius`` slices."""
    return [sum(c) for c in combinations(slices(bits, blocks), blocks - radius)]


def gray_rank(codes):
    """Position of each code in the reflected Gray sequence."""
    r = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def levels(codes, group):
    """Index levels over codes in Gray order, bottom up: (mask, pattern, first, last) of nodes.

    Nodes never cross a group. Level 0 are the codes themselves.
    """
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = [(np.full(len(codes), full), codes, None, None)]
    owner = group
    ones, zeros = codes, ~codes
    while True:
        change = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        size = np.diff(np.append(change, len(owner)))
        if size.max() <= FANOUT:
            return out, change, size
        position = np.arange(len(owner)) - np.repeat(change, size)
        first = np.flatnonzero(position % FANOUT == 0)
        last = np.append(first[1:], len(owner))
        ones, zeros = np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first)
        owner = owner[first]
        out.append((ones | zeros, ones, first, last))


def links(codes, group, radius, budget=1 << 21):
    """Pairs (i, j), i < j, of positions in one group within ``radius`` bits.

    ``group`` is sorted; codes are in Gray order within it. Yields arrays; ``budget``
    bounds the node visits held at once.
    """
    index, start, size = levels(codes, group)
    top = len(index) - 1
    # The top nodes of each group, and the group of every query.
    which = np.cumsum(np.concatenate([[False], group[1:] != group[:-1]]))
    step = max(1, budget // FANOUT)
    todo = [(np.arange(a, min(a + step, len(codes))), None, None, top) for a in range(0, len(codes), step)]
    while todo:
        q, node, far, level = todo.pop()
        if node is None:
            count = size[which[q]]
            node = np.repeat(start[which[q]] - np.cumsum(count) + count, count) + np.arange(count.sum())
            q = np.repeat(q, count)
            far = np.zeros(len(q), dtype=np.uint8)
            above = np.zeros(len(q), dtype=np.uint64)
        elif len(q) > budget:
            h = len(q) // 2
            todo += [(q[:h], node[:h], far[:h], level), (q[h:], node[h:], far[h:], level)]
            continue
        else:
            _, _, first, last = index[level + 1]
            parent = node
            count = last[parent] - first[parent]
            node = np.repeat(first[parent] - np.cumsum(count) + count, count) + np.arange(count.sum())
            above = np.repeat(index[level + 1][0][parent], count)
            q, far = np.repeat(q, count), np.repeat(far, count)
        mask, pattern, _, _ = index[level]
        far = far + np.bitwise_count((codes[q] ^ pattern[node]) & mask[node] & ~above)
        alive = far <= radius
        if level == 0:
            alive &= q < node
            if alive.any():
                yield q[alive], node[alive]
        else:
            todo.append((q[alive], node[alive], far[alive], level - 1))


def stars(codes, reps, group, radius, sketch=None, total=None):
    """Edges (rep, smallest rep of its local component) for linked codes.

    With ``sketch`` (all tables' fingerprints of each code) a link also needs ``total``
    or fewer differing bits over all tables together.
    """
    label = reps.copy()
    where = np.argsort(reps, kind="stable")

    def root(x):
        """The least rep each label leads to: a label is a rep of the same batch."""
        while True:
            x, before = label[where[np.searchsorted(reps, x, sorter=where)]], x
            if (x == before).all():
                return x

    # Every block of pairs is joined as it comes and then forgotten.
    for a, b in links(codes, group, radius, budget=1 << 18):
        if sketch is not None:
            alike = np.bitwise_count(sketch[:, a] ^ sketch[:, b]).sum(0, dtype=np.int64) <= total
            a, b = a[alike], b[alike]
        while len(a):
            x, y = root(label[a]), root(label[b])
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            high = where[np.searchsorted(reps, np.maximum(x, y), sorter=where)]
            np.minimum.at(label, high, np.minimum(x, y))
    label = root(label)
    keep = label != reps
    return reps[keep], label[keep]


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _search(routed, radius, others=(), total=None):
    """Star edges of every route; rows arrive sorted by route."""

    def run(iterator):
        held, n = [], 0
        for b in iterator:
            held.append(b)
            n += b.num_rows
            if n >= 1 << 17:  # whole routes only; the last one waits for its rest
                t = pa.Table.from_batches(held)
                route, key = t.column("route").to_numpy(), t.column("key").to_numpy()
                cut = int(np.argmax((route == route[-1]) & (key == key[-1])))
                if cut:
                    yield solve(t.slice(0, cut))
                held, n = t.slice(cut).to_batches(), n - cut
        if n:
            yield solve(pa.Table.from_batches(held))

    def solve(t):
        route, key = t.column("route").to_numpy(), t.column("key").to_numpy()
        codes, reps = t.column("fp").to_numpy().view(np.uint64), t.column("rep").to_numpy()
        change = np.concatenate([[True], (route[1:] != route[:-1]) | (key[1:] != key[:-1])])
        group = np.cumsum(change)
        shared = np.bincount(group)[group] > 1
        codes, reps, group = codes[shared], reps[shared], group[shared]
        if not len(codes):
            return record(EDGES, a=[], b=[])
        order = np.lexsort((gray_rank(codes), group))
        sketch = np.stack([t.column(c).to_numpy().view(np.uint64)[shared][order] for c in others]) if others else None
        a, b = stars(codes[order], reps[order], group[order], radius, sketch, total)
        return record(EDGES, a=a, b=b)

    return routed.select("route", "key", "fp", "rep", *others).mapInArrow(run, "a long, b long")


def edges(nodes, tables=1, radius=2, blocks=4, limit=65536, total=None):
    """Star edges between representatives of (fp0, ..., rep): no link of any table is lost.

    ``total``: bits that may differ over all tables together (None: no such condition).
    """
    others = [f"fp{t}" for t in range(tables)] if total is not None else []
    spark = nodes.sparkSession
    masks, parts, same = {}, [], []
    for t in range(tables):
        distinct = nodes
        if tables > 1 and total is None:
            # Equal bits of one table link; their least rep alone is searched.
            distinct = nodes.groupBy(f"fp{t}").agg(F.min("rep").alias("rep"))
            same.append(nodes.join(distinct.withColumnRenamed("rep", "b"), f"fp{t}").where("rep <> b").select(F.col("rep").alias("a"), "b"))
        own = {len(masks) + i: m for i, m in enumerate(routes(range(64), radius, blocks))}
        masks.update(own)
        at = F.explode(F.array(*[F.struct(F.lit(i).alias("route"), F.lit(signed(m)).alias("mask")) for i, m in own.items()]))
        parts.append(distinct.select(F.col(f"fp{t}").alias("fp"), "rep", *others, at.alias("r")))
    todo = parts[0]
    for p in parts[1:]:
        todo = todo.unionByName(p)
    todo = todo.select(F.col("r.route").alias("route"), F.col("fp").bitwiseAND(F.col("r.mask")).alias("key"), "fp", "rep", *others)
    done = None
    while True:
        crowded = written(todo.groupBy("route", "key").count().where(F.col("count") > limit).select("route", "key"), "simhash-crowded")
        # Routes are few by construction; those whose open bits bound a group are not cut again
        # (with ``total`` and several tables they do not bound it: see near_duplicates).
        hot = [r[0] for r in crowded.select("route").distinct().collect() if 64 - masks[r[0]].bit_count() > 16]
        crowded = crowded.where(F.col("route").isin(hot)) if hot else None
        ready = todo if crowded is None else todo.join(crowded, ["route", "key"], "left_anti")
        done = ready if done is None else done.unionByName(ready)
        if crowded is None:
            break
        finer = []
        for route in hot:
            rest = [b for b in range(64) if not masks[route] >> b & 1]
            for m in routes(rest, radius, blocks):
                finer.append((route, len(masks), signed(masks[route] | m)))
                masks[len(masks)] = masks[route] | m
        finer = spark.createDataFrame(finer, "route int, finer int, mask long")
        todo = todo.join(crowded, ["route", "key"], "left_semi").join(F.broadcast(finer), "route")  # a literal list of masks
        todo = written(todo.select(F.col("finer").alias("route"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "rep", *others), "simhash-finer")
    found = _search(done.repartition(F.col("route"), F.col("key")).sortWithinPartitions("route", "key"), radius, others, total)
    for s in same:
        found = found.unionByName(s)
    return found


def near_duplicates(docs, shingle=3, radius=2, blocks=4, tables=1, limit=65536, total=None):
    """(doc_id, fp, component_id) of every document; fp is that of the first table.

    With several tables, documents link if their fingerprints of any table do and, given
    ``total``, no more than so many bits differ over all tables. Without ``total`` a route
    holds each value of its table once. With it nodes that share one table's bits meet
    whole in a task however many they are; no registered query asks for that.
    """
    fps = [f"fp{t}" for t in range(tables)]
    prints = written(fingerprints(docs, shingle, tables), "simhash-prints")
    nodes = written(prints.groupBy(*fps).agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    named = components(edges(nodes.where("rep is not null"), tables, radius, blocks, limit, total), "simhash-edges")
    nodes = nodes.join(named, nodes["rep"] == named["node"], "left").select(*fps, F.coalesce("component", "rep").alias("component_id"))
    return prints.join(nodes, fps).select("doc_id", F.col("fp0").alias("fp"), "component_id")


def digest(found):
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
