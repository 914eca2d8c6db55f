"""Near-duplicates by exact Jaccard similarity of word shingles.

Texts with equal sets of shingles are one node. The SimHash index (``simhash.py``) proposes
pairs first: every fingerprint with its star within two bits, texts of one fingerprint with
one of them. Similar texts may lie further apart (9.8 bits at a similarity of 0.8), so
MinHash proposes further pairs: ``bands`` keys,
each over ``rows`` minima, meet in buckets, so that at a similarity s a pair shares one
with probability 1 - (1 - s^rows)^bands: 0.9999 at 0.8 for 32 bands of 6. A pair links
only if its sets, compared in full, reach the least similarity; nothing is linked by a
sketch. A bucket of up to 16 members pairs all with all. A larger one pairs its members
with one that a hash of node and band chooses, by an aggregation and an equi-join: no
bucket is gathered in a task, and the pairs grow with the rows and not with the square of
a group. Bands choose differently, so a member unlike one choice still meets others.
Components are then joined globally.

What stars, chosen members and sketches leave out follows: sets whose similarity is at
least t share one of their first (1 - t) * size + 1 shingles in any one order of all
shingles. So texts of two components that share such a shingle are compared too, and no
link is lost; texts that already have one component need no further link. In that order
the shingles that a sample of texts repeats come last, rare ones first: the sample decides
how many pairs meet, never which link. Pairs are first compared by a quarter of their
shingles, which bounds their similarity from above.

Defined cases: NULL or empty text, or white space only: the empty set, a node like any
other; fewer words than a shingle: the whole sequence; repeated rows are kept; an empty
table gives no rows.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from ..session import written
from .common import batches, record, small_batches
from .components import components
from .simhash import edges, hashes, majority

BANDS, ROWS = 32, 6
#: Members up to which a bucket pairs all with all; choices of the others' member over the bands.
SMALL, CHOICES = 16, 8
QUARTER = np.uint64(1 << 62)


def minima(h, n):
    """The least of each of ``n`` hashes of the shingles."""
    factors = np.random.default_rng(5).integers(0, 1 << 63, (2, n), dtype=np.uint64)
    out = np.full(n, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for i in range(0, len(h), 1024):
        x = h[None, i:i + 1024] * (factors[0] * np.uint64(2) + np.uint64(1))[:, None]
        out = np.minimum(out, (x ^ factors[1][:, None]).min(1))
    return out


def keys(h, bands=BANDS, rows=ROWS):
    """Bucket keys of a set of shingles; none for the empty set."""
    if not len(h):
        return []
    m = minima(h, bands * rows).reshape(bands, rows)
    return [xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in m]


def may_be_alike(a, b, size_a, size_b, tenths):
    """Whether sets of these sizes can be alike in ``tenths`` / 10, given their parts; equal halves count as equal shingles."""
    both = len(np.intersect1d(a, b)) if len(a) and len(b) else 0
    # Repeats of a half within a part: each may meet one of the other part.
    both += len(a) + len(b) - len(np.unique(a)) - len(np.unique(b))
    both += min(size_a - len(a), size_b - len(b))
    return 10 * both >= tenths * (size_a + size_b - both)


def alike(a, b, tenths):
    """Whether two sorted sets of distinct shingles have a Jaccard similarity of ``tenths`` / 10 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 10 * both >= tenths * (len(a) + len(b) - both)


def often(docs, row_hash, shingle, texts=1 << 15, most=1 << 18):
    """(shingles in ascending order, their ranks): those that a sample of distinct texts repeats, rarer ones first.

    Bounded by ``texts`` and ``most``; only the order of shingles depends on it.
    """
    pick = docs.select(row_hash.alias("row_hash")).distinct().orderBy(F.xxhash64("row_hash"), "row_hash").limit(texts)
    rows = docs.select(row_hash.alias("row_hash"), binary()).join(F.broadcast(pick), "row_hash")
    rows = rows.groupBy("row_hash").agg(F.any_value("text").alias("text")).select("text")

    def run(iterator):
        for b in batches(iterator):
            for text in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes(text, shingle)).view(np.int64))], names=["h"])

    counts = rows.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    known = counts.orderBy(F.desc("n"), "h").limit(most).toArrow()
    h, n = (known.column(c).to_numpy() for c in ("h", "n"))
    h = h.view(np.uint64)
    order = np.argsort(h)
    return h[order], n[order]


def firsts(h, tenths, known):
    """The shingles of a sorted set of which any set alike in ``tenths`` / 10 has one among its own."""
    if len(known[0]):
        at = np.minimum(np.searchsorted(known[0], h), len(known[0]) - 1)
        h = h[np.lexsort((h, np.where(known[0][at] == h, known[1][at], 0)))]
    return h[:len(h) - (tenths * len(h) + 9) // 10 + 1] if len(h) else h


PRINT = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64())),
                   ("size", pa.int64()), ("firsts", pa.list_(pa.int64())), ("part", pa.binary())])


def prints(docs, row_hash, shingle, tenths, known):
    """(doc_id, row_hash, high, low, fp, bands, size, firsts, part) of every whole text.

    high and low name its set, fp is its SimHash; part has the upper halves of the shingles in the lowest quarter of all values.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash.alias("row_hash"), binary())

    def run(iterator):
        for b in batches(iterator):
            names, bands, size, first, part = np.zeros((b.num_rows, 2), dtype=np.int64), [], [], [], []
            fp = np.zeros(b.num_rows, dtype=np.uint64)
            for i, text in enumerate(b.column(2).to_pylist()):
                h = np.unique(hashes(text, shingle))
                names[i] = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), dtype=np.int64)
                bands.append(keys(h))
                size.append(len(h))
                first.append(firsts(h, tenths, known).view(np.int64))
                part.append((h[:np.searchsorted(h, QUARTER)] >> np.uint64(32)).astype(np.uint32).tobytes())
                words = hashes(text)
                if len(words):
                    fp[i] = majority(words)
            yield record(PRINT, doc_id=b.column(0), row_hash=b.column(1), high=names[:, 0], low=names[:, 1], fp=fp.view(np.int64), bands=bands, size=size, firsts=first, part=part)

    return rows.mapInArrow(run, "doc_id long, row_hash long, high long, low long, fp long, bands array<long>, size long, firsts array<long>, part binary")


def binary():
    return F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")


def pairs(nodes):
    """Distinct (a, b) of (node, bands): all of a small bucket, in a large one each member with the chosen one."""
    at = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    chosen = at.groupBy("band", "key").agg(F.min_by("node", F.xxhash64("node", F.col("band") % CHOICES)).alias("b"), F.count(F.lit(1)).alias("n"))
    both = written(at.join(chosen.where("n > 1"), ["band", "key"]), "jaccard-buckets")
    small = both.where(F.col("n") <= SMALL).drop("b", "n")
    small = small.join(small.withColumnRenamed("node", "b"), ["band", "key"]).where("node > b").select("node", "b")
    found = both.where(F.col("n") > SMALL).where("node <> b").select("node", "b").unionByName(small)
    return found.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()


def close(found, nodes):
    """Pairs (a, b) of nodes by the SimHash index: stars over equal fingerprints and over those within two bits.

    A star's centre may be unlike members that are alike to each other; ``missed`` finds those.
    """
    at = found.select("high", "low", "fp").distinct().join(nodes.select("high", "low", "node"), ["high", "low"]).select("fp", "node")
    at = written(at, "jaccard-prints-of-nodes")
    codes = written(at.groupBy(F.col("fp").alias("fp0")).agg(F.min("node").alias("rep")), "jaccard-codes")
    same = at.join(codes, at["fp"] == codes["fp0"]).where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    met = edges(codes).unionByName(same).where("a <> b")
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def missed(nodes, tenths):
    """Pairs (a, b) of (node, component, size, firsts, part) of two components that may still be alike."""
    at = nodes.select("node", "component", "size", F.posexplode("firsts").alias("at", "key")).withColumn("left", F.col("size") - F.col("at")).drop("at")
    meeting = at.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").select("key")
    at = written(at.join(meeting, "key").select("key", "node", "component", "size", "left"), "jaccard-meeting")
    other = at.toDF("key", "b", "c", "n", "rest")
    # Sets that meet first in this shingle share no more than what either has from there on.
    enough = F.least("left", "rest") * (10 + tenths) >= (F.col("size") + F.col("n")) * tenths
    both = at.join(other, "key").where((F.col("node") > F.col("b")) & (F.col("component") != F.col("c")) & enough)
    both = both.select(F.col("node").alias("a"), "b").distinct()
    parts = nodes.select("node", "size", "part")
    both = both.join(parts.toDF("a", "size_a", "part_a"), "a").join(parts.toDF("b", "size_b", "part_b"), "b").select("a", "b", "size_a", "size_b", "part_a", "part_b")

    def run(iterator):
        for batch in batches(iterator):
            a, b, size_a, size_b, part_a, part_b = (c.to_pylist() for c in batch.columns)
            found = [i for i in range(len(a)) if may_be_alike(np.frombuffer(part_a[i], np.uint32), np.frombuffer(part_b[i], np.uint32), size_a[i], size_b[i], tenths)]
            yield record(LINK, a=[a[i] for i in found], b=[b[i] for i in found])

    return both.mapInArrow(run, "a long, b long")


def verified(found, texts, shingle, tenths):
    """The pairs (a, b) whose texts (node, text) are alike."""
    both = found.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(iterator):
        known, seen = None, None
        for b in batches(iterator):
            ids, out = [c.to_pylist() for c in b.columns[:2]], []
            for i, (x, y) in enumerate(zip(*ids)):
                if y != known:
                    known, seen = y, np.unique(hashes(b.column(3)[i].as_py(), shingle))
                if alike(np.unique(hashes(b.column(2)[i].as_py(), shingle)), seen, tenths):
                    out.append((x, y))
            yield record(LINK, a=[x for x, _ in out], b=[y for _, y in out])

    return both.mapInArrow(run, "a long, b long")


def near_duplicates(docs, row_hash, shingle=5, tenths=8):
    """(doc_id, row_hash, component) of every row; components are chains of alike texts.

    ``row_hash``: a column that, with doc_id, tells rows of differing texts apart.
    """
    small_batches(docs.sparkSession, 500)  # rows that are compared carry two texts
    found = written(prints(docs, row_hash, shingle, tenths, often(docs, row_hash, shingle)), "jaccard-prints")
    columns = ("bands", "size", "firsts", "part")
    nodes = found.groupBy("high", "low").agg(F.min(F.struct("doc_id", "row_hash")).alias("row"), *[F.any_value(c).alias(c) for c in columns])
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), row_hash.alias("_hash"), binary())

    def linked(met):
        used = met.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        used = nodes.select("node", F.col("row.doc_id").alias("doc_id"), F.col("row.row_hash").alias("row_hash")).join(used, "node", "left_semi")
        # Rows of one id and hash have equal texts: any of them serves.
        texts = rows.join(used, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("row_hash")))
        texts = written(texts.groupBy("node").agg(F.any_value("text").alias("text")), "jaccard-texts")
        return written(verified(met, texts, shingle, tenths), "jaccard-verified")

    met = written(close(found, nodes).unionByName(pairs(nodes.select("node", "bands"))).distinct(), "jaccard-pairs")
    named = components(linked(met), "jaccard-links")
    named = written(nodes.select("node").join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "jaccard-named")
    rest = written(missed(nodes.select("node", "size", "firsts", "part").join(named, "node"), tenths), "jaccard-missed")
    if not rest.isEmpty():
        # Links of the rest join whole components.
        ends = linked(rest).join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        joined = components(ends, "jaccard-rest").toDF("component", "least")
        named = named.join(joined, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    nodes = nodes.select("high", "low", "node").join(named, "node").select("high", "low", "component")
    return found.select("doc_id", "row_hash", "high", "low").join(nodes, ["high", "low"]).select("doc_id", "row_hash", "component")
