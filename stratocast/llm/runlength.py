"""Long repeats across documents by run-length compressed Burrows-Wheeler indexes.

A byte is removed if a 50-byte string that covers it also starts in a document with a
smaller doc_id. Nothing longer than such strings has to meet in one place, so the corpus
is cut by content and not by size:

1. Texts are packed into chunks (about 8 MB, compressed) in the shared folder.
2. Every 50-byte string has an anchor, its 24-gram of least hash. A chunk sends the
   distinct anchors, four bytes each, to their routes; anchors known to one document
   only are dropped there, which leaves the repeated part of the corpus.
3. The stretches of text owned by the other anchors (all their 50-byte strings, 50 to 76
   bytes) are told apart by 64-bit hashes, which go to the routes, distinct per chunk, with
   their smallest doc_id. A stretch that is the only one under its anchor needs no bytes,
   however many documents have it. Of the others one chunk each sends the bytes.
4. A route builds a run-compressed Burrows-Wheeler transform over these stretches, with
   suffix-array samples at run ends, and streams every stretch through it backwards;
   each step yields the matching statistic of one position: whether 50 bytes match, and
   the smallest document in which they do.
5. Chunks mark the matches in their texts, and cut.

So copies of a text cost 14 bytes for each anchor and not its stretch. What an exchange
left on the disks is removed as soon as its step is written.

Equal strings have equal anchors, so no match is lost. Whole stretches of one anchor are
equal if their hashes are; matches of parts are decided by the index on bytes. Anchors that occur in very many chunks or with very
many different surroundings (a very common line) are routed by their single 50-byte strings instead, so that what surrounds
the line in a third of all documents does not meet in one index.

Defined cases: NULL text counts as empty; texts under 50 bytes are kept whole; matches
inside one document, or between rows of one doc_id, do not count; a NULL doc_id counts
as larger than all others, and such rows do not match each other; repeated rows get
equal results; texts of any length and any bytes; an empty table gives no rows.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from ..session import shuffles_removed, written
from .common import record

LENGTH, GRAM = 50, 24
SPREAD = LENGTH - GRAM + 1  # grams of a window
LAST = (1 << 63) - 1


# ------------------------------------------------------------------ the index

class RunLengthIndex:
    """Run-compressed BWT over distinct byte strings, with samples at run ends.

    Built by prefix doubling; every string ends in a separator of its own, smaller than
    any byte, so that all suffixes differ. ``docs`` gives the document of each string.
    """

    def __init__(self, strings, docs, length=LENGTH):
        count = len(strings)
        size = np.fromiter(map(len, strings), dtype=np.int64, count=count)
        n = int(size.sum()) + count
        text = np.empty(n, dtype=np.int64)
        ends = np.cumsum(size + 1) - 1
        body = np.ones(n, dtype=bool)
        body[ends] = False
        text[body] = np.frombuffer(b"".join(strings), dtype=np.uint8).astype(np.int64) + count
        text[ends] = np.arange(count)
        # Ranks of prefixes of 3, 6, 12 ... symbols; separators make long ones unique.
        # Three symbols fit a key below two million strings; an index is given far fewer.
        base = count + 257
        key = (text * base + shifted(text, 1)) * base + shifted(text, 2)
        width, block = 3, None
        while True:
            order = np.argsort(key)
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
            if block is None and width * 2 >= length:
                block = rank * n + shifted(rank, length - width)
            if rank[order[-1]] == n - 1:
                break
            key = rank * n + shifted(rank, width)
            width *= 2
        while block is None:
            if width * 2 >= length:
                block = rank * n + shifted(rank, length - width)
            else:
                rank_key = rank * n + shifted(rank, width)
                o = np.argsort(rank_key)
                rank = np.empty(n, dtype=np.int64)
                rank[o] = np.cumsum(np.concatenate([[0], rank_key[o][1:] != rank_key[o][:-1]]))
                width *= 2
        bwt = text[order - 1]
        change = np.concatenate([[True], bwt[1:] != bwt[:-1]])
        self.n, self.strings = n, count
        self.start = np.flatnonzero(change)
        self.symbol = bwt[self.start]
        run = np.diff(np.append(self.start, n))
        self.sample_first = order[self.start]
        self.sample_last = order[np.append(self.start[1:], n) - 1]
        # LF of a run's first row: rows of smaller symbols, then earlier runs of the same.
        by_symbol = np.argsort(self.symbol, kind="stable")
        self.to = np.empty(len(run), dtype=np.int64)
        self.to[by_symbol] = np.cumsum(run[by_symbol]) - run[by_symbol]
        # Rows whose suffixes agree in ``length`` symbols, and the smallest document there.
        cut = np.flatnonzero(np.concatenate([[True], block[order][1:] != block[order][:-1]]))
        self.block = cut
        self.earliest = np.minimum.reduceat(docs[np.searchsorted(ends, order)], cut)

    def step(self, rows):
        """(preceding symbol, its row) of each row."""
        r = np.searchsorted(self.start, rows, side="right") - 1
        return self.symbol[r], self.to[r] + rows - self.start[r]

    def locate(self, row):
        """Text position of a row: back to a sampled run end, then count."""
        steps, row = 0, np.array([row])
        while True:
            r = int(np.searchsorted(self.start, row[0], side="right") - 1)
            last = (self.start[r + 1] if r + 1 < len(self.start) else self.n) - 1
            if row[0] in (self.start[r], last):
                return int((self.sample_first if row[0] == self.start[r] else self.sample_last)[r] + steps) % self.n
            row, steps = self.step(row)[1], steps + 1

    def statistics(self, sizes, length=LENGTH):
        """Per string and position the smallest document matching ``length`` bytes there.

        All strings are streamed at once, right to left from their separators' rows.
        Column i is position i; positions without ``length`` bytes hold LAST.
        """
        out = np.full((len(sizes), int(max(sizes.max() - length + 1, 1))), LAST, dtype=np.int64)
        which = np.arange(len(sizes))
        rows, left = which.copy(), sizes.copy()
        while len(which):
            symbol, rows = self.step(rows)
            left = left - 1
            assert (symbol >= self.strings).all()
            full = left + length <= sizes[which]
            out[which[full], left[full]] = self.earliest[np.searchsorted(self.block, rows[full], side="right") - 1]
            on = left > 0
            which, rows, left = which[on], rows[on], left[on]
        return out


def shifted(values, by):
    """values[i + by], cyclic."""
    return np.roll(values, -by)


# ------------------------------------------------------------------ chunks and anchors

CHUNK = pa.schema([("ids", pa.binary()), ("sizes", pa.binary()), ("n_bytes", pa.int64()), ("blob", pa.binary())])


def pack(docs, chunk_bytes):
    """Rows of about ``chunk_bytes`` of text: ids, lengths and compressed bytes."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(iterator):
        ids, texts, n = [], [], 0

        def row():
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            return record(CHUNK, ids=[np.array(ids, dtype=np.int64).tobytes()], sizes=[sizes.tobytes()], n_bytes=[int(sizes.sum())],
                          blob=[zstandard.ZstdCompressor(level=3).compress(b"".join(texts))])

        for b in iterator:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                n += len(t)
                if n >= chunk_bytes:
                    yield row()
                    ids, texts, n = [], [], 0
        if ids:
            yield row()

    return rows.mapInArrow(run, "ids binary, sizes binary, n_bytes long, blob binary").withColumn("chunk", F.monotonically_increasing_id())


def gram_hashes(data, first, last):
    """64-bit hashes of the 24-grams that start at first..last-1."""
    w = np.lib.stride_tricks.as_strided(data[first:].view(), shape=(last - first + 16, 8), strides=(1, 1)).copy().view("<u8").ravel()
    n = last - first
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += w[8:8 + n]
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h += w[16:16 + n]
    h *= np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    return h


class Scan:
    """Anchors of a chunk: position, first and last owned window, hash."""

    def __init__(self, row, piece=1 << 20):
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        sizes = np.frombuffer(row["sizes"], dtype=np.int64)
        n = int(sizes.sum())
        raw = zstandard.ZstdDecompressor().decompress(row["blob"], max_output_size=max(n, 1)) if n else b""
        self.data = np.frombuffer(raw + b"\0" * 32, dtype=np.uint8)
        self.n, self.ends = n, np.cumsum(sizes)
        self.begins = self.ends - sizes
        # Windows that would reach over the end of their document.
        edge = np.zeros(n + 1, dtype=np.int32)
        np.add.at(edge, np.maximum(self.begins, self.ends - LENGTH + 1), 1)
        np.add.at(edge, self.ends, -1)
        valid = np.cumsum(edge[:-1], dtype=np.int32) == 0
        parts = []
        for a in range(0, n - LENGTH + 1, piece):
            b = min(a + piece, n - LENGTH + 1)
            h = gram_hashes(self.data, a, b + SPREAD - 1)
            low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
            for s in (1, 2, 4, 8):
                low = np.minimum(low[:-s], low[s:])
            low = np.minimum(low[:b - a], low[SPREAD - 16:SPREAD - 16 + b - a])
            at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
            p = np.flatnonzero(valid[a:b])
            if not len(p):
                continue
            cut = np.flatnonzero(np.concatenate([[True], (at[p][1:] != at[p][:-1]) | (np.diff(p) > 1)]))
            first, last = p[cut], p[np.append(cut[1:], len(p)) - 1]
            parts.append((first + a, last + a, h[at[first]]))
        self.first, self.last, self.hash = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.doc = np.searchsorted(self.ends, self.first, side="right")

    def anchors(self, n_routes):
        """(sorted distinct route << 32 | key, inverse, known to several documents)."""
        code = (self.hash % np.uint64(n_routes)) << np.uint64(32) | (self.hash >> np.uint64(20)) & np.uint64(0xFFFFFFFF)
        order = np.argsort(code, kind="stable")
        s, d = code[order], self.doc[order]
        new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
        cut = np.flatnonzero(new)
        inverse = np.empty(len(s), dtype=np.int64)
        inverse[order] = np.cumsum(new) - 1
        several = d[cut] != d[np.append(cut[1:], len(s)) - 1] if len(s) else np.zeros(0, bool)
        return s[cut], inverse, several

    def crowded(self, inverse, n, least):
        """(anchors with over ``least`` stretches in this chunk, how many distinct ones each has)."""
        crowded = np.bincount(inverse, minlength=n) > least
        many = np.flatnonzero(crowded)
        at = np.flatnonzero(crowded[inverse])
        code = (np.cumsum(crowded) - 1)[inverse[at]]
        h = self.ranges(self.first[at], self.last[at])
        order = np.lexsort((h, code))
        new = np.concatenate([[True], (code[order][1:] != code[order][:-1]) | (h[order][1:] != h[order][:-1])]) if len(at) else np.zeros(0, bool)
        return many, np.bincount(code[order][new], minlength=len(many))

    def items(self, mark, n_routes):
        """Stretches to look up: (first, last window, doc index, route, key), by anchor marks."""
        plain, common = np.flatnonzero(mark == 1), np.flatnonzero(mark == 2)
        route = (self.hash % np.uint64(n_routes)).astype(np.int64)
        key = (self.hash >> np.uint64(20)).astype(np.uint32)
        count = self.last[common] - self.first[common] + 1
        single = np.repeat(self.first[common] - np.cumsum(count) + count, count) + np.arange(count.sum())
        own = self.ranges(single, single)
        first = np.concatenate([self.first[plain], single])
        return (first, np.concatenate([self.last[plain], single]), np.searchsorted(self.ends, first, side="right"),
                np.concatenate([route[plain], (own % np.uint64(n_routes)).astype(np.int64)]), np.concatenate([key[plain], (own >> np.uint64(20)).astype(np.uint32)]))

    def ranges(self, first, last):
        """64-bit hashes of the bytes [first, last + LENGTH), to tell stretches of a chunk apart."""
        if not hasattr(self, "powers"):
            self.powers = np.full(256, 0xD1342543DE82EF95, dtype=np.uint64) ** np.arange(256, dtype=np.uint64)
            self.letters = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)
        out = np.zeros(len(first), dtype=np.uint64)
        size = last + LENGTH - first
        for i in range(int(size.max()) if len(size) else 0):
            on = size > i
            out[on] += self.letters[self.data[first[on] + i]] * self.powers[i]
        out ^= out >> np.uint64(33)
        return out * np.uint64(0xFF51AFD7ED558CCD) ^ size.astype(np.uint64)

    def distinct(self, first, last, doc, route):
        """Distinct stretches by route: (order of items, group starts, smallest id and hash per group)."""
        h = self.ranges(first, last)
        ids = self.ids[doc]
        order = np.lexsort((ids, last - first, h, route))
        r, x, w = route[order], h[order], (last - first)[order]
        cut = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (x[1:] != x[:-1]) | (w[1:] != w[:-1])])) if len(order) else np.zeros(0, np.int64)
        return order, cut, ids[order[cut]], x[cut]


# ------------------------------------------------------------------ steps

MESSAGE = "route long, chunk long, body binary"
SENT = pa.schema([("route", pa.int64()), ("chunk", pa.int64()), ("body", pa.binary())])


def _rows(batch, *names):
    for i in range(batch.num_rows):
        yield {n: batch.column(n)[i].as_py() for n in names}


def _sent(rows):
    c = list(zip(*rows)) or [[], [], []]
    return record(SENT, route=c[0], chunk=c[1], body=c[2])


def by_route(messages, n_routes, solve):
    """``solve(route, [(chunk, body)])`` for every route; yields messages back."""

    def run(iterator):
        route, held = None, []
        for b in iterator:
            for r in _rows(b, "route", "chunk", "body"):
                if route is not None and r["route"] != route:
                    yield _sent(solve(route, held))
                    held = []
                route = r["route"]
                held.append((r["chunk"], r["body"]))
        if held:
            yield _sent(solve(route, held))

    return messages.repartition(n_routes, "route").sortWithinPartitions("route", "chunk").mapInArrow(run, MESSAGE)


def by_chunk(chunks, messages, n_chunks, solve, ddl):
    """``solve(chunk row, {route: body})`` for every chunk; yields record batches."""
    text = chunks.select("chunk", F.lit(-1).cast("long").alias("route"), "ids", "sizes", "blob")
    answers = messages.select("chunk", "route", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("sizes"), F.col("body").alias("blob"))
    both = text.unionByName(answers).repartition(n_chunks, "chunk").sortWithinPartitions("chunk", "route")

    def run(iterator):
        row, told = None, {}
        for b in iterator:
            for r in _rows(b, "chunk", "route", "ids", "sizes", "blob"):
                if r["route"] < 0:
                    if row is not None:
                        yield from solve(row, told)
                    row, told = r, {}
                else:
                    told[r["route"]] = r["blob"]
        if row is not None:
            yield from solve(row, told)

    return both.mapInArrow(run, ddl)


def send_anchors(chunks, n_routes, least=64):
    """Distinct anchors of each chunk to their routes: keys, whether in several documents, and
    the number of distinct stretches of those with over ``least``."""

    def run(iterator):
        for b in iterator:
            for row in _rows(b, "chunk", "ids", "sizes", "blob"):
                scan = Scan(row)
                code, inverse, several = scan.anchors(n_routes)
                many, stretches = scan.crowded(inverse, len(code), least)
                route = (code >> np.uint64(32)).astype(np.int64)
                cut = np.searchsorted(route, np.arange(n_routes + 1))
                inside = np.searchsorted(many, cut)

                def body(r):
                    (x, y), (i, j) = cut[r:r + 2], inside[r:r + 2]
                    return (int(y - x).to_bytes(8, "little") + code[x:y].astype(np.uint32).tobytes() + np.packbits(several[x:y]).tobytes()
                            + (many[i:j] - x).astype(np.uint32).tobytes() + stretches[i:j].astype(np.uint32).tobytes())

                yield _sent((int(r), row["chunk"], body(r)) for r in np.flatnonzero(np.diff(cut)))

    return chunks.select("chunk", "ids", "sizes", "blob").mapInArrow(run, MESSAGE)


def shared_anchors(common, crowd):
    """Marks per anchor of a chunk: 0 one document only, 1 repeated, 2 in over ``common`` chunks
    or with over ``crowd`` distinct stretches in the chunks that have many."""

    def solve(route, held):
        keys, several, stretches = [], [], []
        for _, body in held:
            n = int.from_bytes(body[:8], "little")
            at = 8 + 4 * n + (n + 7) // 8
            keys.append(np.frombuffer(body, dtype=np.uint32, count=n, offset=8))
            several.append(np.unpackbits(np.frombuffer(body, dtype=np.uint8, offset=8 + 4 * n, count=(n + 7) // 8), count=n).astype(bool))
            place, number = np.frombuffer(body, dtype=np.uint32, offset=at).reshape(2, -1) if len(body) > at else np.zeros((2, 0), np.uint32)
            stretches.append(np.zeros(n, dtype=np.int64))
            stretches[-1][place] = number
        all_keys = np.concatenate(keys)
        order = np.argsort(all_keys, kind="stable")
        s = all_keys[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        cut = np.flatnonzero(new)
        count = np.diff(np.append(cut, len(s)))
        mark = ((count > 1) | np.logical_or.reduceat(np.concatenate(several)[order], cut)).astype(np.uint8)
        mark[(count > common) | (np.add.reduceat(np.concatenate(stretches)[order], cut) > crowd)] = 2
        out = np.empty(len(s), dtype=np.uint8)
        out[order] = np.repeat(mark, count)
        at = 0
        for (chunk, _), k in zip(held, keys):
            own = out[at:at + len(k)]
            at += len(k)
            if own.any():
                yield route, chunk, np.packbits(np.stack([own == 1, own == 2])).tobytes()

    return solve


def chunk_items(row, told, n_routes):
    """A chunk's scan, its looked-up stretches with route and key, and their distinct groups."""
    scan = Scan(row)
    code, inverse, _ = scan.anchors(n_routes)
    mark = np.zeros(len(code), dtype=np.uint8)
    cut = np.searchsorted((code >> np.uint64(32)).astype(np.int64), np.arange(n_routes + 1))
    for r, body in told.items():
        n = cut[r + 1] - cut[r]
        one, two = np.unpackbits(np.frombuffer(body, dtype=np.uint8), count=2 * n).reshape(2, n)
        mark[cut[r]:cut[r + 1]] = one + 2 * two
    first, last, doc, route, key = scan.items(mark[inverse], n_routes)
    return scan, first, last, doc, route, key, *scan.distinct(first, last, doc, route)


def planes(values):
    """Bytes of longs, the first of each, then the second ...: those of small numbers compress to little."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def unplaned(raw, n, offset):
    return np.frombuffer(raw, dtype=np.uint8, count=8 * n, offset=offset).reshape(8, n).T.copy().view(np.int64).ravel()


def described(key, h, low):
    """Stretches as a message: how many, then their keys, hashes and smallest ids."""
    return len(key).to_bytes(8, "little") + key.tobytes() + h.tobytes() + planes(low)


def read_described(raw):
    """(keys, hashes, smallest ids, where the message goes on)."""
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(raw, dtype=np.uint32, count=n, offset=8), np.frombuffer(raw[8 + 4 * n:8 + 12 * n], dtype=np.uint64), unplaned(raw, n, 8 + 12 * n), 8 + 20 * n


#: Answers on a stretch: nothing to do; all of it is in a smaller document; to be looked up; to be looked up, and its bytes are to be sent.
ALL, LOOK, SEND = 1, 2, 3


def send_hashes(n_routes):
    def solve(row, told):
        _, _, _, _, route, key, order, groups, low, h = chunk_items(row, told, n_routes)
        head = order[groups]
        cut = np.searchsorted(route[head], np.arange(n_routes + 1))
        pack = zstandard.ZstdCompressor(level=1).compress
        yield _sent((r, row["chunk"], pack(described(key[head[x:y]], h[x:y], low[x:y]))) for r, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if y > x)

    return solve


def asked(route, held):
    """Answers per chunk, two bits for each of its stretches."""
    sent = [read_described(zstandard.ZstdDecompressor().decompress(body))[:3] for _, body in held]
    key, h, low = (np.concatenate(x) for x in zip(*sent))
    order = np.lexsort((low, h, key))
    k, x = key[order], h[order]
    first = np.concatenate([[True], k[1:] != k[:-1]])
    new = first | np.concatenate([[True], x[1:] != x[:-1]])
    # Windows of equal bytes have equal anchors: a stretch alone under its key meets no other.
    alone = (np.add.reduceat(new, np.flatnonzero(first), dtype=np.int64) == 1)[np.cumsum(first) - 1]
    least = low[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    answer = np.empty(len(order), dtype=np.uint8)
    answer[order] = np.where(alone, np.where(least < low[order], ALL, 0), np.where(new, SEND, LOOK))
    at = 0
    for (chunk, _), (own, _, _) in zip(held, sent):
        mine = answer[at:at + len(own)]
        at += len(own)
        if mine.any():
            yield route, chunk, np.packbits(np.stack([mine & 1, mine >> 1])).tobytes()


def answers(told, route, n_routes):
    """The answer on each stretch of a chunk, whose routes are given in order."""
    out = np.zeros(len(route), dtype=np.uint8)
    cut = np.searchsorted(route, np.arange(n_routes + 1))
    for r, body in told.items():
        n = cut[r + 1] - cut[r]
        one, two = np.unpackbits(np.frombuffer(body, dtype=np.uint8), count=2 * n).reshape(2, n)
        out[cut[r]:cut[r + 1]] = one + 2 * two
    return out


KINDS = 3  # messages to a chunk: marks of anchors, answers on stretches, bits of windows


def of_kind(messages, kind):
    return messages.select("chunk", (F.col("route") * KINDS + kind).alias("route"), "body")


def by_kind(told):
    return [{r // KINDS: b for r, b in told.items() if r % KINDS == kind} for kind in range(KINDS)]


def send_stretches(n_routes):
    """Stretches to be looked up, with the bytes of those that were asked for."""

    def solve(row, told):
        marks, told, _ = by_kind(told)
        scan, first, last, _, route, key, order, groups, low, h = chunk_items(row, marks, n_routes)
        head = order[groups]
        answer = answers(told, route[head], n_routes)
        look = np.flatnonzero(answer >= LOOK)
        cut = np.searchsorted(route[head[look]], np.arange(n_routes + 1))
        out = []
        for r, (x, y) in enumerate(zip(cut[:-1], cut[1:])):
            if y > x:
                own = look[x:y]
                send = answer[own] == SEND
                i = head[own[send]]
                size = last[i] + LENGTH - first[i]
                at = np.repeat(first[i] - np.cumsum(size) + size, size) + np.arange(size.sum())
                body = described(key[head[own]], h[own], low[own]) + np.packbits(send).tobytes() + size.astype(np.uint8).tobytes() + scan.data[at].tobytes()
                out.append((r, row["chunk"], zstandard.ZstdCompressor(level=1).compress(body)))
        yield _sent(out)

    return solve


def earlier(index_bytes):
    """Per stretch a bit for each of its windows: found in a smaller document."""

    def solve(route, held):
        keys, codes, lows, sent, sizes, strings = [], [], [], [], [], []
        for _, body in held:
            raw = zstandard.ZstdDecompressor().decompress(body)
            key, h, low, at = read_described(raw)
            n = len(key)
            send = np.unpackbits(np.frombuffer(raw, dtype=np.uint8, count=(n + 7) // 8, offset=at), count=n).astype(bool)
            at += (n + 7) // 8
            size = np.frombuffer(raw, dtype=np.uint8, count=int(send.sum()), offset=at).astype(np.int64)
            ends = np.cumsum(size) + at + len(size)
            strings += [raw[e - s:e] for s, e in zip(size.tolist(), ends.tolist())]
            for x, y in zip((keys, codes, lows, sent, sizes), (key, h, low, send, size)):
                x.append(y)
        key, h, low, send, size = map(np.concatenate, (keys, codes, lows, sent, sizes))
        # Equal stretches are one; the first of them brought the bytes.
        order = np.lexsort((h, key))
        new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (h[order][1:] != h[order][:-1])])
        which = np.empty(len(key), dtype=np.int64)
        which[order] = np.cumsum(new) - 1
        docs = np.minimum.reduceat(low[order], np.flatnonzero(new))
        own_key = key[order][new].astype(np.int64)
        text = np.empty(len(docs), dtype=np.int64)
        text[which[send]] = np.arange(len(strings))
        size = size[text]
        n_units = max(1, math.ceil(int(size.sum()) / index_bytes))
        found = np.full((len(docs), SPREAD), LAST, dtype=np.int64)
        order = np.argsort(own_key % n_units, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(own_key[order] % n_units)) + 1):
            got = RunLengthIndex([strings[i] for i in text[own].tolist()], docs[own]).statistics(size[own])
            found[own, :got.shape[1]] = got
        window = np.arange(SPREAD)[None] <= (size[which] - LENGTH)[:, None]
        hit = (found[which] < low[:, None]) & window
        bits = (hit << np.arange(SPREAD, dtype=np.uint32)[None]).sum(1).astype(np.uint32)
        at = 0
        for (chunk, _), own in zip(held, keys):
            mine = bits[at:at + len(own)]
            at += len(own)
            if mine.any():
                yield route, chunk, mine.tobytes()

    return solve


CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def cut_texts(n_routes, digest):
    """Documents of a chunk without the marked bytes; ``kept`` as bytes or as their sha256."""

    def solve(row, told):
        marks, told, bits_of = by_kind(told)
        scan, first, last, doc, route, _, order, groups, low, _ = chunk_items(row, marks, n_routes)
        cover = np.zeros(scan.n + 1, dtype=np.int32)
        if len(order):
            answer = answers(told, route[order[groups]], n_routes)
            bits = np.where(answer == ALL, np.uint32(0xFFFFFFFF), np.uint32(0))
            look = np.flatnonzero(answer >= LOOK)
            cut = np.searchsorted(route[order[groups[look]]], np.arange(n_routes + 1))
            for r, body in bits_of.items():
                bits[look[cut[r]:cut[r + 1]]] = np.frombuffer(body, dtype=np.uint32)
            group = np.repeat(np.arange(len(groups)), np.diff(np.append(groups, len(order))))
            own = np.where(scan.ids[doc[order]] > low[group], np.uint32(0xFFFFFFFF), bits[group])
            f, w = first[order], (last - first)[order] + 1
            for i in range(int(w.max())):
                hit = (w > i) & (own >> np.uint32(i) & 1).astype(bool)
                np.add.at(cover, f[hit] + i, 1)
                np.add.at(cover, f[hit] + i + LENGTH, -1)
        gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
        opens = gone & ~np.concatenate([[False], gone[:-1]])
        inner = scan.begins[scan.begins < scan.ends]
        opens[inner] = gone[inner]
        total, starts = np.zeros((2, scan.n + 1), dtype=np.int32)
        np.cumsum(gone, out=total[1:])
        np.cumsum(opens, out=starts[1:])
        kept = []
        for a, b in zip(scan.begins.tolist(), scan.ends.tolist()):
            piece = scan.data[a:b]
            piece = piece[~gone[a:b]].tobytes() if total[b] > total[a] else piece.tobytes()
            kept.append(hashlib.sha256(piece).digest() if digest else piece)
        yield record(CUT, doc_id=[None if i == LAST else i for i in scan.ids.tolist()], n_bytes=scan.ends - scan.begins,
                     n_removed=total[scan.ends] - total[scan.begins], n_spans=starts[scan.ends] - starts[scan.begins], kept=kept)

    return solve


def remove_repeats(docs, chunk_bytes=8 << 20, index_bytes=1 << 20, common=512, crowd=4096, digest=False):
    """(doc_id, n_bytes, n_removed, n_spans, kept): ``kept`` bytes, or with ``digest`` their sha256.

    ``common`` chunks or ``crowd`` distinct stretches make an anchor common. So the stretches
    of any other anchor, which all meet in one index, are fewer than 64 * ``common`` + ``crowd``.
    """
    chunks = written(pack(docs, chunk_bytes), "repeats-chunks")
    total, n_chunks = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    n_chunks = max(1, n_chunks)
    # Chunks and routes both grow with the root of the corpus beyond some GB, so that a
    # message keeps a useful size; an index inside a route is bounded by index_bytes.
    n_routes = max(1, min(math.ceil(total / (1 << 20)), math.ceil(4 * math.sqrt(total / (1 << 20)))))
    def step(messages, label):
        with shuffles_removed(docs.sparkSession):
            return written(messages, label)

    marks = step(by_route(send_anchors(chunks, n_routes), n_routes, shared_anchors(common, crowd)), "repeats-marks")
    told = of_kind(marks, 0)
    asks = step(by_route(by_chunk(chunks, marks, n_chunks, send_hashes(n_routes), MESSAGE), n_routes, asked), "repeats-asks")
    told = told.unionByName(of_kind(asks, 1))
    found = step(by_route(by_chunk(chunks, told, n_chunks, send_stretches(n_routes), MESSAGE), n_routes, earlier(index_bytes)), "repeats-found")
    told = told.unionByName(of_kind(found, 2))
    return by_chunk(chunks, told, n_chunks, cut_texts(n_routes, digest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(found):
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))
