"""Fill-in-middle over seekable compressed frames.

A text is stored as independent zstandard frames, each with the units (lines), code points
and bytes up to its end. A cut after ``k`` units is found by bisecting the cumulative unit
counts and decompressing the one frame that holds it; a document is rearranged by reading
byte ranges, frame by frame, into a new set of frames; digests stream frames in order.
At no time is more than a frame or two of a text decompressed.

Defined cases: a NULL text is empty; an empty text and one that already holds a marker stay
plain (their output is the text); a NULL doc_id hashes as no digits at all; equal ids cut
alike, repeated rows are kept; a text without a line end is one line; an empty table gives
no rows; further columns do not take part.
"""

import bisect
import hashlib

import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from .common import batches, record

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FRAME = 64 << 10
#: Bytes of UTF-8 that do not start a code point.
CONTINUED = bytes(range(0x80, 0xC0))


class Frames:
    """Frames of one text with cumulative units, code points and bytes (``ends``)."""

    def __init__(self, data=(), ends=((), (), ())):
        self.data, (self.units, self.chars, self.bytes) = list(data), map(list, ends)
        self.opened = 0

    @classmethod
    def store(cls, chunks, size=FRAME, level=1):
        """Frames of a stream of byte chunks, each of ``size`` bytes but for the last."""
        out, pack, held = cls(), zstandard.ZstdCompressor(level=level), b""
        for chunk in chunks:
            held = held + chunk if held else chunk
            at = 0
            while len(held) - at > size:
                out.add(held[at:at + size], pack)
                at += size
            held = held[at:]
        if held:
            out.add(held, pack)
            if not held.endswith(b"\n"):
                out.units[-1] += 1  # the last line has no end
        return out

    def add(self, raw, pack):
        self.data.append(pack.compress(raw))
        for ends, n in ((self.units, raw.count(b"\n")), (self.chars, len(raw.translate(None, CONTINUED))), (self.bytes, len(raw))):
            ends.append((ends[-1] if ends else 0) + n)

    def total(self, ends):
        return ends[-1] if ends else 0

    def open(self, i):
        self.opened += 1
        return zstandard.ZstdDecompressor().decompress(self.data[i])

    def cut(self, k):
        """(bytes, code points) of the first ``k`` units; opens one frame at most."""
        if k <= 0:
            return 0, 0
        if k >= self.total(self.units):
            return self.total(self.bytes), self.total(self.chars)
        i = bisect.bisect_left(self.units, k)
        before = (lambda ends: ends[i - 1] if i else 0)
        raw, at = self.open(i), 0
        for _ in range(k - before(self.units)):
            at = raw.index(b"\n", at) + 1
        return before(self.bytes) + at, before(self.chars) + len(raw[:at].translate(None, CONTINUED))

    def read(self, start, end):
        """Byte chunks of the range, one for each frame that it touches."""
        i = bisect.bisect_right(self.bytes, start)
        while start < end:
            first = self.bytes[i - 1] if i else 0
            raw = self.open(i)
            yield raw[start - first:end - first]
            start, i = self.bytes[i], i + 1

    def all(self):
        return self.read(0, self.total(self.bytes))

    def find(self, marker, start=0):
        """Byte offset of the first ``marker`` from ``start`` on, or -1; joins of frames included."""
        tail, at = b"", start
        for chunk in self.read(start, self.total(self.bytes)):
            both = tail + chunk
            hit = both.find(marker)
            if hit >= 0:
                return at - len(tail) + hit
            at += len(chunk)
            tail = both[-(len(marker) - 1):]
        return -1

    def sha256(self, *ranges):
        h = hashlib.sha256()
        for start, end in ranges or [(0, self.total(self.bytes))]:
            for chunk in self.read(start, end):
                h.update(chunk)
        return h.hexdigest()


def draws(doc_id, seed):
    """Four 32-bit numbers of a document, from the sha256 of ``seed:doc_id``."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i:i + 8], 16) for i in (0, 8, 16, 24)]


def arrange(text, doc_id, seed=7, rate=100, spm=50, size=FRAME):
    """(form, prefix code points, middle code points, output frames) of a stored text."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    n = text.total(text.units)
    if not n or h3 % 100 >= rate or any(text.find(m) >= 0 for m in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", None, None, text
    (a, chars_a), (b, chars_b) = (text.cut(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    form = "spm" if h4 % 100 < spm else "psm"

    def chunks():
        prefix, suffix = (PREFIX, 0, a), (SUFFIX, b, text.total(text.bytes))
        for marker, start, end in ([suffix, prefix] if form == "spm" else [prefix, suffix]) + [(MIDDLE, a, b)]:
            yield marker
            yield from text.read(start, end)

    return form, chars_a, chars_b - chars_a, Frames.store(chunks(), size)


def ranges(output, form):
    """Byte ranges of prefix, middle and suffix in a stored output, found by its markers alone."""
    end = output.total(output.bytes)
    if form == "plain":
        return [(0, end), (end, end), (end, end)]
    second = output.find(SUFFIX if form == "psm" else PREFIX, 3)
    third = output.find(MIDDLE, second + 3)
    one, two, middle = (3, second), (second + 3, third), (third + 3, end)
    return [one, middle, two] if form == "psm" else [two, middle, one]


STORED = "doc_id long, frames array<binary>, units array<long>, chars array<long>, bytes array<long>"


def stored(docs, size=FRAME):
    """Every whole text as seekable frames: (doc_id, frames, units, chars, bytes)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    lists = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("frames", pa.list_(pa.binary())), ("units", lists), ("chars", lists), ("bytes", lists)])

    def run(iterator):
        for b in batches(iterator, 8 << 20):
            made = [Frames.store([t], size) for t in b.column(1).to_pylist()]
            yield record(schema, doc_id=b.column(0), frames=[f.data for f in made], units=[f.units for f in made], chars=[f.chars for f in made], bytes=[f.bytes for f in made])

    return rows.mapInArrow(run, STORED)


def opened(batch):
    """(doc_id, Frames) of every row of a stored batch."""
    for doc_id, data, *ends in zip(*[c.to_pylist() for c in batch.columns[:5]]):
        yield doc_id, Frames(data, ends)


def fill_in_middle(texts, seed=7, rate=100, spm=50, size=FRAME):
    """Stored texts rearranged: (doc_id, frames, ... of the output, n, form, prefix_chars, middle_chars)."""
    lists = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("frames", pa.list_(pa.binary())), ("units", lists), ("chars", lists), ("bytes", lists),
                        ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])

    def run(iterator):
        for b in batches(iterator, 8 << 20):
            ids, out, n = [], [], []
            for doc_id, text in opened(b):
                ids.append(doc_id)
                n.append(text.total(text.units))
                out.append(arrange(text, doc_id, seed, rate, spm, size))
            made = [o[3] for o in out]
            yield record(schema, doc_id=ids, frames=[f.data for f in made], units=[f.units for f in made], chars=[f.chars for f in made], bytes=[f.bytes for f in made],
                         n=n, form=[o[0] for o in out], prefix_chars=[o[1] for o in out], middle_chars=[o[2] for o in out])

    return texts.select("doc_id", "frames", "units", "chars", "bytes").mapInArrow(run, f"{STORED}, n long, form string, prefix_chars long, middle_chars long")


def text(outputs):
    """The training texts themselves: (doc_id, form, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("form", pa.string()), ("text", pa.string())])

    def run(iterator):
        for b in batches(iterator, 2 << 20):
            rows = list(opened(b))
            yield record(schema, doc_id=[i for i, _ in rows], form=b.column(5), text=[b"".join(f.all()).decode() for _, f in rows])

    return outputs.select("doc_id", "frames", "units", "chars", "bytes", "form").mapInArrow(run, "doc_id long, form string, text string")


def digest(outputs):
    """Hashes of every output and of the text rebuilt from output and form, streamed by frames."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
                        ("output_sha256", pa.string()), ("restored_sha256", pa.string())])

    def run(iterator):
        for b in batches(iterator, 8 << 20):
            rows, forms = list(opened(b)), b.column(6).to_pylist()
            yield record(schema, doc_id=b.column(0), n=b.column(5), form=b.column(6), prefix_chars=b.column(7), middle_chars=b.column(8),
                         output_sha256=[f.sha256() for _, f in rows], restored_sha256=[f.sha256(*ranges(f, form)) for (_, f), form in zip(rows, forms)])

    return outputs.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
l AS (SELECT *, string_split(text, chr(10)) AS p FROM t),
n AS (SELECT *, len(p) - 1 AS ends, len(p) - CASE WHEN text = '' OR p[-1] = '' THEN 1 ELSE 0 END AS n FROM l),
h AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS d FROM n),
k AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi, text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 100 AS plain FROM h),
q AS (SELECT *, CASE WHEN lo = 0 THEN '' WHEN lo <= ends THEN array_to_string(p[1:lo], chr(10)) || chr(10) ELSE text END AS one,
 CASE WHEN hi = 0 THEN '' WHEN hi <= ends THEN array_to_string(p[1:hi], chr(10)) || chr(10) ELSE text END AS two FROM k),
r AS (SELECT doc_id, n, text, plain, d, one AS prefix, substr(two, length(one) + 1) AS middle, substr(text, length(two) + 1) AS suffix FROM q)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN d < 50 THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
 sha256(CASE WHEN plain THEN text WHEN d < 50 THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM r
"""
