"""Matroska media columns: EBML elements, clusters, lacing and cues to packet tables.

``mux`` stores a payload losslessly as an uncompressed 8-bit mono PCM track; ``parse``
walks any Matroska file of known or unknown element sizes and yields its tracks, cue
points and packets (track, timestamp, byte range, keyframe, lacing). Both are plain
functions of one value; ``media`` and ``packets`` apply them to DataFrame columns in
Arrow batches, without a shuffle.

Defined cases: NULL media give no packets; NULL text counts as empty; an empty text is
padded to one frame; truncated or malformed files give the packets before the fault and
``ok`` false; repeated rows give equal values; further columns are not read.
"""

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import batches, record

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1
SAMPLING, CHANNELS, BIT_DEPTH, TIMESTAMP_SCALE, TIMESTAMP = 0xB5, 0x9F, 0x6264, 0x2AD7B1, 0xE7
SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DURATION = 0x4282, 0x4489
MASTERS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES}

#: Bytes (samples) of a frame, frames of a block, blocks of a cluster.
UNIT, FRAME, LACE, BLOCKS = 192, 768, 8, 16
RATE = 8000
#: Bytes of a payload whose level is summed at once.
LEVEL = 1 << 20


def vint(n, width=0):
    """A variable-length size; all ones in the value bits are reserved for "unknown"."""
    while width == 0 or n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident, body):
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident, n):
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames, kind):
    """Lacing bits and the head of a block's frames: 1 Xiph, 2 fixed size, 3 EBML."""
    if len(frames) == 1:
        return 0, b""
    sizes = [len(f) for f in frames]
    if kind == 2 and len(set(sizes)) > 1:
        kind = 3
    head = bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 3:
        head += vint(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1]):
            d, w = b - a, 1
            while abs(d) > (1 << 7 * w - 1) - 1:
                w += 1
            head += ((d + (1 << 7 * w - 1) - 1) | 1 << 7 * w).to_bytes(w, "big")
    return kind, head


def mux(payload):
    """A Matroska file of one PCM track holding ``payload``; lacing kinds alternate."""
    frames = [payload[i:i + FRAME] for i in range(0, len(payload), FRAME)]
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", float(RATE))) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    clusters, cues, at = [], [], len(info) + len(tracks)
    per = LACE * BLOCKS
    for c in range(0, len(frames), per):
        start = c * FRAME * 1000 // RATE
        body = [uint(TIMESTAMP, start)]
        for b in range(c, min(c + per, len(frames)), LACE):
            group = frames[b:b + LACE]
            kind, head = laced(group, (3, 2, 1)[b // LACE % 3])
            relative = b * FRAME * 1000 // RATE - start
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", relative, 0x80 | kind << 1) + head + b"".join(group)))
        cues.append(element(CUE_POINT, uint(CUE_TIME, start) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        clusters.append(element(CLUSTER, b"".join(body)))
        at += len(clusters[-1])
    body = info + tracks + b"".join(clusters) + element(CUES, b"".join(cues))
    return element(EBML, element(DOC_TYPE, b"matroska")) + element(SEGMENT, body)


class Fault(ValueError):
    """The bytes are no well-formed element."""


def read_id(data, at, end):
    if at >= end or data[at] == 0:
        raise Fault(at)
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > end:
        raise Fault(at)
    return int.from_bytes(data[at:at + width], "big"), at + width


def read_vint(data, at, end):
    """(value, position after it); None for the unknown size."""
    if at >= end or data[at] == 0:
        raise Fault(at)
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Fault(at)
    n = int.from_bytes(data[at:at + width], "big") & (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def elements(data, at, end):
    """Depth-first (id, start of body, end of body) of all elements in a range.

    A master of unknown size ends where an element of an upper level begins.
    """
    stack = [(None, end, True)]
    while True:
        while len(stack) > 1 and at >= stack[-1][1]:
            stack.pop()
        if at >= end:
            return
        ident, body = read_id(data, at, end)
        size, body = read_vint(data, body, end)
        while len(stack) > 1 and not stack[-1][2] and (ident in (EBML, SEGMENT) or ident in TOP_LEVEL and stack[-1][0] != SEGMENT):
            stack.pop()
        stop = stack[-1][1] if size is None else body + size
        if stop > stack[-1][1] or size is None and ident not in MASTERS:
            raise Fault(at)
        yield ident, body, stop
        if ident in MASTERS:
            stack.append((ident, stop, size is not None))
            at = body
        else:
            at = stop


def frames_of(data, at, end):
    """(track, relative timestamp, flags, [(start, end)]) of a block."""
    track, at = read_vint(data, at, end)
    if at + 3 > end:
        raise Fault(at)
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags >> 1 & 3
    if kind == 0:
        return track, relative, flags, [(at, end)]
    if at >= end:
        raise Fault(at)
    n, at = data[at] + 1, at + 1
    sizes = []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise Fault(at)
                size, at = size + data[at], at + 1
                if data[at - 1] < 255:
                    break
            sizes.append(size)
    elif kind == 3 and n > 1:
        size, at = read_vint(data, at, end)
        sizes.append(size)
        for _ in range(n - 2):
            first = at
            d, at = read_vint(data, at, end)
            size += (d if d is not None else (1 << 7 * (at - first)) - 1) - ((1 << 7 * (at - first) - 1) - 1)
            sizes.append(size)
    elif kind == 2:
        if (end - at) % n:
            raise Fault(at)
        sizes = [(end - at) // n] * (n - 1)
    out = []
    for size in sizes:
        if size is None or size < 0 or at + size > end:
            raise Fault(at)
        out.append((at, at + size))
        at += size
    return track, relative, flags, out + [(at, end)]


def parse(data):
    """{"tracks", "cues", "packets", "ok"} of a Matroska file.

    A packet is (track, timestamp in ns, start, end, keyframe, lacing, cluster); frames
    of one block share its timestamp, spread evenly where the block has a duration.
    """
    tracks, cues, packets, ok = [], [], [], True
    scale, base, cluster, segment, group = 1_000_000, 0, -1, 0, {}

    def number(a, b):
        return int.from_bytes(data[a:b], "big")

    def add(block, duration, key):
        track, relative, flags, spans = block
        for i, (a, b) in enumerate(spans):
            shift = duration * i // len(spans) if duration else 0
            packets.append((track, (base + relative + shift) * scale, a, b, key, flags >> 1 & 3, cluster))

    def close():
        if "block" in group:
            add(group["block"], group.get("duration", 0), "reference" not in group)
        group.clear()

    try:
        for ident, a, b in elements(data, 0, len(data)):
            if ident not in (BLOCK, BLOCK_DURATION, REFERENCE):
                close()
            if ident == SEGMENT:
                segment = a
            elif ident == TIMESTAMP_SCALE:
                scale = number(a, b)
            elif ident == TRACK_ENTRY:
                tracks.append({"number": 0, "type": 0, "codec": "", "bits": 0, "rate": 0.0})
            elif tracks and ident in (TRACK_NUMBER, TRACK_TYPE, BIT_DEPTH):
                tracks[-1][{TRACK_NUMBER: "number", TRACK_TYPE: "type", BIT_DEPTH: "bits"}[ident]] = number(a, b)
            elif tracks and ident == CODEC_ID:
                tracks[-1]["codec"] = bytes(data[a:b]).rstrip(b"\0").decode("utf-8", "replace")
            elif tracks and ident == SAMPLING and b - a in (4, 8):
                tracks[-1]["rate"] = struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0]
            elif ident == CLUSTER:
                cluster, base = cluster + 1, 0
            elif ident == TIMESTAMP:
                base = number(a, b)
            elif ident == SIMPLE_BLOCK:
                block = frames_of(data, a, b)
                add(block, 0, bool(block[2] & 0x80))
            elif ident == BLOCK:
                group["block"] = frames_of(data, a, b)
            elif ident == BLOCK_DURATION:
                group["duration"] = number(a, b)
            elif ident == REFERENCE:
                group["reference"] = True
            elif ident == CUE_POINT:
                cues.append([0, 0, -1])
            elif cues and ident == CUE_TIME:
                cues[-1][0] = number(a, b) * scale
            elif cues and ident == CUE_TRACK:
                cues[-1][1] = number(a, b)
            elif cues and ident == CUE_CLUSTER:
                cues[-1][2] = segment + number(a, b)
        close()
    except (Fault, struct.error):
        ok = False
    return {"tracks": tracks, "cues": [tuple(c) for c in cues], "packets": packets, "ok": ok}


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
PACKETS = pa.schema([("doc_id", pa.int64()), ("track", pa.int64()), ("timestamp_ns", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
                     ("keyframe", pa.bool_()), ("lacing", pa.int32()), ("cluster", pa.int64())])


def padded(data):
    return data + b" " * ((-len(data)) % UNIT or (0 if data else UNIT))


def media(docs):
    """(doc_id, n_bytes, media): every whole text as an uncompressed track."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(iterator):
        for b in batches(iterator, 8 << 20):
            texts = b.column(1).to_pylist()
            yield record(MEDIA, doc_id=b.column(0).to_pylist(), n_bytes=[len(t) for t in texts], media=[mux(padded(t)) for t in texts])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packets(files):
    """One row per packet of (doc_id, media), with its byte range in the file."""

    def run(iterator):
        for b in batches(iterator, 4 << 20):
            rows = [(i, *p) for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if m is not None for p in parse(m)["packets"]]
            yield record(PACKETS, **dict(zip(PACKETS.names, zip(*rows) if rows else [[]] * 8)))

    return files.select("doc_id", "media").mapInArrow(run, "doc_id long, track long, timestamp_ns long, start long, end long, keyframe boolean, lacing int, cluster long")


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
                    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def features(files):
    """Payload read back through the packet table, digests and a summary of the file.

    ``level`` is the distance from silence (128) summed over all bytes of the payload.
    """

    def of(data):
        found = parse(data)
        payload = b"".join([data[p[2]:p[3]] for p in found["packets"]])
        track = found["tracks"][0] if found["tracks"] else {"codec": "", "bits": 0, "rate": 0}
        lacing = "/".join(str(sum(p[5] == k for p in found["packets"])) for k in range(4))
        last = max((p[1] for p in found["packets"]), default=0)
        level = sum(int(np.abs(np.frombuffer(payload, np.uint8, min(LEVEL, len(payload) - i), i).astype(np.int16) - 128).sum(dtype=np.int64)) for i in range(0, len(payload), LEVEL))
        feature = (f"codec={track['codec']};bits={track['bits']};rate={track['rate']:g};tracks={len(found['tracks'])};clusters={found['packets'][-1][6] + 1 if found['packets'] else 0};"
                   f"packets={len(found['packets'])};lacing={lacing};cues={len(found['cues'])};last_ns={last};level={level};ok={int(found['ok'])}")
        return payload, feature

    def run(iterator):
        for b in batches(iterator, 4 << 20):
            out = []
            for i, n, m in zip(*(c.to_pylist() for c in b.columns)):
                payload, feature = of(m)
                out.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            yield record(DIGEST, **dict(zip(DIGEST.names, zip(*out))))

    return files.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
