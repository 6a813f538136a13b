"""Media columns by signature sniffing.

Aho-Corasick finds the magic bytes of all known formats in one pass over a value; a validator for each format then
walks its structure (chunk lengths, checksums, trailers) and gives the length, or rejects the hit. What stands at
offset 0 corrects the declared type; what stands further in is carved.

Edge cases: a null value counts as empty bytes, has no type of its own (application/octet-stream) and nothing carved;
repeated rows are sniffed each; truncated or corrupt structures are rejected, not guessed.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_slices

UNKNOWN = "application/octet-stream"
#: Magic bytes, the offset at which they stand in a file, and the format's type.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"BM", 0, "image/bmp"),
    (b"WAVE", 8, "audio/wav"),
    (b"WEBP", 8, "image/webp"),
    (b"OggS", 0, "application/ogg"),
    (b"%PDF-", 0, "application/pdf"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
]


def _png(d, at):
    p = at + 8
    while p + 12 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, p)
        if p + 12 + n > len(d) or (p == at + 8) != (kind == b"IHDR") or zlib.crc32(d[p + 4 : p + 8 + n]) != struct.unpack_from(">I", d, p + 8 + n)[0]:
            return 0
        p += 12 + n
        if kind == b"IEND":
            return p - at
    return 0


def _jpeg(d, at):
    p, scan = at + 2, False
    while p + 4 <= len(d):
        if d[p] != 0xFF:
            return 0
        kind = d[p + 1]
        if kind == 0xD9:
            return p + 2 - at if scan else 0
        if kind == 0xFF:
            p += 1
            continue
        if kind < 0xC0 or 0xD0 <= kind <= 0xD8:
            return 0
        n = struct.unpack_from(">H", d, p + 2)[0]
        if n < 2:
            return 0
        p += 2 + n
        if kind == 0xDA:  # coded data: to the next marker that is neither stuffed nor a restart
            scan = True
            while (p := d.find(b"\xff", p)) >= 0 and p + 1 < len(d) and (d[p + 1] == 0 or 0xD0 <= d[p + 1] <= 0xD7):
                p += 2
            if p < 0:
                return 0
            if p + 2 <= len(d) and d[p + 1] == 0xD9:
                return p + 2 - at
    return 0


def _gif(d, at):
    if at + 13 > len(d):
        return 0
    p = at + 13 + (3 << ((d[at + 10] & 7) + 1) if d[at + 10] & 0x80 else 0)

    def blocks(p):
        while p < len(d) and d[p]:
            p += 1 + d[p]
        return p + 1

    seen = False
    while p < len(d):
        if d[p] == 0x3B:
            return p + 1 - at if seen else 0
        if d[p] == 0x21:
            p = blocks(p + 2)
        elif d[p] == 0x2C and p + 10 <= len(d):
            p, seen = blocks(p + 11 + (3 << ((d[p + 9] & 7) + 1) if d[p + 9] & 0x80 else 0)), True
        else:
            return 0
    return 0


def _bmp(d, at):
    if at + 54 > len(d):
        return 0
    n, zero, pixels, head = struct.unpack_from("<IIII", d, at + 2)
    planes, bits = struct.unpack_from("<HH", d, at + 26)
    ok = zero == 0 and head in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + head <= pixels < n <= len(d) - at
    return n if ok else 0


def _riff(d, at):
    if d[at : at + 4] != b"RIFF" or at + 12 > len(d):
        return 0
    n = struct.unpack_from("<I", d, at + 4)[0] + 8
    p, end, kinds = at + 12, at + n, set()
    if n < 12 or end > len(d):
        return 0
    while p < end:
        if p + 8 > end:
            return 0
        kind, k = struct.unpack_from("<4sI", d, p)
        kinds.add(kind)
        p += 8 + k + k % 2
    need = {b"fmt ", b"data"} if d[at + 8 : at + 12] == b"WAVE" else set()
    return n if p == end and kinds and need <= kinds else 0


def _ogg(d, at):
    p, last = at, False
    while d[p : p + 4] == b"OggS" and p + 27 <= len(d) and p + 27 + d[p + 26] <= len(d) and not last:
        last = bool(d[p + 5] & 4)
        q = p + 27 + d[p + 26]
        p = q + sum(d[p + 27 : q])
        if p > len(d):
            return 0
    return p - at if last else 0


#: A PDF's header; what an update adds after an end starts with objects, a table or a trailer.
_PDF_HEAD, _PDF_MORE = re.compile(rb"%PDF-[12]"), re.compile(rb"\s*(?:%[^\r\n]*[\r\n]\s*)*(?:\d+\s+\d+\s+obj\b|xref\b|trailer\b|startxref\b)")
_PDF_LINEAR = re.compile(rb"\s*(?:%[^\r\n]*[\r\n]+\s*)*\d+\s+\d+\s+obj\s*<<(?=[^>]*/Linearized\b)[^>]*/L\s+(\d+)")


def _pdf(d, at):
    """Up to the last end that belongs to the file: each section of a linearized or updated file has one of its own."""
    if d[at + 5 : at + 6] not in (b"1", b"2"):
        return 0
    start, end = d.find(b"startxref", at), 0
    if linear := _PDF_LINEAR.match(d, at + 8, at + 2048):
        whole = at + int(linear[1])
        if whole <= len(d) and d.rfind(b"%%EOF", max(at, whole - 16), whole) >= 0:
            end = d.rfind(b"%%EOF", at, whole) + 5
            start = d.find(b"startxref", end) if _PDF_MORE.match(d, end) else -1
    while start >= 0 and (here := d.find(b"%%EOF", start)) >= 0:
        head = _PDF_HEAD.search(d, end or at + 5, here)
        if end and head:
            break  # of another file
        end = here + 5
        if not _PDF_MORE.match(d, end):
            break
        start = d.find(b"startxref", end)
    return end - at if end else 0


def _gzip(d, at):
    z = zlib.decompressobj(31)
    try:
        p = at
        while p < len(d) and not z.eof:
            z.decompress(z.unconsumed_tail or d[p : p + 65536], 1 << 20)
            if not z.unconsumed_tail:
                p += 65536
    except zlib.error:
        return 0
    return min(p, len(d)) - len(z.unused_data) - at if z.eof else 0


#: The validator of each type: the length of the structure at an offset, or 0.
VALID = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "audio/wav": _riff, "image/webp": _riff,
    "application/ogg": _ogg, "application/pdf": _pdf, "application/gzip": _gzip,
}


@functools.cache
def _finder():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, off, kind in MAGIC:
        found.add_word(magic.decode("latin-1"), (len(magic), off, kind))
    found.make_automaton()
    return found


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of every valid structure that does not lie inside an earlier one, but for the first: what lies inside a structure at 0 is listed too."""
    hits = sorted((end + 1 - n - off, kind) for end, (n, off, kind) in _finder().iter(data.decode("latin-1")) if end + 1 - n - off >= 0)
    out, over = [], 0
    for at, kind in hits:
        if (at >= over or not at) and (n := VALID[kind](data, at)):
            out.append((at, n, kind))
            over = at + n if at else 0
    return out


def wav(payload: bytes, rate: int = 8000) -> bytes:
    """One channel of 8-bit samples."""
    pad = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def samples(data: bytes) -> bytes:
    """The samples of a WAV value."""
    p = 12
    while data[p : p + 4] != b"data":
        p += 8 + (n := struct.unpack_from("<I", data, p + 4)[0]) + n % 2
    return data[p + 8 : p + 8 + struct.unpack_from("<I", data, p + 4)[0]]


def sniffed(df: DataFrame, key: str = "media_id", declared: str = "declared", content: str = "content") -> DataFrame:
    """key, declared, media_type (corrected), is_corrected and carved: the structures that lie further in, with their bytes."""

    def make():
        def fn(b):
            kinds, carved = [], []
            for d in (x or b"" for x in b.column("content").to_pylist()):
                found = sniff(d)
                kinds.append(next((k for at, _, k in found if not at), UNKNOWN))
                carved.append([{"at": at, "length": n, "media_type": k, "content": d[at : at + n]} for at, n, k in found if at])
            return {"key": b.column("key"), "declared": b.column("declared"), "media_type": kinds, "is_corrected": [k != x for k, x in zip(kinds, b.column("declared").to_pylist(), strict=True)], "carved": carved}

        return fn

    kind = dict(df.dtypes)[key]
    out = map_slices(df.select(F.col(key).alias("key"), F.col(declared).cast("string").alias("declared"), F.col(content).cast("binary").alias("content")), make, f"key {kind}, declared string, media_type string, is_corrected boolean, carved array<struct<at:long,length:long,media_type:string,content:binary>>", 32)
    return out.withColumnRenamed("key", key)


def text_media(docs: DataFrame, block: int = 64) -> DataFrame:
    """Every text stored as 8-bit samples, sniffed, read back and measured: the digests of the stored and of the read bytes."""

    def make():
        def fn(b):
            rows = []
            for t in b.column("text").to_pylist():
                raw = (t or "").encode("utf-8", "surrogatepass")
                stored = wav(raw + b"\0" * (max(1, -(-len(raw) // block)) * block - len(raw)))
                found = sniff(stored)
                kind = next((k for at, _, k in found if not at), UNKNOWN)
                back = samples(stored) if kind == "audio/wav" else b""
                x = np.frombuffer(back, np.uint8)
                bins = np.bincount(x, minlength=256)
                mean = float(bins @ np.arange(256)) / max(1, len(x))
                p = bins[bins > 0] / max(1, len(x))
                feature = f"{kind};samples={len(x)};mean={mean:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};peak={int(x.max(initial=0))};carved={sum(1 for at, _, _ in found if at)}"
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-block:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            return {"doc_id": b.column("doc_id")} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

        return fn

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", 64)
