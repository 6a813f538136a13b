"""WARC archives: a writer of one gzip member per record, and a sequential reader of any such archive.

The reader decompresses a member at a time in small pieces, frames the block by its content length, and verifies block
and payload digests. Records of equal payloads are written once in full; the others revisit it.

Edge cases: a null html counts as an empty payload; where all rows of a group have a null page_id, or where rows of
the largest page_id are repeated, each of those is a response; rows are kept one to one; an empty table gives empty
archives; corrupt or truncated archives raise ValueError in the reader.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut, map_slices, written

#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 4 << 20
#: The date of all records, as results must not depend on the clock.
DATE = "2024-01-01T00:00:00Z"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, ident: str, block: bytes, headers: dict[str, str]) -> bytes:
    """One record as a gzip member."""
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<{ident}>", "WARC-Date": DATE, "WARC-Block-Digest": f"sha1:{sha1(block)}", "Content-Length": str(len(block))} | headers
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


@dataclass
class Record:
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    @property
    def payload(self) -> bytes:
        """The block after the HTTP header of responses; else the block."""
        return self.block.partition(b"\r\n\r\n")[2] if self.headers.get("content-type", "").startswith("application/http") else self.block

    def http(self, name: str) -> str | None:
        for line in self.block.partition(b"\r\n\r\n")[0].decode("latin-1").split("\r\n")[1:]:
            if line.lower().startswith(name.lower() + ":"):
                return line.partition(":")[2].strip()
        return None


def _member(pieces: Iterator[bytes], rest: bytes) -> tuple[Iterator[bytes], list[bytes]]:
    """Decompressed pieces of the member that starts with rest; when they are used up, the list holds what follows it."""
    after: list[bytes] = []

    def run():
        z, data = zlib.decompressobj(31), rest
        while not z.eof:
            if not data and not (data := next(pieces, b"")):
                raise ValueError("truncated archive")
            try:
                got = z.decompress(data, 1 << 16)
            except zlib.error as e:
                raise ValueError(f"corrupt archive: {e}") from e
            data = z.unconsumed_tail
            if got:
                yield got
        after.append(z.unused_data)

    return run(), after


def read(pieces: Iterator[bytes]) -> Iterator[Record]:
    """Records of an archive that comes in pieces of any length; a record and a piece are held at a time."""
    pieces, rest = iter(pieces), b""
    while rest or (rest := next(pieces, b"")):
        member, after = _member(pieces, rest)
        held = bytearray()
        while (end := held.find(b"\r\n\r\n")) < 0:
            if (got := next(member, None)) is None:
                raise ValueError("a record without a header")
            held += got
        version, *lines = bytes(held[:end]).decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(headers["content-length"])
        body = held[end + 4 :]
        while len(body) < n + 4 and (got := next(member, None)) is not None:
            body += got
        if any(member) or len(body) != n + 4 or body[n:] != b"\r\n\r\n":
            raise ValueError("a record's length is not its content length")
        r = Record(headers, bytes(body[:n]))
        if (d := headers.get("warc-block-digest")) and d != f"sha1:{sha1(r.block)}":
            raise ValueError("a block differs from its digest")
        if headers["warc-type"] == "response" and (d := headers.get("warc-payload-digest")) and d != f"sha1:{sha1(r.payload)}":
            raise ValueError("a payload differs from its digest")
        yield r
        rest = after[0]


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: for each page whose payload a page of larger id has too, the largest such id."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # the ids of payloads that repeat, apart from the payloads; its own exchange lets a hot payload's rows be split
    most = cut(own.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("most"), F.count("*").alias("n")).where("n > 1").select("digest", "most"))
    return own.join(most, "digest", "left").select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("most")), F.col("most")).alias("refers_to"))


def archives(planned: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """name and content of the archives that hold a record of every page."""

    def make():
        held, size, made = [], 0, 0

        class Writer:
            def __call__(self, b):
                nonlocal held, size, made
                names, blobs = [], []
                for page_id, url, html, to in zip(*(b.column(k).to_pylist() for k in ("page_id", "url", "html", "refers_to")), strict=True):
                    payload, ident = html.encode("utf-8", "surrogatepass"), "urn:x-page:" + ("" if page_id is None else str(page_id))
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                    more = {"WARC-Target-URI": " ".join((url or ident).split()) or ident, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{sha1(payload)}"}
                    if to is None:
                        held.append(record("response", ident, http + payload, more))
                    else:
                        held.append(record("revisit", ident, http, more | {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:x-page:{to}>"}))
                    size += len(held[-1])
                    if size >= archive_bytes:
                        names.append(self.name())
                        blobs.append(b"".join(held))
                        held, size = [], 0
                return {"name": names, "content": blobs} if names else None

            def name(self):
                nonlocal made
                from pyspark import TaskContext

                made += 1
                return f"pages-{TaskContext.get().partitionId():05d}-{made:05d}.warc.gz"

            def end(self):
                return {"name": [self.name()], "content": [b"".join(held)]} if held else None

        return Writer()

    return map_slices(planned, make, "name string, content binary")


def records(found: DataFrame, piece: int = 1 << 16, payloads: bool = False) -> DataFrame:
    """The records of archives, given as `content` (as spark.read.format('binaryFile') gives them too)."""

    def make():
        def fn(b):
            out: dict[str, list] = {k: [] for k in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")}
            for data in b.column("content").to_pylist():
                for r in read(data[i : i + piece] for i in range(0, len(data or b""), piece)):
                    kind = r.headers["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    number = lambda k, r=r: int(x) if (x := r.headers.get(k, "").strip("<>").rpartition(":")[2]).lstrip("-").isdigit() else None
                    out["page_id"].append(number("warc-record-id"))
                    out["url"].append(r.headers.get("warc-target-uri"))
                    out["payload_bytes"].append(len(r.payload) if kind == "response" else int(r.http("Content-Length") or 0))
                    out["payload_digest"].append(sha1(r.payload) if kind == "response" else r.headers["warc-payload-digest"].removeprefix("sha1:"))
                    out["record_type"].append(kind)
                    out["refers_to"].append(number("warc-refers-to") if kind == "revisit" else None)
                    out["payload"].append(r.payload if payloads and kind == "response" else None)
            return out

        return fn

    return map_slices(found.select("content"), make, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary", 1)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages written to archives in the shared folder, and the archives' records."""
    return records(written(archives(planned(pages, least)))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
