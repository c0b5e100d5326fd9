"""WARC records in ZIP-packaged archives, written and read by range.

Pages are packed into archives of bounded size. An archive is a ZIP file with two stored (uncompressed) members:
``archive/data.warc.gz``, one gzip member per WARC record, and ``indexes/index.tsv`` with record id, offset and length.
Reading parses the end-of-central-directory record, ZIP64 locator and directory where present, and the central
directory; finds the members' data from their local headers; and range-reads one record after another through the
index. Nothing is extracted.

Archives are rows of a table (one binary file each), so any store that Spark reaches will do; :class:`ZipArchive`
reads any ``read_range(offset, length)``, so it serves files and object stores too.

Of records with equal payloads of at least ``min_bytes`` bytes, that with the largest id is a response and the others
are revisits of it, without a payload but with its digest and length. Defined cases: null payload counts as empty; null
url becomes a URN; rows with equal ids and payloads are alike (all are the response if theirs is the largest id);
a null id ranks below all others. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import zlib
from base64 import b32decode, b32encode
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.tsv"
ARCHIVE_BYTES = 4 << 20
DATE = "2020-01-01T00:00:00Z"
_EOCD, _EOCD64, _LOCATOR, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_MAX32 = 0xFFFFFFFF


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; with 64-bit records where sizes ask for them, or always."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        raw, crc, at = name.encode(), zlib.crc32(data), len(out)
        big = zip64 or len(data) >= _MAX32 or at >= _MAX32
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        n = _MAX32 if big else len(data)
        version = 45 if big else 20
        out += struct.pack("<4s5H3I2H", _LOCAL, version, 0x800, 0, 0, 0x21, crc, n, n, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if big else b""
        central += struct.pack("<4s6H3I5H2I", _CENTRAL, version, version, 0x800, 0, 0, 0x21, crc, n, n, len(raw), len(extra), 0, 0, 0, 0, _MAX32 if big else at) + raw + extra
    at, n = len(out), len(members)
    out += central
    if zip64 or at >= _MAX32 or n >= 0xFFFF:
        end = len(out)
        out += struct.pack("<4sQ2H2I4Q", _EOCD64, 44, 45, 45, 0, 0, n, n, len(central), at)
        out += struct.pack("<4sIQI", _LOCATOR, 0, end, 1)
        n, at, size = 0xFFFF, _MAX32, _MAX32
    else:
        size = len(central)
    return bytes(out + struct.pack("<4s4H2IH", _EOCD, 0, 0, n, n, size, at, 0))


class ZipArchive:
    """Reads a ZIP file through ``read_range(offset, length)``, of which ``size`` bytes exist."""

    def __init__(self, read_range: Callable[[int, int], bytes], size: int):
        self.read, self.size = read_range, size
        tail_at = max(0, size - 65_557)
        tail = read_range(tail_at, size - tail_at)
        end = tail.rfind(_EOCD)
        while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(_EOCD, 0, end + 3) if end else -1
        if end < 0:
            raise ValueError("no end of central directory")
        _, _, _, _, n, length, at, _ = struct.unpack_from("<4s4H2IH", tail, end)
        if n == 0xFFFF or length == _MAX32 or at == _MAX32:
            locator = read_range(tail_at + end - 20, 20)
            if locator[:4] != _LOCATOR:
                raise ValueError("no ZIP64 locator")
            record = read_range(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != _EOCD64:
                raise ValueError("no ZIP64 end of central directory")
            n, length, at = struct.unpack_from("<3Q", record, 32)
        self.members: dict[str, tuple[int, int, int, int]] = {}
        central, p = read_range(at, length), 0
        for _ in range(n):
            if central[p : p + 4] != _CENTRAL:
                raise ValueError("bad central directory")
            flags, method = struct.unpack_from("<2H", central, p + 8)
            crc, packed, unpacked, n_name, n_extra, n_comment = struct.unpack_from("<3I3H", central, p + 16)
            (offset,) = struct.unpack_from("<I", central, p + 42)
            name = central[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = central[p + 46 + n_name : p + 46 + n_name + n_extra]
            q = 0
            while q + 4 <= len(extra):
                tag, m = struct.unpack_from("<2H", extra, q)
                if tag == 1:
                    wide = iter(struct.unpack_from(f"<{m // 8}Q", extra, q + 4))
                    unpacked = next(wide) if unpacked == _MAX32 else unpacked
                    packed = next(wide) if packed == _MAX32 else packed
                    offset = next(wide) if offset == _MAX32 else offset
                q += 4 + m
            if unpacked != packed and method == 0:
                raise ValueError("stored member of two sizes")
            self.members[name] = (method, offset, packed, crc)
            p += 46 + n_name + n_extra + n_comment
        self.starts: dict[str, int] = {}

    def range(self, name: str, offset: int, length: int) -> bytes:
        """Bytes of a stored member, by its own offsets."""
        method, at, size, _ = self.members[name]
        if method:
            raise ValueError(f"{name} isn't stored")
        if offset < 0 or offset + length > size:
            raise ValueError("beyond the member's end")
        if name not in self.starts:
            local = self.read(at, 30)
            if local[:4] != _LOCAL:
                raise ValueError("bad local header")
            self.starts[name] = at + 30 + sum(struct.unpack_from("<2H", local, 26))
        return self.read(self.starts[name] + offset, length)

    def whole(self, name: str) -> bytes:
        data = self.range(name, 0, self.members[name][2])
        if zlib.crc32(data) != self.members[name][3]:
            raise ValueError(f"{name}: checksum")
        return data


def record(page_id: int | None, url: str | None, payload: bytes | None, sha1: str, n_bytes: int, refers_to: int | None) -> bytes:
    """A WARC/1.1 response, or a revisit where there is ``refers_to``."""
    digest = b32encode(bytes.fromhex(sha1)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else f'urn:page:{page_id}'}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {n_bytes}",
    ]
    if refers_to is None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode() + (payload or b"")
        head.append("Content-Type: application/http; msgtype=response")
    else:
        block = b""
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and the payload of a record, its digest verified for responses."""
    end = data.index(b"\r\n\r\n")
    version, *lines = data[:end].decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(fields["content-length"])
    block = data[end + 4 : end + 4 + n]
    if len(block) != n or data[end + 4 + n :] != b"\r\n\r\n":
        raise ValueError("bad record length")
    if fields["warc-type"] != "response":
        return fields, b""
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    if b32encode(hashlib.sha1(payload).digest()).decode() != fields["warc-payload-digest"].removeprefix("sha1:"):
        raise ValueError("payload digest")
    return fields, payload


def write_archives(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """Archives (name, records, content) of all rows; revisits chosen over the whole table.

    Digests are pre-aggregated where they are read; only digests held more than once meet the pages again, in a join
    that can split hot ones.
    """
    pages = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumns({"sha1": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
    light = pages.select("id", "sha1", "n").where(F.col("n") >= min_bytes)
    shared = light.groupBy("sha1", "n").agg(F.max("id").alias("holder"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and holder is not null").select("sha1", "n", "holder")
    shared = written(shared, "digests")  # so that both sides of the join are shuffled and Spark can split a hot digest
    chosen = pages.join(shared, ["sha1", "n"], "left").select("id", "url", "sha1", "n", F.when(~F.col("id").eqNullSafe(F.col("holder")), F.col("holder")).alias("refers_to"), "payload")
    chosen = chosen.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, index, first = bytearray(), [], None

        def done() -> pa.RecordBatch:
            table = "".join(f"{i}\t{at}\t{n}\n" for i, at, n in index).encode()
            name = f"pages-{first}-{hashlib.sha1(table).hexdigest()[:12]}.zip"
            content = zip_stored([(DATA, bytes(data)), (INDEX, table)], zip64=True)  # one format at every size
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(index)], pa.int64()), pa.array([content], pa.binary())], names=["name", "records", "content"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "sha1", "n", "refers_to")), strict=True):
                made = gzip.compress(record(*row), 4, mtime=0)
                first = row[0] if not index else first
                index.append(("null" if row[0] is None else row[0], len(data), len(made)))
                data += made
                if len(data) >= ARCHIVE_BYTES:
                    yield done()
                    data, index = bytearray(), []
        if index:
            yield done()

    return chosen.mapInArrow(pack, "name string, records long, content binary")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per record of archives (name, content): page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, and the payload (null for revisits) if asked for."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def number(x: str | None) -> int | None:
        x = x and x.removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x and x != "null" else None

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for content in batch.column("content"):
                view = memoryview(content.as_buffer())
                archive = ZipArchive(lambda at, n, v=view: bytes(v[at : at + n]), len(view))
                rows = []
                for line in archive.whole(INDEX).decode().splitlines():
                    _, at, n = line.split("\t")
                    fields, payload = parse_record(gzip.decompress(archive.range(DATA, int(at), int(n))))
                    kind = fields["warc-type"]
                    size = len(payload) if kind == "response" else int(fields["x-payload-length"])
                    digest = b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    row = (number(fields["warc-record-id"]), fields["warc-target-uri"], size, digest, kind, number(fields.get("warc-refers-to")))
                    rows.append((*row, payload if kind == "response" else None)[: len(names)])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=names)

    return archives.select("content").mapInArrow(unpack, schema)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS holder FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND holder <> page_id THEN holder END AS refers_to
FROM m
"""


def query(spark, sf_dir: str) -> DataFrame:
    archives = written(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")), "archives")
    return read_archives(archives).drop("url")
