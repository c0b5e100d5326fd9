"""Archives and media."""

import hashlib
import io
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from shardloom.llm import flac, warc


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_both_ways(zip64):
    members = [("a/x.bin", b"hello" * 100), ("b.txt", b""), ("ü.txt", b"z")]
    data = warc.zip_stored(members, zip64)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert [(n, z.read(n)) for n in z.namelist()] == members
    for blob in (data, _with_comment(members)):
        a = warc.ZipArchive(lambda at, n, b=blob: b[at : at + n], len(blob))
        assert {n: a.whole(n) for n in a.members} == dict(members)
        assert a.range("a/x.bin", 5, 5) == b"hello"
        with pytest.raises(ValueError):
            a.range("a/x.bin", 499, 2)
    with pytest.raises(ValueError):
        warc.ZipArchive(lambda at, n: data[at : at + n], len(data) - 1)


def _with_comment(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for n, b in members:
            z.writestr(n, b)
        z.comment = b"PK\x05\x06 a comment that looks like an end"
    return out.getvalue()


def test_record_round_trip():
    body = "é".encode() * 700
    sha = hashlib.sha1(body).hexdigest()
    fields, payload = warc.parse_record(warc.record(3, "http://a/b c\r\nX: y", body, sha, len(body), None))
    assert payload == body and fields["warc-type"] == "response" and "x" not in fields
    fields, payload = warc.parse_record(warc.record(4, None, None, sha, len(body), 3))
    assert fields["warc-refers-to"] == "<urn:page:3>" and payload == b""
    broken = warc.record(3, "u", body, "0" * 40, len(body), None)
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(broken)


def test_archives(spark, monkeypatch):
    long = "<p>" + "x" * 1200
    rows = [(1, "u1", long), (2, "u2", long), (3, None, long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", "é" * 600), (9, "v", "é" * 600), (3, None, long), (None, "u", long), (10, "w", "y" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 500)
    want = Counter()
    holder = defaultdict(list)
    for i, _, h in rows:
        holder[h or ""].append(-1 if i is None else i)
    for i, _, h in rows:
        b = (h or "").encode()
        top = max(holder[h or ""])
        again = len(b) >= 1000 and top != i
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None)] += 1
    for d in (pages, pages.selectExpr("*", "1 as id", "2 as n", "3 as sha1", "4 as holder", "5 as payload")):
        out = warc.read_archives(warc.write_archives(d), payloads=True)
        assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out.collect()) == want
        for r in out.where("record_type = 'response'").collect():
            assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_crcs_and_numbers():
    assert flac.crc8(b"123456789") == 0xF4 and flac.crc16(b"123456789") == 0xFEE8
    assert [flac.coded_number(n).hex() for n in (127, 128, 2047, 2048, 65535, 65536, 2**21)] == ["7f", "c280", "dfbf", "e0a080", "efbfbf", "f0908080", "f888808080"]


def payloads():
    rng = np.random.default_rng(0)
    walk = np.cumsum(rng.integers(-1, 2, 192 * 30)).clip(-128, 127).astype(np.int16) + 128
    ramp = (np.arange(192 * 3) % 200).astype(np.uint8)
    raw = [b"", b"a" * 1000, rng.integers(0, 256, 5000, dtype=np.uint8).tobytes(), bytes([0, 255]) * 400, walk.astype(np.uint8).tobytes(), ramp.tobytes(), b"\xff\xf8\x14\x02" * 300, "日本 text ".encode() * 400, bytes([128] * 191 + [255]), bytes(192 * 70)]
    return [flac.padded(x) for x in raw]


def test_streams_round_trip():
    p = payloads()
    m = flac.encode(p)
    assert flac.decode(m) == p
    assert all(flac.encode([x])[0] == y for x, y in zip(p, m))
    for x, y in zip(p, m):  # the general decoder agrees, and so does a seek
        s = flac.Stream(y)
        out, at, k = b"", s.frames, 0
        while len(out) < s.samples:
            channels, number, at = flac.decode_frame(y, at, s)
            assert number == k
            out, k = out + bytes(v + 128 for v in channels[0]), k + 1
        assert out == x and at == len(y)
        assert flac.read_samples(y, len(x) - 16, 16) == x[-16:] and flac.read_samples(y, 100, 20) == x[100:120]


def test_tails_by_seek():
    p = payloads()
    m = flac.encode(p)
    assert flac.tails(m, 16) == [x[-16:] for x in p] and flac.tails(m, 192) == [x[-192:] for x in p]
    assert all(flac.tails([y], 16) == [x[-16:]] for x, y in zip(p, m))
    rng = np.random.default_rng(6)
    long = rng.integers(0, 256, 192 * 100, dtype=np.uint8).tobytes()
    data = bytearray(flac.encode([long])[0])
    data[flac.Stream(bytes(data)).frames + 60] ^= 4  # a frame before the last seek point is not read
    assert flac.tails([bytes(data), m[1]], 16) == [long[-16:], p[1][-16:]]
    with pytest.raises(ValueError):
        flac.decode([bytes(data)])
    data[-20] ^= 4
    with pytest.raises(ValueError):
        flac.tails([bytes(data)], 16)


def test_corruption_is_found():
    m = flac.encode([payloads()[4]])[0]
    at = flac.Stream(m).frames
    for k in (at + 9, at + 60, len(m) - 1, 30):  # in frames, and in the stream's MD5
        bad = bytearray(m)
        bad[k] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, v, n):
        if n:
            self.bits += format(v & (1 << n) - 1, f"0{n}b")

    def rice(self, r, k):
        u = 2 * r if r >= 0 else -2 * r - 1
        self.bits += "0" * (u >> k) + "1"
        self.put(u, k)

    def bytes(self):
        b = self.bits + "0" * (-len(self.bits) % 8)
        return bytes(int(b[i : i + 8], 2) for i in range(0, len(b), 8))


def lpc_frame(samples, coefs, shift, number, parts=0, escape=False, fixed=None):
    w = Writer()
    order = len(coefs) if fixed is None else fixed
    w.put(0, 1)
    w.put(32 + order - 1 if fixed is None else 8 + order, 6)
    w.put(0, 1)
    for s in samples[:order]:
        w.put(s, 8)
    if fixed is None:
        w.put(5 - 1, 4)
        w.put(shift, 5)
        for c in coefs:
            w.put(c, 5)
    use = coefs if fixed is None else ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])[fixed]
    res = [samples[i] - (sum(c * samples[i - 1 - j] for j, c in enumerate(use)) >> shift) for i in range(order, 192)]
    w.put(0, 2)
    w.put(parts, 4)
    size = 192 >> parts
    at = 0
    for p in range(1 << parts):
        n = size - (order if p == 0 else 0)
        if escape and p == 0:
            w.put(15, 4)
            w.put(12, 5)
            for r in res[at : at + n]:
                w.put(r, 12)
        else:
            w.put(3, 4)
            for r in res[at : at + n]:
                w.rice(r, 3)
        at += n
    head = bytes([0xFF, 0xF8, 0x14, 0x02]) + flac.coded_number(number)
    frame = head + bytes([flac.crc8(head)]) + w.bytes()
    return frame + flac.crc16(frame).to_bytes(2, "big")


@pytest.mark.parametrize("kind", ["lpc", "lpc2", "parts", "escape", "fixed3", "fixed4"])
def test_other_subframes(kind):
    rng = np.random.default_rng(1)
    pcm = (np.cumsum(rng.integers(-3, 4, 192 * 4)).clip(-128, 127)).astype(int)
    frames = []
    for k in range(4):
        s = pcm[192 * k : 192 * k + 192].tolist()
        frames.append({
            "lpc": lambda: lpc_frame(s, [7], 3, k), "lpc2": lambda: lpc_frame(s, [14, -7], 3, k), "parts": lambda: lpc_frame(s, [7], 3, k, parts=2),
            "escape": lambda: lpc_frame(s, [7], 3, k, parts=1, escape=True), "fixed3": lambda: lpc_frame(s, [], 0, k, fixed=3), "fixed4": lambda: lpc_frame(s, [], 0, k, fixed=4),
        }[kind]())
    payload = bytes((pcm + 128).astype(np.uint8))
    data = flac._header(payload, np.array([len(f) for f in frames])) + b"".join(frames)
    assert flac.decode([data, flac.encode([payload])[0]]) == [payload, payload]


def test_tails_of_another_make():
    s = (np.arange(192) % 7).tolist()
    pcm = s * 3
    frames = [lpc_frame(s, [14, -7], 3, k, parts=2 * (k == 2)) for k in range(3)]
    payload = bytes(x + 128 for x in pcm)
    data = flac._header(payload, np.array([len(f) for f in frames])) + b"".join(frames)
    assert flac.tails([data, flac.encode([payload])[0]], 16) == [payload[-16:]] * 2


def test_columns(spark, docs, docs_rows, none, clashing):
    want = Counter()
    for i, t, *_ in docs_rows:
        p = flac.padded((t or "").encode())
        want[(i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))] += 1
    for d in (docs, clashing):
        media = flac.encode_column(d)
        got = flac.digests(media).collect()
        assert Counter(tuple(r)[:5] for r in got) == want
    blocks = flac.pcm_blocks(media, block_samples=192).where("doc_id = 36").orderBy("sample_offset").collect()
    text = next(t for i, t, *_ in docs_rows if i == 36)
    assert b"".join(r["pcm"] for r in blocks) == flac.padded(text.encode()) and [r["sample_offset"] for r in blocks] == [192 * k for k in range(len(blocks))]
    assert flac.digests(flac.encode_column(none)).count() == 0
