import subprocess
import sys
from pathlib import Path
import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import flac


class Bits:
    def __init__(self, data):
        self.s, self.p = "".join(f"{b:08b}" for b in data), 0

    def take(self, n):
        self.p += n
        return int(self.s[self.p - n : self.p], 2) if n else 0

    def signed(self, n):
        v = self.take(n)
        return v - (1 << n) if v >> (n - 1) else v

    def unary(self):
        q = self.s.index("1", self.p) - self.p
        self.p += q + 1
        return q


def crc(data, poly, width):
    c = 0
    for b in data:
        c ^= b << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c >> (width - 1) else c << 1) & ((1 << width) - 1)
    return c


def plain(media):
    """A decoder bit by bit, written from the format's description; no seek points are used."""
    assert media[:4] == b"fLaC"
    at, last, points = 4, 0, []
    while not last:
        last, kind, size = media[at] >> 7, media[at] & 127, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if kind == 0:
            x = int.from_bytes(body[10:18], "big")
            depth, total, md5 = (x >> 36 & 31) + 1, x & (1 << 36) - 1, body[18:]
        elif kind == 3:
            points = [struct.unpack(">QQH", body[k : k + 18]) for k in range(0, size, 18)]
        at += 4 + size
    audio, out, offsets = at, [], []
    while len(out) < total:
        b = Bits(media[at : at + 6000])
        assert b.take(15) == 0x7FFC and b.take(1) == 0
        code, rate, chan, size = b.take(4), b.take(4), b.take(4), b.take(3)
        assert (code, rate, chan, size, b.take(1)) == (7, 0, 0, 1, 0)
        lead = b.take(8)
        ones = 0
        while lead >> (7 - ones) & 1:
            ones += 1
        number = lead & (127 >> ones)
        for _ in range(ones - 1):
            assert b.take(2) == 2
            number = number << 6 | b.take(6)
        n = b.take(16) + 1
        head = b.p // 8
        assert b.take(8) == crc(media[at : at + head], 7, 8)
        offsets.append((len(out), at - audio, n))
        assert b.take(1) == 0
        kind = b.take(6)
        assert b.take(1) == 0 and number == len(offsets) - 1
        order = kind - 31 if kind >= 32 else kind - 8
        x = [b.signed(depth) for _ in range(order)]
        shift, coef = 0, [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order]
        if kind >= 32:
            width, shift = b.take(4) + 1, b.signed(5)
            coef = [b.signed(width) for _ in range(order)]
        assert b.take(2) == 0
        parts = b.take(4)
        for k in range(1 << parts):
            rice = b.take(4)
            for _ in range((n >> parts) - (order if k == 0 else 0)):
                u = b.unary() << rice | b.take(rice)
                r = u >> 1 ^ -(u & 1)
                x.append(r + (sum(c * v for c, v in zip(coef, reversed(x), strict=False)) >> shift))
        out += x
        end = (b.p + 7) // 8
        assert crc(media[at : at + end], 0x8005, 16) == int.from_bytes(media[at + end : at + end + 2], "big")
        at += end + 2
    assert at == len(media) and points == offsets
    v = np.array(out, np.int8)
    assert hashlib.md5(v.tobytes()).digest() == md5
    return (v.view(np.uint8) ^ 0x80).tobytes()


def prose(r, n):
    return " ".join(r.choices("the of thion éa and\n reth 12 ß".split(" "), k=n))


def test_independent_decoder_agrees():
    r = random.Random(1)
    texts = [None, "", "a", prose(r, 20), prose(r, 900), "x" * 3000, "é" * 700, "".join(chr(r.randrange(1, 256)) for _ in range(2500))]
    pay = [flac.payload(t) for t in texts]
    media = flac.encode(pay)
    assert [plain(m) for m in media] == pay == flac.decode(media)
    kinds = {m[flac.Stream(m).audio + 8] >> 1 for m in media}
    assert len(kinds) > 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=3000).map(lambda b: b + bytes(-len(b) % 64 if b else 64)), min_size=1, max_size=4))
def test_round_trip(pay):
    media = flac.encode(pay, limit=2000)
    assert flac.decode(media, limit=1500) == pay
    for p, m in zip(pay, media, strict=True):
        assert (flac.samples(m) + 128).astype(np.uint8).tobytes() == p


def test_smooth_signals_are_predicted():
    t = np.arange(8192)
    p = (128 + 90 * np.sin(t / 9) + 20 * np.sin(t / 3.1)).astype(np.uint8).tobytes()
    (m,) = flac.encode([p])
    assert m[flac.Stream(m).audio + 8] >> 1 in (10, 35) and len(m) < 0.7 * len(p)
    assert plain(m) == p == flac.decode([m])[0]


def test_other_encoders_forms():
    """Constant and verbatim subframes, 16 bits, a table block size and no seek points."""

    def frame(number, sub, n):
        head = b"\xff\xf8" + bytes([0x80 if n == 256 else 0x70, 0x08]) + bytes([number]) + (b"" if n == 256 else struct.pack(">H", n - 1))
        body = head + bytes([crc(head, 7, 8)]) + sub
        return body + struct.pack(">H", crc(body, 0x8005, 16))

    values = [*range(-50, 50)]
    info = struct.pack(">HH", 256, 256) + bytes(6) + ((8000 << 44) | (15 << 36) | 356).to_bytes(8, "big") + bytes(16)
    m = b"fLaC\x80\x00\x00\x22" + info + frame(0, b"\x00" + struct.pack(">h", -3), 256) + frame(1, b"\x02" + struct.pack(">100h", *values), 100)
    assert flac.samples(m).tolist() == [-3] * 256 + values


def test_seeking_reads_only_some_frames():
    r = random.Random(2)
    p = flac.payload(prose(r, 5000))
    (m,) = flac.encode([p])
    for first, count in [(0, 5), (1023, 2), (5000, 3000), (len(p) - 3, 10), (len(p) + 5, 3)]:
        assert (flac.read_samples(m, first, count) + 128).astype(np.uint8).tobytes() == p[first : first + count]


def test_damage_is_found():
    r = random.Random(3)
    (m,) = flac.encode([flac.payload(prose(r, 900))])
    for _ in range(60):
        at = r.randrange(flac.Stream(m).audio, len(m))
        bad = bytearray(m)
        bad[at] ^= 1 << r.randrange(8)
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])


def test_query_columns(spark):
    r = random.Random(4)
    texts = [(1, None), (2, ""), (3, "é" * 40), (3, "é" * 40), (None, prose(r, 50)), (5, prose(r, 60_000))]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in texts], "doc_id long, text string, media string, feature string")
    got = {(x.doc_id, x.n_bytes): x for x in flac.digests(docs).collect()}
    assert flac.digests(docs).count() == 6 and flac.digests(docs.limit(0)).count() == 0
    for i, t in texts:
        b = (t or "").encode()
        p = flac.payload(t)
        x = got[i, len(b)]
        (m,) = flac.encode([p])
        assert (x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (x.media_bytes, x.media_sha256, x.feature) == (len(m), hashlib.sha256(m).hexdigest(), flac.feature(p))
    blocks = flac.pcm_blocks(flac.store(docs.where("doc_id = 5").drop("media"))).orderBy("block").collect()
    assert b"".join((np.frombuffer(x.pcm, np.uint8) ^ 0x80).tobytes() for x in blocks) == flac.payload(texts[5][1])
    assert [x.sample_offset for x in blocks] == [1024 * k for k in range(len(blocks))]


def test_long_text_is_worked_on_in_parts():
    """64 MB of text within 1.5 GB, the interpreter and its libraries included, and the same stream however it is cut."""
    code = """
import resource, numpy as np
from weftgraph.llm import flac
r = np.random.default_rng(1)
text = bytes(r.choice(np.frombuffer(b"etaoin shrdlu", np.uint8), 1 << 26)).decode()
p = flac.payload(text)
m = flac.encode([p])
assert flac.decode(m) == [p] and flac.feature(p)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).resolve().parents[2])
    assert int(out.stdout.split()[-1]) < 1500
    r = np.random.default_rng(2)
    payloads = [bytes(r.integers(60, 90, n, np.uint8)) for n in (64, 5000, 40_000, 1024, 2048, 100_000)]
    whole = flac.encode(payloads, 1 << 30)
    assert flac.encode(payloads, 3000) == whole == [flac.encode([p], 1024)[0] for p in payloads]
    assert flac._decode(whole, 2000) == payloads
