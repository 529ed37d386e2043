import hashlib
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lumenloom import session
from lumenloom.llm import common, flac, media


class Bits:
    """A plain bit reader for the scalar decoder."""

    def __init__(self, data):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def read(self, n):
        self.left -= n
        return (self.value >> self.left) & ((1 << n) - 1)

    def signed(self, n):
        v = self.read(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self):
        n = 0
        while not self.read(1):
            n += 1
        return n


def crc(data, poly, bits):
    value, top, mask = 0, 1 << (bits - 1), (1 << bits) - 1
    for b in data:
        value ^= b << (bits - 8)
        for _ in range(8):
            value = ((value << 1) ^ poly if value & top else value << 1) & mask
    return value


def scalar_decode(stream):
    """Straight from the format's description, one bit at a time."""
    points, total, md5, at = flac.seek_points(stream)
    out = []
    for j, (_, offset, _) in enumerate(points):
        end = points[j + 1][1] + at if j + 1 < len(points) else len(stream)
        frame = stream[at + offset : end]
        assert crc(frame, 0x8005, 16) == 0
        r = Bits(frame)
        assert r.read(14) == 0x3FFE and r.read(2) == 0 and r.read(4) == 7 and r.read(4) == 0 and r.read(8) == 2
        lead = r.read(8)
        number = lead
        if lead >= 0xC0:
            n = 8 - (lead ^ 0xFF).bit_length()
            number = lead & (0x7F >> n)
            for _ in range(n - 1):
                number = number << 6 | r.read(8) & 0x3F
        assert number == j
        size = r.read(16) + 1
        head = 8 * len(frame) - r.left
        assert r.read(8) == crc(frame[: head // 8], 0x07, 8)
        assert r.read(1) == 0
        kind = r.read(6)
        assert r.read(1) == 0
        if kind == 0:
            x = [r.signed(8)] * size
        elif kind == 1:
            x = [r.signed(8) for _ in range(size)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            x = [r.signed(8) for _ in range(order)]
            coefs, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order] if kind < 32 else None, 0
            if kind >= 32:
                p = r.read(4) + 1
                shift = r.signed(5)
                coefs = [r.signed(p) for _ in range(order)]
            width = 4 + r.read(2)
            parts = r.read(4)
            for part in range(1 << parts):
                k = r.read(width)
                for _ in range((size >> parts) - (order if part == 0 else 0)):
                    if k == (1 << width) - 1:
                        raise AssertionError("the encoder writes no escapes")
                    z = r.unary() << k | r.read(k)
                    x.append((z >> 1 ^ -(z & 1)) + (sum(c * x[-1 - i] for i, c in enumerate(coefs)) >> shift))
        out += x
    assert len(out) == total
    data = bytes(v & 0xFF for v in out)
    assert hashlib.md5(data).digest() == md5
    return bytes(b ^ 0x80 for b in data)


def samples():
    rng = random.Random(1)
    text = ("lorem ipsum dolor sit amet, " * 200).encode()
    return [
        bytes(64),
        bytes([7]) * 640,
        os.urandom(3200),
        bytes([0, 255] * 640),
        text[: 64 * 80],
        bytes(min(255, max(0, int(128 + 100 * ((i % 200) / 100 - 1)))) for i in range(4096)),
        bytes(rng.choice([0, 0, 0, 0, 0, 255]) for _ in range(2048)),
        "é日本語".encode() * 64,
        bytes(range(256)) * 20,
        b"a" * 1023 + b"z",
    ]


def test_round_trip_and_scalar_decoder():
    payloads = [p + bytes(-len(p) % 64) for p in samples()]
    streams = flac.encode(payloads)
    assert flac.decode(streams) == payloads
    for s, p in zip(streams, payloads, strict=True):
        assert scalar_decode(s) == p
        assert flac.encode([p]) == [s]  # whatever is beside it


def test_many_frames_use_long_numbers():
    p = (b"abc def " * 8) * 2100
    assert scalar_decode(flac.encode([p], block=64)[0]) == p


def test_seek():
    p = os.urandom(500) + b"hello world " * 900
    p += bytes(-len(p) % 64)
    s = flac.encode([p])[0]
    for a, n in ((0, 10), (1000, 100), (1023, 2), (2048, 3000), (len(p) - 5, 50), (len(p), 5)):
        assert flac.read_samples(s, a, n) == p[a : a + n]


@pytest.mark.parametrize("at", [-1, -40, 60])
def test_damage_is_found(at):
    s = bytearray(flac.encode([b"hello world " * 320])[0])
    s[at] ^= 1
    with pytest.raises(flac.FlacError):
        flac.decode([bytes(s)])


def test_columns(spark, monkeypatch):
    seen = []
    write_pcm = media.write_pcm

    def spy(stored, path, **how):
        seen.append((stored.columns, stored.inputFiles()))
        write_pcm(stored, path, **how)
        kept = spark.read.parquet(path)
        assert kept.where("media_sha256 is not null").count() == stored.count()
        whole = {r.doc_id: b"".join(bytes(p.pcm) for p in sorted(r.p)) for r in kept.groupBy("doc_id").agg(F.collect_set(F.struct("first_sample", "pcm")).alias("p")).collect()}
        assert all(len(v) % 64 == 0 and v for v in whole.values())

    monkeypatch.setattr(media, "write_pcm", spy)
    before = set(session._written)
    rows = [(1, "hi"), (2, None), (3, ""), (None, "hi"), (1, "hi"), (4, "x" * 70_000), (5, "y" * 1024), (6, "z" * 1025)]
    docs = spark.createDataFrame([(i, t, 0, "own") for i, t in rows], "doc_id long, text string, n_bytes int, media string")
    got = media.round_trip(docs).collect()
    # what is stored are the streams; the blocks are decoded from those files, and only the features stay
    assert [("media" in c, bool(f)) for c, f in seen] == [(True, True)] * media.WAVES
    assert len(session._written - before) == media.WAVES
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stream = flac.encode([padded])[0]
        want.append((i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(stream), hashlib.sha256(stream).hexdigest()))
    assert sorted(map(str, (tuple(r)[:7] for r in got))) == sorted(map(str, want))
    frames = {r.doc_id: int(r.feature.split(";")[0][7:]) for r in got}
    assert (frames[4], frames[5], frames[6]) == (69, 1, 2)
    assert media.round_trip(docs.limit(0)).count() == 0


def test_stored_blocks_by_sample_offset(spark, tmp_path):
    texts = {i: "".join(random.Random(i).choice("abc \n") for _ in range(3000 * i)) for i in range(1, 6)}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    path = str(tmp_path / "pcm")
    media.write_pcm(common.materialize(media.encode_texts(docs), "flac"), path)
    for doc, first, count in ((1, 0, 10), (3, 1000, 3000), (5, 1023, 2), (5, 14_990, 500), (2, 10**6, 5), (9, 0, 5)):
        want = texts.get(doc, "").encode()
        want = want + bytes(-len(want) % 64)
        assert media.read_samples(spark, path, doc, first, count) == want[first : first + count]
