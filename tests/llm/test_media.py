import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from factloom.llm import media

#: The standard's table K.3, and an AC table of our own with runs, end of block and a run of 16.
DC = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, *range(12)])
AC_SYMBOLS = [0x00, 0xF0, *(run << 4 | size for run in range(4) for size in range(1, 9))]
AC = bytes([0, 0, 0, 0, 0, len(AC_SYMBOLS) - 10, 10, 0, 0, 0, 0, 0, 0, 0, 0, 0, *AC_SYMBOLS])


def put(bits, value, size):
    bits.append(f"{value:0{size}b}" if size else "")


def scalar_file(width, height, components, restart, seed):
    """A file made bit by bit, and the coefficients of its blocks in scan order."""
    r = random.Random(seed)
    codes = {k: {s: (c, n) for c, n, s in media.canonical(list(t[:16]), list(t[16:]))} for k, t in (("dc", DC), ("ac", AC))}
    h, v = max(c[1] for c in components), max(c[2] for c in components)
    single = len(components) == 1
    across, down = (-(-width // 8), -(-height // 8)) if single else (-(-width // (8 * h)), -(-height // (8 * v)))
    scan, want, last, bits = b"", [], [0] * len(components), []

    def close():
        raw = "".join(bits)
        raw += "1" * (-len(raw) % 8)
        bits.clear()
        return bytes(int(raw[i : i + 8], 2) for i in range(0, len(raw), 8)).replace(b"\xff", b"\xff\x00")

    for m in range(across * down):
        if restart and m and m % restart == 0:
            scan += close() + bytes([0xFF, 0xD0 + (m // restart - 1) % 8])
            last = [0] * len(components)
        mcu = []
        for k, c in enumerate(components):
            for _ in range(1 if single else c[1] * c[2]):
                block = [0] * 64
                block[0] = r.randrange(-200, 200)
                at = 1
                while at < 64 and r.random() < 0.8:
                    at += r.choice([0, 0, 1, 3, 17])
                    if at < 64:
                        block[at] = r.choice([-1, 1]) * r.randrange(1, 255)
                        at += 1
                diff = block[0] - last[k]
                last[k] = block[0]
                size = abs(diff).bit_length()
                put(bits, *codes["dc"][size])
                put(bits, diff if diff > 0 else diff + (1 << size) - 1, size)
                run, end = 0, max((i for i in range(1, 64) if block[i]), default=0)
                for i in range(1, end + 1):
                    if not block[i]:
                        run += 1
                        continue
                    while run > 15:
                        put(bits, *codes["ac"][0xF0])
                        run -= 16
                    size = abs(block[i]).bit_length()
                    put(bits, *codes["ac"][run << 4 | size])
                    put(bits, block[i] if block[i] > 0 else block[i] + (1 << size) - 1, size)
                    run = 0
                if end < 63:
                    put(bits, *codes["ac"][0])
                mcu.append(block)
        want.append(mcu)
    scan += close()
    seg = lambda k, b: struct.pack(">BBH", 0xFF, k, len(b) + 2) + b
    head = seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0]) + bytes([3] * 64)) + seg(0xC4, b"\x00" + DC + b"\x10" + AC)
    head += seg(0xC0, struct.pack(">BHHB", 8, height, width, len(components)) + b"".join(bytes([i, hh << 4 | vv, 0]) for i, hh, vv in components))
    if restart:
        head += seg(0xDD, struct.pack(">H", restart))
    head += seg(0xDA, bytes([len(components)]) + b"".join(bytes([c[0], 0]) for c in components) + bytes([0, 63, 0]))
    return b"\xff\xd8" + head + scan + b"\xff\xd9", np.array(want)


@pytest.mark.parametrize("components", [[(1, 1, 1)], [(1, 2, 2), (2, 1, 1), (3, 1, 1)]])
@pytest.mark.parametrize("restart", [0, 3])
def test_decoder_against_files_made_bit_by_bit(components, restart):
    made = [scalar_file(50, 35, components, restart, s) for s in range(12)]
    for (data, want), got in zip(made, media.decode([f for f, _ in made]), strict=True):
        assert (got["coefficients"] == want).all()
        own = want[:, 0, 0] if len(components) == 1 else None
        assert got["thumbnail"].shape == ((5, 7) if own is not None else (6, 8))
        if own is not None:
            assert (got["thumbnail"].ravel() == np.clip(own * 3 // 8 + 128, 0, 255)).all()


def test_round_trip_of_any_bytes():
    r = random.Random(5)
    data = [b"", b"\xff" * 100, bytes(range(256)), r.randbytes(64 * 700), b"\0" * 64, r.randbytes(9000)]
    files = media.encode([media.payload(d) for d in data])
    for d, f in zip(data, media.decode(files), strict=True):
        assert media.read_payload(f) == media.payload(d)
        assert f["thumbnail"].shape == (f["height"] // 8, f["width"] // 8)
    assert len(media.payload(None)) == 64 and len(media.payload(b"x" * 65)) == 128


def test_slices_give_the_same_file(monkeypatch):
    p = [media.payload(random.Random(k).randbytes(5000)) for k in range(4)]
    whole = media.encode(p)
    monkeypatch.setattr(media, "SLICE", 7)
    assert media.encode(p) == whole
    assert [media.read_payload(d) for d in media.decode(whole)] == p


@pytest.mark.parametrize("broken", [b"", b"\xff\xd8", b"\xff\xd8\xff\xc2\0\x0b\x08\0\x08\0\x08\x01\x01\x11\0", b"GIF89a"])
def test_broken_files_raise(broken):
    with pytest.raises(media.JpegError):
        media.decode([broken])


def test_query_columns(spark):
    rows = [(1, "abc", "x"), (1, "abc", "y"), (2, None, "z"), (3, "é" * 100, "w"), (None, "", "v")]
    out = media.media_features(spark.createDataFrame(rows, "doc_id long, text string, n_bytes string")).collect()
    by = {(r["doc_id"], r["n_bytes"]): r for r in out}
    assert len(out) == 5 and by[1, 3]["payload_sha256"] == hashlib.sha256(b"abc" + bytes(61)).hexdigest()
    assert by[3, 200]["payload_bytes"] == 256 and by[2, 0]["tail_crc32"] == zlib.crc32(bytes(64))
    assert by[2, 0]["media_sha256"] == by[None, 0]["media_sha256"]
    stored = {r["doc_id"]: r["media"] for r in media.media_column(spark.createDataFrame(rows, "doc_id long, text string, e string")).collect()}
    assert hashlib.sha256(stored[3]).hexdigest() == by[3, 200]["media_sha256"]
