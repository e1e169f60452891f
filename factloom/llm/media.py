"""Media columns: baseline JPEG files in a binary column, with dimensions and thumbnail hashes.

The decoder follows the public JPEG standard (ITU-T T.81): parse markers, split scans at restart markers, decode
Huffman symbols of all segments of a batch in lock-step with numpy, sum DC differences, and rebuild a
luminance thumbnail from the DC coefficients alone (one pixel for each 8x8 block).

A text becomes a JPEG file whose quantised coefficients are its bytes: block i holds bytes 64 i to 64 i + 63
in zigzag order, the DC coefficient as byte - 128, an AC coefficient as byte + 256. All AC coefficients thus
have category 9, no run, and take 10 bits. A restart marker follows every block, which makes the blocks independent segments.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import by_rows

#: Blocks that are coded at once; bounds memory whatever the length of a text.
SLICE = 8192
#: Counts of codes by length 1 to 16 and symbols of the tables written. DC: the standard's table K.3. AC: end of block is never used.
DC_COUNTS, DC_SYMBOLS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12))
AC_COUNTS, AC_SYMBOLS = [1, 1] + [0] * 14, [0x09, 0x00]


class JpegError(ValueError):
    """Not a baseline JPEG file, or a broken one."""


def canonical(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(code, length, symbol) in the order of a DHT segment."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, length, symbols[k]))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For every 16-bit window: the length of its code (0: none) and its symbol. table: 16 counts, then symbols."""
    lengths, symbols = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    for code, length, symbol in canonical(list(table[:16]), list(table[16:])):
        at = code << (16 - length)
        lengths[at : at + (1 << (16 - length))] = length
        symbols[at : at + (1 << (16 - length))] = symbol
    return lengths, symbols


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, counts: list[int], symbols: list[int]) -> bytes:
    return _segment(0xC4, bytes([kind, *counts, *symbols]))


_TABLES = _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _dht(0x00, DC_COUNTS, DC_SYMBOLS) + _dht(0x10, AC_COUNTS, AC_SYMBOLS)
_DC_CODES = {symbol: (code, length) for code, length, symbol in canonical(DC_COUNTS, DC_SYMBOLS)}


def _dc_bits() -> list[np.ndarray]:
    """For each byte, the bits of its DC coefficient: code of the category, then the amplitude."""
    out = []
    for byte in range(256):
        value = byte - 128
        size = abs(value).bit_length()
        code, length = _DC_CODES[size]
        amplitude = value if value > 0 else value + (1 << size) - 1
        out.append(np.array([int(c) for c in f"{code:0{length}b}" + (f"{amplitude:0{size}b}" if size else "")], np.uint8))
    return out


_DC_BITS = _dc_bits()
_DC_LENGTHS = np.array([len(b) for b in _DC_BITS])
_DC_MATRIX = np.zeros((256, _DC_LENGTHS.max()), np.uint8)
for _k, _b in enumerate(_DC_BITS):
    _DC_MATRIX[_k, : len(_b)] = _b


def _code_blocks(blocks: np.ndarray, restarts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of blocks (n, 64), each padded and followed by its restart marker (-1: none); and where each block ends."""
    n = len(blocks)
    wide = _DC_MATRIX.shape[1] + 63 * 10
    bits = np.ones((n, wide + -wide % 8), np.uint8)
    ac = np.empty((n, 63, 10), np.uint8)
    ac[:, :, 0], ac[:, :, 1] = 0, 1
    ac[:, :, 2:] = np.unpackbits(blocks[:, 1:], axis=1).reshape(n, 63, 8)
    ac = ac.reshape(n, 630)
    lengths = _DC_LENGTHS[blocks[:, 0]]
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        bits[rows, :d] = _DC_MATRIX[blocks[rows, 0], :d]
        bits[rows, d : d + 630] = ac[rows]
    coded = np.packbits(bits, axis=1)
    used = (lengths + 630 + 7) // 8
    keep = np.arange(coded.shape[1]) < used[:, None]
    flat, marker = coded[keep], restarts >= 0
    stuffed = flat == 0xFF
    before = np.repeat(np.cumsum(marker) - marker, used) * 2
    place = np.arange(len(flat)) + np.cumsum(stuffed) - stuffed + before
    last = np.cumsum(used) - 1
    ends = place[last] + 1 + stuffed[last] + 2 * marker
    out = np.zeros(ends[-1] if n else 0, np.uint8)
    out[place] = flat
    out[ends[marker] - 2] = 0xFF
    out[ends[marker] - 1] = 0xD0 + restarts[marker]
    return out, ends


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file for each payload. A payload's length must be a positive multiple of 64; its length goes into a comment."""
    counts = np.array([len(p) // 64 for p in payloads], np.int64)
    if any(len(p) % 64 or not p for p in payloads):
        raise ValueError("a payload's length must be a positive multiple of 64")
    shapes = []
    for n in counts.tolist():
        w = max(1, int(np.ceil(np.sqrt(n))))
        shapes.append((w, -(-n // w)))
    total = np.array([w * h for w, h in shapes], np.int64)
    parts: list[list[bytes]] = [[] for _ in payloads]
    queue: list[tuple[int, int, int]] = []  # document, first block, end

    def flush() -> None:
        if not queue:
            return
        blocks, restarts = [], []
        for doc, a, b in queue:
            raw = np.frombuffer(payloads[doc], np.uint8)[a * 64 : b * 64].reshape(-1, 64)
            if len(raw) < b - a:  # blocks that only fill the last row of the image
                raw = np.concatenate([raw, np.zeros((b - a - len(raw), 64), np.uint8)])
            blocks.append(raw)
            at = np.arange(a, b)
            restarts.append(np.where(at == total[doc] - 1, -1, at % 8))
        data, ends = _code_blocks(np.concatenate(blocks), np.concatenate(restarts))
        view, k, start = data.tobytes(), 0, 0
        for doc, a, b in queue:
            k += b - a
            parts[doc].append(view[start : ends[k - 1]])
            start = ends[k - 1]
        queue.clear()

    room = SLICE
    for doc, n in enumerate(total.tolist()):
        a = 0
        while a < n:
            b = min(n, a + room)
            queue.append((doc, a, b))
            room -= b - a
            a = b
            if not room:
                flush()
                room = SLICE
    flush()
    out = []
    for (w, h), p, chunks in zip(shapes, payloads, parts, strict=True):
        if max(w, h) * 8 > 65535:
            raise ValueError("a text of more than 4 GB doesn't fit one image")
        out.append(
            b"\xff\xd8" + _segment(0xFE, b"payload %d" % len(p)) + _TABLES + _segment(0xC0, struct.pack(">BHHBBBB", 8, h * 8, w * 8, 1, 1, 0x11, 0))
            + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])) + b"".join(chunks) + b"\xff\xd9"
        )
    return out


def parse(data: bytes) -> dict:
    """The markers of a baseline JPEG file up to its scan: width, height, components, tables, restart interval, comment, where the scan starts."""
    try:
        return _parse(data)
    except (struct.error, IndexError) as e:
        raise JpegError("a header that breaks off") from e


def _parse(data: bytes) -> dict:
    if data[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    at, out = 2, {"quant": {}, "huffman": {}, "restart": 0, "comment": b""}
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise JpegError(f"no marker at byte {at}")
        marker = data[at + 1]
        if marker == 0xFF:  # a fill byte
            at += 1
            continue
        body = data[at + 4 : at + 2 + int.from_bytes(data[at + 2 : at + 4], "big")]
        at += 4 + len(body)
        if marker == 0xC0:
            height, width, n = struct.unpack(">HHB", body[1:6])
            if body[0] != 8 or not height or not width:
                raise JpegError("not 8 bits, or no size")
            out |= {"width": width, "height": height, "components": [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]}
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise JpegError(f"frame type {marker:#x} isn't baseline")
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                out["huffman"][body[0]] = bytes(body[1:n])
                body = body[n:]
        elif marker == 0xDB:
            while body:
                n = 129 if body[0] >> 4 else 65
                out["quant"][body[0] & 15] = body[1] if n == 65 else int.from_bytes(body[1:3], "big")
                body = body[n:]
        elif marker == 0xDD:
            out["restart"] = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            out["comment"] = bytes(body)
        elif marker == 0xDA:
            if "components" not in out:
                raise JpegError("a scan before its frame")
            n = body[0]
            if n != len(out["components"]):
                raise JpegError("components in several scans aren't handled")
            out["scan"] = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            out["start"] = at
            return out
        elif marker == 0xD9:
            raise JpegError("no scan")


def _units(head: dict) -> tuple[list[tuple[int, int, int]], int, int]:
    """The blocks of an MCU as (component, DC table, AC table), and MCUs across and down."""
    parts = head["components"]
    if len(parts) == 1:
        h, v, blocks = 1, 1, [(0, head["scan"][0][1], head["scan"][0][2])]
    else:
        h, v = max(c[1] for c in parts), max(c[2] for c in parts)
        order = {c[0]: i for i, c in enumerate(parts)}
        blocks = [(order[s[0]], s[1], s[2]) for s in head["scan"] for _ in range(parts[order[s[0]]][1] * parts[order[s[0]]][2])]
    return blocks, -(-head["width"] // (8 * h)), -(-head["height"] // (8 * v))


def _lockstep(data: np.ndarray, starts: np.ndarray, mcus: np.ndarray, blocks: list[tuple[int, int, int]], tables: dict[int, bytes]) -> np.ndarray:
    """Coefficients (segment, MCU, block, 64) in zigzag order of segments that start at these bytes and hold so many MCUs. data has no stuffing."""
    w = np.zeros(len(data) + 8, np.uint64)
    padded = np.concatenate([data, np.full(13, 0xFF, np.uint8)])
    for k in range(5):
        w |= padded[k : k + len(w)].astype(np.uint64) << np.uint64(32 - 8 * k)
    luts = {k: lookup(t) for k, t in tables.items()}
    n, most = len(starts), int(mcus.max())
    out = np.zeros((n, most, len(blocks), 64), np.int16)
    flat = out.reshape(-1)
    position = starts.astype(np.int64) * 8
    predicted = np.zeros((max(b[0] for b in blocks) + 1, n), np.int32)
    mask40, limit = np.uint64((1 << 40) - 1), len(w) - 1

    def symbol(p: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths, symbols = luts[kind]
        window = (w[np.minimum(p >> 3, limit)] << (p & 7).astype(np.uint64)) & mask40
        peek = (window >> np.uint64(24)).astype(np.int64)
        length, sym = lengths[peek], symbols[peek]
        if not length.all():
            raise JpegError("no such code")
        size = sym & 15
        both = length + size
        raw = (window >> (np.uint64(40) - both.astype(np.uint64))).astype(np.int32) & ((1 << size.astype(np.int32)) - 1)
        value = np.where(raw < (1 << size.astype(np.int32)) >> 1, raw - (1 << size.astype(np.int32)) + 1, raw)
        return sym, value, p + both

    for m in range(most):
        live = np.flatnonzero(mcus > m)
        for k, (component, dc, ac) in enumerate(blocks):
            sym, value, p = symbol(position[live], dc)
            predicted[component, live] += value
            base = (live * most + m) * len(blocks) * 64 + k * 64
            flat[base] = predicted[component, live]
            rows, at = np.arange(len(live)), np.ones(len(live), np.int64)
            q = p
            while len(rows):
                sym, value, q = symbol(q, 0x10 | ac)
                run = (sym >> 4).astype(np.int64)
                at = at + run
                stop = (sym & 15) == 0
                end = stop & (run < 15)
                write = ~stop
                if (at[write] > 63).any():
                    raise JpegError("more than 64 coefficients")
                if write.all():
                    flat[base[rows] + at] = value
                else:
                    flat[base[rows[write]] + at[write]] = value[write]
                at = at + 1
                done = end | (at > 63)
                if done.any():
                    p[rows[done]] = q[done]
                    rows, at, q = rows[~done], at[~done], q[~done]
            position[live] = p
    return out


def decode(files: list[bytes]) -> list[dict]:
    """For each file: width, height, comment, coefficients (MCU, block of the MCU, 64) in zigzag order, and the luminance thumbnail. Raises JpegError."""
    heads = [parse(f) for f in files]
    groups: dict = {}
    for i, h in enumerate(heads):
        blocks, across, down = _units(h)
        h |= {"mcus": across * down, "across": across, "down": down, "blocks": blocks}
        if not all(k in h["huffman"] for _, dc, ac in blocks for k in (dc, 0x10 | ac)):
            raise JpegError("a Huffman table is missing")
        groups.setdefault((tuple(blocks), tuple(sorted(h["huffman"].items()))), []).append(i)
    out: list[dict] = [{} for _ in files]
    for (blocks, tables), members in groups.items():
        chunk: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        pieces: dict[int, list[np.ndarray]] = {i: [] for i in members}

        def flush(chunk=chunk, pieces=pieces, blocks=blocks, tables=tables) -> None:
            if chunk:
                sizes = [len(c[1]) for c in chunk]
                shift = np.cumsum([0, *sizes[:-1]])
                counts = np.concatenate([c[3] for c in chunk])
                got = _lockstep(np.concatenate([c[1] for c in chunk]), np.concatenate([c[2] + s for c, s in zip(chunk, shift, strict=True)]), counts, list(blocks), dict(tables))
                k = 0
                for i, _, _, n in chunk:
                    x = got[k : k + len(n)]
                    pieces[i].append(x.reshape(-1, *x.shape[2:]) if (n == x.shape[1]).all() else np.concatenate([y[:c] for y, c in zip(x, n, strict=True)]))
                    k += len(n)
                chunk.clear()

        room = SLICE
        for i in members:
            head = heads[i]
            raw = np.frombuffer(files[i], np.uint8)[head["start"] :]
            ff = np.flatnonzero(raw[:-1] == 0xFF)
            after = raw[ff + 1]
            stop = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF)]
            end = int(stop[0]) if len(stop) else len(raw)
            restart = ff[(after >= 0xD0) & (after <= 0xD7) & (ff < end)]
            interval = head["restart"] or head["mcus"]
            n = -(-head["mcus"] // interval)
            if len(restart) + 1 < n:
                raise JpegError("restart markers are missing")
            drop = np.zeros(end, bool)
            drop[ff[(after == 0) & (ff + 1 < end)] + 1] = True
            drop[restart], drop[restart + 1] = True, True
            clean, gone = raw[:end][~drop], np.cumsum(drop)
            starts = np.concatenate([[0], restart[: n - 1] + 2 - gone[restart[: n - 1] + 1]]).astype(np.int64)
            counts = np.full(n, interval, np.int64)
            counts[-1] = head["mcus"] - interval * (n - 1)
            a = 0
            while a < n:
                b = min(n, a + room)
                lo, hi = starts[a], starts[b] if b < n else len(clean)
                chunk.append((i, clean[lo:hi], starts[a:b] - lo, counts[a:b]))
                room -= b - a
                a = b
                if not room:
                    flush()
                    room = SLICE
        flush()
        for i in members:
            coefficients = np.concatenate(pieces[i])
            head = heads[i]
            out[i] = {"width": head["width"], "height": head["height"], "comment": head["comment"], "coefficients": coefficients, "thumbnail": _thumbnail(head, coefficients)}
    return out


def _thumbnail(head: dict, coefficients: np.ndarray) -> np.ndarray:
    """Luminance from DC coefficients only: one pixel for each block of the first component."""
    _, h, v, q = head["components"][0]
    if len(head["components"]) == 1:
        h = v = 1
    own = [k for k, b in enumerate(head["blocks"]) if b[0] == 0]
    dc = coefficients[:, own, 0].astype(np.int64) * head["quant"].get(q, 1) // 8 + 128
    image = dc.reshape(head["down"], head["across"], v, h).transpose(0, 2, 1, 3).reshape(head["down"] * v, head["across"] * h)
    return np.clip(image, 0, 255).astype(np.uint8)


def thumbnail_hash(image: np.ndarray) -> str:
    """64 bits as hex: whether each of 8x8 cells is darker than its right neighbour, of the image averaged to 8 rows of 9 cells."""
    rows, cols = (np.linspace(0, n, k + 1).astype(int)[:-1] for n, k in zip(image.shape, (8, 9), strict=True))
    sums = np.zeros((image.shape[0] + 1, image.shape[1] + 1), np.int64)
    sums[1:, 1:] = image.astype(np.int64).cumsum(0).cumsum(1)
    r1 = np.maximum(np.append(rows[1:], image.shape[0]), rows + 1)
    c1 = np.maximum(np.append(cols[1:], image.shape[1]), cols + 1)
    cell = sums[np.ix_(r1, c1)] - sums[np.ix_(rows, c1)] - sums[np.ix_(r1, cols)] + sums[np.ix_(rows, cols)]
    mean = cell // ((r1 - rows)[:, None] * (c1 - cols)[None, :])
    return np.packbits(mean[:, 1:] > mean[:, :-1]).tobytes().hex()


def payload(data: bytes | None) -> bytes:
    """The bytes with zeros appended up to a positive multiple of 64."""
    data = data or b""
    return data + bytes(max(64, len(data) + -len(data) % 64) - len(data))


def read_payload(decoded: dict) -> bytes:
    """The payload that encode() stored."""
    n = int(decoded["comment"].removeprefix(b"payload "))
    c = decoded["coefficients"].reshape(-1, 64)[: n // 64]
    out = np.empty(c.shape, np.uint8)
    out[:, 0] = c[:, 0] + 128
    out[:, 1:] = c[:, 1:] - 256
    return out.tobytes()


def media_column(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_bytes and media, the JPEG file that holds the text's bytes. Null texts count as empty."""
    fields = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keep)

    def rows(b):
        raw = [(t or "").encode() for t in b.column(len(keep)).to_pylist()]
        return {k: b.column(i) for i, k in enumerate(keep)} | {"n_bytes": [len(r) for r in raw], "media": encode([payload(r) for r in raw])}

    return by_rows(docs.select(*keep, text), rows, f"{fields}, n_bytes long, media binary")


def media_features(docs: DataFrame) -> DataFrame:
    """Store each text of docs(doc_id, text) as a JPEG file, read the file again and compute features.

    One row for each row of docs: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width, height.
    Null and empty texts are 64 zero bytes. Repeated rows stay repeated. An empty table gives an empty result. Other columns are ignored.
    Files are made and read in one pass within a task; nothing is shuffled.
    """

    def rows(b):
        raw = [(t or "").encode() for t in b.column(1).to_pylist()]
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")}
        at = 0
        while at < len(raw):  # a few megabytes at once
            end, size = at, 0
            while end < len(raw) and (size < 2_000_000 or end == at):
                size += len(raw[end]) + 64
                end += 1
            files = encode([payload(r) for r in raw[at:end]])
            for f, d in zip(files, decode(files), strict=True):
                back = read_payload(d)
                out["payload_bytes"].append(len(back))
                out["payload_sha256"].append(hashlib.sha256(back).hexdigest())
                out["tail_crc32"].append(zlib.crc32(back[-64:]))
                out["media_bytes"].append(len(f))
                out["media_sha256"].append(hashlib.sha256(f).hexdigest())
                out["feature"].append(f"{d['width']}x{d['height']}:{thumbnail_hash(d['thumbnail'])}")
                out["width"].append(d["width"])
                out["height"].append(d["height"])
            at = end
        return {"doc_id": b.column(0), "n_bytes": [len(r) for r in raw]} | out

    return by_rows(
        docs.select("doc_id", "text"), rows,
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long",
    )
