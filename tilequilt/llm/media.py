"""Media columns in baseline JPEG: lossless storage of a payload, and features read back from any baseline JPEG.

A payload's bytes, less 128, are the quantised coefficients of 8x8 luminance blocks in scan order (coefficients are the
unit that a JPEG stores exactly; samples go through a rounded transform). A restart marker follows each block, so that
the decoder works on all blocks of many images at a time. The reader takes any baseline JPEG with 8-bit samples:
markers are parsed, scans Huffman-decoded, and a luminance thumbnail is made of the DC coefficients alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, in_arrow, text_bytes

UNIT = 64
#: Blocks in one vectorised step.
SLAB = 1 << 14
_COMMENT = b"payload="


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in scan order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


def code_lengths() -> tuple[dict[int, int], dict[int, int]]:
    """Code lengths by symbol, of DC and AC, by a rule: short for text bytes less 128, long for runs of zeros."""
    ac = {0x00: 4, 0xF0: 12}
    for run in range(16):
        for size in range(1, 11):
            ac[run << 4 | size] = 12 if run else 3 if 3 <= size <= 8 else 5
    return dict.fromkeys(range(12), 4), ac


def table_bytes(lengths: dict[int, int]) -> bytes:
    """A DHT segment's counts and symbols."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes(sum(v == n for v in lengths.values()) for n in range(1, 17)) + bytes(order)


def canonical(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a DHT segment's counts and symbols."""
    out, code, at = [], 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out.append((symbols[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


@cache
def _codes() -> tuple[np.ndarray, np.ndarray]:
    """[code, length] by symbol for DC and AC of what is written here."""
    out = []
    for lengths in code_lengths():
        raw, table = table_bytes(lengths), np.zeros((2, 256), np.uint64)
        for s, c, n in canonical(raw[:16], raw[16:]):
            table[:, s] = c, n
        out.append(table)
    return out[0], out[1]


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def grid(blocks: int) -> tuple[int, int]:
    """Width and height in blocks, about square."""
    w = int(np.ceil(np.sqrt(blocks)))
    if w > 8191:
        raise ValueError(f"{blocks} blocks do not fit an image")
    return w, -(-blocks // w)


def header(payload: int) -> bytes:
    w, h = grid(payload // UNIT)
    dc, ac = code_lengths()
    frame = bytes([8]) + (8 * h).to_bytes(2, "big") + (8 * w).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    tables = b"\x00" + table_bytes(dc) + b"\x10" + table_bytes(ac)
    parts = [_segment(0xFE, _COMMENT + b"%d" % payload), _segment(0xDB, b"\x00\x08" + b"\x01" * 63), _segment(0xC0, frame), _segment(0xC4, tables), _segment(0xDD, b"\x00\x01"), _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")]
    return b"\xff\xd8" + b"".join(parts)


def _sizes(x: np.ndarray) -> np.ndarray:
    """Bits of |x|."""
    return np.frexp(np.abs(x).astype(np.float32))[1]


def scan_blocks(coefs: np.ndarray, index: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded blocks [n, 64], each byte-aligned, and RST markers after all that aren't an image's last.

    index: each block's place in its image. Returns (bytes, where each block with its marker ends).
    """
    n = len(coefs)
    dc, ac = _codes()
    on = coefs != 0
    on[:, 0] = True
    block, k = np.nonzero(on)
    value = coefs[block, k].astype(np.int64)
    size = _sizes(value).astype(np.uint64)
    amp = np.where(value < 0, value + (1 << size.astype(np.int64)) - 1, value).astype(np.uint64)
    begins = np.flatnonzero(k == 0)
    run = np.diff(k, prepend=0) - 1
    run[begins] = 0
    zrl, symbol = run >> 4, ((run & 15) << 4) | size.astype(np.int64)
    code, length = ac[0][symbol], ac[1][symbol]
    code[begins], length[begins] = dc[0][size[begins].astype(np.int64)], dc[1][size[begins].astype(np.int64)]
    code, length = code << size | amp, length + size
    for z in range(1, 4):  # up to three runs of sixteen zeros stand before
        more = zrl >= z
        code[more] |= ac[0][0xF0] << length[more]
        length[more] += ac[1][0xF0]
    ends = np.append(begins[1:], len(k)) - 1
    short = ends[k[ends] < 63]
    code[short] = code[short] << ac[1][0] | ac[0][0]
    length[short] += ac[1][0]
    upto = np.cumsum(length)
    bits = upto[ends] - np.concatenate([[np.uint64(0)], upto[ends][:-1]])
    words = (bits >> np.uint64(6)) + np.uint64(2)
    word0 = np.cumsum(words) - words
    base = np.repeat(upto[ends] - bits, np.diff(np.append(begins, len(k))))
    off = upto - length - base
    at, sh = (word0[block] + (off >> np.uint64(6))).astype(np.int64), off & np.uint64(63)
    top = code << (np.uint64(64) - length)
    packed = np.zeros(int(words.sum()), np.uint64)
    np.add.at(packed, at, top >> sh)
    np.add.at(packed, at + 1, np.where(sh > 0, top << ((np.uint64(64) - sh) & np.uint64(63)), np.uint64(0)))
    raw = packed.byteswap().view(np.uint8)
    count = ((bits + np.uint64(7)) >> np.uint64(3)).astype(np.int64)
    cum = np.cumsum(count)
    src = np.arange(cum[-1]) + np.repeat((word0 * np.uint64(8)).astype(np.int64) - (cum - count), count)
    data = raw[src]
    data[cum - 1] |= ((1 << (count * 8 - bits.astype(np.int64))) - 1).astype(np.uint8)
    stuffed = data == 0xFF
    marks = np.where(last, 0, 2)
    before = np.cumsum(stuffed) - stuffed + np.repeat(np.cumsum(marks) - marks, count)
    out_end = cum + np.cumsum(stuffed)[cum - 1] + np.cumsum(marks)
    out = np.zeros(int(out_end[-1]), np.uint8)
    out[np.arange(len(data)) + before] = data
    inner = np.flatnonzero(~last)
    out[out_end[inner] - 2] = 0xFF
    out[out_end[inner] - 1] = 0xD0 + (index[inner] & 7)
    return out, out_end


def _slabs(counts: list[int]) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (item, first block, blocks) of SLAB blocks at most, over items of so many blocks."""
    group, room = [], SLAB
    for i, n in enumerate(counts):
        at = 0
        while at < n:
            some = min(n - at, room)
            group.append((i, at, some))
            at, room = at + some, room - some
            if not room:
                yield group
                group, room = [], SLAB
    if group:
        yield group


def encode(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG of each payload (a positive multiple of 64 bytes)."""
    blocks = [len(p) // UNIT for p in payloads]
    full = [w * h for w, h in map(grid, blocks)]
    parts: list[list[bytes]] = [[header(len(p))] for p in payloads]
    for group in _slabs(full):
        coefs = np.zeros((sum(n for _, _, n in group), 64), np.int16)
        at = 0
        for i, first, n in group:
            some = np.frombuffer(payloads[i], np.uint8)[first * UNIT : (first + n) * UNIT].reshape(-1, 64)
            coefs[at : at + len(some)] = some.astype(np.int16) - 128
            at += n
        index = np.concatenate([np.arange(f, f + n) for _, f, n in group])
        last = np.concatenate([np.arange(f + 1, f + n + 1) == full[i] for i, f, n in group])
        out, end = scan_blocks(coefs, index, last)
        at = begin = 0
        for i, _, n in group:
            at += n
            parts[i].append(out[begin : end[at - 1]].tobytes())
            begin = int(end[at - 1])
    return [b"".join([*p, b"\xff\xd9"]) for p in parts]


class Image:
    """What the markers of a baseline JPEG say, and where its scan is."""

    def __init__(self, raw: bytes) -> None:
        if raw[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        self.quant, self.huff, self.restart, self.payload, self.comps = {}, {}, 0, None, []
        at = 2
        while True:
            while raw[at : at + 2] == b"\xff\xff":
                at += 1
            if at + 4 > len(raw) or raw[at] != 0xFF:
                raise ValueError("no scan in the JPEG")
            marker, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
            body, at = raw[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huff[body[0]] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif marker == 0xC0:
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.comps = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            elif marker in (0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
                raise ValueError("no baseline JPEG")
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xFE and body.startswith(_COMMENT):
                self.payload = int(body[len(_COMMENT) :])
            elif marker == 0xDA:
                break
        tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
        if len(tables) != len(self.comps):
            raise ValueError("scans of single components are not read")
        if len(self.comps) == 1:
            self.comps = [(self.comps[0][0], 1, 1, self.comps[0][3])]
        h, v = (max(c[i] for c in self.comps) for i in (1, 2))
        self.mcu_w, self.mcu_h = -(-self.width // (8 * h)), -(-self.height // (8 * v))
        self.pattern = [i for i, c in enumerate(self.comps) for _ in range(c[1] * c[2])]
        self.luts = tuple(self.huff[t] for c in self.comps for t in (tables[c[0]] >> 4, 0x10 | tables[c[0]] & 15))
        self.scan = at
        self.blocks = self.mcu_w * self.mcu_h * len(self.pattern)

    def thumbnail(self, dc: np.ndarray) -> np.ndarray:
        """Luminance samples [ceil(height / 8), ceil(width / 8)] of the DC coefficients of all blocks in scan order."""
        _, h, v, q = self.comps[0]
        own = dc.reshape(self.mcu_h, self.mcu_w, len(self.pattern))[:, :, : h * v].reshape(self.mcu_h, self.mcu_w, v, h)
        plane = own.transpose(0, 2, 1, 3).reshape(self.mcu_h * v, self.mcu_w * h)
        tall, wide = max(c[2] for c in self.comps), max(c[1] for c in self.comps)
        plane = plane[: -(-self.height * v // (8 * tall)), : -(-self.width * h // (8 * wide))]
        return np.clip(np.floor(plane * self.quant[q][0] / 8 + 128.5), 0, 255).astype(np.uint8)


@lru_cache(64)
def _lut(raw: bytes) -> np.ndarray:
    """symbol | length << 8 by the next 16 bits; 0 where no code fits."""
    out = np.zeros(1 << 16, np.int32)
    for s, code, n in canonical(raw[:16], raw[16:]):
        out[code << (16 - n) : (code + 1) << (16 - n)] = s | n << 8
    return out


def _clean(raw: bytes, at: int) -> tuple[np.ndarray, np.ndarray]:
    """The scan from at on without stuffing and markers; where its restart segments end."""
    d = np.frombuffer(raw, np.uint8)[at:]
    ff = np.flatnonzero(d[:-1] == 0xFF)
    nxt = d[ff + 1]
    stop = np.flatnonzero((nxt != 0) & (nxt != 0xFF) & ((nxt < 0xD0) | (nxt > 0xD7)))
    if len(stop):
        ff, nxt, d = ff[: stop[0]], nxt[: stop[0]], d[: ff[stop[0]]]
    drop = np.zeros(len(d), bool)
    rst = ff[nxt >= 0xD0]
    rst = rst[(d[rst + 1] & 0xF8) == 0xD0] if len(rst) else rst
    drop[ff[nxt == 0] + 1] = True
    drop[rst] = drop[rst + 1] = True
    kept = d[~drop]
    ends = rst - np.cumsum(drop)[rst] + 1 if len(rst) else np.empty(0, np.int64)
    return kept, np.append(ends, len(kept))


def decode_segments(data: np.ndarray, start: np.ndarray, stop: np.ndarray, blocks: np.ndarray, pattern: list[int], luts: tuple[bytes, ...]) -> np.ndarray:
    """Coefficients [all blocks, 64] of byte-aligned segments [start, stop) of data with so many blocks each.

    All segments advance together, one Huffman symbol a step. DC values are predicted within a segment.
    """
    total = int(blocks.sum())
    out = np.zeros(total * 64, np.int16)
    lut = np.concatenate([_lut(x) for x in luts])
    wide = np.zeros(len(data) + 8, np.uint64)
    wide[: len(data)] = data
    win = np.zeros(len(data) + 3, np.uint64)
    for j in range(5):
        win |= wide[j : j + len(win)] << np.uint64(32 - 8 * j)
    first = np.cumsum(blocks) - blocks
    pos, place, k = start.astype(np.int64) * 8, first * 64, np.zeros(len(start), np.int64)
    finish, limit = (first + blocks) * 64, stop.astype(np.int64) * 8
    own = np.array(pattern, np.int64)
    origin = first * 64
    while len(pos):
        w = win[pos >> 3]
        low = pos & 7
        table = np.minimum(k, 1)
        if len(own) > 1:
            table += 2 * own[(place - origin) // 64 % len(own)]
        hit = lut[(table << 16) | ((w >> (24 - low).astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.int64)]
        n, run, size = hit >> 8, (hit >> 4) & 15, hit & 15
        if not n.all():
            raise ValueError("no such Huffman code")
        bits = ((w >> (40 - low - n - size).astype(np.uint64)) & ((1 << size) - 1).astype(np.uint64)).astype(np.int64)
        value = np.where(bits < (1 << size) >> 1, bits - (1 << size) + 1, bits)
        pos += n + size
        isac = k > 0
        k += np.where(isac, run, 0)
        on = size > 0
        where = place + k
        if int((k[on] > 63).sum()):
            raise ValueError("a run passes the end of a block")
        out[where[on]] = value[on]
        k = np.where(isac & ~on & (run < 15), 64, k + 1)
        over = k > 63
        if over.any():
            place = np.where(over, place + 64, place)
            k[over] = 0
            if (pos > limit).any():
                raise ValueError("the scan is cut off")
            go = place < finish
            if not go.all():
                pos, place, k, finish, limit, origin = (x[go] for x in (pos, place, k, finish, limit, origin))
    coefs = out.reshape(-1, 64)
    if total > len(blocks):
        comp = own[(np.arange(total) - np.repeat(first, blocks)) % len(own)]
        seg = np.repeat(np.arange(len(blocks)), blocks)
        for c in range(max(own) + 1):
            mine = np.flatnonzero(comp == c)
            upto = np.cumsum(coefs[mine, 0].astype(np.int64))
            starts = np.flatnonzero(np.diff(seg[mine], prepend=-1))
            base = np.repeat(upto[starts] - coefs[mine[starts], 0], np.diff(np.append(starts, len(mine))))
            coefs[mine, 0] = upto - base
    return coefs


def _own(image: Image) -> bool:
    return image.restart == 1 and len(image.pattern) == 1


def decode(media: list[bytes]) -> Iterator[tuple[Image, np.ndarray]]:
    """(image, coefficients [block, 64] in scan order) of each JPEG; images with one block a segment go together."""
    images = [Image(m) for m in media]
    at = 0
    while at < len(images):
        group, size = [at], images[at].blocks
        while (n := group[-1] + 1) < len(images) and images[n].luts == images[at].luts and _own(images[n]) and _own(images[at]) and size + images[n].blocks <= SLAB:
            group.append(n)
            size += images[n].blocks
        data, starts, stops, blocks, base = [], [], [], [], 0
        for i in group:
            kept, ends = _clean(media[i], images[i].scan)
            step = (images[i].restart or images[i].mcu_w * images[i].mcu_h) * len(images[i].pattern)
            count = np.minimum(step, images[i].blocks - np.arange(0, images[i].blocks, step))
            if len(ends) < len(count):
                raise ValueError("restart markers are missing")
            ends = ends[: len(count)]
            data.append(kept)
            starts.append(np.append(0, ends[:-1]) + base)
            stops.append(ends + base)
            blocks.append(count)
            base += len(kept)
        whole, a, z, b = (np.concatenate(x) for x in (data, starts, stops, blocks))
        pieces, first = [], 0
        while first < len(b):  # one large image goes in slabs of segments
            upto = first + max(1, int(np.searchsorted(np.cumsum(b[first:]), SLAB, side="right")))
            lo, hi = int(a[first]), int(z[upto - 1])
            pieces.append(decode_segments(whole[lo:hi], a[first:upto] - lo, z[first:upto] - lo, b[first:upto], images[at].pattern, images[at].luts))
            first = upto
        coefs, first = np.concatenate(pieces), 0
        for i in group:
            yield images[i], coefs[first : first + images[i].blocks]
            first += images[i].blocks
        at = group[-1] + 1


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64-bit difference hash (hex) of a luminance thumbnail: sampled at 8 rows and 9 columns, neighbours compared."""
    rows = (np.arange(8) * 2 + 1) * thumb.shape[0] // 16
    cols = (np.arange(9) * 2 + 1) * thumb.shape[1] // 18
    cells = thumb[np.ix_(rows, cols)]
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def padded(raw: bytes) -> bytes:
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = text_bytes(batch.column("text"))
        for lo in range(0, len(texts), 256):
            some = texts[lo : lo + 256]
            yield pa.record_batch([batch.column("doc_id").slice(lo, 256), pa.array([len(t) for t in some], pa.int64()), pa.array(encode([padded(t) for t in some]), pa.binary())], names=["doc_id", "n_bytes", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "thumb_width", "thumb_height", "thumb_sha256"]
    for batch in batches:
        media, rows = batch.column("media").to_pylist(), []
        for raw, (image, coefs) in zip(media, decode(media), strict=True):
            payload = (coefs.ravel() + 128).astype(np.uint8)[: image.payload].tobytes() if image.payload else b""
            thumb = image.thumbnail(coefs[:, 0].astype(np.int64))
            feature = f"{image.width}x{image.height}:{thumbnail_hash(thumb)}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, image.width, image.height, thumb.shape[1], thumb.shape[0], hashlib.sha256(thumb.tobytes()).hexdigest()))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        cols = [pa.array(x, k) for x, k in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)]
        yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *cols], names=["doc_id", "n_bytes", *names])


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of every row of docs (doc_id, text): the text's UTF-8 bytes, zero-padded to a positive
    multiple of 64, as a baseline JPEG. A null text is empty; null ids pass; repeated rows each come back; an empty
    table gives an empty one; extra columns are ignored. A text over 4 GB does not fit an image and fails."""
    rows = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return in_arrow(rows, _store, "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """Dimensions, hashes and the payload's digests of stored (doc_id, n_bytes, media), read from the stored bytes.

    payload columns hold what the coefficients carry (a JPEG not made by store_media has an empty payload). Anything
    but a baseline JPEG raises an error: stored media are never null.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, thumb_width int, thumb_height int, thumb_sha256 string"
    return in_arrow(columns(stored, "doc_id", "n_bytes", "media"), _read, schema)
