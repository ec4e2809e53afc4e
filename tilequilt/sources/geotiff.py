"""GeoTIFF as a Spark data source: metadata rows, or overlapping tile windows read by byte ranges.

spark.dataSource.register(GeoTiffSource), then
spark.read.format("geotiff").option("tile", 512).option("overlap", 64).load("dir-or-file[,file...]").
Paths may be any that pyarrow's file systems open. Each partition reads some rows of tiles and only the strips or
tiles of the file that they touch. A window that can't be read gives read_ok = false and no pixels.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

META = "path string, width int, height int, band_count int, epsg int, is_geographic boolean, geo_transform array<double>, error string"
TILES = "path string, width int, height int, band_count int, tile_row int, tile_col int, tile_index int, x int, y int, tile_w int, tile_h int, pixels binary, read_ok boolean"
#: Bytes of decoded cells that a reader remembers: tiles beside each other share strips.
CACHE_BYTES = 64 << 20
#: Bytes of each TIFF field type.
_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 11: 4, 12: 8, 16: 8, 17: 8}
_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}


def opened(path: str):
    """(file, size) of a path or URI."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_file(inner), system.get_file_info(inner).size


def listed(path: str) -> list[str]:
    """The GeoTIFF files of comma-separated paths and folders."""
    from pyarrow import fs

    out = []
    for p in path.split(","):
        system, inner = fs.FileSystem.from_uri(p) if "://" in p else (fs.LocalFileSystem(), p.removeprefix("file:"))
        if system.get_file_info(inner).type == fs.FileType.Directory:
            prefix = p[: len(p) - len(inner)] if p.endswith(inner) else ""
            out += sorted(prefix + f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.path.lower().endswith((".tif", ".tiff")))
        else:
            out.append(p)
    return out


class Tiff:
    """The first image of a TIFF or BigTIFF file."""

    def __init__(self, path: str) -> None:
        self.file, _ = opened(path)
        head = self._at(0, 16)
        self.e = {b"II": "<", b"MM": ">"}[head[:2]]
        magic = struct.unpack(self.e + "H", head[2:4])[0]
        if magic not in (42, 43):
            raise ValueError("not a TIFF file")
        big = magic == 43
        at = struct.unpack(self.e + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
        n, entry = (struct.unpack(self.e + "Q", self._at(at, 8))[0], 20) if big else (struct.unpack(self.e + "H", self._at(at, 2))[0], 12)
        raw, self.tags = self._at(at + (8 if big else 2), n * entry), {}
        for i in range(n):
            f = raw[i * entry : (i + 1) * entry]
            tag, kind = struct.unpack(self.e + "HH", f[:4])
            count = struct.unpack(self.e + ("Q" if big else "I"), f[4 : 12 if big else 8])[0]
            value = f[12:] if big else f[8:]
            if kind in _SIZE:
                size = count * _SIZE[kind]
                data = value[:size] if size <= len(value) else self._at(struct.unpack(self.e + ("Q" if big else "I"), value)[0], size)
                self.tags[tag] = data if kind not in _CODE else struct.unpack(f"{self.e}{count}{_CODE[kind]}", data)
        self.width, self.height = self.tags[256][0], self.tags[257][0]
        self.bands, self.compression = self.tags.get(277, (1,))[0], self.tags.get(259, (1,))[0]
        self.predictor, self.planar = self.tags.get(317, (1,))[0], self.tags.get(284, (1,))[0]
        bits, form = self.tags.get(258, (1,))[0], self.tags.get(339, (1,))[0]
        self.dtype = np.dtype(f"{self.e}{({1: 'u', 2: 'i', 3: 'f'}[form])}{bits // 8}")
        self.tiled = 322 in self.tags
        self.decoded, self.held = {}, 0
        self.cell_w, self.cell_h = (self.tags[322][0], self.tags[323][0]) if self.tiled else (self.width, min(self.height, self.tags.get(278, (self.height,))[0]))
        self.offsets, self.counts = (self.tags[324], self.tags[325]) if self.tiled else (self.tags[273], self.tags[279])

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def keys(self) -> dict[int, int]:
        raw = self.tags.get(34735, ())
        return {raw[i]: raw[i + 3] for i in range(4, len(raw) - 3, 4) if raw[i + 1] == 0}

    def meta(self) -> dict:
        keys = self.keys()
        epsg = keys.get(3072) or keys.get(2048)
        if 33550 in self.tags and 33922 in self.tags:
            (sx, sy, _), (i, j, _, x, y, _) = self.tags[33550][:3], self.tags[33922][:6]
            if keys.get(1025) == 2:  # the tie point is a pixel's centre
                i, j = i + 0.5, j + 0.5
            gt = [x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy]
        elif 34264 in self.tags:
            m = self.tags[34264]
            gt = [m[3], m[0], m[1], m[7], m[4], m[5]]
        else:
            gt = [0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
        return {"width": self.width, "height": self.height, "band_count": self.bands, "epsg": epsg, "is_geographic": keys.get(1024) == 2, "geo_transform": [float(v) for v in gt]}

    def cell(self, i: int) -> np.ndarray:
        """Cell i of the file as [rows, columns, bands]; decoded cells are remembered up to CACHE_BYTES."""
        if i not in self.decoded:
            found = self._decoded(i)
            self.held += found.nbytes
            if self.held > CACHE_BYTES:
                self.decoded, self.held = {}, found.nbytes
            self.decoded[i] = found
        return self.decoded[i]

    def _decoded(self, i: int) -> np.ndarray:
        raw = unpacked(self._at(self.offsets[i], self.counts[i]), self.compression)
        bands = self.bands if self.planar == 1 else 1
        rows = self.cell_h
        if not self.tiled:
            down = -(-self.height // self.cell_h)
            rows = min(self.cell_h, self.height - (i % down) * self.cell_h)
        data = np.frombuffer(raw, self.dtype, rows * self.cell_w * bands).reshape(rows, self.cell_w, bands)
        if self.predictor == 3:  # differences of the rows' bytes, which are dealt out by significance, highest first
            size = self.dtype.itemsize
            planes = np.cumsum(np.frombuffer(raw, np.uint8, rows * self.cell_w * bands * size).reshape(rows, -1, bands), axis=1, dtype=np.uint8)
            whole = planes.reshape(rows, size, self.cell_w * bands).transpose(0, 2, 1)
            return np.ascontiguousarray(whole).view(self.dtype.newbyteorder(">")).reshape(rows, self.cell_w, bands)
        return np.cumsum(data, axis=1, dtype=self.dtype) if self.predictor == 2 else data

    def window(self, x: int, y: int, w: int, h: int) -> np.ndarray:
        """Bytes [h, w, bands] of a window; wider samples are cut to 0..255, fractions rounded."""
        if x < 0 or y < 0 or x + w > self.width or y + h > self.height or w <= 0 or h <= 0:
            raise ValueError("window outside the image")
        across, down = -(-self.width // self.cell_w), -(-self.height // self.cell_h)
        out = np.zeros((h, w, self.bands), np.uint8)
        for r in range(y // self.cell_h, (y + h - 1) // self.cell_h + 1):
            for c in range(x // self.cell_w, (x + w - 1) // self.cell_w + 1):
                for p in range(1 if self.planar == 1 else self.bands):
                    cell = self.cell(p * across * down + r * across + c)
                    top, left = r * self.cell_h, c * self.cell_w
                    y0, y1, x0, x1 = max(y, top), min(y + h, top + len(cell)), max(x, left), min(x + w, left + self.cell_w)
                    part = cell[y0 - top : y1 - top, x0 - left : x1 - left]
                    if self.dtype.kind == "f":  # to the nearest whole number, halves up; no number becomes 0
                        part = np.floor(np.nan_to_num(part.astype(np.float64)) + 0.5)
                    part = np.clip(part, 0, 255).astype(np.uint8)
                    out[y0 - y : y1 - y, x0 - x : x1 - x, slice(None) if self.planar == 1 else slice(p, p + 1)] = part
        return out


def unpacked(raw: bytes, compression: int) -> bytes:
    if compression == 1:
        return raw
    if compression in (8, 32946):
        return zlib.decompress(raw)
    if compression == 32773:
        out, i = bytearray(), 0
        while i < len(raw):
            n = raw[i] - 256 if raw[i] > 127 else raw[i]
            if n >= 0:
                out += raw[i + 1 : i + 2 + n]
                i += n + 2
            else:
                if n != -128:
                    out += raw[i + 1 : i + 2] * (1 - n)
                i += 2 if n != -128 else 1
        return bytes(out)
    if compression == 5:
        return _lzw(raw)
    raise ValueError(f"compression {compression} is not read")


def _lzw(raw: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, codes widen one early."""
    out, table, width, last = bytearray(), [], 9, None
    acc = bits = 0
    for byte in raw:
        acc, bits = acc << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        out += word
        last = word
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def write_geotiff(path: str, image: np.ndarray, geo_transform: list[float] | None = None, epsg: int | None = None, tile: int = 0, compression: int = 1) -> None:
    """Write [rows, columns, bands] to a local file, in strips of 16 rows or in tiles, plain, deflated or PackBits."""
    h, w, bands = image.shape
    image = image.astype(image.dtype.newbyteorder("<"))
    if tile:
        padded = np.pad(image, ((0, -h % tile), (0, -w % tile), (0, 0)))
        cells = [padded[r : r + tile, c : c + tile] for r in range(0, len(padded), tile) for c in range(0, padded.shape[1], tile)]
    else:
        cells = [image[r : r + 16] for r in range(0, h, 16)]
    raw = [np.ascontiguousarray(c).tobytes() for c in cells]
    if compression == 8:
        raw = [zlib.compress(r) for r in raw]
    elif compression == 32773:
        raw = [b"".join(bytes([len(r[i : i + 128]) - 1]) + r[i : i + 128] for i in range(0, len(r), 128)) for r in raw]
    bits = image.dtype.itemsize * 8
    form = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    offsets = np.cumsum([8, *map(len, raw)])[:-1].tolist()
    places = {322: (4, [tile]), 323: (4, [tile]), 324: (4, offsets), 325: (4, [len(r) for r in raw])} if tile else {273: (4, offsets), 278: (4, [16]), 279: (4, [len(r) for r in raw])}
    tags = {256: (4, [w]), 257: (4, [h]), 258: (3, [bits] * bands), 259: (3, [compression]), 262: (3, [1]), 277: (3, [bands]), 284: (3, [1]), 339: (3, [form] * bands)} | places
    if geo_transform:
        g = geo_transform
        tags |= {33550: (12, [g[1], -g[5], 0.0]), 33922: (12, [0.0, 0.0, 0.0, g[0], g[3], 0.0])}
    if epsg:
        geographic = 4000 <= epsg < 5000
        tags[34735] = (3, [1, 1, 0, 2, 1024, 0, 1, 2 if geographic else 1, 2048 if geographic else 3072, 0, 1, epsg])
    body, at = b"".join(raw), 8 + sum(map(len, raw))
    entries, extra = b"", b""
    after = at + 2 + 12 * len(tags) + 4
    for tag in sorted(tags):
        kind, values = tags[tag]
        data = struct.pack(f"<{len(values)}{_CODE[kind]}", *values)
        if len(data) > 4:
            value = struct.pack("<I", after + len(extra))
            extra += data
        else:
            value = data.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, kind, len(values)) + value
    with open(path, "wb") as f:
        f.write(struct.pack("<2sHI", b"II", 42, at) + body + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + extra)


class Rows(InputPartition):
    """Rows [first, last) of tiles of one file; first -1: its metadata."""

    def __init__(self, path: str, first: int = -1, last: int = -1) -> None:
        self.path, self.first, self.last = path, first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths, self.mode = listed(options["path"]), options.get("mode", "tiles")
        self.tile, self.overlap = int(options.get("tile", 512)), int(options.get("overlap", 64))

    def partitions(self) -> list[Rows]:
        if self.mode == "meta":
            return [Rows(p) for p in self.paths]
        out, stride = [], self.tile - self.overlap
        for p in self.paths:
            try:
                out += [Rows(p, r, r + 1) for r in range(-(-Tiff(p).height // stride))]
            except Exception:  # the file is reported by the one row of its one partition
                out.append(Rows(p, 0, 0))
        return out

    def read(self, part: Rows) -> Iterator[tuple]:
        if part.first < 0:
            try:
                yield (part.path, *Tiff(part.path).meta().values(), None)
            except Exception as e:  # a file that can't be read is a row that says so
                yield (part.path, None, None, None, None, None, None, f"Cannot open file: {part.path} ({e})")
            return
        if part.first == part.last:
            yield (part.path, *[None] * 11, False)
            return
        image = Tiff(part.path)
        stride = self.tile - self.overlap
        cols = -(-image.width // stride)
        for row in range(part.first, part.last):
            for col in range(cols):
                x, y = col * stride, row * stride
                w, h = min(self.tile, image.width - x), min(self.tile, image.height - y)
                try:
                    pixels = image.window(x, y, w, h).tobytes()
                except Exception:  # the tile is reported, not lost
                    pixels = None
                yield (part.path, image.width, image.height, image.bands, row, col, row * cols + col, x, y, w, h, pixels, pixels is not None)


class GeoTiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return META if self.options.get("mode", "tiles") == "meta" else TILES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
