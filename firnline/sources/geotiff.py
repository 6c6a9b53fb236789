"""GeoTIFF: a file's blocks are read by tasks, each its own; written, a raster
is a folder of tiles with their place in the world.

Read: little- and big-endian, classic and BigTIFF, strips and tiles, the first
band of integers and floating point numbers; uncompressed, deflate, LZW or
zstd, with horizontal or floating point differences. Rotated rasters, pixels
that aren't square and other compressions are errors."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.grid import NODATA, TILE, GridSpec, workers_see
from firnline.operators.project import GEOGRAPHIC

#: Bytes and codes of the file format's field types.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: Tags.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, SCALE, TIE, KEYS, MISSING = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113


def _open(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(path)
    store, at = fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return store.open_input_file(at)


def header(path: str, page: int = 0) -> dict[int, tuple]:
    """Tags of an image of the file, the first one's if not told otherwise, and
    its byte order under 0."""
    with _open(path) as f:
        start = f.read_at(16, 0)
        order = {b"II": "<", b"MM": ">"}.get(start[:2])
        kind = struct.unpack(order + "H", start[2:4])[0] if order else 0
        if kind not in (42, 43):
            raise ValueError(f"not a TIFF file: {path}")
        wide = kind == 43
        at = struct.unpack(order + ("Q" if wide else "I"), start[8:16] if wide else start[4:8])[0]
        head, size, room = (8, 20, 8) if wide else (2, 12, 4)
        for k in range(page + 1):
            if not at:
                raise ValueError(f"{k} images, none with number {page}: {path}")
            n = struct.unpack(order + ("Q" if wide else "H"), f.read_at(head, at))[0]
            if k < page:
                at = struct.unpack(order + ("Q" if wide else "I"), f.read_at(room, at + head + n * size))[0]
        at += head
        entries, out = f.read_at(n * size, at), {0: (order,)}
        for i in range(0, n * size, size):
            tag, code = struct.unpack_from(order + "HH", entries, i)
            count = struct.unpack_from(order + ("Q" if wide else "I"), entries, i + 4)[0]
            if code not in TYPES:
                continue
            item = TYPES[code]
            total = struct.calcsize(order + item) * count
            data = entries[i + size - room : i + size]
            if total > room:
                data = f.read_at(total, struct.unpack(order + ("Q" if wide else "I"), data)[0])
            out[tag] = (data[:count],) if item == "s" else struct.unpack_from(f"{order}{count * len(item)}{item[0]}", data)
    return out


def unpacked(data: bytes) -> bytes:
    """LZW as this format has it: codes from the highest bit, 9 bits at first,
    256 clears the table, 257 ends."""
    out, table, width, bits, held, last = [], [], 9, 0, 0, None
    base = [bytes([k]) for k in range(256)] + [b"", b""]
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            code, bits = held >> (bits - width), bits - width
            held &= (1 << bits) - 1
            if code == 257:
                return b"".join(out)
            if code == 256:
                table, width, last = base.copy(), 9, None
                continue
            if last is None:
                entry = table[code]
            else:
                entry = table[code] if code < len(table) else last + last[:1]
                table.append(last + entry[:1])
            out.append(entry)
            last = entry
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
    return b"".join(out)


def _decoder(tags: dict[int, tuple]):
    """bytes of a block, its columns -> rows x columns x samples of numbers."""
    order, bits, form = tags[0][0], tags.get(BITS, (8,))[0], tags.get(FORMAT, (1,))[0]
    samples, compression, predictor = tags.get(SAMPLES, (1,))[0], tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0]
    if tags.get(PLANAR, (1,))[0] == 2:
        samples = 1
    if form not in (1, 2, 3) or bits not in (8, 16, 32, 64):
        raise ValueError(f"samples of {bits} bits, format {form}")
    kind = np.dtype(f"{order}{'?uif'[form]}{bits // 8}")

    def decode(data: bytes, columns: int) -> np.ndarray:
        if compression in (8, 32946):
            data = zlib.decompress(data)
        elif compression == 5:
            data = unpacked(data)
        elif compression == 50000:
            import zstandard

            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        elif compression != 1:
            raise ValueError(f"compression {compression}")
        wide = columns * samples
        rows = len(data) // (wide * kind.itemsize)
        raw = np.frombuffer(data, np.uint8, rows * wide * kind.itemsize).reshape(rows, -1)
        if predictor == 3:  # bytes by weight, the first bytes of all numbers first
            summed = raw.reshape(rows, -1, samples).cumsum(axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, wide)
            return np.ascontiguousarray(summed.transpose(0, 2, 1)).view(f">f{kind.itemsize}").reshape(rows, columns, samples)
        x = raw.copy().view(kind).reshape(rows, columns, samples)
        if predictor == 2:
            x = x.astype(kind.newbyteorder("=")).cumsum(axis=1, dtype=kind.newbyteorder("="))
        return x

    return decode


def spec_of(tags: dict[int, tuple]) -> GridSpec:
    sx, sy = tags.get(SCALE, (1.0, 1.0))[:2]
    if abs(sx - sy) > 1e-9 * max(abs(sx), 1e-12):
        raise ValueError("pixels aren't square")
    tie = tags.get(TIE, (0.0,) * 6)
    keys, crs = tags.get(KEYS, ()), ""
    for i in range(4, len(keys) - 3, 4):
        if keys[i] == 3072 or keys[i] == 2048 and not crs:  # projected, else geographic
            crs = f"EPSG:{keys[i + 3]}"
    return GridSpec(tags[WIDTH][0], tags[HEIGHT][0], float(sx), tie[3] - tie[0] * sx, tie[4] + tie[1] * sy, crs)


class Blocks:
    """Where the blocks of a file's first band are (of all its bands, if those
    are in the same blocks), and how to read them."""

    def __init__(self, path: str, page: int = 0):
        tags = header(path, page)
        self.path, self.spec = path, spec_of(tags)
        if TILES in tags:
            self.wide, self.high, places, sizes = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0], tags[TILES], tags[TILE_BYTES]
        else:
            self.wide, self.high, places, sizes = self.spec.width, tags.get(ROWS, (self.spec.height,))[0], tags[STRIPS], tags[STRIP_BYTES]
        self.across = -(-self.spec.width // self.wide)
        self.count = self.across * -(-self.spec.height // self.high)  # of the first band, if bands are apart
        self.places, self.sizes = places[: self.count], sizes[: self.count]
        self.tags = {k: tags[k] for k in (0, BITS, FORMAT, SAMPLES, COMPRESSION, PREDICTOR, PLANAR) if k in tags}
        missing = tags.get(MISSING)
        self.nodata = float(missing[0].split(b"\0")[0]) if missing and missing[0].split(b"\0")[0].strip() else None

    def within(self, window: tuple[int, int, int, int]) -> list[tuple[int, int, int]]:
        """(block, place, bytes) of the blocks that meet rows window[0] to
        window[1] and columns window[2] to window[3], ends included."""
        r0, r1, c0, c1 = max(window[0], 0), min(window[1], self.spec.height - 1), max(window[2], 0), min(window[3], self.spec.width - 1)
        if r0 > r1 or c0 > c1:
            return []
        rows, cols = range(r0 // self.high, r1 // self.high + 1), range(c0 // self.wide, c1 // self.wide + 1)
        return [(k, self.places[k], self.sizes[k]) for k in (i * self.across + j for i in rows for j in cols)]

    def read(self, blocks, *bands: str):
        """A batch of r, c and the bands for each block."""
        decode = _decoder(self.tags)
        with _open(self.path) as f:
            for k, at, n in blocks:
                r0, c0 = k // self.across * self.high, k % self.across * self.wide
                x = decode(f.read_at(n, at), self.wide) if n else np.full((self.high, self.wide, len(bands)), np.nan)
                x = x[: self.spec.height - r0, : self.spec.width - c0].astype(float)
                x = np.where(~np.isfinite(x) | (x == self.nodata if self.nodata is not None else False), np.nan, x)
                r, c = np.meshgrid(np.arange(x.shape[0]) + r0, np.arange(x.shape[1]) + c0, indexing="ij")
                values = [pa.array(x[:, :, i].ravel(), from_pandas=True) for i in range(len(bands))]
                yield pa.RecordBatch.from_arrays([pa.array(r.ravel()), pa.array(c.ravel()), *values], names=["r", "c", *bands])


def read_geotiff(spark: SparkSession, path: str, band: str = "z") -> tuple[DataFrame, GridSpec]:
    """r, c, band of every cell (NULL where the file says so), and the grid."""
    return read_bands(spark, path, (band,))


def read_bands(spark: SparkSession, path: str, bands: tuple[str, ...], page: int = 0) -> tuple[DataFrame, GridSpec]:
    """The first bands of an image of the file, and its grid."""
    workers_see(spark)
    found = Blocks(path, page)
    if len(bands) > 1 and (found.tags.get(PLANAR, (1,))[0] == 2 or found.tags.get(SAMPLES, (1,))[0] < len(bands)):
        raise ValueError(f"no {len(bands)} bands in one block: {path}")
    names = ("block", "at", "bytes")
    blocks = pa.table({n: pa.array(v, pa.int64()) for n, v in zip(names, (range(found.count), found.places, found.sizes), strict=True)})
    found.places = found.sizes = ()  # tasks get theirs by the table

    def read(batches):
        for b in batches:
            yield from found.read(zip(*(c.to_pylist() for c in b.columns), strict=True), *bands)

    tasks = min(found.count, 4 * spark.sparkContext.defaultParallelism + found.count // 64)
    return spark.createDataFrame(blocks).repartitionByRange(max(1, tasks), "block").mapInArrow(read, ", ".join(("r long", "c long", *(f"`{b}` double" for b in bands)))), found.spec


def geo_keys(crs: str) -> tuple[int, ...]:
    """The key directory's numbers for EPSG:<code>; pixels are areas."""
    if not crs.startswith("EPSG:"):
        return 1, 1, 0, 1, 1025, 0, 1, 1
    geographic = int(crs[5:]) in GEOGRAPHIC
    return 1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, int(crs[5:])


def file_of(x: np.ndarray, spec: GridSpec, r0: int, c0: int, nodata: float = NODATA) -> bytes:
    """A file of one strip: 32-bit floating point, deflate."""
    data = zlib.compress(np.where(np.isnan(x), nodata, x).astype("<f4").tobytes(), 6)
    text = f"{nodata:g}\0".encode()
    fields = [
        (WIDTH, "I", (x.shape[1],)), (HEIGHT, "I", (x.shape[0],)), (BITS, "H", (32,)), (COMPRESSION, "H", (8,)), (262, "H", (1,)), (STRIPS, "I", (0,)), (SAMPLES, "H", (1,)),
        (ROWS, "I", (x.shape[0],)), (STRIP_BYTES, "I", (len(data),)), (FORMAT, "H", (3,)), (SCALE, "d", (spec.cell, spec.cell, 0.0)),
        (TIE, "d", (0.0, 0.0, 0.0, spec.x0 + c0 * spec.cell, spec.y0 - r0 * spec.cell, 0.0)), (KEYS, "H", geo_keys(spec.crs)), (MISSING, "s", (text,)),
    ]
    code = {"s": 2, "H": 3, "I": 4, "d": 12}
    at = 8 + 2 + 12 * len(fields) + 4
    rows, more = b"", b""
    for tag, kind, values in fields:
        raw = values[0] if kind == "s" else struct.pack(f"<{len(values)}{kind}", *values)
        n = len(raw) if kind == "s" else len(values)
        if tag == STRIPS:
            rows += struct.pack("<HHI", tag, code[kind], n) + b"data"
        elif len(raw) <= 4:
            rows += struct.pack("<HHI", tag, code[kind], n) + raw.ljust(4, b"\0")
        else:
            rows += struct.pack("<HHII", tag, code[kind], n, at + len(more))
            more += raw + b"\0" * (len(raw) % 2)
    rows = rows.replace(b"data", struct.pack("<I", at + len(more)))
    return b"II*\0" + struct.pack("<IH", 8, len(fields)) + rows + b"\0" * 4 + more + data


def write_geotiff(cells: DataFrame, spec: GridSpec, band: str, path: str, tile: int = 8 * TILE) -> list[str]:
    """A folder of files, one for each tile that has cells; returns their names."""
    workers_see(cells.sparkSession)
    x = cells.select("r", "c", F.col(band).cast("double").alias("v"), F.floor(F.col("r") / tile).alias("tr"), F.floor(F.col("c") / tile).alias("tc"))

    def write(pdf):
        import pandas as pd
        from pyarrow import fs

        tr, tc = int(pdf.tr.iloc[0]), int(pdf.tc.iloc[0])
        a = np.full((min(tile, spec.height - tr * tile), min(tile, spec.width - tc * tile)), np.nan)
        a[pdf.r - tr * tile, pdf.c - tc * tile] = pdf.v
        store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        store.create_dir(at, recursive=True)
        name = f"{band}_r{tr}_c{tc}.tif"
        with store.open_output_stream(f"{at}/.{name}") as f:
            f.write(file_of(a, spec, tr * tile, tc * tile))
        store.move(f"{at}/.{name}", f"{at}/{name}")
        return pd.DataFrame({"name": [name]})

    return sorted(r.name for r in x.groupBy("tr", "tc").applyInPandas(write, "name string").collect())  # one row per tile
