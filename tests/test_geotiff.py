"""GeoTIFF files built by hand, in the forms that the format allows."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.grid import GridSpec
from firnline.plans import config
from firnline.plans.run import read_cells
from firnline.sources import geotiff


def lzw(data):
    """Codes of 9 to 12 bits, highest bit first; the table is cleared before it
    would need wider ones."""
    bits, table, width, word = [], {}, 9, b""

    def put(code):
        bits.extend((code >> k) & 1 for k in range(width - 1, -1, -1))

    put(256)
    table = {bytes([k]): k for k in range(256)}
    table[b"clear"], table[b"end"] = 256, 257
    for byte in data:
        if word + bytes([byte]) in table:
            word += bytes([byte])
            continue
        put(table[word])
        table[word + bytes([byte])] = len(table)
        if len(table) == 4094:
            put(256)
            table, width = {bytes([k]): k for k in range(256)} | {b"clear": 256, b"end": 257}, 9
        elif len(table) >= (1 << width):
            width += 1
        word = bytes([byte])
    put(table[word])
    if len(table) + 1 >= (1 << width) and width < 12:
        width += 1
    put(257)
    bits += [0] * (-len(bits) % 8)
    return bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))


def build(x, order="<", tile=None, rows=3, compression=1, predictor=1, big=False, nodata=b"-99\0"):
    """A file with x as its one band."""
    kind = x.dtype.newbyteorder(order)
    form = {"u": 1, "i": 2, "f": 3}[x.dtype.kind]
    h, w = x.shape
    blocks = []
    if tile:
        for r in range(0, h, tile):
            for c in range(0, w, tile):
                b = np.zeros((tile, tile), x.dtype)
                part = x[r : r + tile, c : c + tile]
                b[: part.shape[0], : part.shape[1]] = part
                blocks.append(b)
    else:
        blocks = [x[r : r + rows] for r in range(0, h, rows)]
    raw = []
    for b in blocks:
        if predictor == 2:
            b = np.diff(b, axis=1, prepend=b.dtype.type(0))
        data = b.astype(kind).tobytes()
        if predictor == 3:
            size = x.dtype.itemsize
            p = np.frombuffer(b.astype(f">f{size}").tobytes(), np.uint8).reshape(b.shape[0], b.shape[1], size).transpose(0, 2, 1).reshape(b.shape[0], -1)
            data = np.diff(p, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
        raw.append(zlib.compress(data) if compression == 8 else lzw(data) if compression == 5 else data)
    word, letter, long = ("Q", 16, 20) if big else ("I", 4, 12)
    fields = [(256, "H", [w]), (257, "H", [h]), (258, "H", [x.dtype.itemsize * 8]), (259, "H", [compression]), (277, "H", [1]), (317, "H", [predictor]), (339, "H", [form])]
    fields += [(322, "H", [tile]), (323, "H", [tile]), (324, word, None), (325, "I", [len(r) for r in raw])] if tile else [(273, word, None), (278, "H", [rows]), (279, "I", [len(r) for r in raw])]
    fields += [(33550, "d", [2.5, 2.5, 0]), (33922, "d", [0, 0, 0, 100, 200, 0]), (34735, "H", [1, 1, 0, 1, 3072, 0, 1, 32633])] + ([(42113, "s", nodata)] if nodata else [])
    fields.sort()
    room = 8 if big else 4
    at = (16 + 8 if big else 8 + 2) + long * len(fields) + room
    entries, more = b"", b""
    sizes = [struct.calcsize(f"{order}{len(raw) if v is None else len(v)}{k}") for _, k, v in fields]
    data_at = at + sum(s for s in sizes if s > room)
    places = np.cumsum([data_at, *(len(r) for r in raw[:-1])]).tolist()
    code = {"s": 2, "H": 3, "I": 4, "d": 12, "Q": 16}
    for tag, k, v in fields:
        v = places if v is None else v
        packed = v if k == "s" else struct.pack(f"{order}{len(v)}{k}", *v)
        entries += struct.pack(f"{order}HH{word}", tag, code[k], len(v))
        if len(packed) <= room:
            entries += packed.ljust(room, b"\0")
        else:
            entries += struct.pack(order + word, at + len(more))
            more += packed
    start = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 16) if big else struct.pack(order + "HI", 42, 8))
    return start + struct.pack(order + ("Q" if big else "H"), len(fields)) + entries + b"\0" * room + more + b"".join(raw)


def read(spark, tmp_path, data):
    (tmp_path / "x.tif").write_bytes(data)
    df, spec = geotiff.read_geotiff(spark, f"file://{tmp_path}/x.tif")
    out = np.full((spec.height, spec.width), np.inf)
    for q in df.collect():
        out[q.r, q.c] = np.nan if q.z is None else q.z
    return out, spec


FORMS = [
    {"kind": "<f4"}, {"kind": "<i2", "order": ">", "tile": 16}, {"kind": "<u1", "compression": 8, "rows": 100}, {"kind": "<i4", "compression": 8, "predictor": 2, "tile": 16},
    {"kind": "<f4", "compression": 8, "predictor": 3, "order": ">"}, {"kind": "<f8", "compression": 5, "predictor": 3, "tile": 32}, {"kind": "<i2", "compression": 5, "rows": 7},
    {"kind": "<f8", "big": True}, {"kind": "<u2", "big": True, "order": ">", "tile": 16, "predictor": 2}, {"kind": "<f4", "nodata": None},
]


@pytest.mark.parametrize("form", FORMS, ids=str)
def test_all_forms_are_read(spark, tmp_path, form):
    kind = np.dtype(form.pop("kind") if "kind" in form else "<f4")
    rng = np.random.default_rng(1)
    x = rng.integers(0, 200, (37, 29)).astype(kind) if kind.kind in "iu" else (rng.random((37, 29)) * 9).astype(kind)
    if kind.kind != "u":
        x[3, 4] = -99
    got, spec = read(spark, tmp_path, build(x, **form))
    want = x.astype(float)
    if form.get("nodata", 1):
        want[want == -99] = np.nan
    assert np.array_equal(got, want, equal_nan=True)
    assert spec == GridSpec(29, 37, 2.5, 100.0, 200.0, "EPSG:32633")


def test_what_cannot_be_read_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="not a TIFF"):
        read(spark, tmp_path, b"PK\3\4" + b"\0" * 20)
    with pytest.raises(Exception, match="compression 7"):
        read(spark, tmp_path, build(np.zeros((4, 4), "<f4")).replace(struct.pack("<HHIH", 259, 3, 1, 1), struct.pack("<HHIH", 259, 3, 1, 7)))


def test_tiles_are_written_with_their_places(spark, tmp_path):
    x = spark.createDataFrame([(r, c, float(r * 100 + c) if (r, c) != (2, 3) else None) for r in range(30) for c in range(21)], "r long, c long, z double")
    names = geotiff.write_geotiff(x, GridSpec(21, 30, 5.0, 1000.0, 9000.0, "EPSG:32611"), "z", f"{tmp_path}/out", 16)
    assert len(names) == 4
    for name in names:
        got, spec = read(spark, tmp_path, (tmp_path / "out" / name).read_bytes())
        r0, c0 = round((9000.0 - spec.y0) / 5), round((spec.x0 - 1000.0) / 5)
        assert spec.crs == "EPSG:32611" and spec.cell == 5.0
        for r, c in np.ndindex(got.shape):
            assert (r + r0, c + c0) == (2, 3) and np.isnan(got[r, c]) or got[r, c] == (r + r0) * 100 + c + c0


def test_a_run_reads_files_and_brings_canopy_onto_the_grid(spark, tmp_path):
    z = np.arange(24, dtype="<f4").reshape(4, 6)
    (tmp_path / "z.tif").write_bytes(build(z, nodata=None))
    (tmp_path / "w.tif").write_bytes(build(np.array([[10, 20, 30], [40, 50, 60]], "<u1"), nodata=None).replace(struct.pack("<d", 2.5), struct.pack("<d", 5.0)))
    cells, spec = read_cells(spark, config.RunConfig(dem_path=f"{tmp_path}/z.tif", forest_canopy_path=f"{tmp_path}/w.tif"))
    got = {(q.r, q.c): (q.z, q.canopy) for q in cells.collect()}
    assert (spec.width, spec.height, spec.cell) == (6, 4, 2.5) and got[0, 0] == (None, 10.0) and got[3, 5] == (23.0, 60.0) and got[1, 2] == (8.0, 20.0)
