"""Colours as one image that map viewers open: a tiled RGBA GeoTIFF (BigTIFF,
deflate) with overviews as further pages.

Tasks compress tiles, each of its own rows, so that none holds more than a tile.
As tables of tiles come before the data and have a known size, every tile's
place follows from the sizes of those before it: runs of tiles are summed, and
a task writes a run's bytes and its part of the tables to their places. The
driver writes the pages' headers, last, and gives the file its name then: an
image is whole or not there. A task that is run again writes the same bytes to
the same places.

The file must be on a store that can be written in the middle and that driver
and executors share (a mounted one); paths with a scheme other than `file:` are
errors.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firnline.grid import TILE, GridSpec, cut_lineage, workers_see
from firnline.sources import geotiff as G

BANDS = ("red", "green", "blue", "alpha")
FACTORS = (2, 4, 8, 16)
RUN = 256  # tiles that a task writes in one go
#: Tags that only images have.
KIND, LOOK, EXTRA = 254, 262, 338


@dataclass(frozen=True)
class Page:
    factor: int
    width: int
    height: int
    across: int  # tiles in a row
    count: int
    first: int  # number of its first tile, over all pages


def pages(spec: GridSpec, factors=FACTORS, tile: int = TILE) -> list[Page]:
    """The image and its overviews; tiles are numbered from the coarsest page
    on, so that what a viewer shows first lies together."""
    out, first = [], 0
    for f in sorted({1, *factors}, reverse=True):
        part = spec.coarser(f)
        across, down = -(-part.width // tile), -(-part.height // tile)
        out.append(Page(f, part.width, part.height, across, across * down, first))
        first += across * down
    return out[::-1]


def compressed(x: np.ndarray) -> bytes:
    """A tile of rows x columns x 4 bytes; columns after the first as differences."""
    d = x.copy()
    d[:, 1:] -= x[:, :-1]
    return zlib.compress(d.tobytes(), 6)


def _head(plan: list[Page], spec: GridSpec, tile: int, places: int, sizes: int, single: dict[int, tuple[int, int]]) -> bytes:
    """The file's first bytes: a directory per page. places, sizes: where the
    tables are; single: place and size of the tile of pages with one tile, whose
    tables have no place of their own in this format."""
    out = b"II+\0" + struct.pack("<HHQ", 8, 0, 16)
    code = {"H": 3, "I": 4, "d": 12, "Q": 16}
    for page in plan:
        tables = single.get(page.first, (0, 0)) if page.count == 1 else (places + 8 * page.first, sizes + 8 * page.first)
        fields = [
            (KIND, "I", (int(page.factor > 1),)), (G.WIDTH, "I", (page.width,)), (G.HEIGHT, "I", (page.height,)), (G.BITS, "H", (8,) * 4), (G.COMPRESSION, "H", (8,)),
            (LOOK, "H", (2,)), (G.SAMPLES, "H", (4,)), (G.PLANAR, "H", (1,)), (G.PREDICTOR, "H", (2,)), (G.TILE_WIDTH, "I", (tile,)), (G.TILE_HEIGHT, "I", (tile,)),
            (G.TILES, "Q", tables[0]), (G.TILE_BYTES, "Q", tables[1]), (EXTRA, "H", (2,)), (G.FORMAT, "H", (1,) * 4),
        ]
        if page.factor == 1:
            keys = G.geo_keys(spec.crs)
            fields += [(G.SCALE, "d", (spec.cell, spec.cell, 0.0)), (G.TIE, "d", (0.0, 0.0, 0.0, spec.x0, spec.y0, 0.0)), (G.KEYS, "H", keys)]
        more_at = len(out) + 8 + 20 * len(fields) + 8
        entries, more = b"", b""
        for tag, kind, values in fields:
            if isinstance(values, int):  # where a table is, or its one number
                entries += struct.pack("<HHQQ", tag, code[kind], page.count, values)
                continue
            raw = struct.pack(f"<{len(values)}{kind}", *values)
            entries += struct.pack("<HHQ", tag, code[kind], len(values))
            if len(raw) <= 8:
                entries += raw.ljust(8, b"\0")
            else:
                entries += struct.pack("<Q", more_at + len(more))
                more += raw.ljust(-(-len(raw) // 8) * 8, b"\0")
        after = more_at + len(more) if page is not plan[-1] else 0
        out += struct.pack("<Q", len(fields)) + entries + struct.pack("<Q", after) + more
    return out


def _tiles(colours: DataFrame, spec: GridSpec, plan: list[Page], tile: int) -> DataFrame:
    """k, data: every tile that has cells, compressed. Cells are read once; one
    shuffle takes each to its tile of the image, and one of every f x f cells,
    their middle one, to its tile of the overview by f."""
    r, c = F.col("r"), F.col("c")

    def place(page: Page) -> Column:
        f = page.factor
        pr, pc = F.floor(r / f), F.floor(c / f)
        number = F.lit(page.first) + F.floor(pr / tile) * page.across + F.floor(pc / tile)
        here = F.struct(number.alias("k"), (F.pmod(pr, F.lit(tile)) * tile + F.pmod(pc, F.lit(tile))).cast("int").alias("at"))
        return F.when((F.pmod(r, F.lit(f)) == f // 2) & (F.pmod(c, F.lit(f)) == f // 2), here)

    byte = lambda b: F.greatest(F.least(F.coalesce(F.col(b).cast("int"), F.lit(0)), F.lit(255)), F.lit(0))
    rgba = byte("red").bitwiseOR(F.shiftleft(byte("green"), 8)).bitwiseOR(F.shiftleft(byte("blue"), 16)).bitwiseOR(F.shiftleft(byte("alpha"), 24))
    inside = colours.where(r.between(0, spec.height - 1) & c.between(0, spec.width - 1))
    x = inside.select(F.explode(F.array_compact(F.array(*map(place, plan)))).alias("p"), rgba.alias("rgba")).select("p.k", "p.at", "rgba")

    def pack(table: pa.Table) -> pa.Table:
        a = np.zeros(tile * tile, np.uint32)
        np.maximum.at(a, table["at"].to_numpy(), table["rgba"].to_numpy().view(np.uint32))
        data = compressed(a.view(np.uint8).reshape(tile, tile, 4))
        return pa.table({"k": table["k"].slice(0, 1).combine_chunks(), "data": pa.array([data], pa.binary())})

    return x.groupBy("k").applyInArrow(pack, "k long, data binary")


def _local(path: str) -> str:
    if path.startswith("file:"):
        path = path[5:]
        path = path[2:] if path.startswith("//") else path
    if "://" in path:
        raise ValueError(f"an image needs a store that can be written in the middle: {path}")
    return os.path.abspath(path)


def write_image(colours: DataFrame, spec: GridSpec, path: str, factors=FACTORS, tile: int = TILE) -> str:
    """r, c, red, green, blue, alpha to one file. Cells without a row, and those
    whose colour is NULL, are transparent; rows outside the grid aren't shown; of
    several rows of one cell the one counts whose bytes, alpha first, are the
    largest number. Returns the file's path."""
    spark = colours.sparkSession
    workers_see(spark)
    if spec.width < 1 or spec.height < 1:
        raise ValueError("an image needs a cell at least")
    path, plan = _local(path), pages(spec, factors, tile)
    total = sum(p.count for p in plan)
    empty = compressed(np.zeros((tile, tile, 4), np.uint8))
    places = -(-len(_head(plan, spec, tile, 0, 0, {})) // 8) * 8
    sizes = places + 8 * total
    nothing = sizes + 8 * total  # where the tile is that all tiles without cells share
    data = nothing + len(empty)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    staged = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{uuid.uuid4().hex}"

    def put(run: pa.Table, parts: pa.Table) -> pa.Table:
        first, at = run["run"][0].as_py() * RUN, data + run["start"][0].as_py()
        where, long = np.full(min(RUN, total - first), nothing, "<u8"), np.full(min(RUN, total - first), len(empty), "<u8")
        parts = parts.sort_by("k")
        with open(staged, "r+b") as f:
            f.seek(at)
            for k, block in zip(parts["k"].to_pylist(), parts["data"], strict=True):
                where[k - first], long[k - first] = at, len(b := block.as_py())
                f.write(b)
                at += len(b)
            for table, values in ((places, where), (sizes, long)):
                f.seek(table + 8 * first)
                f.write(values.tobytes())
        return run.select(["run"])

    try:
        with open(staged, "wb") as f:
            f.seek(nothing)
            f.write(empty)
        blocks = cut_lineage(_tiles(colours, spec, plan, tile).withColumn("run", F.floor(F.col("k") / RUN)), "blocks")
        held = blocks.groupBy("run").agg(F.sum(F.length("data")).alias("size"))
        runs = spark.range(-(-total // RUN)).withColumnRenamed("id", "run").join(held, "run", "left").withColumn("size", F.coalesce("size", F.lit(0)))
        # The one sum in a row: a number for every 16.8 million pixels.
        runs = runs.select("run", (F.sum("size").over(Window.orderBy("run")) - F.col("size")).alias("start"))
        runs.groupBy("run").cogroup(blocks.groupBy("run")).applyInArrow(put, "run long").write.format("noop").mode("overwrite").save()
        with open(staged, "r+b") as f:
            single = {}
            for page in plan:
                if page.count == 1:
                    f.seek(places + 8 * page.first)
                    at = struct.unpack("<Q", f.read(8))[0]
                    f.seek(sizes + 8 * page.first)
                    single[page.first] = at, struct.unpack("<Q", f.read(8))[0]
            f.seek(0)
            f.write(_head(plan, spec, tile, places, sizes, single))
        os.replace(staged, path)
    except BaseException:
        if os.path.exists(staged):
            os.remove(staged)
        raise
    return path


def read_image(spark: SparkSession, path: str, page: int = 0) -> DataFrame:
    """r, c, red, green, blue, alpha of the image (page 0) or of an overview,
    every pixel; a task reads its own tiles."""
    x, _ = G.read_bands(spark, _local(path), BANDS, page)
    return x.select("r", "c", *[F.col(b).cast("int").alias(b) for b in BANDS])
