"""GeoTIFF as a data source of Spark's:

    register(spark)
    spark.read.format("geotiff").option("path", p).option("band", "z").load().where("r < 512")
    cells.write.format("geotiff").option("path", p).options(**grid_options(spec)).mode("overwrite").save()

Reading, conditions on r and c choose the blocks that are read. Writing, cells
must come tile by tile (`by_tile`); files become visible when all tasks have
ended well, and nothing is left of a write that fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from firnline.grid import TILE, GridSpec, workers_see
from firnline.sources.geotiff import Blocks, file_of

PART_BYTES = 8 << 20  # of blocks that a task reads


def register(spark: SparkSession) -> None:
    workers_see(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiff)


def grid_options(spec: GridSpec) -> dict[str, str]:
    return {"width": str(spec.width), "height": str(spec.height), "cell": repr(spec.cell), "x0": repr(spec.x0), "y0": repr(spec.y0), "crs": spec.crs}


def by_tile(cells: DataFrame, tile: int = 8 * TILE) -> DataFrame:
    """cells in an order in which a tile's are together, in one task."""
    tr, tc = (F.floor(F.col(k) / tile) for k in "rc")
    return cells.repartition(tr, tc).sortWithinPartitions(tr, tc)


@dataclass
class Run(InputPartition):
    blocks: list[tuple[int, int, int]]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return f"r long, c long, `{self.options.get('band', 'z')}` double"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], schema.names[2])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, schema, overwrite)


class Reader(DataSourceReader):
    def __init__(self, path: str, band: str):
        self.path, self.band = path, band
        self.window = [0, 1 << 60, 0, 1 << 60]  # rows and columns, ends included

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of r and c narrow the window; Spark still applies all of them,
        as blocks hold other cells, too."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column in (("r",), ("c",)) and isinstance(value, int):
                k = 0 if column == ("r",) else 2
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.window[k] = max(self.window[k], value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.window[k + 1] = min(self.window[k + 1], value - isinstance(f, LessThan))
            yield f

    def partitions(self) -> list[InputPartition]:
        out, size = [], PART_BYTES
        for block in Blocks(self.path).within(tuple(self.window)):
            if size + block[2] > PART_BYTES:
                out.append(Run([]))
                size = 0
            out[-1].blocks.append(block)
            size += block[2]
        return out or [Run([])]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if partition.blocks:
            yield from Blocks(self.path).read(partition.blocks, self.band)


class Writer(DataSourceArrowWriter):
    """A file per tile. Tasks write into a folder of this write's own; commit
    moves the files of the attempts that count."""

    def __init__(self, options, schema, overwrite: bool):
        o = {k.lower(): v for k, v in options.items()}
        self.path, self.overwrite = o["path"], overwrite
        self.spec = GridSpec(int(o["width"]), int(o["height"]), float(o["cell"]), float(o.get("x0", 0)), float(o.get("y0", 0)), o.get("crs", ""))
        self.band = next(n for n in schema.names if n not in ("r", "c"))
        self.tile = int(o.get("tile", 8 * TILE))
        self.own = f"_writing-{uuid.uuid4().hex}"
        store, at = self._store()
        store.create_dir(f"{at}/{self.own}", recursive=True)  # here alone: a task that outlives an abort can't bring it back

    def _store(self):
        from pyarrow import fs

        if "://" not in self.path and not self.path.startswith("file:"):
            return fs.LocalFileSystem(), self.path
        return fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path[5:])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = self._store()
        attempt, names = uuid.uuid4().hex, []
        store.create_dir(f"{at}/{self.own}/{attempt}", recursive=False)
        now, held = None, None

        def end() -> None:
            if now is not None:
                name = f"{self.band}_r{now[0]}_c{now[1]}.tif"
                if any(n.endswith(f"/{name}") for n in names):
                    raise ValueError("cells of a tile must be together: see by_tile")
                with store.open_output_stream(f"{at}/{self.own}/{attempt}/{name}") as f:
                    f.write(file_of(held, self.spec, now[0] * self.tile, now[1] * self.tile))
                names.append(f"{attempt}/{name}")

        for b in iterator:
            r, c, v = (b.column(b.schema.names.index(n)).cast(k).to_numpy(zero_copy_only=False) for n, k in (("r", pa.int64()), ("c", pa.int64()), (self.band, pa.float64())))
            tiles = np.stack([r // self.tile, c // self.tile], axis=1)
            cuts = np.flatnonzero((tiles[1:] != tiles[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(r)], strict=True):
                if lo == hi:
                    continue
                if (key := tuple(tiles[lo].tolist())) != now:
                    end()
                    now = key
                    held = np.full((min(self.tile, self.spec.height - now[0] * self.tile), min(self.tile, self.spec.width - now[1] * self.tile)), np.nan)
                held[r[lo:hi] - now[0] * self.tile, c[lo:hi] - now[1] * self.tile] = v[lo:hi]
        end()
        return Written(names)

    def commit(self, messages: list[Written]) -> None:
        from pyarrow import fs

        store, at = self._store()
        names = [n for m in messages if m is not None for n in m.names]
        if len({n.rpartition("/")[2] for n in names}) < len(names):
            self.abort(messages)
            raise ValueError("cells of a tile came from several tasks: see by_tile")
        old = [f.path for f in store.get_file_info(fs.FileSelector(at)) if f.base_name.startswith(f"{self.band}_r") and f.extension == "tif"]
        for p in old if self.overwrite else []:
            store.delete_file(p)
        for n in names:
            store.move(f"{at}/{self.own}/{n}", f"{at}/{n.rpartition('/')[2]}")
        store.delete_dir(f"{at}/{self.own}")

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, at = self._store()
        if store.get_file_info(f"{at}/{self.own}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/{self.own}")
