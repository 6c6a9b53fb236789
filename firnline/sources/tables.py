"""Reading and writing cell tables, region tables, versions and small files."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firnline.grid import TILE, to_null


def read_raster(spark: SparkSession, path: str, band: str, zero_is_void: bool = False) -> DataFrame:
    """r, c and the band; sentinel values become NULL."""
    x = spark.read.parquet(path)
    return x.select("r", "c", to_null(F.col(band).cast("double"), zero_too=zero_is_void).alias(band))


def write_raster(cells: DataFrame, path: str, tile: int = TILE) -> None:
    """Tiles of 256 cells a side as partitions, so a window of the map reads
    its tiles only."""
    tiled = cells.withColumns({"tr": F.floor(F.col("r") / tile), "tc": F.floor(F.col("c") / tile)})
    tiled.repartition("tr", "tc").write.mode("overwrite").partitionBy("tr", "tc").parquet(path)


def read_window(spark: SparkSession, path: str, r0: int, r1: int, c0: int, c1: int, tile: int = TILE) -> DataFrame:
    """Rows r0..r1-1 and columns c0..c1-1; other tiles are pruned."""
    x = spark.read.parquet(path)
    near = F.col("tr").between(r0 // tile, (r1 - 1) // tile) & F.col("tc").between(c0 // tile, (c1 - 1) // tile)
    return x.where(near & F.col("r").between(r0, r1 - 1) & F.col("c").between(c0, c1 - 1)).drop("tr", "tc")


def write_rgba(cells: DataFrame, path: str, factors=(2, 4, 8, 16)) -> None:
    """r, c, red, green, blue, alpha in full (factor 1) and as overviews by the
    middle cell of each block; a map reads the level that it shows."""
    bands = ("red", "green", "blue", "alpha")
    out = cells.select("r", "c", *bands, F.lit(1).alias("factor"))
    for f in factors:
        mid = (F.pmod("r", F.lit(f)) == f // 2) & (F.pmod("c", F.lit(f)) == f // 2)
        out = out.unionByName(cells.where(mid).select(F.floor(F.col("r") / f).alias("r"), F.floor(F.col("c") / f).alias("c"), *bands, F.lit(f).alias("factor")))
    out.write.mode("overwrite").partitionBy("factor").parquet(path)


def next_version(folder: str | Path, stem: str) -> int:
    """One above the highest <stem>_v<N>; 1 without any; other names are passed
    over."""
    found = [int(m[1]) for p in Path(folder).glob(f"{stem}_v*") if (m := re.fullmatch(rf"{re.escape(stem)}_v(\d+)", p.stem))]
    return max(found, default=0) + 1


def write_regions(regions: DataFrame, folder: str, stem: str) -> str:
    path = f"{folder}/{stem}_v{next_version(folder, stem)}.parquet"
    regions.write.parquet(path)
    return path


def find_by_token(folder: str | Path, token: str) -> Path | None:
    """The last file whose name, in lower case without underscores, ends with
    the token."""
    hits = sorted(p for p in Path(folder).rglob("*") if p.stem.lower().replace("_", "").endswith(token.lower().replace("_", "")))
    return hits[-1] if hits else None


def read_treelines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="name string, range string, `group` string, treeline double, n_forest_kpx double")


def read_ascii_grid(spark: SparkSession, path: str, band: str = "z") -> tuple[DataFrame, dict]:
    """An ESRI ASCII grid: header of `key value` lines, then rows of numbers."""
    head: dict[str, float] = {}
    for line in spark.read.text(path).limit(6).collect():
        parts = line.value.split()
        if len(parts) == 2 and re.match(r"[A-Za-z_]+$", parts[0]):
            head[parts[0].lower()] = float(parts[1])
    # Lines are numbered split by split: each task counts its own, the driver adds up one number per task.
    lines = spark.read.text(path).withColumn("_p", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id())
    lines = lines.where(~F.col("value").rlike(r"^\s*[A-Za-z]") & (F.trim("value") != "")).sortWithinPartitions("_n")
    at, first = 0, []
    for p, n in sorted(lines.groupBy("_p").count().collect()):
        first.append((p, at))
        at += n
    starts = F.create_map(*[F.lit(v) for p in first for v in p]) if first else F.create_map()
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("_n")) - 1
    rows = lines.withColumn("r", inside + F.coalesce(F.try_element_at(starts, F.col("_p")), F.lit(0))) if first else lines.withColumn("r", inside)
    cells = rows.select("r", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("c", "_v"))
    value = to_null(F.col("_v").cast("double"), head.get("nodata_value", -9999.0))
    return cells.select(F.col("r").cast("long"), F.col("c").cast("long"), value.alias(band)), head
