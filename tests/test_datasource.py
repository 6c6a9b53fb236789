"""GeoTIFF by spark.read and write: what is read of a file, and what is left of
a write."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan
from test_geotiff import build

from firnline.grid import GridSpec
from firnline.sources import datasource, geotiff


@pytest.fixture
def raster(tmp_path):
    x = np.arange(40 * 50, dtype="<f4").reshape(40, 50)
    x[3, 4] = -99
    (tmp_path / "a.tif").write_bytes(build(x, tile=16, compression=8))
    return f"{tmp_path}/a.tif", x


def test_windows_read_their_blocks_only(spark, raster):
    path, x = raster
    datasource.register(spark)
    reader = datasource.Reader(path, "z")
    assert list(reader.pushFilters([GreaterThanOrEqual(("r",), 17), LessThan(("r",), 32), EqualTo(("c",), 20)]))  # Spark applies them as well
    assert [b[0] for p in reader.partitions() for b in p.blocks] == [5]  # of 3 x 4 blocks
    assert sum(len(p.blocks) for p in datasource.Reader(path, "z").partitions()) == 12
    whole = spark.read.format("geotiff").option("path", path).load()
    got = {(q.r, q.c): q.z for q in whole.collect()}
    assert len(got) == 2000 and got[3, 4] is None and got[39, 49] == x[39, 49]
    part = spark.read.format("geotiff").option("path", path).option("band", "h").load().where("r >= 17 and r < 32 and c = 20")
    assert {(q.r, q.c): q.h for q in part.collect()} == {(r, 20): float(x[r, 20]) for r in range(17, 32)}
    found = geotiff.Blocks(path)
    with open(path, "r+b") as f:  # no other block can be read now
        for k, (at, n) in enumerate(zip(found.places, found.sizes, strict=True)):
            if k != 5:
                f.seek(at)
                f.write(b"\xff" * n)
    assert part.count() == 15
    with pytest.raises(Exception, match="decompress"):
        whole.count()
    assert spark.read.format("geotiff").option("path", path).load().where("r > 4000").count() == 0


def test_a_write_is_whole_or_not_there(spark, raster, tmp_path):
    path, _ = raster
    datasource.register(spark)
    out, s = f"{tmp_path}/out", GridSpec(50, 40, 2.0, 100.0, 900.0, "EPSG:32611")
    os.mkdir(out)
    cells = spark.read.format("geotiff").option("path", path).load().where("r <> 7").repartition(5)
    write = lambda x: x.write.format("geotiff").options(path=out, tile="16", **datasource.grid_options(s)).mode("overwrite").save()
    write(datasource.by_tile(cells, 16))
    assert sorted(os.listdir(out)) == sorted(f"z_r{r}_c{c}.tif" for r in range(3) for c in range(4))
    back = {}
    for n in os.listdir(out):
        y, part = geotiff.read_geotiff(spark, f"{out}/{n}")
        r0, c0 = round((900.0 - part.y0) / 2), round((part.x0 - 100.0) / 2)
        back |= {(q.r + r0, q.c + c0): q.z for q in y.collect()}
    want = {(q.r, q.c): q.z for q in cells.collect()}
    assert {k: v for k, v in back.items() if k[0] != 7} == want and {v for k, v in back.items() if k[0] == 7} == {None}
    kept = {n: os.path.getsize(f"{out}/{n}") for n in os.listdir(out)}
    with pytest.raises(Exception, match="by_tile"):  # tiles in several tasks
        write(cells)
    broken = datasource.by_tile(cells, 16).withColumn("z", F.when((F.col("r") == 39) & (F.col("c") == 1), F.raise_error(F.lit("boom")).cast("double")).otherwise(F.col("z")))
    with pytest.raises(Exception, match="boom"):
        write(broken)
    assert {n: os.path.getsize(f"{out}/{n}") for n in os.listdir(out)} == kept
