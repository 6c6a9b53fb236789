"""Cell tables: one row per raster cell, keyed by row `r` (0 = top) and column
`c`, bands as columns, missing values as NULL."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODATA = -9999.0
TILE = 256


@dataclass(frozen=True)
class GridSpec:
    """Size and georeference of a cell table."""

    width: int
    height: int
    cell: float = 21.34
    x0: float = 0.0
    y0: float = 0.0
    crs: str = ""

    @property
    def cell_area(self) -> float:
        return self.cell * self.cell

    @classmethod
    def of(cls, cells: DataFrame, cell: float = 21.34, **more) -> GridSpec:
        """From the table itself: one aggregate, two numbers."""
        r, c = cells.agg(F.max("r"), F.max("c")).first()
        return cls(int(c or 0) + 1, int(r or 0) + 1, cell, **more)

    def coarser(self, factor: int) -> GridSpec:
        return replace(self, width=-(-self.width // factor), height=-(-self.height // factor), cell=self.cell * factor)

    def x(self) -> Column:
        return F.lit(self.x0) + (F.col("c") + 0.5) * self.cell

    def y(self) -> Column:
        return F.lit(self.y0) - (F.col("r") + 0.5) * self.cell


def to_null(band: str | Column, nodata: float = NODATA, zero_too: bool = False) -> Column:
    """Sentinel and NaN to NULL; with zero_too, a void written as 0 as well."""
    x = F.col(band) if isinstance(band, str) else band
    bad = x.isNull() | F.isnan(x) | (x == nodata)
    return F.when(~(bad | (x == 0)) if zero_too else ~bad, x)


def dense(spark: SparkSession, spec: GridSpec) -> DataFrame:
    """Every (r, c) of the grid."""
    n = F.lit(spec.width)
    return spark.range(spec.width * spec.height).select(F.floor(F.col("id") / n).alias("r"), (F.col("id") % n).alias("c"))


_RECORDED: list[list[str]] = []
_OWN: dict[str, str] = {}  # by application: the folder of runs without a setting


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A
    temporary one is made only where that is unset and driver and executors are
    one process (local runs and tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId  # the setting can't be changed while an application runs
        path = _OWN.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="shared-")
        _OWN[app] = path
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    for made in _RECORDED:
        made.append(path)
    return path


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the cluster's shared folder and read it back, between the
    rounds of an iterative operator."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that cut_lineage writes within are deleted at the end: every
    result must have been written by then."""
    made: list[str] = []
    _RECORDED.append(made)
    try:
        yield
    finally:
        _RECORDED[:] = [x for x in _RECORDED if x is not made]
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for p in made:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def workers_see(spark: SparkSession) -> None:
    """Let Python workers import this package where it isn't installed."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
