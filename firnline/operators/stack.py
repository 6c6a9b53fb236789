"""Bands of one grid joined by place without a shuffle between them.

Each table of bands is stored once, in buckets by tile and sorted by place
within them: the one shuffle it ever takes. Joins then go bucket by bucket,
whatever the number of bands and of joins."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.grid import TILE, GridSpec, cut_lineage, scratch_path

BUCKET_CELLS = 4_000_000
KEYS = ["tr", "tc", "r", "c"]
#: Buckets by tile serve joins by tile and place, files are sorted as they say
#: (each bucket is one file), and small tables aren't sent to all instead.
SETTINGS = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}


@contextmanager
def joins_by_bucket(spark: SparkSession):
    before = {k: spark.conf.get(k) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Stack:
    """with Stack(cells, spec) as bands: bands.add(more); x = bands.joined()

    The cells are those of the first table; bands that others don't have there
    are NULL. A table has one row per cell: of repeated rows, each is joined
    with each. Stored tables are dropped at the end."""

    def __init__(self, cells: DataFrame, spec: GridSpec, tile: int = TILE, buckets: int | None = None):
        self.spark, self.tile = cells.sparkSession, tile
        self.buckets = buckets or max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-spec.width * spec.height // BUCKET_CELLS))
        self.names: list[str] = []
        self.columns: list[str] = []
        self.add(cells)

    def __enter__(self) -> Stack:
        return self

    def __exit__(self, *_) -> None:
        while self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop()}")  # files go with the run's scratch tables

    def add(self, bands: DataFrame) -> None:
        """Store r, c and bands. Names that the stack has already are errors."""
        new = [b for b in bands.columns if b not in ("r", "c")]
        clash = {b.lower() for b in new} & {b.lower() for b in (*self.columns, "tr", "tc")}
        if clash:
            raise ValueError(f"bands of these names are in the stack: {sorted(clash)}")
        place = [F.col(k).cast("long").alias(k) for k in "rc"]
        x = bands.select(*[F.floor(F.col(k) / self.tile).alias(f"t{k}") for k in "rc"], *place, *[F.col(f"`{b}`") for b in new])
        x = x.repartition(self.buckets, "tr", "tc").sortWithinPartitions(*KEYS)
        name = f"bands_{uuid.uuid4().hex}"
        writer = x.write.format("parquet").option("path", scratch_path(self.spark, "bands"))
        writer.bucketBy(self.buckets, "tr", "tc").sortBy(*KEYS).saveAsTable(name)
        self.names.append(name)
        self.columns += new

    def plan(self) -> DataFrame:
        """The join; without exchanges if it is planned under joins_by_bucket."""
        out = self.spark.table(self.names[0])
        for name in self.names[1:]:
            out = out.join(self.spark.table(name), KEYS, "left")
        return out.drop("tr", "tc")

    def joined(self, *columns) -> DataFrame:
        """The wide table, written; with columns, r, c and those."""
        with joins_by_bucket(self.spark):
            x = self.plan()
            return cut_lineage(x.select("r", "c", *columns) if columns else x, "stack")
