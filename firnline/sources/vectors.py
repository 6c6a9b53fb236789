"""Polygon layers: WKT or GeoJSON to rows of (name, rings), and back to cells."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.grid import GridSpec, cut_lineage, workers_see
from firnline.operators.regions import spans

LAYER = "name string, rings array<array<array<double>>>"
_RING = re.compile(r"\(([^()]+)\)")


def rings_of_wkt(text: str) -> list[list[list[float]]]:
    """All rings of a POLYGON or MULTIPOLYGON; a point is inside where it is
    inside an odd number of them."""
    return [[[float(v) for v in p.split()[:2]] for p in ring.split(",")] for ring in _RING.findall(text)]


def rings_of_geojson(geometry: dict | None) -> list[list[list[float]]]:
    if not geometry or geometry.get("type") not in ("Polygon", "MultiPolygon"):
        return []
    parts = geometry["coordinates"] if geometry["type"] == "MultiPolygon" else [geometry["coordinates"]]
    return [[[float(v) for v in p[:2]] for p in ring] for part in parts for ring in part]


def read_layer(spark: SparkSession, path: str, name: str = "name") -> DataFrame:
    """A GeoJSON collection (one string, so read by one task), GeoJSON with a
    feature per line, or a table (Parquet, or CSV with header) with a `wkt`
    column; `name` is the attribute that names a polygon (else its
    number). Rows without a polygon are left out."""
    workers_see(spark)
    if path.endswith((".json", ".geojson", ".geojsonl", ".ndjson")):
        whole = spark.read.text(path, wholetext=path.endswith("json") and not path.endswith(".ndjson")).select("value")

        def features(batches):
            for b in batches:
                for text in filter(None, b.value):
                    found = json.loads(text)
                    found = found["features"] if found.get("type") == "FeatureCollection" else [found]
                    rows = [(str((f.get("properties") or {}).get(name, i)), rings_of_geojson(f.get("geometry", f))) for i, f in enumerate(found)]
                    yield pd.DataFrame(rows, columns=["name", "rings"])

        return whole.mapInPandas(features, LAYER).where(F.size("rings") > 0)
    x = spark.read.csv(path, header=True, quote='"', escape='"') if path.endswith((".csv", ".txt")) else spark.read.parquet(path)
    named = F.col(name).cast("string") if name in x.columns else F.lit(None).cast("string")

    def parsed(batches):
        for b in batches:
            yield pd.DataFrame({"name": b["name"], "rings": [rings_of_wkt(t or "") for t in b.wkt]})

    return x.select(F.coalesce(named, F.md5("wkt")).alias("name"), "wkt").mapInPandas(parsed, LAYER).where(F.size("rings") > 0)


def burn(cells: DataFrame, spec: GridSpec, layer: DataFrame) -> DataFrame:
    """r, c, name: cells whose centre is in a polygon, a row for each of a
    cell's polygons. The layer stays a table, however many polygons it has."""
    x = cut_lineage(layer.select("name", "rings"), "layer").withColumn("id", F.monotonically_increasing_id())  # of a written table: always the same
    runs = spans(x.select("id", "rings"), spec).join(x.select("id", "name"), "id")
    at = runs.select("r", F.explode(F.sequence("c0", "c1")).alias("c"), "name")
    return at.join(cells.select("r", "c"), ["r", "c"], "left_semi").select("r", "c", "name")
