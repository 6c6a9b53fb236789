"""The whole workflow: elevation and canopy to classes, regions and colours."""

from __future__ import annotations

import logging
import sys
import time
import uuid
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.functions import fuzzy
from firnline.functions import palette as P
from firnline.functions import votes as V
from firnline.grid import GridSpec, cut_lineage, scratch, to_null
from firnline.operators import align, classify, distance, flow, focal, regions, segment, zonal
from firnline.operators.stack import Stack
from firnline.plans import config as C
from firnline.plans.manifest import Manifest
from firnline.sources import geotiff, imagery, tables, vectors

log = logging.getLogger(__name__)
SCENARIOS = ("frequent", "extreme")
ROLE = {"frequent": "F", "extreme": "E"}


def release_areas(cells: DataFrame, spec: GridSpec, p: C.ReleaseConfig, scenario: str) -> DataFrame:
    """r, c and a scenario's continuous, binary and sieved release areas and the
    distance to the binary one."""
    slope = p.slope(scenario)
    abc, more = tuple(slope.pop(k) for k in "abc"), slope
    rugged = {"rugged": "ruggedness", "rugged_abc": (p.rugg_a, p.rugg_b, p.rugg_c)} if p.enable_ruggedness else {}
    pra = fuzzy.release_area("slope", "windshelter", "canopy", abc, p.forest(scenario), (p.wind_a, p.wind_b, p.wind_c), **rugged, **more)
    x = cells.withColumn("pra", pra)
    x = x.withColumn("binary", (F.col("pra") >= p.of(scenario, "pra_threshold")).cast("int"))
    x = regions.sieve(x, spec, "binary", p.sieve_filter_m2)
    return distance.proximity(x, spec, F.col("binary") == 1, "pra_proximity")


def terrain(cells: DataFrame, spec: GridSpec, p: C.ReleaseConfig) -> DataFrame:
    x = focal.slope(cells, spec, edges=True)
    if p.enable_ruggedness:
        x = focal.ruggedness(focal.aspect(x, spec), out="ruggedness")
    return focal.wind_shelter(x, spec, "z", p.wind_direction, p.wind_tolerance, p.wind_probability, p.wind_radius_m, radius=p.wind_radius_cells)


def with_treeline(cells: DataFrame, spec: GridSpec, p: C.ReleaseConfig) -> DataFrame:
    """cells with `treeline`, unless that is off: from a layer of regions and a
    table of their treelines, from the layer alone, or one for the whole map. A
    layer or table that can't be read or used means no treeline: the log says
    so, and the run goes on."""
    if not p.enable_treeline:
        return cells
    spark = cells.sparkSession
    try:
        if not p.subregions_path:
            return cut_lineage(zonal.treelines(cells), "treeline")
        zones = vectors.burn(cells, spec, vectors.read_layer(spark, p.subregions_path))
        table = tables.read_treelines(spark, p.treeline_table_csv) if p.treeline_table_csv else None
        return cut_lineage(zonal.treelines(cells, zones, table, p.treeline_min_reliable_kpx), "treeline")  # read here, so that it fails here
    except Exception:
        log.exception("no treeline: it can't be had from layer %r and table %r", p.subregions_path, p.treeline_table_csv)
        return cells


def start_zones(cells: DataFrame, spec: GridSpec, params: segment.SegmentParams | None = None) -> tuple[DataFrame, DataFrame]:
    """Labels of a scenario's release cells, and their metrics."""
    labels = cut_lineage(segment.segment(cells.withColumn("mask", F.col("sieved")), spec, params), "labels")
    x = focal.curvature(cells.drop("math_aspect", "curvature")).withColumn("aspect", F.col("math_aspect"))
    return labels, zonal.zonal_metrics(x.join(labels, ["r", "c"]), spec)


def add_scenario(bands: Stack, released: DataFrame, flow_bands: DataFrame, labels: DataFrame, spec: GridSpec, role: str) -> None:
    """Store a scenario's release areas, runout, distances to it and zone sizes
    as bands of the wide stack."""
    bands.add(released.select("r", "c", *[F.col(a).alias(f"{role}_{b}") for a, b in (("pra", "pra"), ("sieved", "release"), ("pra_proximity", "pra_proximity"))]))
    bands.add(flow_bands.select("r", "c", *[F.col(b).alias(f"{role}__{b}") for b in NEEDED]))
    near = distance.distances(released.sparkSession, flow_bands.where("fpTravelAngleMax > 0"), spec, f"{role}_runout_prox")
    bands.add(near.withColumn(f"{role}_runout_prox", F.col(f"{role}_runout_prox") * spec.cell))
    sizes = labels.groupBy("label").agg((F.count(F.lit(1)) * spec.cell_area / 10000.0).alias(f"{role}_pra_size"))
    bands.add(labels.join(sizes, "label").select("r", "c", f"{role}_pra_size"))


def scenario_columns(stack: DataFrame, spec: GridSpec, role: str, cutoff: float = 25.0) -> DataFrame:
    """A scenario's columns of the wide stack from its bands; what no path
    reaches is 0."""
    drop, angle, flux = (F.coalesce(f"{role}__{b}", F.lit(0.0)) for b in NEEDED)
    columns = {
        "zdelta": drop, "travel_angle": angle, "rout_flux_area": flux * spec.cell_area,
        "flux_area": V.flux_area(flux, spec.cell_area, angle, cutoff), "alpha_zdelta": V.angle_score(drop, angle),
    }
    return stack.withColumns({f"{role}_{k}": v for k, v in columns.items()}).drop(*[f"{role}__{b}" for b in NEEDED])


def run_stack(cells: DataFrame, spec: GridSpec, cfg: C.RunConfig, manifest: Manifest | None = None, area: DataFrame | None = None) -> dict[str, DataFrame]:
    """cells: r, c, z, canopy; area: r, c of the area of interest. Returns the
    tables of every step that is on. A scenario whose runout fails is left out,
    which the log and the manifest say."""
    out: dict[str, DataFrame] = {}
    base = cut_lineage(with_treeline(terrain(cells, spec, cfg.pra), spec, cfg.pra), "terrain")
    stack = focal.whole_slope(cells, spec)
    steep = stack.withColumn("_s", F.greatest(F.coalesce("slope", F.lit(0)), F.lit(0)))
    smooth = focal.box_mean(steep, spec, "_s", cfg.ates.win_size | 1, "nearest", "slope_smooth")
    stack = smooth.drop("_s").withColumn("canopy_pct", F.rint(F.coalesce("canopy", F.lit(0.0))))
    with Stack(stack, spec) as bands:
        _scenarios(out, bands, base, spec, cfg, manifest)
        if cfg.run_ates and any(k.startswith("runout_") for k in out):
            _classes(out, bands, spec, cfg, manifest, area)
    if cfg.run_colorize:
        out |= colours(out, spec)
    return out


def _scenarios(out: dict[str, DataFrame], bands: Stack, base: DataFrame, spec: GridSpec, cfg: C.RunConfig, manifest: Manifest | None) -> None:
    for s in SCENARIOS:
        if not cfg.run_pra or not getattr(cfg.pra, f"run_{s}"):
            continue
        began = time.time()
        released = cut_lineage(release_areas(base, spec, cfg.pra, s), f"pra-{s}")
        out[f"pra_{s}"] = released
        params = cfg.segments.params(s)
        labels, metrics = start_zones(released, spec, params)
        out[f"zones_{s}"], out[f"zone_metrics_{s}"] = labels, metrics
        counts = zonal.kind_counts(labels, spec, {"above_least": params.least_m2, "above_cap": params.max_m2}).first().asDict()
        log.info("start zones of %s: %s", s, counts)
        if manifest:
            manifest.step(f"pra_{s}", time.time() - began, zones=counts)
        if not cfg.run_runout:
            continue
        began = time.time()
        try:
            got = cut_lineage(flow.runout(released, spec, "sieved", cfg.flow.params(s, spec.cell)), f"runout-{s}")
        except Exception as e:
            log.exception("runout of %s failed; the scenario is left out", s)
            if manifest:
                manifest.failed(f"runout_{s}", e)
            continue
        out[f"runout_{s}"] = got.select("r", "c", *[c for c in got.columns if c in cfg.flow.outputs() or c in NEEDED])
        add_scenario(bands, released, got, labels, spec, ROLE[s])
        if manifest:
            manifest.step(f"runout_{s}", time.time() - began)


def _classes(out: dict[str, DataFrame], bands: Stack, spec: GridSpec, cfg: C.RunConfig, manifest: Manifest | None, area: DataFrame | None) -> None:
    began = time.time()
    stack = bands.joined()
    for s in SCENARIOS:
        if f"runout_{s}" in out:
            stack = scenario_columns(stack, spec, ROLE[s], cfg.ates.flux_cutoff)
    if (top := classify.canopy_beyond(stack)) is not None:
        text = f"canopy is up to {top:.1f}; it should be percent already"
        log.warning(text)
        if manifest:
            manifest.warn(text)
    classes = classify.classify(stack, spec, cfg.ates.model, cfg.ates.base_layer, cfg.ates.cuts())
    out["ates"] = cut_lineage(classify.postprocess(classes, spec, "ates", cfg.ates.minimum_m2(), area), "ates").select("r", "c", "ates")
    out["ates_regions"] = regions.in_order(regions.polygonize(out["ates"], spec, "ates", 8)[0])
    if manifest:
        manifest.step("ates", time.time() - began)


NEEDED = ("zDelta", "fpTravelAngleMax", "routFluxSum")
#: Products by the token that their name holds: band, palette, whether classes.
PRODUCTS = {
    "pra_extreme": [("", "pra", P.parse(P.RELEASE_RAMPS["extreme"]), False), ("binary_", "sieved", P.RELEASE_BINARY["extreme"], True)],
    "pra_frequent": [("", "pra", P.parse(P.RELEASE_RAMPS["frequent"]), False), ("binary_", "sieved", P.RELEASE_BINARY["frequent"], True)],
    "runout_extreme": [("angle_", "fpTravelAngleMax", P.SCENARIO_ANGLE["extreme"], False)],
    "runout_frequent": [("angle_", "fpTravelAngleMax", P.SCENARIO_ANGLE["frequent"], False)],
    "ates": [("", "ates", P.CLASSES, True)],
}
for _s in SCENARIOS:
    PRODUCTS[f"pra_{_s}"] += [("slope_", "slope", P.parse(P.SLOPE_RAMP), False), ("canopy_", "canopy", P.CANOPY, False)]
    PRODUCTS[f"runout_{_s}"] += [("zdelta_", "zDelta", P.ZDELTA, False), ("flux_", "routFluxSum", P.parse(P.FLUX_RAMP), False)]


def colours(tables_: dict[str, DataFrame], spec: GridSpec, palettes: dict[str, P.Palette] | None = None) -> dict[str, DataFrame]:
    """Colour tables of what there is, by the palettes given for a colour
    table's name or the usual ones; a band that isn't there is passed over."""
    out = {}
    for name, x in tables_.items():
        for prefix, band, palette, classes in PRODUCTS.get(name, ()):
            if band not in x.columns:
                continue
            key = f"{prefix}{name}_rgba"
            value = F.col(band) * spec.cell_area if band == "routFluxSum" else F.col(band)  # the flux ramp is by area
            out[key] = x.withColumn("p", P.colour(value, (palettes or {}).get(key, palette), classes)).select("r", "c", "p.*")
    return out


def colour_run(spark: SparkSession, folder: str | Path, spec: GridSpec, palettes: dict[str, P.Palette] | None = None, images: bool = False) -> list[str]:
    """Colour the products of a run's folder once more, each found by its
    token, as images, too, if asked for; returns the colour tables written."""
    found = {name: path for name in PRODUCTS if (path := tables.find_by_token(folder, name))}
    made = colours({name: spark.read.parquet(f"file://{Path(path).resolve()}") for name, path in found.items()}, spec, palettes)
    for name, x in made.items():
        tables.write_rgba(x, f"file://{Path(folder).resolve()}/{name}")
        if images:
            imagery.write_image(x, spec, f"{folder}/{name}.tif")
    return sorted(made)


def _write(name: str, x: DataFrame, folder: Path, cfg: C.RunConfig, out: dict[str, DataFrame], spec: GridSpec) -> None:
    path = f"{folder}/{cfg.output_basename + '_' if cfg.output_basename else ''}{name}"
    files = cfg.output.save_tif and cfg.dem_path.lower().endswith((".tif", ".tiff"))
    if name.endswith("_rgba"):
        tables.write_rgba(x, path)
        if files:
            imagery.write_image(x, spec, f"{path}.tif")
    elif name.startswith("zone_metrics_") or name == "ates_regions":
        if cfg.output.save_shp:
            members = out["zones_" + name[13:]] if name != "ates_regions" else regions.polygonize(out["ates"], spec, "ates", 8)[1]
            shapes = regions.outlines(members, spec)
            tables.write_regions(x.join(shapes, "label", "left"), str(folder), Path(path).name)
    elif cfg.output.save_tif:
        tables.write_raster(x, path)
        if files:
            for band in (b for b in ("ates", "pra", "sieved", "label", *cfg.flow.outputs()) if b in x.columns):
                geotiff.write_geotiff(x, spec, band, f"{path}_tif")


def run(spark: SparkSession, cfg: C.RunConfig, source: str = "unknown") -> str:
    """Read, compute, write; the manifest is there from the start and says how
    the run ended, whatever ended it; the log of the run lies beside it."""
    folder = Path(cfg.working_dir) / f"{cfg.project_name}_{uuid.uuid4().hex[:8]}"
    inputs = (cfg.dem_path, cfg.forest_canopy_path, cfg.aoi_path, cfg.pra.subregions_path, cfg.pra.treeline_table_csv)
    manifest = Manifest(folder / "manifest.json", cfg, source, inputs)
    lines = logging.FileHandler(folder / "run.log")
    lines.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
    logger = logging.getLogger("firnline")
    logger.addHandler(lines)
    level = logger.level
    logger.setLevel(logging.INFO)
    try:
        with scratch(spark):
            cells, spec = read_cells(spark, cfg)
            for size in (cfg.target_resolution_x, cfg.target_resolution_y):
                if size and size != cfg.cell:
                    target = replace(spec, width=max(1, int(spec.width * spec.cell / size)), height=max(1, int(spec.height * spec.cell / size)), cell=size)
                    both = [align.align(cells, spec, target, b, how) for b, how in (("z", "bilinear"), ("canopy", "nearest"))]
                    cells, spec = both[0].join(both[1], ["r", "c"]), target
                    break
            area = area_of_interest(spark, cells, spec, cfg.aoi_path) if cfg.aoi_path else None
            out = run_stack(cells, spec, cfg, manifest, area)
            for name, x in out.items():
                _write(name, x, folder, cfg, out, spec)
            if cfg.output.save_reports and "ates" in out:
                rows = out["ates"].groupBy("ates").count().collect()  # a row per class
                manifest.step("report", 0.0, cells_by_class={str(r["ates"]): r["count"] for r in rows})
    except BaseException as e:
        log.exception("the run failed")
        manifest.finish("failed", f"{type(e).__name__}: {e}"[:2000])
        raise
    finally:
        logger.setLevel(level)
        logger.removeHandler(lines)
        lines.close()
    manifest.finish("done with failures" if manifest.data["failures"] else "done")
    return str(folder)


def read_cells(spark: SparkSession, cfg: C.RunConfig) -> tuple[DataFrame, GridSpec]:
    """r, c, z, canopy on the elevation model's grid. Two tables share theirs;
    a file has its own, and canopy is brought onto the elevation model's."""
    got = {}
    for band, path in (("z", cfg.dem_path), ("canopy", cfg.forest_canopy_path)):
        if path.lower().endswith((".tif", ".tiff")):
            got[band] = geotiff.read_geotiff(spark, path, band)
        else:
            x = tables.read_raster(spark, path, band)
            got[band] = x, GridSpec.of(x, cfg.cell)
    (z, spec), (canopy, other) = got["z"], got["canopy"]
    if replace(other, width=spec.width, height=spec.height) != spec:
        return align.align_and_clip(z, spec, canopy, other), spec
    void = to_null("z", zero_too=True)
    return z.select("r", "c", void.alias("z")).join(canopy, ["r", "c"], "left"), spec


def area_of_interest(spark: SparkSession, cells: DataFrame, spec: GridSpec, path: str) -> DataFrame:
    """r, c of a mask table, or of a polygon layer's cells."""
    if not path.endswith((".json", ".geojson", ".csv", ".txt")) and "wkt" not in (x := spark.read.parquet(path)).columns:
        return x.select("r", "c").distinct()
    return vectors.burn(cells, spec, vectors.read_layer(spark, path)).select("r", "c").distinct()


def main(args: list[str] | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    if len(args) != 1:
        print("usage: python -m firnline.plans.run CONFIG.ini")
        return 2
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("terrain").getOrCreate()
    print(run(spark, C.load(args[0]), args[0]))
    return 0


if __name__ == "__main__":
    sys.exit(main())
