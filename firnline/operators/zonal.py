"""Statistics per zone, and treelines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnline.functions.votes import band_label, compass
from firnline.grid import GridSpec, cut_lineage, workers_see


def circular_mean(degrees: Column) -> Column:
    """Aggregate: mean direction of angles in degrees."""
    r = F.radians(degrees)
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))), F.lit(360.0))


BINS = 4096  # counters of a group in a pass


def group_quantile(rows: DataFrame, by: list[str], band: str, p: float, out: str = "quantile", bins: int = BINS) -> DataFrame:
    """by, out, n: the exact p-quantile of a band per group (in all without
    `by`), linear between neighbours, and how many values there are. NULL and
    NaN are no values; a group without any has no row, nor have rows without key.

    A group's range is cut into equal bins; the one that holds the rank becomes
    the range, from its least to its largest value, until they are one or the
    rank falls between two bins. Elevations take two or three passes. A group
    needs `bins` counters in a task, however many rows it has."""
    v = F.col(band).cast("double")
    there = v.isNotNull() & ~F.isnan(v)
    for k in by:
        there = there & F.col(k).isNotNull()
    x = cut_lineage(rows.where(there).select(*by, v.alias("_v")), "values")
    ends = x.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("_v").alias("n")).where("n > 0")
    at = F.col("_at")
    ends = ends.withColumn("_at", (F.col("n") - 1) * p).select(*by, "n", "_lo", "_hi", F.floor(at).alias("_k"), (at - F.floor(at)).alias("_part"))
    ends, done = cut_lineage(ends, "ends"), None
    line = Window.partitionBy(*by, "n").orderBy("_bin")  # a group's bins
    while True:
        flat = ends.where("_lo = _hi").select(*by, "n", F.col("_lo").alias(out))
        done = flat if done is None else done.unionByName(flat)
        ends = ends.where("_lo < _hi")
        if not ends.limit(1).count():
            return done.select(*by, out, "n")
        y = (x.join(ends, by) if by else x.crossJoin(F.broadcast(ends))).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))  # one row of ends
        share = F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * bins)  # halves: no overflow
        y = y.groupBy(*by, "n", "_k", "_part", F.least(share, F.lit(bins - 1)).alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        y = y.withColumns({"_to": F.sum("_c").over(line), "_next": F.lead("_lo").over(line)})
        y = cut_lineage(y.where((F.col("_to") > F.col("_k")) & (F.col("_to") - F.col("_c") <= F.col("_k"))), "bins")
        last = F.col("_k") == F.col("_to") - 1  # the rank's next value is in another bin
        value = F.col("_hi") + F.when(F.col("_part") > 0, (F.col("_next") - F.col("_hi")) * F.col("_part")).otherwise(0.0)
        done = done.unionByName(y.where(last).select(*by, "n", value.alias(out)))
        ends = y.where(~last).select(*by, "n", "_lo", "_hi", (F.col("_k") - F.col("_to") + F.col("_c")).alias("_k"), "_part")


def zonal_metrics(cells: DataFrame, spec: GridSpec, label: str = "label") -> DataFrame:
    """Per label: areas, release-area, elevation, slope and aspect statistics;
    wind, ruggedness and treeline ones where those bands exist. Cells without
    label belong to no zone."""
    have = set(cells.columns)
    pra = F.when(F.col("pra") > 0, F.col("pra"))
    aggs = [
        F.count(F.lit(1)).alias("_n"), F.avg(pra).alias("_pm"), F.max(pra).alias("_px"),
        F.min("z").alias("_zl"), F.max("z").alias("_zh"), F.avg("z").alias("_zm"),
        F.avg("slope").alias("_sm"), F.max("slope").alias("_sx"), circular_mean(F.col("aspect")).alias("_a"),
    ]
    aggs += [F.avg(b).alias(f"_{b}") for b in ("windshelter", "ruggedness") if b in have]
    if "treeline" in have:
        aggs += [F.avg((F.col("z") > F.col("treeline")).cast("double")).alias("_above")]
    g = cells.where(F.col(label).isNotNull()).groupBy(label).agg(*aggs)
    if "treeline" in have:
        middle = group_quantile(cells.where(F.col(label).isNotNull()), [label], "treeline", 0.5, "_tl").drop("n")
        g = g.join(middle, label, "left")
    area = F.round(F.col("_n") * spec.cell_area, 1)
    ha, mean = F.round(area / 10000.0, 3), F.round(F.coalesce("_pm", F.lit(0.0)), 4)
    out = {
        "area_m2": area, "area_ha": ha, "pra_mean": mean, "pra_max": F.round(F.coalesce("_px", F.lit(0.0)), 4),
        "elev_min": F.round("_zl", 1), "elev_max": F.round("_zh", 1), "elev_mean": F.round("_zm", 1),
        "relief_m": F.round(F.col("_zh") - F.col("_zl"), 1), "slope_mean": F.round("_sm", 1), "slope_max": F.round("_sx", 1),
        "aspect_deg": F.round("_a", 1), "aspect_class": compass(F.col("_a")), "release_potential": F.round(mean * ha, 3),
    }
    if "windshelter" in have:
        out["wind_mean"] = F.round("_windshelter", 3)
    if "ruggedness" in have:
        out["rugg_mean"] = F.round("_ruggedness", 4)
    if "treeline" in have:
        out |= {"treeline_m": F.round("_tl", 0), "above_tl_frac": F.round("_above", 2), "band": band_label(F.col("_above"))}
    return g.select(label, *[v.alias(k) for k, v in out.items()])


def region_means(cells: DataFrame, label: str, band: str) -> DataFrame:
    return cells.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(band).alias("mean"))


def treeline_percentile(cells: DataFrame, by: str | None = None, forested: float = 30.0, p: float = 0.95, least: int = 500) -> DataFrame:
    """A high percentile of the elevations of forested cells, per zone or in
    all; NULL with fewer than `least` forested cells."""
    keys = [by] if by else []
    rows = cells.where(F.col("canopy") >= forested).select(*keys, "z")
    rows = rows.where(F.col(by).isNotNull()) if by else rows
    got = group_quantile(rows, keys, "z", p, "_q")
    if by:  # groups whose forest has no elevation, and the map without forest
        got = rows.groupBy(by).agg(F.count("z").alias("_n")).join(got, by, "left")
    else:
        got = rows.agg(F.count("z").alias("_n")).join(got, F.col("n") == F.col("_n"), "left")
    return got.select(*keys, F.when(F.col("_n") >= least, F.col("_q")).alias("treeline"), F.col("_n").alias("n_forest"))


def treeline_fraction(cells: DataFrame, forested: float = 30.0, fraction: float = 0.3, bin_m: float = 50.0, least: int = 50) -> DataFrame:
    """Centre of the highest elevation bin that is forested to the fraction and
    has more than `least` cells. The last bin is closed at its upper end."""
    ends = cells.agg(F.min("z").alias("_lo"), F.max("z").alias("_hi"))
    x = cells.where(F.col("z").isNotNull()).crossJoin(F.broadcast(ends))  # one row
    last = F.greatest(F.floor((F.col("_hi") - F.col("_lo")) / bin_m) - 1, F.lit(0))
    k = F.least(F.floor((F.col("z") - F.col("_lo")) / bin_m), last)
    bins = x.groupBy(k.alias("bin"), "_lo").agg(F.count(F.lit(1)).alias("n"), F.sum((F.coalesce("canopy", F.lit(0.0)) >= forested).cast("double")).alias("f"))
    good = bins.where((F.col("n") > least) & (F.col("f") / F.col("n") >= fraction))
    return good.agg(F.max(F.col("_lo") + (F.col("bin") + 0.5) * bin_m).alias("treeline"))


def treelines(cells: DataFrame, zones: DataFrame | None = None, table: DataFrame | None = None, least_kpx: float = 150.0) -> DataFrame:
    """cells (r, c, z, canopy) with `treeline`. zones: r, c, name; a cell in
    several takes the last by name. With a table of treelines, a zone's own or
    its fallback; with zones alone, each zone's percentile; else one for all."""
    if zones is None:
        return cells.crossJoin(F.broadcast(treeline_percentile(cells).select("treeline")))  # one row
    at = zones.groupBy("r", "c").agg(F.max("name").alias("_zone"))
    x = cells.join(at, ["r", "c"], "left")
    per = treeline_percentile(x.where("_zone is not null"), "_zone") if table is None else treeline_fallback(table, least_kpx).withColumnRenamed("name", "_zone")
    return x.join(F.broadcast(per.select("_zone", "treeline")), "_zone", "left").drop("_zone")  # a row per named zone


def kind_counts(labels: DataFrame, spec: GridSpec, caps: dict[str, float]) -> DataFrame:
    """How many zones there are, and how many are above each of some areas."""
    area = labels.groupBy("label").agg((F.count(F.lit(1)) * spec.cell_area).alias("a"))
    return area.agg(F.count(F.lit(1)).alias("zones"), F.sum("a").alias("area_m2"), *[F.count(F.when(F.col("a") > v, 1)).alias(k) for k, v in caps.items()])


def treeline_fallback(regions: DataFrame, least: float = 150.0) -> DataFrame:
    """name, range, group, treeline, n_forest_kpx: a region's own value if it
    has forest enough, else its range's median, else its group's, of the
    regions that have."""
    own = F.col("n_forest_kpx") >= least
    by_range = regions.where(own).groupBy("range").agg(F.median("treeline").alias("_r"))
    by_group = regions.where(own).groupBy("group").agg(F.median("treeline").alias("_g"))
    x = regions.join(by_range, "range", "left").join(by_group, "group", "left")
    return x.select("name", "range", "group", F.coalesce(F.when(own, F.col("treeline")), F.col("_r"), F.col("_g")).alias("treeline"))


def elevation_profile(cells: DataFrame, label: str, bin_m: float = 30.0, band: str = "slope") -> DataFrame:
    """label, bin, m: a band's mean per bin of elevation."""
    known = cells.where(F.col(label).isNotNull() & F.col("z").isNotNull())
    return known.groupBy(label, F.floor(F.col("z") / bin_m).alias("bin")).agg(F.avg(band).alias("m"))


def dips(y: np.ndarray, prominence: float, sigma: float = 1.5) -> list[int]:
    """Places of the minima of a smoothed profile that are as deep as asked: the
    lesser of the rims on either side, up to where it goes deeper, less the
    minimum."""
    k = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-k, k + 1) / sigma) ** 2)
    y = np.convolve(np.pad(y, k, mode="symmetric" if len(y) >= k else "edge"), w / w.sum(), mode="valid")
    found = []
    for i in range(1, len(y) - 1):
        if y[i] < y[i - 1] and y[i] <= y[i + 1]:
            left, right = y[: i + 1][::-1], y[i:]
            deeper_l, deeper_r = np.flatnonzero(left < y[i]), np.flatnonzero(right < y[i])
            rim = min(left[: deeper_l[0] if len(deeper_l) else None].max(), right[: deeper_r[0] if len(deeper_r) else None].max())
            if rim - y[i] >= prominence:
                found.append(i)
    return found


def bench_profile(cells: DataFrame, label: str, bin_m: float = 30.0, sigma: float = 1.5, prominence: float = 1.5) -> DataFrame:
    """Elevations of benches: minima of the smoothed mean slope per 30 m bin, as
    prominent as asked. A zone's profile has as many numbers as bins."""
    workers_see(cells.sparkSession)

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(pdf.bin.min()), int(pdf.bin.max())
        y = pdf.set_index("bin").m.reindex(range(lo, hi + 1)).to_numpy(dtype=float)
        y = np.where(np.isnan(y), np.nanmean(y) if np.isfinite(y).any() else 0.0, y)
        found = [(lo + i + 0.5) * bin_m for i in dips(y, prominence, sigma)]
        return pd.DataFrame({label: pdf[label].iloc[0], "bench": np.array(found, dtype=float)})

    return elevation_profile(cells, label, bin_m).groupBy(label).applyInPandas(find, f"{label} {dict(cells.dtypes)[label]}, bench double")


def normalised(cells: DataFrame, bands: list[str]) -> DataFrame:
    """(x - min) / (max - min + 1e-8) over the whole grid, as <band>_norm."""
    ends = cells.agg(*[f(b).alias(f"_{n}_{b}") for b in bands for n, f in (("lo", F.min), ("hi", F.max))])
    x = cells.crossJoin(F.broadcast(ends))  # one row
    return x.withColumns({f"{b}_norm": (F.col(b) - F.col(f"_lo_{b}")) / (F.col(f"_hi_{b}") - F.col(f"_lo_{b}") + 1e-8) for b in bands}).drop(*ends.columns)


