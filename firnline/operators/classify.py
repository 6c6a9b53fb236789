"""Terrain classes 0 to 4: the vote classifier, the older slope- and
release-based ones, and the shared post-processing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions import votes as V
from firnline.grid import GridSpec
from firnline.operators.focal import box_means, box_width
from firnline.operators.regions import gap_metrics, mmu_clean

REQUIRED = ("slope", "canopy_pct", "E_pra", "F_pra", "E_zdelta", "F_zdelta", "E_travel_angle", "F_travel_angle", "E_rout_flux_area", "F_rout_flux_area")


def with_fallback(cells: DataFrame, bands: Iterable[str]) -> DataFrame:
    """With bands of one scenario only, they serve for both roles."""
    for b in bands:
        e, f = f"E_{b}", f"F_{b}"
        if e in cells.columns and f not in cells.columns:
            cells = cells.withColumn(f, F.col(e))
        if f in cells.columns and e not in cells.columns:
            cells = cells.withColumn(e, F.col(f))
    return cells


def vote_inputs(cells: DataFrame, spec: GridSpec, context_m: float = 300.0) -> DataFrame:
    """Adds coarse slope and canopy (box means, mirrored edges) and gap areas."""
    width = box_width(context_m, spec.cell)
    x = cells.withColumns(
        {
            "valid": F.coalesce(F.col("valid"), F.lit(False)) if "valid" in cells.columns else F.lit(True),
            "slope": F.coalesce(F.col("slope").cast("double"), F.lit(0.0)),
            "canopy_pct": F.coalesce(F.col("canopy_pct").cast("double"), F.lit(0.0)),
        }
    )
    x = box_means(x, spec, {"coarse_slope": ("slope", width, "reflect"), "coarse_canopy": ("canopy_pct", width, "reflect")})
    return gap_metrics(x, spec, with_width=False)


def vote_columns(columns: Iterable[str], cell: float) -> list[tuple[Column, Column, int]]:
    """(vote, where it counts, weight) of the votes that the columns allow."""
    have, out = set(columns), []
    bands = {"pra": "pra", "size": "pra_size", "alpha": "travel_angle", "flux": "rout_flux_area"}
    for name, band in bands.items():
        if f"F_{band}" not in have:
            continue
        low = F.col(f"E_{band}") if f"E_{band}" in have else None
        k = V.area_factor(cell) if name == "flux" else 1.0
        c1, c2, c3 = (c * k for c in V.SPLIT_CUTS[name])
        high = F.col(f"F_{band}")
        out.append((V.split_vote(low, high, c1, c2, c3), V.speaks(low, high) & F.col("valid"), 1))
    out.append((V.step_vote(F.col("coarse_slope"), V.COARSE_CUTS), F.col("valid"), 1))
    out.append((V.step_vote(F.col("gap_area_ha"), V.GAP_CUTS), F.col("valid") & (F.col("coarse_canopy") >= 30), V.GAP_WEIGHT))
    return out


def classify_votes(cells: DataFrame, spec: GridSpec, prepared: bool = False, out: str = "ates") -> DataFrame:
    """The weighted mean of the votes, rounded half to even, raised to the
    floors, with the class-0 ceiling last. NULL outside the valid area."""
    cells = with_fallback(cells, ("pra", "zdelta", "travel_angle", "rout_flux_area"))
    missing = [b for b in REQUIRED if b not in cells.columns]
    if missing:
        raise ValueError(f"bands missing: {', '.join(missing)}")
    x = cells if prepared else vote_inputs(cells, spec)
    parts = vote_columns(x.columns, spec.cell)
    top = sum((F.when(ok, w * v).otherwise(0) for v, ok, w in parts), F.lit(0))
    den = sum((F.when(ok, F.lit(w)).otherwise(0) for _, ok, w in parts), F.lit(0))
    vote = F.when(den > 0, F.greatest(F.lit(0.0), F.least(F.lit(4.0), F.rint(top / den)))).otherwise(0.0).cast("int")
    slope, canopy, coarse = F.col("slope"), F.col("canopy_pct"), F.col("coarse_slope")
    raised = V.floors(vote, F.col("E_zdelta"), F.col("F_zdelta"), F.col("F_rout_flux_area"), slope, canopy, spec.cell)
    raised = F.greatest(raised, *[F.when(coarse >= cut, k).otherwise(0) for cut, k in V.COARSE_FLOORS])
    far = [F.col(b) if b in x.columns else None for b in ("E_runout_prox", "E_pra_proximity")]
    zero = V.zero_score(coarse, slope, canopy, *far) >= V.ZERO_SCORE
    return x.withColumn(out, F.when(F.col("valid"), F.when(zero, 0).otherwise(raised)).cast("tinyint"))


def exposure(cells: DataFrame, az=(1, 30, 75), rf=(0, 500, 3000), near: float = 25.0) -> DataFrame:
    """az, rf and prox classes: the extreme scenario gives 1, the frequent one 2
    or 3; the higher one stands."""
    prox = F.coalesce(F.col("E_runout_prox") < near, F.lit(False)) if "E_runout_prox" in cells.columns else F.lit(False)
    return cells.withColumns(
        {
            "az": F.when(F.col("F_alpha_zdelta") >= az[2], 3).when(F.col("F_alpha_zdelta") >= az[1], 2).when(F.col("E_alpha_zdelta") >= az[0], 1).otherwise(0),
            "rf": F.when(F.col("F_flux_area") > rf[2], 3).when(F.col("F_flux_area") > rf[1], 2).when(F.col("E_flux_area") > rf[0], 1).otherwise(0),
            "prox": F.when(prox, 1).otherwise(0),
        }
    )


def classify_slope(cells: DataFrame, sat=(15, 25, 32, 45), trees=(20, 60, 85), overhead: float = 60.0, out: str = "ates") -> DataFrame:
    """Older base by slope: slope classes raised by exposure (and wind deposits,
    if there is such a band), looked up by forest and release area; overhead
    hazard stays 4."""
    s = F.col("slope")
    sat_class = F.when(F.col("slope_smooth") > sat[3], 4).when(s > sat[2], 3).when(s > sat[1], 2).when(s > sat[0], 1).otherwise(0)
    extra = [F.coalesce(F.col("wind_class"), F.lit(0))] if "wind_class" in cells.columns else []
    merged = F.greatest(sat_class, F.col("az"), F.col("rf"), F.col("prox"), *extra)
    over = F.coalesce(F.col("F_travel_angle") >= overhead, F.lit(False))
    release = F.when(F.col("E_release") > 0, 100).otherwise(0)
    found = V.forest_lookup(merged, V.forest_code(F.col("canopy_pct"), *trees), release)
    # In dense forest the highest class goes down one.
    dense = F.when((F.col("canopy_pct") > trees[2]) & (found == 4), 3).otherwise(found)
    return cells.withColumn(out, F.when(F.col("valid"), F.when(over, 4).otherwise(dense)).cast("tinyint"))


def classify_release(cells: DataFrame, pra=(0.05, 0.25, 0.6), steep: float = 45.0, overhead: float = 60.0, tree1: float = 20.0, out: str = "ates") -> DataFrame:
    """Older base by release areas: continuous release area of the two
    scenarios, raised by exposure; steep or overhead cells 4, but steep ones in
    forest 3."""
    base = F.greatest(V.ladder(F.col("F_pra"), [(pra[1], 2), (pra[2], 3)]), V.ladder(F.col("E_pra"), [(pra[0], 1)]))
    extra = [F.coalesce(F.col("wind_class"), F.lit(0))] if "wind_class" in cells.columns else []
    merged = F.greatest(base, F.col("az"), F.col("rf"), F.col("prox"), *extra)
    over = F.coalesce(F.col("F_travel_angle") >= overhead, F.lit(False))
    is_steep = F.coalesce(F.col("slope_smooth") > steep, F.lit(False))
    value = F.when(over, 4).when(is_steep, F.when(F.col("canopy_pct") > tree1, 3).otherwise(4)).otherwise(merged)
    return cells.withColumn(out, F.when(F.col("valid"), value).cast("tinyint"))


def classify(cells: DataFrame, spec: GridSpec, model: str = "dev8", base_layer: str = "pra", cuts: dict | None = None) -> DataFrame:
    """cuts, for the older model: pra, sat, trees, az, rf, near, overhead."""
    if model == "dev8":
        return classify_votes(cells, spec)
    if model != "legacy":
        raise ValueError(f"unknown model: {model}")
    if base_layer not in ("pra", "slope"):
        raise ValueError(f"unknown base layer: {base_layer}")
    k = {"pra": (0.05, 0.25, 0.6), "sat": (15, 25, 32, 45), "trees": (20, 60, 85), "az": (1, 30, 75), "rf": (0, 500, 3000), "near": 25.0, "overhead": 60.0} | (cuts or {})
    x = exposure(with_fallback(cells, ("alpha_zdelta", "flux_area", "travel_angle", "pra", "release")), k["az"], k["rf"], k["near"])
    if base_layer == "pra":
        return classify_release(x, k["pra"], k["sat"][3], k["overhead"], k["trees"][0])
    return classify_slope(x, k["sat"], k["trees"], k["overhead"])


def canopy_beyond(cells: DataFrame, most: float = 100.5) -> float | None:
    """The largest canopy of valid cells, if it can't be percent."""
    top = cells.where("valid").agg(F.max("canopy_pct")).first()[0]
    return top if top is not None and top > most else None


#: Minimum mapping units by class, in square metres.
MINIMUM_M2 = {0: 10000.0, 1: 10000.0, 2: 5000.0, 3: 5000.0, 4: 2500.0}


def postprocess(cells: DataFrame, spec: GridSpec, band: str = "ates", minimum_m2: dict[int, float] | None = None, area: DataFrame | None = None) -> DataFrame:
    """Minimum mapping units, then the area of interest."""
    x = mmu_clean(cells, spec, band, minimum_m2 or MINIMUM_M2, "_clean").withColumn(band, F.col("_clean")).drop("_clean")
    return x if area is None else x.join(area.select("r", "c"), ["r", "c"], "left_semi")


