"""Votes, floors and codes of the terrain classifiers, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the vote classifier.
REFERENCE_CELL = 21.34
SPLIT_CUTS = {
    "pra": (0.0, 0.0087, 0.1613),
    "size": (0.0, 0.0136, 0.3086),
    "alpha": (0.0, 24.005, 34.270),
    "flux": (0.0, 10.299, 375.18),
}
COARSE_CUTS = (8.029, 17.933, 31.419)
GAP_CUTS = (0.0, 54.9, 100.0)
GAP_WEIGHT = 2
FLUX_FLOOR = 500.0
CLIFF_SLOPE, CLIFF_CANOPY = 45, 20
COARSE_FLOORS = ((40.0, 3), (45.0, 4))
ZERO_SCORE = 0.60
#: Lookup tables of the older classifier, rows by forest code, columns by class 0 to 4.
OPEN_TABLE = {10: (0, 1, 2, 3, 4), 20: (0, 1, 2, 2, 3), 30: (0, 1, 1, 2, 3), 40: (0, 1, 1, 1, 2)}
RELEASE_TABLE = {10: (1, 1, 2, 3, 4), 20: (1, 1, 2, 2, 3), 30: (1, 1, 2, 2, 3), 40: (1, 1, 2, 2, 2)}


def area_factor(cell: float) -> float:
    """Cuts on areas are for the reference cell; other cells scale them."""
    return cell * cell / (REFERENCE_CELL * REFERENCE_CELL)


def step_vote(x: Column, cuts) -> Column:
    """How many cuts x is above; NULL and NaN count as 0."""
    v = F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))
    return reduce(lambda a, b: a + b, [(v > F.lit(float(c))).cast("int") for c in cuts])


def split_vote(low: Column | None, high: Column, c1: float, c2: float, c3: float) -> Column:
    """0 to 3: the typical band above c3 gives 3; else the extreme one decides."""
    v = F.when(high > c3, 3)
    if low is not None:
        v = v.when(low > c2, 2).when(low > c1, 1)
    return v.otherwise(0)


def speaks(low: Column | None, high: Column) -> Column:
    """A vote counts only where one of its bands is above 0."""
    hi = F.coalesce(high > 0, F.lit(False))
    return hi if low is None else hi | F.coalesce(low > 0, F.lit(False))


def angle_score(zdelta: Column, angle: Column, max_z: float = 270.0) -> Column:
    """Mean of the two scores, each 0 to 100, cut to an integer."""
    z = F.greatest(F.lit(0.0), F.least(F.lit(100.0), zdelta / max_z * 100.0))
    a = F.greatest(F.lit(0.0), F.least(F.lit(100.0), angle / 90.0 * 100.0))
    return ((z + a) / 2.0).cast("smallint")


def flux_area(flux: Column, cell_area: float, angle: Column | None = None, cutoff: float = 25.0) -> Column:
    """Contributing area; with an angle band, 0 below the cutoff."""
    area = flux * cell_area
    return area if angle is None else F.when(angle < cutoff, 0.0).otherwise(area)


def far_if_bad(x: Column, far: float = 10_000.0) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (x < 0), far).otherwise(x)


def floors(vote: Column, e_zdelta: Column, f_zdelta: Column, f_flux: Column, slope: Column, canopy: Column, cell: float) -> Column:
    f = area_factor(cell)
    return F.greatest(
        vote,
        F.when(e_zdelta > 0, 1).otherwise(0),
        F.when(f_zdelta > 0, 2).otherwise(0),
        F.when(f_flux >= FLUX_FLOOR * f, 3).otherwise(0),
        F.when((slope > CLIFF_SLOPE) & (canopy <= CLIFF_CANOPY), 4).otherwise(0),
    )


def _clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def zero_score(coarse: Column, slope: Column, canopy: Column, runout_far: Column | None = None, release_far: Column | None = None) -> Column:
    """Mean of 3 to 5 factors; distance factors only where the band exists."""
    parts = [_clip01((14.0 - coarse) / 14.0), _clip01((20.0 - slope) / 20.0), _clip01(canopy / 60.0)]
    if runout_far is not None:
        parts.append(_clip01(far_if_bad(runout_far) / 200.0))
    if release_far is not None:
        parts.append(_clip01(far_if_bad(release_far) / 500.0))
    return reduce(lambda a, b: a + b, parts) / float(len(parts))


def ladder(x: Column, cuts: list[tuple[float, int]], strict: bool = False) -> Column:
    """Highest class whose cut x reaches (strict: exceeds); else 0."""
    out = None
    for cut, value in sorted(cuts, key=lambda p: -p[1]):
        hit = x > cut if strict else x >= cut
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(0)


def forest_code(canopy: Column, tree1: float = 20, tree2: float = 60, tree3: float = 85) -> Column:
    return F.when(canopy <= tree1, 10).when(canopy <= tree2, 20).when(canopy <= tree3, 30).otherwise(40)


def forest_lookup(merged: Column, forest: Column, release: Column) -> Column:
    """Class by forest code, merged class and release code; any other: NULL."""
    pairs = []
    for extra, table in ((0, OPEN_TABLE), (100, RELEASE_TABLE)):
        for code, row in table.items():
            for k, v in enumerate(row):
                pairs += [F.lit(extra + code + k), F.lit(v)]
    return F.element_at(F.create_map(*pairs), merged + forest + release)


def band_label(above: Column) -> Column:
    return F.when(above.isNull(), "unknown").when(above >= 0.7, "alpine").when(above <= 0.3, "below_treeline").otherwise("treeline")


def compass(degrees: Column) -> Column:
    names = F.array(*[F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.element_at(names, (F.floor(F.pmod(degrees + 22.5, F.lit(360.0)) / 45.0) + 1).cast("int"))
