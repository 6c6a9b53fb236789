"""The vote classifier on constant grids whose centre class is known by hand."""

import pytest
from pyspark.sql import functions as F

from firnline.grid import GridSpec, dense
from firnline.operators import classify

BANDS = ("E_pra", "F_pra", "E_zdelta", "F_zdelta", "E_travel_angle", "F_travel_angle", "E_rout_flux_area", "F_rout_flux_area")


def centre(spark, size=8, cell=21.34, slope=10.0, canopy=0.0, cliff=None, at=None, **bands):
    spec = GridSpec(size, size, cell)
    x = dense(spark, spec).withColumns({b: F.lit(float(bands.get(b, 0.0))) for b in {*BANDS, *bands}})
    mid = size // 2
    here = (F.col("r") == mid) & (F.col("c") == mid)
    x = x.withColumns({"valid": F.lit(True), "slope": F.when(here, cliff or slope).otherwise(slope), "canopy_pct": F.lit(canopy)})
    r, c = at or (mid, mid)
    return classify.classify_votes(x, spec).where((F.col("r") == r) & (F.col("c") == c)).first()["ates"]


@pytest.mark.parametrize(
    "kw,want",
    [
        ({"F_zdelta": 10}, 2),
        ({"F_zdelta": 10, "F_rout_flux_area": 600}, 3),
        ({"cell": 5.0, "F_zdelta": 10, "F_rout_flux_area": 10}, 2),
        ({"cell": 5.0, "F_zdelta": 10, "F_rout_flux_area": 30}, 3),
        ({"slope": 0.0, "E_zdelta": 10, "E_runout_prox": 0, "E_pra_proximity": 0}, 1),
        ({"slope": 0.0, "canopy": 100.0, "F_zdelta": 10, "E_runout_prox": 500, "E_pra_proximity": 500}, 0),
        ({"size": 31, "canopy": 10.0, "cliff": 50.0}, 4),
    ],
)
def test_centre_class(spark, kw, want):
    assert centre(spark, **kw) == want


def test_open_cliff_stays_local(spark):
    assert centre(spark, size=31, canopy=10.0, cliff=50.0, at=(0, 0)) != 4


def test_missing_bands_are_named(spark):
    with pytest.raises(ValueError, match="slope"):
        classify.classify_votes(dense(spark, GridSpec(3, 3)), GridSpec(3, 3))
    with pytest.raises(ValueError, match="unknown model"):
        classify.classify(dense(spark, GridSpec(3, 3)), GridSpec(3, 3), "other")
