"""Run configuration: an INI file read into typed parameters."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, field, fields
from pathlib import Path

from firnline.functions.fuzzy import forest_preset
from firnline.operators.flow import FlowParams
from firnline.operators.segment import SegmentParams


class Scenarios:
    """Parameters named <scenario>_<name> or, alike for both, <name>."""

    def of(self, scenario: str, name: str):
        return getattr(self, f"{scenario}_{name}") if hasattr(self, f"{scenario}_{name}") else getattr(self, name)


@dataclass
class ReleaseConfig(Scenarios):
    """Release areas; defaults are those of a shipped configuration. Forest
    parameters that aren't given follow from the forest type."""

    run_frequent: bool = True
    run_extreme: bool = True
    sieve_filter_m2: float = 1000.0
    forest_type: str = "sen2cc"
    enable_ruggedness: bool = False
    rugg_a: float = 0.01
    rugg_b: float = 5.0
    rugg_c: float = -0.007
    wind_direction: float = 0.0
    wind_tolerance: float = 180.0
    wind_probability: float = 0.5
    wind_radius_m: float = 60.0
    wind_radius_cells: int = 0
    wind_a: float = 3.0
    wind_b: float = 10.0
    wind_c: float = 3.0
    frequent_pra_threshold: float = 0.25
    frequent_slope_a: float = 12.0
    frequent_slope_b: float = 4.0
    frequent_slope_c: float = 42.5
    frequent_slope_a_low: float | None = None
    frequent_slope_b_low: float | None = None
    frequent_slope_a_high: float | None = None
    frequent_slope_b_high: float | None = None
    frequent_slope_clip_lo: float | None = None
    frequent_slope_clip_hi: float | None = None
    frequent_forest_a: float | None = None
    frequent_forest_b: float | None = None
    frequent_forest_c: float | None = None
    extreme_pra_threshold: float = 0.05
    extreme_slope_a: float = 14.0
    extreme_slope_b: float = 4.0
    extreme_slope_c: float = 40.0
    extreme_slope_a_low: float | None = None
    extreme_slope_b_low: float | None = None
    extreme_slope_a_high: float | None = None
    extreme_slope_b_high: float | None = None
    extreme_slope_clip_lo: float | None = None
    extreme_slope_clip_hi: float | None = None
    extreme_forest_a: float | None = None
    extreme_forest_b: float | None = None
    extreme_forest_c: float | None = None
    enable_treeline: bool = True
    subregions_path: str = ""
    treeline_table_csv: str = ""
    treeline_min_reliable_kpx: float = 150.0

    def slope(self, scenario: str) -> dict:
        """Arguments of fuzzy.slope_membership."""
        names = {"a": "a", "b": "b", "c": "c", "a_low": "a_low", "b_low": "b_low", "a_high": "a_high", "b_high": "b_high", "clip_lo": "clip_lo", "clip_hi": "clip_hi"}
        return {k: self.of(scenario, f"slope_{v}") for k, v in names.items()}

    def forest(self, scenario: str) -> tuple[float, float, float]:
        preset = forest_preset(self.forest_type)
        given = [self.of(scenario, f"forest_{k}") for k in "abc"]
        return tuple(p if g is None else g for g, p in zip(given, preset, strict=True))


@dataclass
class SegmentConfig(Scenarios):
    enable_morphological_cleanup: bool = True
    opening_iterations: int = 1
    closing_iterations: int = 1
    split_trigger: str = "both"
    split_use_treeline: bool = True
    split_enforce_size_cap: bool = False
    frequent_min_distance: int = 2
    frequent_pra_maxima_min_distance: int = 2
    frequent_pra_scale_factor: float = 1.0
    frequent_merge_threshold: float = 5000.0
    frequent_max_polygon_size_m2: float = 250000.0
    frequent_pra_weight: float = 5.0
    frequent_curvature_weight: float = 2.5
    frequent_aspect_weight: float = 1.0
    frequent_forest_weight: float = 1.0
    frequent_elevation_weight: float = 1.0
    frequent_split_bench_prominence: float = 1.5
    frequent_split_min_stratify_area_m2: float = 20000.0
    extreme_min_distance: int = 5
    extreme_pra_maxima_min_distance: int = 5
    extreme_pra_scale_factor: float = 1.0
    extreme_merge_threshold: float = 15000.0
    extreme_max_polygon_size_m2: float = 500000.0
    extreme_pra_weight: float = 5.0
    extreme_curvature_weight: float = 1.0
    extreme_aspect_weight: float = 2.0
    extreme_forest_weight: float = 1.0
    extreme_elevation_weight: float = 2.5
    extreme_split_bench_prominence: float = 1.5
    extreme_split_min_stratify_area_m2: float = 60000.0

    def params(self, scenario: str) -> SegmentParams:
        get = lambda name: self.of(scenario, name)
        clean = self.enable_morphological_cleanup
        return SegmentParams(
            min_distance=get("min_distance"), maxima_distance=get("pra_maxima_min_distance"), scale=get("pra_scale_factor"), merge_m2=get("merge_threshold"),
            max_m2=get("max_polygon_size_m2"), pra_weight=get("pra_weight"), curvature_weight=get("curvature_weight"), aspect_weight=get("aspect_weight"),
            elevation_weight=get("elevation_weight"), opening=self.opening_iterations if clean else 0, closing=self.closing_iterations if clean else 0,
            enforce_cap=self.split_enforce_size_cap, trigger=self.split_trigger, prominence=get("split_bench_prominence"),
            least_m2=get("split_min_stratify_area_m2"), use_treeline=self.split_use_treeline,
        )


@dataclass
class FlowConfig(Scenarios):
    exponent: float = 8.0
    flux_threshold: float = 0.003
    max_z: float = 270.0
    frequent_alpha: float = 30.0
    extreme_alpha: float = 18.0
    forest_interaction: bool = True
    max_added_friction: float = 52.0
    min_added_friction: float = 5.0
    vel_th_for_friction: float = 270.0
    max_detrainment: float = 0.003
    min_detrainment: float = 0.00001
    vel_th_for_detrainment: float = 270.0
    forest_module: str = "forestDetrainment"
    output_files: str = "zDelta|cellCounts|travelLengthMax|travelLengthMin|fpTravelAngleMax|fpTravelAngleMin|flux|slTravelAngle|zDeltaSum|routFluxSum|depFluxSum"
    tile_size: float = 0.0
    tile_overlap: float = 0.0

    def params(self, scenario: str, cell: float) -> FlowParams:
        """Sizes of tiles and overlaps are metres here; they change the work's
        layout, never its result."""
        sizes = {k: max(1, round(v / cell)) for k, v in (("tile", self.tile_size), ("halo", self.tile_overlap)) if v}
        forest = self.forest_interaction and self.forest_module != "None"
        return FlowParams(
            self.of(scenario, "alpha"), self.exponent, self.flux_threshold, self.max_z, self.max_added_friction, self.min_added_friction, self.vel_th_for_friction,
            self.max_detrainment if self.forest_module == "forestDetrainment" else 0.0, self.min_detrainment if self.forest_module == "forestDetrainment" else 0.0,
            self.vel_th_for_detrainment, forest, **sizes,
        )

    def outputs(self) -> list[str]:
        return [x for x in self.output_files.split("|") if x]


@dataclass
class ClassConfig:
    model: str = "dev8"
    base_layer: str = "pra"
    pra1: float = 0.05
    pra2: float = 0.25
    pra3: float = 0.6
    sat01: float = 15.0
    sat12: float = 25.0
    sat23: float = 32.0
    sat34: float = 45.0
    win_size: int = 5
    az1: float = 1.0
    az2: float = 30.0
    az3: float = 75.0
    rf1: float = 0.0
    rf2: float = 500.0
    rf3: float = 3000.0
    flux_cutoff: float = 25.0
    class4_alpha: float = 60.0
    tree1: float = 20.0
    tree2: float = 60.0
    tree3: float = 85.0
    mmu_class0: float = 10000.0
    mmu_class1: float = 10000.0
    mmu_class2: float = 5000.0
    mmu_class3: float = 5000.0
    mmu_class4: float = 2500.0
    class0_prox: float = 25.0

    def minimum_m2(self) -> dict[int, float]:
        return {k: getattr(self, f"mmu_class{k}") for k in range(5)}

    def cuts(self) -> dict:
        """Arguments of classify.classify for the older model."""
        return {
            "pra": (self.pra1, self.pra2, self.pra3), "sat": (self.sat01, self.sat12, self.sat23, self.sat34), "trees": (self.tree1, self.tree2, self.tree3),
            "az": (self.az1, self.az2, self.az3), "rf": (self.rf1, self.rf2, self.rf3), "near": self.class0_prox, "overhead": self.class4_alpha,
        }


@dataclass
class OutputConfig:
    save_tif: bool = True
    save_shp: bool = True
    save_reports: bool = True


@dataclass
class RunConfig:
    project_name: str = "terrain"
    working_dir: str = "./outputs"
    output_basename: str = ""
    target_resolution_x: float = 0.0
    target_resolution_y: float = 0.0
    dem_path: str = "./dem"
    forest_canopy_path: str = "./forest_canopy"
    aoi_path: str = ""
    cell: float = 21.34
    run_pra: bool = True
    run_runout: bool = True
    run_ates: bool = True
    run_colorize: bool = True
    pra: ReleaseConfig = field(default_factory=ReleaseConfig)
    segments: SegmentConfig = field(default_factory=SegmentConfig)
    flow: FlowConfig = field(default_factory=FlowConfig)
    ates: ClassConfig = field(default_factory=ClassConfig)
    output: OutputConfig = field(default_factory=OutputConfig)


SECTIONS = {
    "General": None, "Input": None, "Processing": None, "PRA": "pra", "PRA_Segmentation": "segments", "FlowPy": "flow", "ATES": "ates", "Output": "output",
}
#: Keys that are read and change nothing here, and why.
WITHOUT_EFFECT = {
    "PRA_Segmentation": {
        "downsample_factor": "zones are cut at full resolution", "enable_island_cleanup": "islands are start zones",
        "small_threshold": "islands are start zones", "large_ratio": "islands are start zones",
    },
    "FlowPy": {"engine": "there is one kernel", "f_fr_layer_type": "canopy is the forest layer", "skip_forest_dist": "forest acts from the release on"},
}


def _typed(kind: str, text: str):
    kind, text = kind.removesuffix(" | None"), text.strip()
    if kind == "bool":
        known = configparser.ConfigParser.BOOLEAN_STATES
        if text.lower() not in known:
            raise ValueError(f"not a truth value: {text}")
        return known[text.lower()]
    return {"float": float, "int": int, "str": str}[kind](text)


def load(path: str | Path) -> RunConfig:
    """Unknown sections and keys are errors; absent keys keep their defaults, and
    so do empty numbers."""
    ini = configparser.ConfigParser(inline_comment_prefixes=(";", "#"))
    with open(path) as f:
        ini.read_file(f)
    run = RunConfig()
    for section in ini.sections():
        if section not in SECTIONS:
            raise ValueError(f"unknown section: [{section}]")
        target = getattr(run, SECTIONS[section]) if SECTIONS[section] else run
        known = {f.name: f.type for f in fields(target) if f.type.removesuffix(" | None") in ("str", "float", "int", "bool")}
        for key, text in ini.items(section):
            if key in WITHOUT_EFFECT.get(section, {}):
                continue
            if key not in known:
                raise ValueError(f"unknown key in [{section}]: {key}")
            if text.strip() or known[key] == "str":
                setattr(target, key, _typed(known[key], text))
    return run
