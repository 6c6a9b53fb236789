"""Palettes: colour arithmetic on the driver (a palette is a few dozen stops),
colouring as column expressions."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: sRGB primaries and white D65.
WHITE = (0.95047, 1.0, 1.08883)
TO_XYZ = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
FROM_XYZ = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))


def to_linear(v: float) -> float:
    v /= 255.0
    return v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4


def from_linear(v: float) -> int:
    v = 12.92 * v if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055
    return min(255, max(0, round(v * 255)))


def _times(m, v):
    return tuple(sum(a * b for a, b in zip(row, v, strict=True)) for row in m)


def rgb_to_lab(rgb) -> tuple[float, float, float]:
    x, y, z = (v / w for v, w in zip(_times(TO_XYZ, [to_linear(c) for c in rgb]), WHITE, strict=True))
    f = lambda t: t ** (1 / 3) if t > 0.008856 else 7.787 * t + 16 / 116
    return 116 * f(y) - 16, 500 * (f(x) - f(y)), 200 * (f(y) - f(z))


def lab_to_rgb(lab) -> tuple[int, int, int]:
    fy = (lab[0] + 16) / 116
    fs = (fy + lab[1] / 500, fy, fy - lab[2] / 200)
    xyz = [w * (t**3 if t**3 > 0.008856 else (t - 16 / 116) / 7.787) for t, w in zip(fs, WHITE, strict=True)]
    return tuple(from_linear(max(0.0, v)) for v in _times(FROM_XYZ, xyz))


def mix(a, b, t: float, lab: bool = False) -> tuple[int, int, int]:
    if lab:
        return lab_to_rgb([p + (q - p) * t for p, q in zip(rgb_to_lab(a), rgb_to_lab(b), strict=True)])
    return tuple(round(p + (q - p) * t) for p, q in zip(a, b, strict=True))


@dataclass(frozen=True)
class Palette:
    """Stops (value, r, g, b, a) in ascending order, and the colour of NULL."""

    stops: tuple[tuple[float, int, int, int, int], ...]
    nothing: tuple[int, int, int, int] = (0, 0, 0, 0)
    meta: dict = field(default_factory=dict, compare=False)

    def segments(self):
        """(lo, hi, colour at lo, colour at hi)."""
        return [(a[0], b[0], a[1:], b[1:]) for a, b in zip(self.stops, self.stops[1:], strict=False)]


def expand_ramp(anchors, per_seg: int = 14, scale: str = "linear", lab: bool = False):
    """Stops between anchors (value, (r, g, b)), evenly in value or its log."""
    out = []
    for (v0, a), (v1, b) in zip(anchors, anchors[1:], strict=False):
        for k in range(per_seg):
            t = k / per_seg
            v = math.exp(math.log(v0) + (math.log(v1) - math.log(v0)) * t) if scale == "log" else v0 + (v1 - v0) * t
            out.append((v, *mix(a, b, t, lab)))
    v, a = anchors[-1]
    return [*out, (v, *a)]


ALPHA = 166  # of a ramp that names none


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def parse(text: str, alpha: int | None = None) -> Palette:
    """A palette file: stops `value r g b [a] [label]`, or, with a line `# @ramp
    key=value ...` (the # may be missing), anchors `value #hex` or `value r g b`
    of a ramp; blanks or commas between; # begins a comment, but for a directive
    or a colour. `nv` is missing values' line; they are always transparent. A
    ramp's floor hides all below. alpha, if given, is every stop's, but a floor
    stays hidden."""
    stops, anchors, ramp = [], [], None
    nothing = (0, 0, 0, 0)
    for line in text.splitlines():
        line = line.strip()
        bare = line.lstrip("# ").lower()
        if bare.startswith("@ramp"):
            ramp = dict(p.split("=", 1) for p in bare.split()[1:] if "=" in p)
            continue
        if not line or line.startswith("#") or line.upper().startswith("INTERPOLATION"):
            continue
        parts = [p for p in re.split(r"[\s,]+", line) if p]
        value = _number(parts[0].rstrip(":"))
        if len(parts) >= 2 and parts[1].startswith("#") and value is not None:
            h = parts[1].lstrip("#")
            anchors.append((value, tuple(int(h[i : i + 2], 16) for i in (0, 2, 4))))
        elif len(parts) >= 4 and all(_number(p) is not None for p in parts[1:4]):
            rgb = tuple(int(float(p)) for p in parts[1:4])
            if parts[0].lower() == "nv":
                nothing = (*rgb, 0)
            elif value is not None:
                anchors.append((value, rgb))
                given = _number(parts[4]) if len(parts) > 4 else None
                stops.append((value, *rgb, 255 if given is None else int(given)))
    if ramp is not None:
        a = int(alpha if alpha is not None else float(ramp.get("alpha", ALPHA)))
        rows = expand_ramp(sorted(anchors), int(ramp.get("per_seg", 14)), ramp.get("scale", "linear"), ramp.get("lab", "0") not in ("0", "false"))
        stops = [(*r, a) for r in rows]
        if "floor" in ramp:
            low, first = float(ramp["floor"]), stops[0][1:4]
            stops = [(0.0, *first, 0), (0.999 * low, *first, 0), *stops]
    elif alpha is not None:
        stops = [(*s[:4], int(alpha)) for s in stops]
    return Palette(tuple(sorted(stops, key=lambda s: s[0])), nothing, ramp or {})


def load(name: str, folder: str | Path) -> Palette:
    """By path, by name in the folder, or by name and ".txt"."""
    for p in (Path(name), Path(folder) / name, Path(folder) / f"{name}.txt"):
        if p.is_file():
            return parse(p.read_text())
    raise FileNotFoundError(name)


def colour(x: Column, palette: Palette, categorical: bool = False) -> Column:
    """struct(red, green, blue, alpha) of a value: linear between stops, or by
    exact match; below the first stop its colour, above the last one's."""
    names = ("red", "green", "blue", "alpha")

    def fixed(rgba) -> list[Column]:
        return [F.lit(int(v)) for v in rgba]

    if categorical:
        none = fixed(palette.nothing)
        channels = []
        for i, name in enumerate(names):
            out = F.when(x.isNull() | F.isnan(x.cast("double")), none[i])
            for s in palette.stops:
                out = out.when(x == F.lit(s[0]), F.lit(int(s[i + 1])))
            channels.append(out.otherwise(none[i]).cast("int").alias(name))
        return F.struct(*channels)
    # The stretch between two stops in which a value lies is looked up once, in
    # one constant array, for all channels; beyond the ends a stretch is flat.
    x = F.when(~F.isnan(x.cast("double")), x.cast("double"))
    values, shades = [float(s[0]) for s in palette.stops], [tuple(float(v) for v in s[1:5]) for s in palette.stops]
    ends = [(0.0, 1.0, shades[0], shades[0]), *zip(values, values[1:], shades, shades[1:], strict=False), (0.0, 1.0, shades[-1], shades[-1])]
    column = lambda items: F.lit(np.array(items, dtype=float))  # noqa: E731  one literal
    below = sum((F.when(x > v, 1).otherwise(0) for v in values), F.lit(0)) if len(values) <= 24 else F.size(F.filter(column(values), lambda v: v < x))
    below = F.coalesce(below, F.lit(0))
    lo, hi = (F.get(column([e[k] for e in ends]), below) for k in (0, 1))
    share = (F.when(x > 1e300, 1e300).when(x < -1e300, -1e300).otherwise(x) - lo) / (hi - lo)  # endless values are on flat stretches
    shade = lambda k, i: F.get(column([e[k][i] for e in ends]), below)
    mixed = lambda i: F.floor(shade(2, i) + share * (shade(3, i) - shade(2, i)) + 0.5)
    return F.struct(*[F.coalesce(mixed(i).cast("int"), none).alias(n) for i, (n, none) in enumerate(zip(names, fixed(palette.nothing), strict=True))])


#: Class colours and the canopy ramp (value, r, g, b, a).
CLASSES = Palette(((0.0, 255, 255, 255, 0), (1.0, 144, 239, 152, 166), (2.0, 0, 173, 255, 166), (3.0, 241, 83, 147, 166), (4.0, 180, 0, 255, 166)))
CANOPY = Palette(
    (
        (0.0, 255, 255, 229, 0), (10.0, 247, 252, 185, 110), (20.0, 217, 240, 163, 150), (30.0, 173, 221, 142, 175), (40.0, 120, 198, 121, 190),
        (50.0, 65, 171, 93, 200), (65.0, 35, 132, 67, 205), (80.0, 0, 104, 55, 210), (100.0, 0, 69, 41, 220),
    )
)
RELEASE_BINARY = {
    "extreme": Palette(((0.0, 0, 0, 0, 0), (1.0, 255, 20, 147, 200))),
    "frequent": Palette(((0.0, 0, 0, 0, 0), (1.0, 0, 178, 169, 200))),
}
#: The continuous release-area ramps.
RELEASE_RAMPS = {
    "extreme": "@ramp scale=linear lab=0 per_seg=10 floor=0.05 alpha=166\n0.05 #FFE94A\n0.295 #FFB020\n0.54 #F26419\n0.731 #D62828\n0.75 #C51B8A\n1 #4A0072",
    "frequent": "@ramp scale=linear lab=0 per_seg=10 floor=0.25 alpha=166\n0.25 #FFE94A\n0.425 #FFB020\n0.6 #F26419\n0.735 #D62828\n0.75 #C51B8A\n1 #4A0072",
}
#: Flux, slope and travel-angle palettes.
FLUX_RAMP = "@ramp scale=log lab=1 per_seg=12 floor=100 alpha=166\n100 #0CF3FF\n430 #00b7d0\n1850 #0093ff\n7950 #d30098\n34200 #7a0fb8\n1.5e+05 #6e14a3"
SLOPE_RAMP = "@ramp scale=linear lab=1 per_seg=10 floor=20 alpha=166\n20 #92F955\n30 #FFF75A\n36.5 #DE9849\n39 #EA3525\n45 #8A27DB\n52 #2E1A8A\n90 #2E1A8A"
ANGLE = Palette(
    (
        (0.0, 0, 0, 0, 0), (18.0, 48, 18, 59, 200), (25.0, 70, 98, 216, 200), (28.0, 53, 171, 248, 200), (30.0, 27, 229, 181, 200), (33.0, 116, 254, 93, 200),
        (36.0, 201, 239, 52, 200), (38.0, 251, 185, 56, 200), (42.0, 245, 105, 24, 200), (48.0, 201, 41, 3, 200), (70.0, 122, 4, 3, 200),
    )
)
#: Reversed spectral colours, low to high, of energy-line heights and travel angles.
SPECTRAL = (
    (43, 131, 186), (64, 146, 182), (86, 161, 179), (107, 176, 175), (128, 191, 171), (150, 206, 168), (171, 221, 164), (185, 227, 169), (199, 232, 173),
    (213, 238, 178), (227, 244, 182), (241, 249, 187), (255, 255, 191), (255, 242, 175), (254, 228, 160), (254, 215, 144), (254, 201, 128), (253, 187, 113),
    (253, 174, 97), (247, 149, 86), (240, 124, 74), (234, 100, 63), (228, 75, 51), (221, 50, 39), (215, 25, 28),
)
#: Travel angles of those colours, by scenario.
SPECTRAL_ANGLES = {
    "extreme": (
        18.00017166137695313, 22.08227642607282348, 24.91113765298762672, 27.08463878306177364, 28.80935919199530559, 30.24837924913186882,
        31.47371423581699901, 32.6177310907912883, 33.72848674961021231, 34.8128999150580114, 35.89951023611972403, 37.00512361584223697,
        38.13186708785179491, 39.29486362749098305, 40.5219049158762914, 41.81810985810820824, 43.19460447623168875, 44.66595076968791744,
        46.29247702187605285, 48.0744403467509045, 50.10517310991218665, 52.51222720694659785, 55.58763734253803079, 59.83429503831879259,
        75.0,
    ),
    "frequent": (
        28.00001907348632813, 29.57701827334770783, 30.79859633333810365, 31.86281471049444036, 32.87045961225810231, 33.82084332523660208,
        34.7486410825880796, 35.67023132168630895, 36.58896212088944111, 37.51862394348898988, 38.45302736895254014, 39.41103022241098586,
        40.40873947542526423, 41.45381046391702284, 42.54551927905207265, 43.68482510003572372, 44.90790527085708561, 46.23099344712307612,
        47.6651835317178012, 49.24576608030846359, 51.06102177522567587, 53.21852346923144239, 55.90024374552260156, 59.47577425939959284,
        75.0,
    ),
}


def _spectral(values) -> Palette:
    """Spectral stops with alpha 200; nothing is shown at 0."""
    return Palette(((0.0, *SPECTRAL[0], 0), *((float(v), *rgb, 200) for v, rgb in zip(values, SPECTRAL, strict=True))))


ZDELTA = _spectral([round(10.8 * (k + 1), 4) for k in range(25)])
SCENARIO_ANGLE = {s: _spectral(v) for s, v in SPECTRAL_ANGLES.items()}
