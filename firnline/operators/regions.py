"""Connected regions: labels, sieve, minimum mapping units, gaps, adjacency,
merging, polygons.

Labels are found tile by tile (a tile is bounded, whatever the grid), then
tiles are joined through the labels that meet at their borders; only those
border pairs take part in the rounds that follow.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firnline.grid import TILE, GridSpec, cut_lineage, workers_see

SHIFTS = {4: ((0, 1), (1, 0)), 8: ((0, 1), (1, -1), (1, 0), (1, 1))}


def _label_tile(pdf: pd.DataFrame, width: int, connectivity: int) -> pd.DataFrame:
    """Least cell id of each cell's component within a tile, by value."""
    r, c = pdf.r.to_numpy(), pdf.c.to_numpy()
    r0, c0 = r.min(), c.min()
    place = np.full((r.max() - r0 + 2, c.max() - c0 + 3), -1, dtype=np.int64)
    place[r - r0, c - c0 + 1] = np.arange(len(r))
    value = pd.factorize(pdf.value)[0]
    ids = r * width + c
    pairs = []
    for dr, dc in SHIFTS[connectivity]:
        other = place[r - r0 + dr, c - c0 + 1 + dc]
        ok = np.flatnonzero(other >= 0)
        ok = ok[value[ok] == value[other[ok]]]
        pairs.append((ok, other[ok]))
    a, b = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(r), dtype=np.int64)
    rank[order] = np.arange(len(r))
    a, b = rank[a], rank[b]  # roots are ranks by cell id; the least one wins
    parent = np.arange(len(r))
    while len(a):
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        if not len(a):
            break
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    label = ids[order][parent[rank]]
    return pd.DataFrame({"r": r, "c": c, "value": pdf.value, "label": label})


CHUNK = 1_000_000  # pairs that a task joins at once


def _union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the pairs that aren't roots, and their roots (the least node)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while len(a):
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


def _stars(pairs: DataFrame, most: int) -> DataFrame:
    """a, b that join the same nodes: each task joins its pairs in memory, `most`
    at a time, and gives every node but the least of a group with that one."""

    def join(batches):
        held: list[pd.DataFrame] = []

        def joined() -> pd.DataFrame:
            x = pd.concat(held)
            held.clear()
            node, root = _union(x.a.to_numpy(), x.b.to_numpy())
            return pd.DataFrame({"a": node, "b": root})

        for x in batches:
            for at in range(0, len(x), max(1, most)):
                held.append(x[at : at + max(1, most)])
                if sum(map(len, held)) >= most:
                    yield joined()
        if held:
            yield joined()

    workers_see(pairs.sparkSession)
    return pairs.mapInPandas(join, "a long, b long")


def _settled(stars: DataFrame) -> bool:
    """Whether every node has one root and no root is another's node."""
    none = F.lit(None).cast("long")
    ends = stars.select("a", "b", F.lit(0).alias("_root")).unionByName(stars.select(F.col("b").alias("a"), none.alias("b"), F.lit(1).alias("_root")))
    seen = ends.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi"), F.max("_root").alias("_root"))
    return not seen.where("lo < hi or lo is not null and _root = 1").limit(1).count()


def _roots(pairs: DataFrame, most: int = CHUNK) -> DataFrame:
    """node, root (the least node it is joined with) over pairs (a, b), a > b.

    In a round tasks join what they hold; where a node is in several tasks' pairs
    its neighbours gather under the least one, by joins, for the next round. Few
    pairs are one task's, so one round settles them; no task holds more than
    `most` pairs, however many there are."""
    pairs = pairs.where("a <> b").distinct()
    while True:
        pairs = cut_lineage(_stars(pairs, most), "pairs")
        if _settled(pairs):
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).distinct()
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        up = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        pairs = down.where("a <> b").distinct()


def connected(cells: DataFrame, spec: GridSpec, value: str | None = None, connectivity: int = 8, tile: int = TILE) -> DataFrame:
    """r, c, value, label of each cell; cells of one label are connected and of
    one value. The label is the least r * width + c. Cells with a NULL value
    are background."""
    workers_see(cells.sparkSession)
    v = F.col(value) if value else F.lit(1)
    x = cells.where(v.isNotNull()).select(F.col("r").cast("long"), F.col("c").cast("long"), v.alias("value"))
    x = x.withColumns({"tr": F.floor(F.col("r") / tile), "tc": F.floor(F.col("c") / tile)})
    width, kind = spec.width, x.schema["value"].dataType.simpleString()
    local = x.groupBy("tr", "tc").applyInPandas(lambda pdf: _label_tile(pdf, width, connectivity), f"r long, c long, value {kind}, label long")
    local = cut_lineage(local, "tiles")
    # Pairs of labels that meet at tile borders.
    edge = local.where(F.pmod("r", F.lit(tile)).isin(0, tile - 1) | F.pmod("c", F.lit(tile)).isin(0, tile - 1))
    steps = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in SHIFTS[connectivity]]))
    probe = edge.withColumn("s", steps).select(
        F.col("value").alias("_v"), F.col("label").alias("_l"), (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c")
    )
    meet = probe.join(edge, ["r", "c"]).where((F.col("_v") == F.col("value")) & (F.col("_l") != F.col("label")))
    roots = _roots(meet.select(F.greatest("label", "_l").alias("a"), F.least("label", "_l").alias("b")))
    return local.join(roots, local.label == roots.node, "left").select("r", "c", "value", F.coalesce("root", "label").alias("label"))


def cells_for(area_m2: float, spec: GridSpec) -> int:
    return max(1, round(area_m2 / spec.cell_area))


def sieve(cells: DataFrame, spec: GridSpec, band: str, area_m2: float = 1000.0, out: str = "sieved") -> DataFrame:
    """A 0/1 band without its 4-connected islands below an area; holes stay."""
    on = connected(cells.where(F.col(band) == 1), spec, None, 4)
    sizes = on.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    big = on.join(sizes, "label").where(F.col("_n") >= cells_for(area_m2, spec)).select("r", "c", F.lit(1).alias("_big"))
    return cells.join(big, ["r", "c"], "left").withColumn(out, F.when(F.col(band) == 1, F.coalesce("_big", F.lit(0))).otherwise(F.col(band))).drop("_big")


def gap_metrics(cells: DataFrame, spec: GridSpec, canopy: str = "canopy_pct", valid: str = "valid", open_at: float = 30.0, area_cap_ha: float = 100.0, width_cap: float = 500.0, enclosed_only: bool = False, with_width: bool = True) -> DataFrame:
    """Adds gap_area_ha of the 8-connected opening a cell is in, and gap_width
    (twice the distance to the nearest forest); 0 in forest. Unknown canopy and
    cells outside count as forest."""
    from firnline.operators.distance import distance_to

    is_open = F.coalesce(F.col(canopy) <= open_at, F.lit(False)) & F.coalesce(F.col(valid), F.lit(False))
    marked = cells.withColumn("_open", is_open)
    on = connected(marked.where("_open"), spec, None, 8)
    rim = (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == spec.height - 1) | (F.col("c") == spec.width - 1)
    sizes = on.groupBy("label").agg(F.count(F.lit(1)).alias("_n"), F.max(rim.cast("int")).alias("_rim"))
    area = F.least(F.lit(area_cap_ha), F.col("_n") * spec.cell_area / 10000.0)
    if enclosed_only:
        area = F.when(F.col("_rim") == 1, 0.0).otherwise(area)
    x = marked.join(on.join(sizes, "label").select("r", "c", area.alias("gap_area_ha")), ["r", "c"], "left")
    x = x.withColumn("gap_area_ha", F.coalesce("gap_area_ha", F.lit(0.0)))
    if with_width:
        x = distance_to(x, spec, ~F.col("_open"), "_d").withColumn(
            "gap_width", F.when(F.col("_open"), F.least(F.lit(width_cap), 2.0 * spec.cell * F.coalesce("_d", F.lit(1e9)))).otherwise(0.0)
        ).drop("_d")
    return x.drop("_open")


def mmu_clean(cells: DataFrame, spec: GridSpec, band: str, minimum_m2: dict[int, float], out: str = "cleaned") -> DataFrame:
    """Regions of a class below its minimum area take the class of the nearest
    surviving cell (ties: least row, then column). All regions are judged on
    the input; NULL cells neither take nor give."""
    from firnline.operators.distance import nearest_feature

    parts = connected(cells, spec, band, 8)
    sizes = parts.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    least = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in minimum_m2.items() for x in (int(k), cells_for(v, spec))]), F.col("value").cast("int")), F.lit(1))
    judged = parts.join(sizes, "label").select("r", "c", (F.col("_n") >= least).alias("_stays"))
    x = cells.join(judged, ["r", "c"], "left")
    near = nearest_feature(x, spec, F.coalesce(F.col("_stays"), F.lit(False)), band, "_near")
    return near.withColumn(out, F.when(F.col(band).isNotNull(), F.coalesce(F.when(F.col("_stays"), F.col(band)), F.col("_near"), F.col(band)))).drop("_stays", "_near")


def adjacency(labels: DataFrame, connectivity: int = 8) -> DataFrame:
    """a < b: labels that touch, and how many cell sides they share."""
    steps = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in SHIFTS[connectivity]]))
    probe = labels.withColumn("s", steps).select(
        F.col("label").alias("_l"), ((F.col("s.dr") == 0) | (F.col("s.dc") == 0)).cast("long").alias("_side"),
        (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"),
    )
    meet = probe.join(labels.select("r", "c", "label"), ["r", "c"]).where("_l <> label")
    return meet.groupBy(F.least("_l", "label").alias("a"), F.greatest("_l", "label").alias("b")).agg(F.sum("_side").alias("sides"))


def merge_small(labels: DataFrame, spec: GridSpec, threshold_m2: float, cap_m2: float | None = None) -> DataFrame:
    """label -> merged. Touching regions below the threshold merge (named after
    the largest, ties by label); a cluster still below it joins the touching
    large region with the longest shared border (ties by label); islands stay.

    Under a cap clusters come in order of their least label, and each takes, of
    the large regions that still have room for it, the one with the longest
    border: regions grow as they take, so none passes the cap by it."""
    area = labels.groupBy("label").agg((F.count(F.lit(1)) * spec.cell_area).alias("area"))
    touching = cut_lineage(adjacency(labels), "touching")
    small = area.where(F.col("area") < threshold_m2)
    both = touching.join(small.select(F.col("label").alias("a")), "a").join(small.select(F.col("label").alias("b")), "b")
    roots = _roots(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    grouped = area.join(roots, area.label == roots.node, "left").select("label", "area", F.coalesce("root", "label").alias("root"))
    clusters = cut_lineage(
        grouped.groupBy("root").agg(F.sum("area").alias("total"), F.max_by("label", F.struct("area", -F.col("label"))).alias("name")), "clusters"
    )
    member = cut_lineage(grouped.join(clusters, "root").select("label", "name", "total"), "members")
    sides = touching.unionByName(touching.select(F.col("b").alias("a"), F.col("a").alias("b"), "sides"))
    sides = sides.join(member.select(F.col("label").alias("a"), F.col("name").alias("small"), F.col("total").alias("ta")), "a")
    sides = sides.join(member.select(F.col("label").alias("b"), F.col("name").alias("large"), F.col("total").alias("tb")), "b")
    sides = sides.where((F.col("small") != F.col("large")) & (F.col("ta") < threshold_m2) & (F.col("tb") >= threshold_m2))
    border = sides.groupBy("small", "large").agg(F.sum("sides").alias("s"), F.first("ta").alias("ta"), F.first("tb").alias("tb"))
    if cap_m2 is None:
        best = border.groupBy("small").agg(F.max_by("large", F.struct("s", -F.col("large"))).alias("into"))
    else:
        order = clusters.select(F.col("name").alias("small"), F.col("root").alias("place"))
        best = _admitted(border.join(order, "small"), spec, cap_m2)
    return member.join(best, F.col("name") == F.col("small"), "left").select("label", F.coalesce("into", "name").alias("merged"))


def _admitted(claims: DataFrame, spec: GridSpec, cap_m2: float) -> DataFrame:
    """small -> into, as if clusters chose one after another by `place`. claims:
    small, large, s (border), ta and tb (areas), place.

    In a round every region looks at the clusters that may still come to it, in
    order: as long as it is the best choice of each, it admits them while they
    fit. A cluster that prefers another region, where it may yet be refused,
    ends the round for those behind it. The first cluster of all is always
    decided, so rounds end. A round reads no more claims of a region than cells
    fit into it, so no group grows with the map."""
    spark, most = claims.sparkSession, int(cap_m2 / spec.cell_area) + 1
    kind = dict(claims.dtypes)["small"]
    done = spark.createDataFrame([], f"small {kind}, into {kind}")
    claims = cut_lineage(claims, "claims")
    while True:
        claims = claims.where(F.col("ta") + F.col("tb") <= cap_m2)
        best = claims.groupBy("small").agg(F.max_by("large", F.struct("s", -F.col("large"))).alias("best"))
        line = Window.partitionBy("large").orderBy("place")
        x = claims.join(best, "small").withColumn("_k", F.row_number().over(line)).where(F.col("_k") <= most)
        x = x.withColumns({"_other": F.max((F.col("best") != F.col("large")).cast("int")).over(line), "_sum": F.sum("ta").over(line)})
        now = cut_lineage(x.where((F.col("_other") == 0) & (F.col("tb") + F.col("_sum") <= cap_m2)).select("small", F.col("large").alias("into"), "ta"), "admitted")
        if not now.limit(1).count():
            return done
        done = done.unionByName(now.select("small", "into"))
        grown = now.groupBy(F.col("into").alias("large")).agg(F.sum("ta").alias("_more"))
        claims = claims.join(now.select("small"), "small", "left_anti").join(grown, "large", "left")
        claims = cut_lineage(claims.withColumn("tb", F.col("tb") + F.coalesce("_more", F.lit(0.0))).drop("_more"), "claims")


def polygonize(cells: DataFrame, spec: GridSpec, value: str, connectivity: int = 4) -> tuple[DataFrame, DataFrame]:
    """Regions (label, value, cells, area_m2, bounding box) and memberships."""
    parts = connected(cells, spec, value, connectivity)
    regions = parts.groupBy("label").agg(
        F.first("value").alias("value"), F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * spec.cell_area).alias("area_m2"),
        F.min("r").alias("r_min"), F.max("r").alias("r_max"), F.min("c").alias("c_min"), F.max("c").alias("c_max"),
    )
    return regions, parts


def in_order(regions: DataFrame) -> DataFrame:
    """Regions by label, so that those equal in area come in one order."""
    return regions.orderBy("label")


# Sides of a cell, clockwise from the upper one: the way it goes, and where it ends.
HEADING = ((0, 1), (1, 0), (0, -1), (-1, 0))
ENDS = ((0, 1), (1, 1), (1, 0), (0, 0))


def _chains(label: np.ndarray, own: np.ndarray, first: tuple[int, int], width: int, text) -> list[tuple]:
    """(label, entry, exit, points) of borders within a tile: label is an array
    of a tile and a cell around it, -1 where there is no region; own marks the
    tile's cells. Regions lie to the right. Where a border leaves the tile, exit
    is the number of the side it goes on with; a ring that stays has none."""
    rows, cols = label.shape
    flat, mine = label.ravel(), own.ravel()
    at = np.flatnonzero(mine & (flat >= 0))
    there, after = np.zeros(flat.size * 4, dtype=bool), np.zeros(flat.size * 4, dtype=np.int64)
    for s, (dr, dc) in enumerate(HEADING):
        ahead, left = dr * cols + dc, -dc * cols + dr
        side = at * 4 + s
        there[side] = flat[at + left] != flat[at]
        on, turn_left = flat[at + ahead] == flat[at], flat[at + ahead + left] == flat[at]
        # To the right at a corner where regions touch themselves.
        after[side] = np.where(~on, at * 4 + (s + 1) % 4, np.where(turn_left, (at + ahead + left) * 4 + (s + 3) % 4, (at + ahead) * 4 + s))
    sides = np.flatnonzero(there)
    inner = mine[after[sides] // 4]
    entered = np.zeros(there.size, dtype=bool)
    entered[after[sides[inner]]] = True
    todo, nxt, stays = there.tolist(), after.tolist(), mine.tolist()
    number = lambda i: ((first[0] + i // 4 // cols) * width + first[1] + i // 4 % cols) * 4 + i % 4
    out = []
    for start in [*sides[~entered[sides]].tolist(), *sides.tolist()]:
        if not todo[start]:
            continue
        i, points, leaves = start, [], None
        while True:
            todo[i] = False
            j = nxt[i]
            if j % 4 != i % 4:
                dr, dc = ENDS[i % 4]
                points.append(text(first[0] + i // 4 // cols + dr, first[1] + i // 4 % cols + dc))
            if not stays[j // 4]:
                leaves = number(j)
                break
            if j == start:
                break
            i = j
        out.append((int(flat[start // 4]), number(start), leaves, points))
    return out


def _rings(chains: DataFrame) -> DataFrame:
    """label, ring, place, points: chains (entry, exit) that go on into each
    other, in order. Pointers that double their reach find each ring's least
    entry, then each chain's distance from the ring's end: as many rounds as
    the logarithm of the longest ring's number of chains."""
    alone = chains.where("exit is null").select("label", F.col("entry").alias("ring"), F.lit(0).cast("long").alias("place"), "points")
    links = chains.where("exit is not null")
    t = cut_lineage(links.select("entry", F.col("exit").alias("next"), F.col("entry").alias("ring")), "links")
    while True:
        q = t.select(F.col("entry").alias("next"), F.col("next").alias("_n"), F.col("ring").alias("_r"))
        t = cut_lineage(t.join(q, "next").select("entry", F.col("_n").alias("next"), F.least("ring", "_r").alias("ring"), (F.col("_r") < F.col("ring")).alias("_less")), "links")
        if not t.where("_less").limit(1).count():
            break
        t = t.drop("_less")
    links = cut_lineage(links.join(t.select("entry", "ring"), "entry"), "rings")
    t = cut_lineage(links.select("entry", F.when(F.col("exit") != F.col("ring"), F.col("exit")).alias("next"), F.lit(1).cast("long").alias("left")), "places")
    while t.where("next is not null").limit(1).count():
        q = t.select(F.col("entry").alias("next"), F.col("next").alias("_n"), F.col("left").alias("_l"))
        t = cut_lineage(t.join(q, "next", "left").select("entry", F.col("_n").alias("next"), (F.col("left") + F.coalesce("_l", F.lit(0))).alias("left")), "places")
    return links.join(t.select("entry", (-F.col("left")).alias("place")), "entry").select("label", "ring", "place", "points").unionByName(alone)


def outlines(members: DataFrame, spec: GridSpec, tile: int = TILE) -> DataFrame:
    """label, wkt: each region's rings along cell sides, outer ones and holes,
    the region to the right. Tiles trace what of a border is in them, pieces
    are put in order by list ranking; only a region's text is one value."""
    workers_see(members.sparkSession)
    width, cell, x0, y0 = spec.width, spec.cell, spec.x0, spec.y0
    near = lambda a: F.array_distinct(F.array(*[F.floor((F.col(a) + d) / tile) for d in (-1, 0, 1)]))
    x = members.select(*[F.col(k).cast("long").alias(k) for k in ("r", "c", "label")]).withColumn("tr", F.explode(near("r"))).withColumn("tc", F.explode(near("c")))

    def run(key, table):
        tr, tc = (k.as_py() for k in key)
        r, c, v = (table.column(n).to_numpy() for n in ("r", "c", "label"))
        first = tr * tile - 1, tc * tile - 1
        label = np.full((tile + 2, tile + 2), -1, dtype=np.int64)
        label[r - first[0], c - first[1]] = v
        own = np.zeros(label.shape, dtype=bool)
        own[1:-1, 1:-1] = True
        rows = _chains(label, own, first, width, lambda a, b: f"{x0 + b * cell:.12g} {y0 - a * cell:.12g}")
        names = ("label", "entry", "exit", "points")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
        return pa.table({n: pa.array([q[k] for q in rows], kind) for k, (n, kind) in enumerate(zip(names, kinds, strict=True))})

    chains = cut_lineage(x.groupBy("tr", "tc").applyInArrow(run, "label long, entry long, exit long, points array<string>"), "chains")
    rings = _rings(chains).groupBy("label", "ring").agg(F.sort_array(F.collect_list(F.struct("place", "points"))).alias("_p"))
    rings = rings.withColumn("_p", F.flatten(F.transform("_p", lambda q: q.points)))
    text = F.concat(F.lit("("), F.array_join(F.concat("_p", F.slice("_p", 1, 1)), ", "), F.lit(")"))
    whole = rings.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("ring", text.alias("text")))).alias("_t"))
    return whole.select("label", F.concat(F.lit("POLYGON ("), F.array_join(F.transform("_t", lambda q: q.text), ", "), F.lit(")")).alias("wkt"))


def spans(layer: DataFrame, spec: GridSpec) -> DataFrame:
    """id, r, c0, c1: runs of cells whose centres are inside a shape, from
    layer (id, rings of (x, y)); a point is inside where it is inside an odd
    number of rings. Each edge goes to the rows whose middle it crosses; along a
    row, what lies between the first and second crossing is inside, and so on:
    no cell is tested against an edge, whatever the number of shapes."""
    edges = layer.select("id", F.explode("rings").alias("ring")).select("id", F.posexplode("ring").alias("k", "a"), "ring")
    after = F.element_at("ring", F.when(F.col("k") + 1 < F.size("ring"), F.col("k") + 2).otherwise(1))
    x = edges.select("id", *[p[i].alias(n) for p, n2 in ((F.col("a"), ("ax", "ay")), (after, ("bx", "by"))) for i, n in enumerate(n2)]).where("ay <> by")
    row = lambda y: F.floor((F.lit(spec.y0) - y) / spec.cell - 0.5)
    r0, r1 = F.greatest(row(F.greatest("ay", "by")) + 1, F.lit(0)), F.least(row(F.least("ay", "by")), F.lit(spec.height - 1))
    x = x.withColumns({"_r0": r0, "_r1": r1}).where("_r0 <= _r1").withColumn("r", F.explode(F.sequence("_r0", "_r1")))
    x = x.withColumn("x", (F.col("bx") - F.col("ax")) * (spec.y() - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax"))
    line = Window.partitionBy("id", "r").orderBy("x")
    x = x.select("id", "r", "x", F.row_number().over(line).alias("_k"), F.lead("x").over(line).alias("_to")).where("_k % 2 = 1")
    column = lambda v: F.ceil((v - spec.x0) / spec.cell - 0.5)
    c0, c1 = F.greatest(column(F.col("x")), F.lit(0)), F.least(column(F.col("_to")) - 1, F.lit(spec.width - 1))
    return x.select("id", "r", c0.alias("c0"), c1.alias("c1")).where("c0 <= c1")


def rasterize(cells: DataFrame, spec: GridSpec, shapes: list[tuple[list[tuple[float, float]], object]] | DataFrame, out: str = "burned", kind: str = "long") -> DataFrame:
    """Value of the last shape that holds a cell's centre. shapes: a table of
    id (their order), rings and value, or a list of (ring, value); there a shape
    is a ring of (x, y), or several."""
    if not isinstance(shapes, DataFrame):
        several = lambda s: [s] if np.isscalar(s[0][0]) else s
        rows = [(k, [[[float(v) for v in p[:2]] for p in ring] for ring in several(s)], v) for k, (s, v) in enumerate(shapes)]
        shapes = cells.sparkSession.createDataFrame(rows, f"id long, rings array<array<array<double>>>, value {kind}")
    at = spans(shapes.select("id", "rings"), spec).join(shapes.select("id", F.col("value").alias("_v")), "id")
    at = at.withColumn("c", F.explode(F.sequence("c0", "c1"))).groupBy("r", "c").agg(F.max_by("_v", "id").alias(out))
    return cells.join(at, ["r", "c"], "left")


def clip_to(cells: DataFrame, mask: DataFrame, reindex: bool = False) -> DataFrame:
    """Cells of a mask (r, c); with reindex, rows and columns from 0."""
    x = cells.join(mask.select("r", "c"), ["r", "c"], "left_semi")
    if not reindex:
        return x
    ends = mask.agg(F.min("r").alias("_r0"), F.min("c").alias("_c0"))
    return x.crossJoin(F.broadcast(ends)).withColumns({"r": F.col("r") - F.col("_r0"), "c": F.col("c") - F.col("_c0")}).drop("_r0", "_c0")


def uncovered(cells: DataFrame, labels: DataFrame, spec: GridSpec) -> DataFrame:
    """Cells without label, as new 4-connected regions: each one's label is its
    least cell's number after the largest label."""
    rest = cells.join(labels.select("r", "c"), ["r", "c"], "left_anti")
    top = labels.agg(F.coalesce(F.max("label"), F.lit(0)).alias("_top"))
    return connected(rest, spec, None, 4).crossJoin(F.broadcast(top)).select("r", "c", (F.col("_top") + F.col("label") + 1).alias("label"))  # one row
