"""Shapes, pads and symbol layout as column arithmetic and grouped aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..sources.shared import staged
from . import ordered

GRID = 2.54


def in_unit(unit: Column, selected: int) -> Column:
    """Shared items (unit 0) and those of the selected unit are shown."""
    return F.coalesce(unit, F.lit(0)).isin(0, selected)


def drawn(tag: Column, layer: Column) -> Column:
    """Footprint shapes that are drawn: text always, others on eight layers."""
    return (tag == "fp_text") | (tag.isin(L.FOOTPRINT_SHAPES) & layer.isin(L.DRAWN_LAYERS))


def bounding_boxes(points: DataFrame, keys, owners: DataFrame | None = None) -> DataFrame:
    """Box around points with 15 % padding, two units at least.

    ``owners`` adds the things without any point; their box is 10 x 10 at 0.
    """
    box = points.groupBy(*keys).agg(
        F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"),
        F.max("y").alias("_y1"))
    if owners is not None:
        box = owners.select(*keys).distinct().join(box, list(keys), "left")
    w, h = F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")
    px, py = F.greatest(w * 0.15, F.lit(2.0)), F.greatest(h * 0.15, F.lit(2.0))
    empty = F.col("_x0").isNull()

    def value(c, default):
        return F.when(empty, F.lit(default)).otherwise(c)

    return box.select(
        *keys, value(F.col("_x0") - px, 0.0).alias("box_x"), value(F.col("_y0") - py, 0.0).alias("box_y"),
        value(w + px * 2, 10.0).alias("box_w"), value(h + py * 2, 10.0).alias("box_h"))


def pad_points(pads: DataFrame, keys) -> DataFrame:
    """Corner points of pads ``(x, y, w, h)``."""
    return pads.select(*keys, F.explode(F.array(*[
        F.struct((F.col("x") + s * F.col("w") / 2).alias("x"), (F.col("y") + s * F.col("h") / 2).alias("y"))
        for s in (-1, 1)])).alias("_p")).select(*keys, "_p.x", "_p.y")


def pin_points(pins: DataFrame, keys) -> DataFrame:
    """Base and tip of symbol pins ``(x, y, angle, length)``."""
    rad = F.radians("angle")
    return pins.select(*keys, F.explode(F.array(
        F.struct(F.col("x").alias("x"), F.col("y").alias("y")),
        F.struct((F.col("x") + F.col("length") * F.cos(rad)).alias("x"),
                 (F.col("y") + F.col("length") * F.sin(rad)).alias("y")))).alias("_p")
    ).select(*keys, "_p.x", "_p.y")


def arc_points(arcs: DataFrame, keys) -> DataFrame:
    """Points bounding a three-point arc: the given points and every axis extreme
    of its circle inside the sweep.

    ``arcs`` carries ax, ay (start), bx, by (middle), cx, cy (end).
    """
    ax, ay, bx, by, cx, cy = (F.col(c) for c in ("ax", "ay", "bx", "by", "cx", "cy"))
    d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    work = arcs.withColumn("_d", d).withColumn("_flat", F.abs("_d") < 1e-10)
    safe = F.when(~F.col("_flat"), F.col("_d"))
    qa, qb, qc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    work = work.withColumn("_ux", (qa * (by - cy) + qb * (cy - ay) + qc * (ay - by)) / safe)
    work = work.withColumn("_uy", (qa * (cx - bx) + qb * (ax - cx) + qc * (bx - ax)) / safe)
    ux, uy = F.col("_ux"), F.col("_uy")
    work = (
        work.withColumn("_r", F.sqrt((ax - ux) * (ax - ux) + (ay - uy) * (ay - uy)))
        .withColumn("_from", F.atan2(ay - uy, ax - ux)).withColumn("_to", F.atan2(cy - uy, cx - ux))
        .withColumn("_cw", (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) < 0)
    )

    def sweep(angle: Column) -> Column:
        turn = angle - F.col("_from")
        return F.when(F.col("_cw"), F.when(turn > 0, turn - 2 * math.pi).otherwise(turn)).otherwise(
            F.when(turn < 0, turn + 2 * math.pi).otherwise(turn))

    def inside(angle: float) -> Column:
        at, end = sweep(F.lit(angle)), sweep(F.col("_to"))
        return F.when(F.col("_cw"), at >= end).otherwise(at <= end)

    r = F.col("_r")
    extremes = [(0.0, ux + r, uy), (math.pi / 2, ux, uy + r), (math.pi, ux - r, uy),
                (-math.pi / 2, ux, uy - r)]

    def point(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    points = F.array_compact(F.array(
        point(ax, ay), point(bx, by), point(cx, cy),
        *[F.when(~F.col("_flat") & inside(a), point(x, y)) for a, x, y in extremes]))
    return work.select(*keys, F.explode(points).alias("_p")).select(*keys, "_p.x", "_p.y")


def shape_extents(shapes: DataFrame, listed: DataFrame, keys) -> DataFrame:
    """Points that bound drawn shapes: whole arcs by their sweep, circles by centre and radius, texts by their place.

    ``shapes`` carries start, mid, end, center and at as (x, y) or null, radius and kind, ``listed`` the points
    of shapes that are lists of them, by (file, shape).
    """
    whole = (F.col("kind") == "arc") & F.col("start").isNotNull() & F.col("mid").isNotNull() & F.col("end").isNotNull()
    arcs = shapes.filter(whole).select(*keys, *[F.col(f"{p}.{c}").alias(f"{n}{c}") for p, n in (("start", "a"), ("mid", "b"), ("end", "c")) for c in "xy"])

    def corner(sign):
        r = F.col("radius") * sign
        return F.when(F.col("radius") != 0, F.struct((F.col("center.x") + r).alias("x"), (F.col("center.y") + r).alias("y")))

    single = F.array_compact(F.array(
        *[F.when(~whole, F.col(p)) for p in ("start", "mid", "end")], F.col("at"),
        F.when(F.col("center").isNotNull(), corner(-1)), F.when(F.col("center").isNotNull(), corner(1))))
    points = shapes.select(*keys, F.explode(single).alias("_p")).select(*keys, "_p.x", "_p.y")
    lists = shapes.select(*dict.fromkeys([*keys, "file", "shape"])).join(listed, ["file", "shape"]).select(*keys, "x", "y")
    return points.unionByName(arc_points(arcs, keys)).unionByName(lists)


def thermal_pads(pads: DataFrame, keys) -> DataFrame:
    """Pads marked as heat sinks, or copper without paste larger than 1 x 1.

    ``pads(number, heatsink, layers, w, h)`` with layer names separated by blanks.
    """
    bare = ~F.contains("layers", F.lit("F.Paste")) & F.contains("layers", F.lit("F.Cu"))
    big = (F.col("w") > 1.0) & (F.col("h") > 1.0)
    return pads.filter(F.col("heatsink") | (bare & big)).select(*keys, "number")


def exposed_pads(pads: DataFrame, key: str, weight: Column | None = None) -> DataFrame:
    """Largest pad of a footprint when over three times the upper median area.

    Of areas that differ by rounding errors of their product only, the first pad's counts; ``weight`` is
    another measure by which the greatest one is taken. The median comes from the histogram of areas (value, count), so only distinct
    areas are ordered, block by block.
    """
    area = F.col("w") * F.col("h")
    named = pads.filter("number <> ''").withColumn("_a", area)
    by = F.struct(F.round("_a", 9), -F.col("pad_pos")) if weight is None else weight
    largest = named.groupBy(key).agg(
        F.max_by("number", by).alias("number"),
        F.max("_a").alias("area"), F.count(F.lit(1)).alias("pads"))
    hist = named.groupBy(key, "_a").agg(F.count(F.lit(1)).alias("_n"))
    cum = ordered.running_sum(hist, [key], ["_a"], F.col("_n"), "_cum", F.floor("_a"))
    median = (
        cum.join(largest.select(key, "pads"), key)
        .filter(F.col("_cum") > F.floor(F.col("pads") / 2))
        .groupBy(key).agg(F.min("_a").alias("median_area"))
    )
    floor = F.when(F.col("median_area") == 0, 1.0).otherwise(F.col("median_area"))
    return largest.join(median, key).select(
        key, "pads", "median_area",
        F.when(F.col("area") > floor * 3, F.col("number")).alias("exposed_pad"))


def pad_pin_map(pins: DataFrame, exposed: DataFrame) -> DataFrame:
    """Pad to primary pin: same-name pins share the first one's number, EP is the
    exposed pad.

    ``pins(doc_id, row_pos, number, name)``, ``exposed(doc_id, exposed_pad)``. Pins without a document or a name
    form groups as others do; a pin that has no number claims no pad from one that has.
    """
    first = pins.groupBy(F.col("doc_id").alias("_doc"), F.upper("name").alias("_n")).agg(
        F.min_by("number", "row_pos").alias("primary_pin"))
    named = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.upper("name").eqNullSafe(F.col("_n"))
    mapped = pins.join(first, named).drop("_doc").join(
        exposed.select("doc_id", "exposed_pad"), "doc_id", "left")
    known = lambda order: F.when(F.col("primary_pin").isNotNull(), order)
    own = mapped.select("doc_id", F.lit(0).alias("_late"), "row_pos", F.col("number").alias("pad"), "primary_pin")
    # The first EP pin also claims the real pad, after all others.
    real = mapped.filter("number = 'EP' and exposed_pad is not null").groupBy("doc_id").agg(
        F.lit(1).alias("_late"), F.min("row_pos").alias("row_pos"),
        F.min_by("exposed_pad", "row_pos").alias("pad"),
        F.min_by("primary_pin", known(F.col("row_pos"))).alias("primary_pin"))
    return own.unionByName(real).groupBy("doc_id", "pad").agg(
        F.max_by("primary_pin", known(F.struct("_late", "row_pos"))).alias("primary_pin"))


def stack_same_names(pins: DataFrame, key: str) -> DataFrame:
    """Same-name pins of a symbol move onto the first one's position and angle.

    Pins without a position (null x) stay without one, and so does a group whose
    first pin has none.
    """
    at = F.struct("x", "y", "angle")
    first = pins.groupBy(key, F.upper("name").alias("_n")).agg(F.min_by(at, "pin_pos").alias("_first"))
    moves = F.col("_first.x").isNotNull() & F.col("x").isNotNull()
    return pins.withColumn("_n", F.upper("name")).join(first, [key, "_n"]).withColumn(
        "_at", F.when(moves, F.col("_first")).otherwise(at)).select(
        key, "pin_pos", "number", "name", "_at.x", "_at.y", "_at.angle")


def _side_rank(pins: DataFrame) -> DataFrame:
    return ordered.rank_in(pins, ["doc_id", "side"], ["pin_pos"], "slot",
                           ordered.block_of("pin_pos"))


def layout_grid(pins: DataFrame, alternates: DataFrame | None = None) -> DataFrame:
    """Positions in a newly built symbol: grounds below, outputs right.

    ``pins(doc_id, pin_pos, number, name, pin_type, is_hidden)`` after merging;
    hidden pins sit under the first GND. Pins go 2.54 apart; the box grows with
    the longer side and with the bottom row. Returns x, y, angle and the box.
    ``alternates(doc_id, pin_pos, number)`` are the numbers folded into a shown pin; each
    gets a row of its own at that pin's place.
    """
    ground = (F.col("pin_type") == "power_in") & F.upper("name").isin(L.GROUND_NAMES)
    side = (
        F.when(ground, "bottom").when(F.col("pin_type").isin("power_in", "input"), "left")
        .otherwise("right")
    )
    shown = pins.filter(~F.col("is_hidden")).withColumn("side", side)
    ranked = staged(_side_rank(shown), "ranked-pins")
    per_doc = ranked.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("side") == "left").alias("_l0"), F.count_if(F.col("side") == "right").alias("_r0"),
        F.count_if(F.col("side") == "bottom").alias("bottom_count"))
    # With nothing left or right, the halves of all pins fill both sides as well.
    half = F.floor(F.col("_n") / 2)
    bare = (F.col("_l0") == 0) & (F.col("_r0") == 0)
    per_doc = per_doc.withColumn("left_count", F.when(bare, half).otherwise(F.col("_l0"))).withColumn(
        "right_count", F.when(bare, F.col("_n") - half).otherwise(F.col("_r0"))).withColumn("_bare", bare)
    placed = ranked.join(per_doc, "doc_id")
    first = F.col("slot") <= half
    own, again = F.struct("side", "slot"), F.struct(
        F.when(first, "left").otherwise("right").alias("side"),
        F.when(first, F.col("slot")).otherwise(F.col("slot") - half).cast("int").alias("slot"))
    placed = placed.withColumn("_at", F.explode(F.when(F.col("_bare"), F.array(own, again)).otherwise(F.array(own)))).withColumn(
        "side", F.col("_at.side")).withColumn("slot", F.col("_at.slot")).drop("_at")
    # The first GND of the bottom row is where hidden pins go.
    anchor = ranked.filter("side = 'bottom' and upper(name) = 'GND'").groupBy("doc_id").agg(
        F.min("slot").alias("_gnd"))
    hidden = (
        pins.filter("is_hidden").withColumn("side", F.lit("hidden")).join(per_doc, "doc_id", "left")
        .join(anchor, "doc_id", "left").withColumn("slot", F.col("_gnd")).drop("_gnd")
    )
    every = placed.unionByName(hidden.select(placed.columns))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    bottom = count("bottom_count")
    tallest = F.greatest(count("left_count"), count("right_count"), F.lit(1))
    box_h = tallest * GRID + GRID + F.when(bottom > 0, 5.08).otherwise(0.0)
    box_w = F.greatest(F.lit(15.24), F.when(bottom > 0, bottom * GRID + 5.08).otherwise(0.0))
    every = every.withColumn("box_h", box_h).withColumn("box_w", box_w)
    nth = F.col("slot") - 1
    row_x = F.lit(-GRID) * (bottom - 1) / 2 + nth * GRID
    x = (
        F.when(F.col("side") == "left", -F.col("box_w") / 2 - GRID)
        .when(F.col("side") == "right", F.col("box_w") / 2 + GRID)
        .otherwise(F.coalesce(row_x, F.lit(0.0)))
    )
    y = F.when(F.col("side").isin("left", "right"), F.col("box_h") / 2 - GRID - nth * GRID).otherwise(
        -F.col("box_h") / 2 - GRID)
    angle = F.when(F.col("side") == "left", 0).when(F.col("side") == "right", 180).otherwise(90)
    placed = every.select("doc_id", "pin_pos", "number", "name", "side", x.alias("x"), y.alias("y"),
                          angle.alias("angle"), "box_w", "box_h")
    if alternates is None:
        return placed
    at = staged(placed, "grid")
    folded = at.filter("side <> 'hidden'").drop("number").join(alternates, ["doc_id", "pin_pos"])
    return at.unionByName(folded.select(at.columns))


def layout_preview(pins: DataFrame) -> DataFrame:
    """Positions in a preview symbol: supplies on top, spaced evenly.

    An empty left or right side takes the second half of the other; with neither,
    the top and bottom pins are split over both. ``pins(doc_id, pin_pos, number,
    name, pin_type)`` after merging.
    """
    t = F.col("pin_type")
    first = (
        F.when(t == "power_in", "top").when(t.isin("power_out", "no_connect"), "bottom")
        .when(t.isin("output", "open_collector", "open_emitter"), "right").otherwise("left")
    )
    sided = _side_rank(pins.withColumn("side", first))
    counts = sided.groupBy("doc_id").agg(*[
        F.count_if(F.col("side") == s).alias(f"_{s}") for s in ("left", "right", "top", "bottom")])
    nl, nr, nt, nb = (F.col(f"_{s}") for s in ("left", "right", "top", "bottom"))

    def mid(n):
        return F.floor((n + 1) / 2)

    all_tb = (nl + nr == 0) & (nt + nb > 0)
    # Position among top-then-bottom pins, used when those are split left and right.
    seq = F.when(F.col("side") == "bottom", F.col("slot") + nt).otherwise(F.col("slot"))
    lone_left, lone_right = (nl > 0) & (nr == 0), (nr > 0) & (nl == 0)
    side = (
        F.when(all_tb, F.when(seq <= mid(nt + nb), "left").otherwise("right"))
        .when(lone_left & (F.col("side") == "left") & (F.col("slot") > mid(nl)), "right")
        .when(lone_right & (F.col("side") == "right") & (F.col("slot") > mid(nr)), "left")
        .otherwise(F.col("side"))
    )
    slot = (
        F.when(all_tb, F.when(seq <= mid(nt + nb), seq).otherwise(seq - mid(nt + nb)))
        .when(lone_left & (F.col("side") == "left") & (F.col("slot") > mid(nl)), F.col("slot") - mid(nl))
        .when(lone_right & (F.col("side") == "right") & (F.col("slot") > mid(nr)), F.col("slot") - mid(nr))
        .otherwise(F.col("slot"))
    )
    left = F.when(all_tb, mid(nt + nb)).when(lone_left, mid(nl)).when(lone_right, nr - mid(nr)).otherwise(nl)
    right = F.when(all_tb, nt + nb - mid(nt + nb)).when(lone_left, nl - mid(nl)).when(
        lone_right, mid(nr)).otherwise(nr)
    top, bottom = F.when(all_tb, 0).otherwise(nt), F.when(all_tb, 0).otherwise(nb)
    work = sided.join(counts, "doc_id").select(
        "doc_id", "pin_pos", "number", "name", side.alias("side"), slot.alias("slot"),
        left.alias("_l"), right.alias("_r"), top.alias("_t"), bottom.alias("_b"))
    work = work.withColumn("body_h", F.greatest("_l", "_r", F.lit(1)) * GRID).withColumn(
        "body_w", F.greatest(F.greatest("_t", "_b", F.lit(1)) * GRID, F.lit(10.16)))
    h, w, nth = F.col("body_h"), F.col("body_w"), F.col("slot") - 0.5

    def per(n):
        return nth * (h / F.col(n)) if n in ("_l", "_r") else nth * (w / F.col(n))

    x = (
        F.when(F.col("side") == "left", -w / 2).when(F.col("side") == "right", w / 2)
        .when(F.col("side") == "top", -w / 2 + per("_t")).otherwise(-w / 2 + per("_b"))
    )
    y = (
        F.when(F.col("side") == "left", h / 2 - per("_l")).when(F.col("side") == "right", h / 2 - per("_r"))
        .when(F.col("side") == "top", h / 2).otherwise(-h / 2)
    )
    angle = (
        F.when(F.col("side") == "left", 180).when(F.col("side") == "right", 0)
        .when(F.col("side") == "top", 90).otherwise(270)
    )
    margin = GRID + 5
    return work.select(
        "doc_id", "pin_pos", "number", "name", "side", x.alias("x"), y.alias("y"), angle.alias("angle"),
        (-w / 2 - margin).alias("box_x"), (-h / 2 - margin).alias("box_y"),
        (w + 2 * margin).alias("box_w"), (h + 2 * margin).alias("box_h"))
