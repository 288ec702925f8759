"""Tracks as segments (segment, x0, y0, x1, y1), for ``operators.grid.track_bins``."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

Point = tuple[float, float]


def segments(spark: SparkSession, lines: Sequence[tuple[Point, Point]]) -> DataFrame:
    rows = [(k, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for k, (a, b) in enumerate(lines)]
    return spark.createDataFrame(rows, "segment int, x0 double, y0 double, x1 double, y1 double")


def linear(spark: SparkSession, length: float) -> DataFrame:
    return segments(spark, [((0.0, 0.0), (length, 0.0))])


def star(spark: SparkSession, arms: int, length: float) -> DataFrame:
    """Arms of equal length around a center: a plus with four, a radial maze with eight."""
    ends = [(length * math.cos(2 * math.pi * k / arms), length * math.sin(2 * math.pi * k / arms)) for k in range(arms)]
    return segments(spark, [((0.0, 0.0), e) for e in ends])


def t_maze(spark: SparkSession, stem: float, arm: float) -> DataFrame:
    return segments(spark, [((0.0, 0.0), (0.0, stem)), ((0.0, stem), (-arm, stem)), ((0.0, stem), (arm, stem))])


def w_track(spark: SparkSession, width: float, height: float) -> DataFrame:
    return segments(spark, [((x, 0.0), (x, height)) for x in (0.0, width / 2, width)] + [((0.0, 0.0), (width / 2, 0.0)), ((width / 2, 0.0), (width, 0.0))])


def y_maze(spark: SparkSession, arm: float = 50.0) -> DataFrame:
    """Three arms at 120 degrees, one of them straight down."""
    ends = [(arm * math.cos(a), arm * math.sin(a)) for a in (-math.pi / 2, math.pi / 6, 5 * math.pi / 6)]
    return segments(spark, [((0.0, 0.0), e) for e in ends])


def repeated_y(spark: SparkSession, junctions: int = 4, arm: float = 25.0, fork: float = 12.0) -> DataFrame:
    """Y junctions in a row: from each, one prong leads on and the other ends."""
    lines: list[tuple[Point, Point]] = []
    at, side = (0.0, 0.0), 1.0
    for _ in range(junctions):
        joint = (at[0], at[1] + arm)
        on, dead = ((joint[0] + s * fork * math.sin(math.pi / 3), joint[1] + fork * math.cos(math.pi / 3)) for s in (side, -side))
        lines += [(at, joint), (joint, on), (joint, dead)]
        at, side = on, -side
    return segments(spark, lines)


def comb(spark: SparkSession, teeth: int, spacing: float, length: float, bar: float = 0.0) -> DataFrame:
    """Parallel stems along a straight spine, each with a bar of half-width ``bar`` across its end: repeated T junctions."""
    lines: list[tuple[Point, Point]] = [((k * spacing, 0.0), ((k + 1) * spacing, 0.0)) for k in range(teeth - 1)]
    for k in range(teeth):
        x = k * spacing
        lines.append(((x, 0.0), (x, length)))
        lines += [((x, length), (x + s * bar, length)) for s in (-1, 1)] * (bar > 0)
    return segments(spark, lines)


def lattice(spark: SparkSession, columns: int, rows: int, spacing: float) -> DataFrame:
    """Crossing corridors, as in a crossword."""
    lines = [((i * spacing, j * spacing), ((i + 1) * spacing, j * spacing)) for i in range(columns - 1) for j in range(rows)]
    lines += [((i * spacing, j * spacing), (i * spacing, (j + 1) * spacing)) for i in range(columns) for j in range(rows - 1)]
    return segments(spark, lines)


def rings(spark: SparkSession, radii: Sequence[float], spokes: int, corners: int, doors: Sequence[int] = ()) -> DataFrame:
    """Polygons around a center, joined by spokes from each to the next; side ``doors[k]`` of ring k is open.

    Two rings of five corners and five spokes are an arena of inner and outer rings; more of
    them with one spoke and a door each a maze of nested walls.
    """
    at = lambda r, k: (r * math.cos(2 * math.pi * k / corners), r * math.sin(2 * math.pi * k / corners))
    lines = [(at(r, k), at(r, k + 1)) for i, r in enumerate(radii) for k in range(corners) if i >= len(doors) or doors[i] != k]
    lines += [(at(a, k * corners // spokes), at(b, k * corners // spokes)) for a, b in zip(radii, radii[1:]) for k in range(spokes)]
    return segments(spark, lines)


def honeycomb(spark: SparkSession, n_rings: int = 3, spacing: float = 25.0) -> DataFrame:
    """Platforms of a hexagonal lattice and the links between neighbours."""
    nodes = [(q, r) for q in range(-n_rings, n_rings + 1) for r in range(-n_rings, n_rings + 1) if abs(q + r) <= n_rings]
    place = lambda q, r: (spacing * (q + r / 2), spacing * math.sqrt(3) / 2 * r)
    known = set(nodes)
    return segments(spark, [(place(q, r), place(q + a, r + b)) for q, r in nodes for a, b in ((1, 0), (0, 1), (1, -1)) if (q + a, r + b) in known])


def circle(radius: float, center: Point = (0.0, 0.0), sides: int = 64) -> list[Point]:
    """The outline of a round arena, pool or platform."""
    return [(center[0] + radius * math.cos(2 * math.pi * k / sides), center[1] + radius * math.sin(2 * math.pi * k / sides)) for k in range(sides)]


def corridor(a: Point, b: Point, width: float) -> list[Point]:
    """The rectangle of a corridor from a to b."""
    length = math.hypot(b[0] - a[0], b[1] - a[1])
    if length == 0:
        raise ValueError("a corridor's ends have to differ")
    nx, ny = -(b[1] - a[1]) / length * width / 2, (b[0] - a[0]) / length * width / 2
    return [(a[0] + nx, a[1] + ny), (a[0] - nx, a[1] - ny), (b[0] - nx, b[1] - ny), (b[0] + nx, b[1] + ny)]


def watermaze(diameter: float = 150.0, platform: Point = (30.0, 30.0), platform_radius: float = 5.0) -> tuple[list[Point], dict]:
    """A round pool, with the hidden platform and the four quadrants' centers as regions."""
    far = diameter / 4
    quadrants = {f"quadrant_{n}": (a * far, b * far) for n, (a, b) in {"ne": (1, 1), "nw": (-1, 1), "sw": (-1, -1), "se": (1, -1)}.items()}
    return circle(diameter / 2), {"platform": circle(platform_radius, platform), **quadrants}


def barnes(diameter: float = 120.0, holes: int = 18, hole_radius: float = 2.5, escape: int = 0) -> tuple[list[Point], dict]:
    """A round table with holes near its edge, one of which leads out."""
    r = diameter / 2 - 2 * hole_radius
    places = [(r * math.cos(2 * math.pi * k / holes), r * math.sin(2 * math.pi * k / holes)) for k in range(holes)]
    return circle(diameter / 2), {("escape" if k == escape else f"hole_{k}"): circle(hole_radius, p) for k, p in enumerate(places)}


def cheeseboard(diameter: float = 110.0, spacing: float = 9.0, reward_radius: float = 1.5) -> tuple[list[Point], dict]:
    """A round board with wells on a square lattice."""
    n, limit = int(diameter / 2 // spacing), diameter / 2 - reward_radius
    wells = [(i * spacing, j * spacing) for i in range(-n, n + 1) for j in range(-n, n + 1) if math.hypot(i * spacing, j * spacing) <= limit]
    return circle(diameter / 2), {f"well_{k}": p for k, p in enumerate(wells)}


def square(side: float = 30.0) -> list[Point]:
    return [(0.0, 0.0), (side, 0.0), (side, side), (0.0, side)]
