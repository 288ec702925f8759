"""Queries on outlines of fields and on regions made larger and smaller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import outlines, regions
from .activity import _unit_rates
from .catalog import LO, WIDTH, grid, named, samples

#: Share of a unit's peak above which a bin belongs to its outline.
SHARE = 0.3


@named(f"""WITH RECURSIVE m AS MATERIALIZED (SELECT unit, ix, iy FROM (SELECT unit, bin_id, round(rate, 9) AS r, max(round(rate, 9)) OVER (PARTITION BY unit) AS top FROM unit_rates) JOIN bins USING (bin_id) WHERE r > {SHARE} * top),
  e AS MATERIALIZED (SELECT unit, ix + s.sx AS x, iy + s.sy AS y, ix + s.ex AS ux, iy + s.ey AS uy, way FROM m
        CROSS JOIN (VALUES (0, 0, 0, 1, 0, 0, -1), (1, 1, 0, 1, 1, 1, 0), (2, 1, 1, 0, 1, 0, 1), (3, 0, 1, 0, 0, -1, 0)) s(way, sx, sy, ex, ey, nx, ny)
        WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.unit = m.unit AND o.ix = m.ix + s.nx AND o.iy = m.iy + s.ny)),
  l AS MATERIALIZED (SELECT e.*, (e.x * 1000 + e.y) * 4 + e.way AS id, (f.x * 1000 + f.y) * 4 + f.way AS nid, f.way AS nway FROM e JOIN e f ON f.unit = e.unit AND f.x = e.ux AND f.y = e.uy
        QUALIFY row_number() OVER (PARTITION BY e.unit, e.x, e.y, e.way ORDER BY CASE WHEN f.way = (e.way + 1) % 4 THEN 0 ELSE 1 END) = 1),
  reach AS (SELECT unit, id, id AS spot FROM l UNION SELECT r.unit, r.id, l.nid FROM reach r JOIN l ON l.unit = r.unit AND l.id = r.spot),
  heads AS (SELECT unit, id, min(spot) AS head FROM reach GROUP BY ALL)
  SELECT unit, (head // 4 // 1000) * 20.0::DOUBLE AS x, (head // 4 % 1000) * 10.0::DOUBLE AS y, sum(x * uy - y * ux) < 0 AS hole, CAST(count(*) FILTER (way <> nway) AS INTEGER) AS n_corners,
         sum(CASE WHEN way % 2 = 0 THEN 20.0 ELSE 10.0 END)::DOUBLE AS length, sum(x * uy - y * ux) * 100.0::DOUBLE AS area
  FROM l JOIN heads USING (unit, id) GROUP BY unit, head""")
def field_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings around the bins where units fire most, holes among them."""
    rates = _unit_rates(spark, sf_dir).withColumn("rate", F.round("rate", 9))
    top = rates.groupBy("unit").agg(F.max("rate").alias("top"))
    mask = rates.join(top, "unit").where(F.col("rate") > SHARE * F.col("top")).join(grid(spark, sf_dir).bins, "bin_id")
    return outlines.outlines(mask, LO, WIDTH, by=("unit",)).drop("verts")


#: A polygon with a notch and a point; and how far they are made to reach.
SHAPES: list[tuple[str, regions.Region]] = [("arm", [(20.0, 10.0), (120.0, 10.0), (120.0, 40.0), (60.0, 40.0), (60.0, 80.0), (20.0, 80.0)]), ("post", (150.0, 60.0))]
REACHES = (-8.0, 5.0, 15.0)


def _buffer_sql() -> str:
    rows = []
    for name, shape in SHAPES:
        verts = [shape] if isinstance(shape, tuple) else shape
        rows += [f"('{name}', {isinstance(shape, tuple)}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(verts, [*verts[1:], verts[0]])]
    t = "CASE WHEN ax = zx AND ay = zy THEN 0.0 ELSE least(1.0, greatest(0.0, ((x - ax) * (zx - ax) + (y - ay) * (zy - ay)) / ((zx - ax) * (zx - ax) + (zy - ay) * (zy - ay)))) END"
    return f"""WITH s(region, point, ax, ay, zx, zy) AS (VALUES {', '.join(rows)}), r(reach) AS (VALUES {', '.join(f'({r}::DOUBLE)' for r in REACHES)}),
  g AS (SELECT region, idx, any_value(point) AS point, min(sqrt(pow(x - ax - along * (zx - ax), 2) + pow(y - ay - along * (zy - ay), 2))) AS gap,
               sum(CASE WHEN (ay > y) <> (zy > y) AND x < (zx - ax) * (y - ay) / (zy - ay) + ax THEN 1 ELSE 0 END) % 2 = 1 AS inside
        FROM (SELECT *, {t} AS along FROM samples CROSS JOIN s WHERE x IS NOT NULL AND y IS NOT NULL) GROUP BY region, idx),
  h AS (SELECT region, reach, CASE WHEN reach < 0 THEN NOT point AND (inside OR gap <= 1e-9) AND gap >= -reach ELSE inside AND NOT point OR gap <= greatest(reach, 1e-9) END AS held FROM g CROSS JOIN r)
  SELECT region, reach, count(*) FILTER (held) AS n FROM h GROUP BY ALL"""


@named(_buffer_sql())
def buffered_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events regions hold when they are made larger or smaller."""
    x, y = F.col("x"), F.col("y")
    held = [F.struct(F.lit(n).alias("region"), F.lit(r).alias("reach"), F.coalesce(regions.buffered(x, y, s, r), F.lit(False)).alias("held")) for n, s in SHAPES for r in REACHES]
    d = samples(spark, sf_dir).select(F.explode(F.array(*held)).alias("h")).select("h.*")
    return d.groupBy("region", "reach").agg(F.count_if("held").alias("n"))
