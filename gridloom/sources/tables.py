"""Environments, regions and recordings as files, through Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import Grid


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as samples: user as session, seconds as t, value as x and props.k as y."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    y = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("idx"), t.alias("t"), F.col("value").alias("x"), y.alias("y"), "event_type")


def write_grid(grid: Grid, path: str) -> None:
    spark = grid.bins.sparkSession
    grid.bins.write.parquet(f"{path}/bins")
    grid.edges.write.parquet(f"{path}/edges")
    place = [(list(grid.lo), list(grid.width), list(grid.shape))]
    spark.createDataFrame(place, "lo array<double>, width array<double>, shape array<int>").write.json(f"{path}/place")


def read_grid(spark: SparkSession, path: str) -> Grid:
    p = spark.read.schema("lo array<double>, width array<double>, shape array<int>").json(f"{path}/place").first()
    return Grid(spark.read.parquet(f"{path}/bins"), spark.read.parquet(f"{path}/edges"), tuple(p["lo"]), tuple(p["width"]), tuple(p["shape"]))


def write_regions(table: DataFrame, path: str) -> None:
    table.write.json(path)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, kind string, verts array<struct<x: double, y: double>>, area double, x double, y double").json(path)


def read_labelme(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, verts) of the shapes of LabelMe JSON files."""
    schema = "shapes array<struct<label: string, points: array<array<double>>, shape_type: string>>"
    files = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.from_json("value", schema).alias("j"))
    shapes = files.select("path", F.explode("j.shapes").alias("s"))
    verts = F.transform("s.points", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return shapes.select("path", F.col("s.label").alias("name"), verts.alias("verts"))


def read_cvat(spark: SparkSession, path: str) -> DataFrame:
    """(image, name, verts) of the polygons of CVAT XML files, by Spark's XML source."""
    schema = "_name string, polygon array<struct<_label: string, _points: string>>"
    images = spark.read.format("xml").option("rowTag", "image").schema(schema).load(path)
    p = images.select(F.col("_name").alias("image"), F.explode("polygon").alias("p"))
    xy = F.transform(F.split("p._points", ";"), lambda s: F.split(s, ","))
    verts = F.transform(xy, lambda v: F.struct(v[0].cast("double").alias("x"), v[1].cast("double").alias("y")))
    return p.select("image", F.col("p._label").alias("name"), verts.alias("verts"))
