"""Points within boxes: an equi-join on grid cells, then the exact comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terrano.session import broadcast_within, join_hot, written

#: Degrees of the finest cells; each level's are twice as wide.
FINEST = 1 / 64
#: Boxes up to which their cells are broadcast (about 40 MB).
MAX_BROADCAST_BOXES = 200_000


def _cell(degrees: Column, level: Column) -> Column:
    return F.floor(degrees / (F.lit(FINEST) * F.pow(F.lit(2.0), level))).cast("long")


def within_boxes(points: DataFrame, boxes: DataFrame, lat: str = "latitud", lon: str = "longitud", max_broadcast: int = MAX_BROADCAST_BOXES) -> DataFrame:
    """``points`` with every one of ``boxes`` (box, south, north, west, east; bounds included) that holds them.

    A box lies on the level at which a cell is as wide as it, so it covers four cells there at most; a point looks into its
    own cell of each level that any box is on. Points and boxes meet on level and cell alone, so neither a wide box nor many
    points in one place pair all with all. Boxes whose bounds are null or crossed hold nothing, points without coordinates are in none.
    """
    sound = boxes.where("south <= north and west <= east").select("box", "south", "north", "west", "east")
    width = F.greatest(F.col("north") - F.col("south"), F.col("east") - F.col("west"), F.lit(FINEST))
    leveled = sound.withColumn("_level", F.ceil(F.log2(width / FINEST)).cast("int"))
    across = lambda low, high: F.explode(F.sequence(_cell(F.col(low), F.col("_level")), _cell(F.col(high), F.col("_level"))))
    cells = written(leveled.withColumn("_y", across("south", "north")).withColumn("_x", across("west", "east")), "cells")
    levels = sorted(r[0] for r in cells.select("_level").distinct().collect())  # as many as doublings from the finest cell to the widest box
    placed = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn("_level", F.explode(F.lit(levels).cast("array<int>")))
    placed = placed.withColumn("_y", _cell(F.col(lat), F.col("_level"))).withColumn("_x", _cell(F.col(lon), F.col("_level")))
    met = placed.join(broadcast_within(cells, max_broadcast), ["_level", "_y", "_x"])
    held = F.col(lat).between(F.col("south"), F.col("north")) & F.col(lon).between(F.col("west"), F.col("east"))
    return met.where(held).select(*points.columns, "box")


def count_boxes(points: DataFrame, boxes: DataFrame, lat: str = "latitud", lon: str = "longitud", max_broadcast: int = MAX_BROADCAST_BOXES) -> DataFrame:
    """``points`` that boxes hold, with how many (n), the first and the last of them (first_box, last_box).

    Points of one place are in the same boxes, and boxes of the same bounds hold the same points: each place meets each bounds once,
    so copies of either make no pairs. A place that many points share is joined by broadcast.
    """
    bounds = boxes.groupBy("south", "north", "west", "east").agg(F.count("*").alias("_n"), F.min("box").alias("_first"), F.max("box").alias("_last"))
    classes = bounds.select("south", "north", "west", "east", F.struct("_n", "_first", "_last").alias("box"))
    placed = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn("_place", F.struct(F.col(lat).alias("y"), F.col(lon).alias("x")))
    places = written(placed.groupBy("_place").agg(F.count("*").alias("c")), "places")
    met = within_boxes(places.select("_place", F.col("_place.y").alias(lat), F.col("_place.x").alias(lon)), classes, lat, lon, max_broadcast)
    counted = written(met.groupBy("_place").agg(F.sum("box._n").alias("n"), F.min("box._first").alias("first_box"), F.max("box._last").alias("last_box")), "counted")
    return join_hot(placed, counted, "_place", places).where("n is not null").drop("_place")
