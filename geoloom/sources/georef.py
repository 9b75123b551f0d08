"""Georeferencing of images from text files beside them: world files and projection files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How far from 0 the terms of rotation may be, and the largest projection file that is read.
MOST_ROTATION, MOST_CHARS = 1e-9, 64 * 1024


def world_file(text: Column) -> Column:
    """Six numbers of a world file as a struct: pixel sizes px and py, the corner's west and north, and ``error`` where
    there are fewer numbers, a rotation, or sizes that are none. Words that are no numbers are passed over."""
    v = F.filter(F.transform(F.split(F.trim(text), r"\s+"), lambda w: w.try_cast("double")), lambda x: x.isNotNull())
    a, d, b, e, c, f = (F.get(v, F.lit(i)) for i in range(6))
    whole = lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    good = whole(a) & whole(e) & (a > 0) & (-e > 0)
    error = F.when(F.size(v) < 6, "too_few_numbers").when((F.abs(b) > MOST_ROTATION) | (F.abs(d) > MOST_ROTATION), "rotated").when(~F.coalesce(good, F.lit(False)), "bad_pixel_size")
    ok = error.isNull()
    return F.struct(F.when(ok, a).alias("px"), F.when(ok, -e).alias("py"), F.when(ok, c - a / 2).alias("west"), F.when(ok, f - e / 2).alias("north"), error.alias("error"))


def projection_of(wkt: Column) -> Column:
    """The projection that a .prj file means: 3857, 4326, or null for others and for files that are too long."""
    s = F.lower(wkt)
    web = s.contains("web_mercator") | s.contains("3857")
    return F.when(F.char_length(wkt) > MOST_CHARS, None).when(web, 3857).when(s.contains("geogcs") & ~s.contains("projcs"), 4326)


def geo_keys(model: Column, geographic: Column, projected: Column) -> Column:
    """The same from the keys of a GeoTIFF: a geographic model is 4326, a projected one 3857 by its code; 0 means absent."""
    return F.when((model == 1) | ((model == 0) & (geographic == 4326)), 4326).when(projected.isin(3857, 900913), 3857)


def read_georefs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per world file below ``folder``: name (without ending), px, py, west, north, error, epsg of the projection
    file beside it."""
    read = lambda glob: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder, wholetext=True).select(F.regexp_replace(F.input_file_name(), r"\.[^.]*$", "").alias("name"), "value")
    world = read("*.tfw").select("name", world_file(F.col("value")).alias("w")).select("name", "w.*")
    return world.join(read("*.prj").select("name", projection_of(F.col("value")).alias("epsg")), "name", "left")
