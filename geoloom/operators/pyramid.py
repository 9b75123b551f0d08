"""Pyramids of rasters over Morton keys.

A cell's key interleaves the bits of its row and column, so that the four cells under a coarser one share all but their
last two bits: a level is the level below grouped by key prefix. Cells are dealt out once, by the prefix of a block; the
levels within a block then follow without another shuffle, and what is above has one cell a block. Levels are written by
(level, range of keys), so that a reader of a box at one level opens the files of its ranges only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.runtime import materialize

#: Levels that are made within a block of cells after one shuffle, and levels below a range's key: 262,144 cells a file.
BLOCK_LEVELS = RANGE_LEVELS = 9
#: Masks that leave every other bit, pair, nibble, byte and half-word.
_MASKS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(v: Column) -> Column:
    v = v.cast("long")
    for by, mask in _MASKS:
        v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask))
    return v


def _gather(v: Column) -> Column:
    v = v.bitwiseAND(F.lit(_MASKS[-1][1]))
    for (by, _), mask in zip(reversed(_MASKS), [m for _, m in reversed(_MASKS)][1:] + [0xFFFFFFFF]):
        v = v.bitwiseOR(F.shiftright(v, by)).bitwiseAND(F.lit(mask))
    return v


def morton(r: Column, c: Column) -> Column:
    """The key of a cell with row and column from 0 to 2^31 - 1."""
    return F.shiftleft(_spread(r), 1).bitwiseOR(_spread(c))


def _morton(r: int, c: int) -> int:
    return sum((c >> i & 1) << 2 * i | (r >> i & 1) << 2 * i + 1 for i in range(31))


def build(grid: DataFrame, levels: int, height: str = "h", block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """(level, key, r, c, h, n) of levels 0 to ``levels``: h is the mean of the ``n`` cells below with a height, null where
    there are none; a level has every cell that has one below it. ``grid``: r, c from 0, and a height; cells are distinct."""
    key = morton(F.col("r"), F.col("c"))
    base = grid.select(key.alias("key"), F.col(height).cast("double").alias("_sum"), F.when(F.col(height).isNotNull(), 1).otherwise(0).cast("long").alias("n"))
    at = base.withColumn("_block", F.shiftright("key", 2 * block_levels)).repartition("_block")
    out = at.select(F.lit(0).alias("level"), "key", "_sum", "n")
    for level in range(1, levels + 1):
        within = level <= block_levels
        if level == block_levels + 1:
            at = materialize(at.drop("_block"))
        keys = [F.shiftright("key", 2).alias("key"), *([F.col("_block")] if within else [])]
        at = at.groupBy(*keys).agg(F.sum("_sum").alias("_sum"), F.sum("n").alias("n"))
        out = out.unionByName(at.select(F.lit(level).alias("level"), "key", "_sum", "n"))
    mean = F.when(F.col("n") > 0, F.col("_sum") / F.col("n"))
    return out.select("level", "key", _gather(F.shiftright("key", 1)).alias("r"), _gather(F.col("key")).alias("c"), mean.alias("h"), "n")


def write(levels: DataFrame, path: str, range_levels: int = RANGE_LEVELS) -> None:
    """Writes a pyramid by level and range, one file each, sorted by key."""
    ranged = levels.withColumn("range", F.shiftright("key", 2 * range_levels))
    ranged.repartition("level", "range").sortWithinPartitions("level", "range", "key").write.mode("errorifexists").partitionBy("level", "range").parquet(path)


def range_levels_for(side: int, ranges: int = 64, least: int = 0) -> int:
    """The levels below a range's key with which the longer ``side`` of a raster has at most ``ranges`` ranges, up to RANGE_LEVELS:
    files then follow the raster in full ones, not in small ones that cost more to open than to read."""
    return min(RANGE_LEVELS, max(least, (-(-side // ranges) - 1).bit_length()))


def level_for(wanted: float, cell: float, levels: int) -> int:
    """The coarsest level whose cells are at most ``wanted`` wide, or else the finest; level 0 has cells of ``cell``."""
    return max(0, min(levels, math.floor(math.log2(wanted / cell) + 1e-9))) if wanted > 0 else 0


def read_box(spark: SparkSession, path: str, level: int, r0: int, c0: int, r1: int, c1: int, range_levels: int = RANGE_LEVELS) -> DataFrame:
    """The cells of ``level`` in rows r0 to r1 and columns c0 to c1 (both included); only the files of ranges that the box
    touches are opened."""
    r0, c0 = max(r0, 0), max(c0, 0)
    ranges = [_morton(r, c) for r in range(r0 >> range_levels, (r1 >> range_levels) + 1) for c in range(c0 >> range_levels, (c1 >> range_levels) + 1)]
    found = spark.read.schema("key long, r long, c long, h double, n long, level int, range long").parquet(path)
    return found.where((F.col("level") == level) & F.col("range").isin(ranges) & F.col("r").between(r0, r1) & F.col("c").between(c0, c1)).drop("range")
