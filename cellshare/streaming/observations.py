"""Extension: observations that arrive as a stream, averaged by region with the static mask's weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.coverage import to_cells
from ..plans.grid import Grid


def regional_stream(stream: DataFrame, mask: DataFrame, grid: Grid, value: str = "value", time: str = "ts", window: str = "1 hour", late: str = "2 hours", region: str = "region_id") -> DataFrame:
    """Weighted means by region and window: a stream-static join, then a watermarked aggregation."""
    cells = to_cells(stream.withWatermark(time, late), grid)
    both = cells.join(mask, ["row", "col"])
    return both.groupBy(F.window(time, window).alias("w"), region).agg(F.sum("frac").alias("weight"), (F.sum(F.col(value) * F.col("frac")) / F.sum("frac")).alias("mean")).select(F.col("w.start").alias("start"), region, "weight", "mean")
