"""Regular longitude/latitude grids: row 0 is north, cells are as wide as the bounds allow, not as asked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Bounds and the requested resolution; sizes are truncated toward zero."""

    min_lon: float = -0.25
    min_lat: float = -89.75
    max_lon: float = 359.75
    max_lat: float = 90.25
    resolution: float = 0.5

    def __post_init__(self) -> None:
        if not self.resolution > 0:
            raise ValueError("the resolution must be positive")
        if self.width < 1 or self.height < 1:
            raise ValueError("the bounds hold no cell")

    @property
    def width(self) -> int:
        return int((self.max_lon - self.min_lon) / self.resolution)

    @property
    def height(self) -> int:
        return int((self.max_lat - self.min_lat) / self.resolution)

    @property
    def dx(self) -> float:
        return (self.max_lon - self.min_lon) / self.width

    @property
    def dy(self) -> float:
        return (self.max_lat - self.min_lat) / self.height

    @property
    def transform(self) -> tuple[float, float, float, float, float, float]:
        """North-up affine: x = dx * col + min_lon, y = -dy * row + max_lat."""
        return self.dx, 0.0, self.min_lon, 0.0, -self.dy, self.max_lat

    def columns(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.width).select(F.col("id").cast("int").alias("col"), (F.lit(self.min_lon) + (F.col("id") + 0.5) * self.dx).alias("lon"))

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.height).select(F.col("id").cast("int").alias("row"), (F.lit(self.max_lat) - (F.col("id") + 0.5) * self.dy).alias("lat"))

    def box_of(self, row: Column, col: Column) -> dict[str, Column]:
        """Bounds of a cell."""
        x0, y1 = F.lit(self.min_lon) + col * self.dx, F.lit(self.max_lat) - row * self.dy
        return {"x0": x0, "y0": y1 - self.dy, "x1": x0 + self.dx, "y1": y1}

    def centre_of(self, row: Column, col: Column) -> dict[str, Column]:
        return {"lon": F.lit(self.min_lon) + (col + 0.5) * self.dx, "lat": F.lit(self.max_lat) - (row + 0.5) * self.dy}

    def cells(self, spark: SparkSession) -> DataFrame:
        """All cells with bounds and centres, by arithmetic on one range."""
        i = spark.range(self.width * self.height)
        at = i.select(F.expr(f"cast(id div {self.width} as int)").alias("row"), F.expr(f"cast(id % {self.width} as int)").alias("col"))
        return at.withColumns(self.box_of(F.col("row"), F.col("col")) | self.centre_of(F.col("row"), F.col("col")))


def sizes(low: Column, high: Column, resolution: float) -> tuple[Column, Column]:
    """Number and width of the cells between bounds, truncated as in ``Grid``."""
    n = F.floor((high - low) / resolution).cast("int")
    return n, (high - low) / n
