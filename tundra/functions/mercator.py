"""Spherical Mercator coordinates and a pixel grid as Column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def deg_to_rad(d: Column) -> Column:
    return F.radians(d)


def rad_to_deg(r: Column) -> Column:
    return F.degrees(r)


def rad_to_y(r: Column) -> Column:
    return F.ln(F.tan(F.lit(math.pi / 4) + r / 2))


def deg_to_y(d: Column) -> Column:
    return rad_to_y(F.radians(d))


def y_to_rad(y: Column) -> Column:
    return F.atan(F.exp(y)) * 2 - F.lit(math.pi / 2)


def y_to_deg(y: Column) -> Column:
    return F.degrees(y_to_rad(y))


@dataclass(frozen=True)
class Grid:
    """Pixels over an extent in degrees; y counts from the top."""

    min_lon: float
    min_lat: float
    max_lon: float
    max_lat: float
    res_x: int
    res_y: int

    @classmethod
    def over(cls, extent: tuple[float, float, float, float], resolution: tuple[float, float]) -> Grid:
        return cls(*extent, round(resolution[0]), round(resolution[1]))

    @staticmethod
    def _y(lat: float) -> float:
        return math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))

    def _step(self) -> tuple[float, float]:
        y0, y1 = self._y(self.min_lat), self._y(self.max_lat)
        return y0, (y1 - y0) / self.res_y

    @property
    def _width(self) -> float:
        return (self.max_lon - self.min_lon) / self.res_x

    def which_pixel(self, lon: Column, lat: Column) -> Column:
        """(px, py). Positions below zero step down by one before truncation, exact negative integers too."""
        y0, step = self._step()
        whole = lambda v: F.when(v < 0, v - 1).otherwise(v).cast("int")
        x, y = (lon - F.lit(self.min_lon)) / F.lit(self._width), (deg_to_y(lat) - F.lit(y0)) / F.lit(step)
        return F.struct(whole(x).alias("px"), (F.lit(self.res_y) - whole(y) - 1).alias("py"))

    def pixel_to_deg(self, px: Column, py: Column) -> Column:
        """(lon, lat) of a pixel by formula."""
        y0, step = self._step()
        return F.struct((F.lit(self.min_lon) + px * F.lit(self._width)).alias("lon"), y_to_deg(F.lit(y0) + (F.lit(self.res_y - 1) - py) * F.lit(step)).alias("lat"))

    def latitudes(self) -> Column:
        """Latitude of every pixel row from the bottom, by adding the row height again and again."""
        y, step = self._step()
        out = []
        for _ in range(self.res_y + 1):
            out.append(math.degrees(2 * math.atan(math.exp(y)) - math.pi / 2))
            y += step
        return F.array(*map(F.lit, out))

    def pixel_to_deg_table(self, px: Column, py: Column) -> Column:
        """The same through the table of row latitudes; null outside the grid."""
        row = (F.lit(self.res_y) - py).cast("int")
        return F.struct((F.lit(self.min_lon) + px * F.lit(self._width)).alias("lon"), F.when((row > 0) & (row <= self.res_y + 1), F.element_at(self.latitudes(), row)).alias("lat"))
