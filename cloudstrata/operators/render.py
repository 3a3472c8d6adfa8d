"""Orthographic depth-buffered projections as tables of pixels."""

from __future__ import annotations

import math
import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cameras by view: where the camera stands and what is up; fixed values.
VIEWS = {"front": ((0.0, -1.0, 0.0), (0.0, 0.0, 1.0)), "side": ((1.0, 0.0, 0.0), (0.0, 0.0, 1.0)), "top": ((0.0, 0.0, 1.0), (0.0, 1.0, 0.0)), "oblique": ((1.0, -1.0, 0.8), (0.0, 0.0, 1.0))}


def _unit(v: tuple) -> tuple:
    n = math.sqrt(sum(c * c for c in v))
    return tuple(c / n for c in v)


def _cross(a: tuple, b: tuple) -> tuple:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def camera_basis(camera: tuple, up: tuple) -> tuple[tuple, tuple, tuple]:
    """Right, up and forward unit vectors."""
    forward = _unit(camera)
    right = _unit(_cross(up, forward))
    return right, _cross(forward, right), forward


def projected(points: DataFrame, views: dict[str, tuple] = VIEWS, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """points once for each view, with u, v and depth along the view's basis."""
    def along(b: tuple):
        terms = [(F.col(a) - F.lit(float(o))) * F.lit(float(c)) for a, o, c in zip("xyz", origin, b, strict=True)]
        return terms[0] + terms[1] + terms[2]

    each = [F.struct(F.lit(n).alias("view"), *[along(b).alias(k) for k, b in zip(("u", "v", "depth"), camera_basis(*v), strict=True)]) for n, v in views.items()]
    return points.withColumn("__p", F.explode(F.array(*each))).select(*points.columns, "__p.*")


def frame(rows: DataFrame, size: int, radius: int, pad: float) -> DataFrame:
    """Of each view over all rows: the centre and pixels per unit, so that all of it fits with padding."""
    box = rows.groupBy("view").agg(*[f(c).alias(f"{n}_{c}") for c in ("u", "v") for n, f in (("min", F.min), ("max", F.max))])
    span = F.greatest(F.col("max_u") - F.col("min_u"), F.col("max_v") - F.col("min_v"), F.lit(1e-9))
    return box.select("view", *[((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2).alias(f"centre_{c}") for c in ("u", "v")], (F.lit((size - 1 - 2 * radius) * (1 - 2 * pad)) / span).alias("scale"))


def pixels(rows: DataFrame, frames: DataFrame, size: int, radius: int, by: list[str] | None = None) -> DataFrame:
    """view, py, px and row_id of the winner of each pixel: the nearest to the camera, ties to the later record. A point covers a disc."""
    by = by or []
    disc = [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]
    at = rows.join(F.broadcast(frames), "view")  # a row for each view
    at = at.withColumns({"__x": F.rint((F.col("u") - F.col("centre_u")) * F.col("scale") + (size - 1) / 2).cast("int"), "__y": F.rint(-(F.col("v") - F.col("centre_v")) * F.col("scale") + (size - 1) / 2).cast("int")})
    # points with one centre cover one disc: the winner among them is enough, and is found before the shuffle
    centre = at.groupBy(*by, "view", "__x", "__y").agg(F.max(F.struct("depth", "row_id")).alias("w"))
    at = centre.select(*by, "view", "__x", "__y", "w.depth", "w.row_id")
    splat = F.explode(F.array(*[F.struct((F.col("__x") + dx).alias("px"), (F.col("__y") + dy).alias("py")) for dx, dy in disc]))
    cells = at.select(*by, "view", "depth", "row_id", splat.alias("c")).select(*by, "view", "c.px", "c.py", "depth", "row_id").filter(f"px between 0 and {size - 1} and py between 0 and {size - 1}")
    return cells.groupBy(*by, "view", "py", "px").agg(F.max(F.struct("depth", "row_id")).alias("w")).select(*by, "view", "py", "px", F.col("w.row_id").alias("row_id"))


def render_metrics(drawn: DataFrame, size: int, by: list[str] | None = None) -> DataFrame:
    """Occupied pixels, their percentage, and distinct visible points, of each view."""
    by = by or []
    return drawn.groupBy(*by, "view").agg(F.count("*").alias("occupied_pixels"), (100.0 * F.count("*") / (size * size)).alias("occupied_percent"), F.countDistinct("row_id").alias("visible_points"))


def eight_bit(c):
    """A colour share as 0 to 255, halves to even."""
    return F.rint(c * 255).cast("int")


def normalised_colour(c, kind: str):
    """A colour as a share: 16-bit and 8-bit values by their greatest; others must be finite shares already, or the row raises an error."""
    if kind in ("uint16", "uint8"):
        return c / (65535.0 if kind == "uint16" else 255.0)
    fits = c.isNotNull() & ~F.isnan(c) & c.between(0.0, 1.0)
    return F.when(fits, c).otherwise(F.raise_error(F.lit("a colour isn't a share from 0 to 1")).cast("double"))


def coloured(drawn: DataFrame, colours: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The pixels of drawn with red, green and blue (0 to 255) of the point that won each; colours: row_id and shares."""
    shares = colours.select("row_id", *[eight_bit(F.col(c)).alias(c) for c in ("red", "green", "blue")])
    return drawn.join(shares, "row_id").select(*(by or []), "view", "py", "px", "row_id", "red", "green", "blue")


def images(pixels_rgb: DataFrame, size: int, background: int = 255) -> DataFrame:
    """view and png of coloured pixels: an image has size x size pixels at most, which bounds a group."""
    def run(pdf):
        import numpy as np
        import pandas as pd

        rgb = np.full((size, size, 3), background, np.uint8)
        rgb[pdf["py"], pdf["px"]] = pdf[["red", "green", "blue"]].to_numpy(np.uint8)
        return pd.DataFrame({"view": [pdf["view"].iloc[0]], "png": [png(size, size, rgb.tobytes())]})

    return pixels_rgb.groupBy("view").applyInPandas(run, "view string, png binary")


def png(width: int, height: int, rgb: bytes) -> bytes:
    """An image file of rows of red, green, blue bytes."""
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = b"".join(b"\0" + rgb[3 * width * y : 3 * width * (y + 1)] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
