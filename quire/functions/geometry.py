"""Geometry as Column expressions, in 32-bit floats where thresholds are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: points unless named otherwise
AXIS_TOLERANCE = 1.5
MIN_LINE_LENGTH = 15.0
CLUSTER_TOLERANCE = 3.0
TABLE_PADDING = 6.0
PAGE_MARGIN = 1.0
FULL_PAGE_SHARE = 0.7
LONG_SIDE = 2000


def f32(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def on_page(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Both ends inside the page, a margin of one point included."""
    m = f32(PAGE_MARGIN)
    across = x1.between(-m, width + m) & x2.between(-m, width + m)
    return across & y1.between(-m, height + m) & y2.between(-m, height + m)


def is_horizontal(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    long = F.hypot(x2 - x1, y2 - y1).cast("float") >= f32(MIN_LINE_LENGTH)
    return (F.abs(y2 - y1) <= f32(AXIS_TOLERANCE)) & long


def is_vertical(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return is_horizontal(y1, x1, y2, x2)


def in_table_band(y: Column, min_y: Column, max_y: Column, page_height: Column) -> Column:
    """A distance from the page top inside a region's band, padded, ends included."""
    pad = f32(TABLE_PADDING)
    return y.between(page_height - max_y - pad, page_height - min_y + pad)


def is_full_page(scale_x: Column, scale_y: Column, width: Column, height: Column) -> Column:
    share = f32(FULL_PAGE_SHARE)
    return F.coalesce((width > 0) & (height > 0) & (F.abs(scale_x) / width >= share) & (F.abs(scale_y) / height >= share), F.lit(False))


def crop_rect(min_x: Column, min_y: Column, max_x: Column, max_y: Column, page_height: Column, dpi: Column, width: Column, height: Column) -> Column:
    """struct(left, top, right, bottom) in pixels of a rendered page; never empty."""
    scale, pad = (dpi / F.lit(72)).cast("float"), f32(TABLE_PADDING)

    def pixel(x: Column, low: Column, high: Column) -> Column:
        return F.least(F.greatest((x.cast("float") * scale).cast("int"), low), high)

    left = pixel(min_x - pad, F.lit(0), width - 1)
    top = pixel(page_height - max_y - pad, F.lit(0), height - 1)
    return F.struct(
        left.alias("left"),
        top.alias("top"),
        pixel(max_x + pad, left + 1, width).alias("right"),
        pixel(page_height - min_y + pad, top + 1, height).alias("bottom"),
    )


def subsampling(width: Column, height: Column) -> Column:
    """Smallest power of two that brings the longer side down to the limit by whole division."""
    side = F.greatest(width, height)
    powers = F.array(*(F.lit(1 << i) for i in range(31)))
    return F.get(F.filter(powers, lambda f: F.floor(side / f) <= LONG_SIDE), 0)


def orientation(a: Column, b: Column, c: Column, d: Column, width: Column, height: Column) -> Column:
    """struct(m00, m01, m10, m11, dx, dy) that turns an image placed by (a, b, c, d) upright; null where nothing is to be done.

    dx and dy bring the image's centre back to where it was.
    """
    a, b, c, d = map(f32, (a, b, c, d))
    eps = F.greatest(f32(1e-3) * F.greatest(*map(F.abs, (a, b, c, d))), f32(1e-6))
    zero = {k: F.abs(v) < eps for k, v in (("a", a), ("b", b), ("c", c), ("d", d))}
    straight, turned = zero["b"] & zero["c"], zero["a"] & zero["d"]
    nothing = straight & turned

    def pick(plain: Column, quarter: Column) -> Column:
        return F.when(nothing, None).when(straight, plain).when(turned, quarter).cast("float")

    none = F.lit(0.0)
    m00 = pick(F.when(a < 0, -1.0).otherwise(1.0), none)
    m01 = pick(none, -F.signum(c))
    m10 = pick(none, -F.signum(b))
    m11 = pick(F.when(d > 0, 1.0).otherwise(-1.0), none)
    cx, cy = f32(width) / 2, f32(height) / 2
    same = (m00 == 1) & (m01 == 0) & (m10 == 0) & (m11 == 1)
    return F.when(
        ~same,
        F.struct(
            m00.alias("m00"), m01.alias("m01"), m10.alias("m10"), m11.alias("m11"),
            (cx - (m00 * cx + m01 * cy)).cast("float").alias("dx"), (cy - (m10 * cx + m11 * cy)).cast("float").alias("dy"),
        ),
    )


def destination_y(kind: Column, top: Column, page_height: Column) -> Column:
    """Distance from the page top of an XYZ destination; null for other kinds and for a negative top."""
    return F.when((kind == "XYZ") & (top >= 0), page_height - top)


def scrubber_page(fraction: Column, pages: Column) -> Column:
    return (F.floor(F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0)) * (pages - 1) + F.lit(0.5)) + 1).cast("int")


def spacing_of_progress(progress: Column) -> Column:
    return (f32(1.0) + f32(progress) * f32(0.1)).cast("float")


def progress_of_spacing(spacing: Column) -> Column:
    """Truncated, as in 32-bit floats, then held to 0..10."""
    return F.least(F.greatest(((f32(spacing) - f32(1.0)).cast("float") / f32(0.1)).cast("float").cast("int"), F.lit(0)), F.lit(10))
