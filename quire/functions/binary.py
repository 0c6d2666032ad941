"""Image bytes: JPEG component counts, raw samples of any depth, orientation of pixels. Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pixels above which raw samples are not decoded.
MAX_PIXELS = 30_000_000
_ALONE = {0x01, 0xD8, *range(0xD0, 0xD8)}
_FRAMES = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def jpeg_component_count(data: bytes | None) -> int | None:
    """Components named by the frame header; None for anything malformed."""
    if not data or data[:2] != b"\xff\xd8" or len(data) < 4:
        return None
    at = 2
    while at + 1 < len(data) and data[at] == 0xFF:
        marker, at = data[at + 1], at + 2
        if marker in _ALONE:
            continue
        size = int.from_bytes(data[at : at + 2], "big")
        if marker in _FRAMES and at + 7 < len(data):
            return data[at + 7]
        if marker in _FRAMES or marker == 0xD9 or at + 1 >= len(data) or size < 2:
            return None
        at += size
    return None


def jpeg_components(data: Column) -> Column:
    @F.pandas_udf("int")
    def run(blobs: pd.Series) -> pd.Series:
        return pd.Series([jpeg_component_count(None if b is None else bytes(b)) for b in blobs], dtype="Int32")

    return run(data)


def row_bytes(width: Column, components: Column | int, bits: Column) -> Column:
    n = components if isinstance(components, Column) else F.lit(components)
    return F.floor((width.cast("long") * n * bits + 7) / 8)


def inferred_components(width: Column, height: Column, bits: Column, reported: Column, size: Column) -> Column:
    """1 or 3, whichever explains the number of bytes; the reported count is tried first. Null if none does."""
    ok = bits.between(1, 16) & (width > 0) & (height > 0) & (width.cast("long") * height <= MAX_PIXELS)

    def fits(n: int) -> Column:
        return row_bytes(width, n, bits) * height == size

    return F.when(ok & (reported == 3) & fits(3), 3).when(ok & fits(1), 1).when(ok & fits(3), 3)


def decode_route(bits: Column, suffix: Column, factor: Column, components: Column) -> Column:
    """How an image is to be decoded: "raw" for depths other than 1 and 8, "subsampled" for large three-component JPEGs, else "library"."""
    fast = (suffix == "jpg") & (factor > 1) & F.coalesce(components == 3, F.lit(False))
    return F.when(~bits.isin(1, 8), "raw").when(fast, "subsampled").otherwise("library")


def decode_samples(data: bytes, width: int, height: int, bits: int, components: int) -> np.ndarray:
    """Pixels as uint8 (height, width, 3), samples scaled to 0..255 by whole division."""
    per_row = (width * components * bits + 7) // 8
    rows = np.frombuffer(data, np.uint8).reshape(height, per_row)
    flat = np.unpackbits(rows, axis=1)[:, : width * components * bits].reshape(height, width, components, bits)
    value = (flat.astype(np.int64) << np.arange(bits - 1, -1, -1)).sum(axis=3)
    scaled = (value * 255 // ((1 << bits) - 1)).astype(np.uint8)
    return np.repeat(scaled, 3, axis=2) if components == 1 else scaled


def raw_pixels(data: Column, width: Column, height: Column, bits: Column, reported: Column) -> Column:
    """RGB bytes of raw samples, row by row; null where the size explains no component count."""
    components = inferred_components(width, height, bits, reported, F.octet_length(data))

    @F.pandas_udf("binary")
    def run(d: pd.Series, w: pd.Series, h: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(k) else decode_samples(bytes(x), int(i), int(j), int(q), int(k)).tobytes() for x, i, j, q, k in zip(d, w, h, b, n)])

    return run(data, width, height, bits, components)


def oriented_pixels(pixels: Column, width: Column, height: Column, matrix: Column) -> Column:
    """RGB bytes turned by an orientation struct; unchanged where it is null."""

    @F.pandas_udf("binary")
    def run(d: pd.Series, w: pd.Series, h: pd.Series, m: pd.DataFrame) -> pd.Series:
        out = []
        for x, i, j, m00, m01, m10, m11 in zip(d, w, h, m["m00"], m["m01"], m["m10"], m["m11"]):
            if x is None or pd.isna(m00):
                out.append(x)
                continue
            image = np.frombuffer(bytes(x), np.uint8).reshape(int(j), int(i), 3)
            if m00 == 0:
                # x' = m01 * y and y' = m10 * x
                image = image.transpose(1, 0, 2)[:: 1 if m10 > 0 else -1, :: 1 if m01 > 0 else -1]
            else:
                image = image[:: 1 if m11 > 0 else -1, :: 1 if m00 > 0 else -1]
            out.append(np.ascontiguousarray(image).tobytes())
        return pd.Series(out)

    return run(pixels, width, height, matrix)
