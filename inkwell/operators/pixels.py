"""Masks and colours of page images as rows of pixels (r, g, b from 0 to 255)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def near_gray(r: Column, g: Column, b: Column, gap: int | None) -> Column:
    return F.lit(True) if gap is None else F.greatest(r, g, b) - F.least(r, g, b) <= gap


def mask(r: Column, g: Column, b: Column, mode: str, threshold: int, channels: str = "RGB") -> Column:
    """'white': each of the channels at least the threshold; 'black': each at most.  No channels stand for all."""
    own = [c for name, c in zip("RGB", (r, g, b)) if name in (channels or "RGB")]
    if mode not in ("white", "black") or not own:
        raise ValueError(f"unknown mode {mode} or channels {channels}")
    signs = [c >= threshold if mode == "white" else c <= threshold for c in own]
    return reduce(Column.__and__, signs)


def masked(r: Column, g: Column, b: Column, mode: str, threshold: int, colour: tuple[int, int, int] = (255, 255, 255), channels: str = "RGB") -> list[Column]:
    """The pixels of a mask set to one colour."""
    chosen = mask(r, g, b, mode, threshold, channels)
    return [F.when(chosen, F.lit(value)).otherwise(c) for value, c in zip(colour, (r, g, b))]


def enhanced(r: Column, g: Column, b: Column, mode: str, threshold: int, boost: int, scale: float, gap: int | None) -> list[Column]:
    """The wanted pixels boosted towards white or black, all others scaled; clipped, then truncated."""
    chosen = mask(r, g, b, mode, threshold) & near_gray(r, g, b, gap)
    sign = boost if mode == "white" else -boost
    clip = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)).cast("int")
    return [F.when(chosen, clip((c + sign).cast("double"))).otherwise(clip(c.cast("double") * scale)) for c in (r, g, b)]


def inverted(r: Column, g: Column, b: Column) -> list[Column]:
    return [255 - c for c in (r, g, b)]


def background(pixels: DataFrame, page: str) -> DataFrame:
    """(page, mean, background): white from a mean of 128."""
    mean = F.avg((F.col("r") + F.col("g") + F.col("b")) / 3)
    return pixels.groupBy(page).agg(F.round(mean, 6).alias("mean"), F.when(F.round(mean, 6) >= 128, "white").otherwise("black").alias("background"))


def gray_text(r: Column, g: Column, b: Column) -> list[Column]:
    """Dark pages, printed text: whatever isn't gray turns black, light gray is boosted, then all is inverted."""
    first = enhanced(r, g, b, "white", 80, 0, 0.0, 20)
    return inverted(*enhanced(*first, "white", 200, 30, 0.3, None))


def white_text(r: Column, g: Column, b: Column) -> list[Column]:
    """Dark pages, white text: all but white turns black, then all is inverted."""
    return inverted(*enhanced(r, g, b, "white", 200, 0, 0.0, None))


def handwriting(r: Column, g: Column, b: Column) -> list[Column]:
    """Coloured notes as black on white: gray turns white, then whatever isn't pure white in some channel turns black."""
    c = enhanced(r, g, b, "white", 0, 255, 1.0, 20)
    for channel in "RGB":
        c = masked(*c, "black", 254, (0, 0, 0), channel)
    return c


def printed(r: Column, g: Column, b: Column) -> list[Column]:
    """White pages, printed text: whatever is light in some channel turns white."""
    c = [r, g, b]
    for channel in "RGB":
        c = masked(*c, "white", 200, (255, 255, 255), channel)
    return c


#: The variants of a page by the kind of page and of writing.
VARIANTS = {"02U_invert": gray_text, "02L_invert": white_text, "11_color2black": handwriting, "51_color_filter": printed}
