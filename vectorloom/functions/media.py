"""Column functions on lists of frames and on media paths; decoding is left to a model's own code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Files of a folder that are frames, and paths that are images.
FRAME_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tiff", ".svg")


def sample_frames(frames: Column, k: int, pad: bool = True) -> Column:
    """``k`` frames at even steps from the first to the last; a shorter list is filled up with its last frame, or kept."""
    n = F.size(frames)
    step = F.lit(0.0) if k == 1 else (n - 1) / F.lit(float(k - 1))
    even = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get(frames, F.floor(i * step).cast("int")))
    short = F.concat(frames, F.array_repeat(F.element_at(frames, -1), F.greatest(F.lit(0), k - n))) if pad else frames
    return F.when(n == 0, frames).when(n <= k, short).otherwise(even)


def stride_frames(total: Column, most: int) -> Column:
    """Places of every ``total // most``-th frame, at most ``most`` of them."""
    step = F.greatest(F.lit(1), F.floor(total / most).cast("int"))
    return F.when(total > 0, F.filter(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: i * step), lambda i: i < total)).otherwise(F.array().cast("array<int>"))


def is_image_path(path: Column) -> Column:
    """The extension of a path, or of a URL's path, is an image's."""
    bare = F.when(path.rlike("^https?://"), F.parse_url(path, F.lit("PATH"))).otherwise(path)
    return _extension(bare).isin(*IMAGE_EXTENSIONS)


def is_frame(path: Column) -> Column:
    """A file of a folder of frames."""
    return _extension(path).isin(*FRAME_EXTENSIONS)


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"[^/](\.[^./]*)$", 1))


def is_video_input(frames: Column) -> Column:
    """A list of frames is a video if its first is an image; a single path always is one."""
    return F.coalesce(is_image_path(F.get(frames, F.lit(0))), F.lit(False))


def content(video: Column, image: Column, text: Column) -> Column:
    """Parts of a model's input in the order videos, images, texts; nulls are left out."""
    part = lambda kind, value: F.when(value.isNotNull(), F.struct(F.lit(kind).alias("type"), value.alias("value")))
    return F.filter(F.array(part("video", video), part("image", image), part("text", text)), lambda x: x.isNotNull())
