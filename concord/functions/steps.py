"""Arithmetic of step schedules, masks, seeds and frames, as columns and as driver-side parsers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_step_spec(spec: str | int | float) -> tuple[str, float]:
    """("relative", share) for a number with a point or exponent, in (0, 1]; else ("absolute", steps) of at least 1."""
    text = str(spec).strip()
    if re.search(r"[.eE]", text):
        share = float(text)
        if not 0 < share <= 1:
            raise ValueError(f"a relative number of steps must be in (0, 1]: {spec}")
        return "relative", share
    steps = int(text)
    if steps < 1:
        raise ValueError(f"steps must be at least 1: {spec}")
    return "absolute", float(steps)


def steps_for(masked: Column, spec: str | int | float) -> Column:
    """Steps for a sample with so many masked positions: 0 without any; a share is rounded up, to 1 at least."""
    kind, value = parse_step_spec(spec)
    wanted = F.lit(int(value)) if kind == "absolute" else F.greatest(F.lit(1), F.ceil(masked * F.lit(value)).cast("int"))
    return F.when(masked <= 0, F.lit(0)).otherwise(wanted).cast("int")


def mask_size(count: Column, ratio: float) -> Column:
    """Positions to mask of so many: rounded half to even, at least 1 for a positive ratio, at most all."""
    size = F.rint(count * F.lit(float(ratio))).cast("int")
    if ratio > 0:
        size = F.greatest(F.lit(1), size)
    return F.least(size, count.cast("int"))


def align_frames(frames: Column) -> Column:
    """The least 4n + 1 of at least so many frames; 1 for 1 and fewer."""
    return F.when(frames <= 1, F.lit(1)).otherwise((F.ceil((frames - 1) / 4) * 4 + 1).cast("int")).cast("int")


def latent_prefix(frames: Column) -> Column:
    """Latent frames that a prefix of so many frames takes."""
    return (F.floor((frames - 1) / 4) + 1).cast("int")


def run_seed(base: int, index: Column, stride: int, repeat: Column) -> Column:
    return (F.lit(base) + index * F.lit(stride) + repeat).cast("long")


#: How far apart the seeds of two workers of a pathway are.
WORKER_STRIDES = {"text": 1_000_003, "image": 1_000_003, "edit": 1, "video": 1_000_003}


def worker_seed(base: int, rank: int, pathway: str = "text") -> int:
    return base + rank * WORKER_STRIDES[pathway]


def frame_noise(frame: Column, prefix_frames: int, level: float = 1.0, continuation_only: bool = True) -> Column:
    """Noise of a latent frame, from 0: none in those of the prefix if only the continuation is noised."""
    if not continuation_only:
        return F.lit(float(level))
    return F.when(frame < latent_prefix(F.lit(prefix_frames)), F.lit(0.0)).otherwise(F.lit(float(level)))


def denoise_strength(strength: float, level: float, start_step: int | None = None) -> float:
    """The strength of a run: 0 where nothing is noised and no first step is given, so that latents stay as they are."""
    return 0.0 if start_step is None and level <= 0 else float(strength)


def crop_size(width: Column, height: Column, to_width: int, to_height: int) -> tuple[Column, Column]:
    """Width and height, of 1 at least, of the largest centred crop with the proportions of to_width by to_height."""
    ratio = F.lit(float(to_width) / float(to_height))
    narrow = width < height * ratio
    cut = lambda x: F.greatest(F.floor(x), F.lit(1)).cast("int")
    return F.when(narrow, width.cast("int")).otherwise(cut(height * ratio)), F.when(narrow, cut(width / ratio)).otherwise(height.cast("int"))


def parse_image_size(text: str | None) -> tuple[int, int] | None:
    """(width, height) of "WxH", "W*H" or "W,H"; None if it is not of that form."""
    m = re.fullmatch(r"\s*(\d+)\s*[xX*,]\s*(\d+)\s*", text or "")
    return (int(m[1]), int(m[2])) if m else None
