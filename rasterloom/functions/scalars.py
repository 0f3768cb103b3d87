"""Column expressions shared by the operators; all of them stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name patterns of frames confirmed to contain nothing to find.
CLEAN_SPECIMENS = ("b3_amb", "B2_amb_mosaic_2", "B2_2_1_lbf", "B2_2_9_lbf", "b3_3_18lbf",
                   "wrought_316L_fatigue_0_cycles")
# Name patterns of the reference specimens.
REFERENCE_SPECIMENS = ("333_75", "336_25", "338_13", "343_75")


def r6(c: Column | str) -> Column:
    """Six decimals, the precision at which doubles are compared across engines."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def clip(c: Column, lo, hi) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def stretch(v: Column, lo: Column, hi: Column, vmin: Column, vmax: Column) -> Column:
    """Percentile stretch to [0, 1]; a degenerate window falls back to the full range."""
    flat = hi <= lo
    a, b = F.when(flat, vmin).otherwise(lo), F.when(flat, vmax).otherwise(hi)
    return clip((v - a) / F.greatest(b - a, F.lit(1e-8)), 0.0, 1.0)


def to_byte(v: Column, lo, hi) -> Column:
    """Clip-scale to 0..255, truncating."""
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.floor(clip((v - lo) / (hi - lo + 1e-9), 0.0, 1.0) * 255).cast("int")


def smoothstep(x: Column) -> Column:
    t = clip(x, 0.0, 1.0)
    return t * t * (F.lit(3.0) - F.lit(2.0) * t)


def soft_knee(ratio: Column, knee_lo: float, knee_hi: float, lo: float = 0.1, hi: float = 10.0) -> Column:
    """Correction factor: none below the lower knee, the full ratio above the upper one."""
    from math import log

    log_ratio = F.ln(clip(ratio, lo, hi))
    ramp = max(log(knee_hi) - log(knee_lo), 1e-9)
    weight = smoothstep((F.abs(log_ratio) - F.lit(log(knee_lo))) / F.lit(ramp))
    return clip(F.exp(weight * log_ratio), lo, hi)


def edge_margin_weight(y: Column, x: Column, height: Column, width: Column, margin: int) -> Column:
    """1 on the frame edge, fading to 0 at ``margin`` pixels inside."""
    distance = F.least(y, height - 1 - y, x, width - 1 - x)
    return F.lit(1.0) - smoothstep(distance / F.lit(float(max(1, int(margin)))))


def inside_border(y: Column, x: Column, height: Column, width: Column, margin: int) -> Column:
    return (y >= margin) & (y < height - margin) & (x >= margin) & (x < width - margin)


def stem(name: Column) -> Column:
    """File name without folders and extension."""
    return F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(.)\.[^.]*$", "$1")


def slug(name: Column) -> Column:
    kept = F.substring(F.regexp_replace(stem(name), r"[^\p{L}\p{N}_-]", "_"), 1, 80)
    return F.when(kept == "", "image").otherwise(kept)


def content_id(name: Column, content: Column) -> Column:
    """Slug plus eight hex digits of the content's sha1."""
    return F.concat(slug(name), F.lit("__"), F.substring(F.sha1(content), 1, 8))


def valid_id(ident: Column) -> Column:
    return ident.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,160}$") & ~ident.contains("..")


def contains_any(name: Column, patterns, ignore_case: bool = True) -> Column:
    hay = F.lower(name) if ignore_case else name
    hit = F.lit(False)
    for p in patterns:
        hit = hit | hay.contains(p.lower() if ignore_case else p)
    return F.coalesce(hit, F.lit(False))


def iou(tp: Column, fp: Column, fn: Column, empty=None) -> Column:
    """Intersection over union; ``empty`` is the value for an empty union, which callers must choose."""
    union = tp + fp + fn
    return F.when(union > 0, tp / union).otherwise(F.lit(empty).cast("double"))


def ratio_or_zero(num: Column, den: Column) -> Column:
    """num / max(den, 1), the form used by every fold table."""
    return num / F.greatest(den, F.lit(1))
