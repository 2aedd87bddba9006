"""Column functions for scores, bands and decay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BAND_ORDER, DISPLAY_BANDS, GRADE_API_FLOOR, GRADE_API_SIGMA, GRADE_API_W, GRADE_S_FLOOR, GRADE_S_SIGMA, GRADE_S_W, RISK_BANDS


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _steps(x: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    out = F.when(x >= steps[0][0], steps[0][1])
    for at, name in steps[1:]:
        out = out.when(x >= at, name)
    return out.otherwise(rest)


def risk_band(x: Column) -> Column:
    """Calibrated band; a null score is calm."""
    return _steps(x, RISK_BANDS, "calm")


def display_band(x: Column) -> Column:
    return _steps(x, DISPLAY_BANDS, "CALM")


def corridor_status(x: Column) -> Column:
    return _steps(F.coalesce(x, F.lit(0.0)), [(0.7, "BLOCKED"), (0.45, "CONTESTED")], "NOMINAL")


def band_rank(band: Column) -> Column:
    return F.array_position(F.array(*[F.lit(b) for b in BAND_ORDER]), band).cast("int") - 1


def gaussian(value: Column, centre: Column, sigma: float, floor: float) -> Column:
    z = (value - centre) / sigma
    return F.lit(floor) + F.lit(1.0 - floor) * F.exp(-0.5 * z * z)


def grade_compatibility(api: Column, sulfur: Column, ref_api: Column, ref_sulfur: Column, known: Column) -> Column:
    """A precomputed value passes through; without a specification the score is neutral."""
    score = F.lit(GRADE_API_W) * gaussian(api, ref_api, GRADE_API_SIGMA, GRADE_API_FLOOR) + F.lit(GRADE_S_W) * gaussian(sulfur, ref_sulfur, GRADE_S_SIGMA, GRADE_S_FLOOR)
    return F.coalesce(known, F.when(ref_api.isNull() | ref_sulfur.isNull(), F.lit(0.5)).otherwise(F.round(clamp(score, 0.0, 1.0), 4)))


def half_life(hours: Column, half: float) -> Column:
    return F.pow(F.lit(0.5), hours / half)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)
