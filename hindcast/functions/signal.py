"""Array expressions over loudness envelopes and sample vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def span(rms: Column, step_ms: Column, start_ms: Column, end_ms: Column) -> Column:
    """Envelope steps overlapping ``[start_ms, end_ms)``; a null bound is open."""
    first = F.coalesce(F.floor(start_ms / step_ms), F.lit(0)).cast("int")
    last = F.coalesce(F.ceil(end_ms / step_ms), F.size(rms)).cast("int")
    return F.slice(rms, first + 1, F.greatest(last - first, F.lit(0)))


def share_above(values: Column, theta: float) -> Column:
    """Share of values louder than ``theta``; 0 for an empty span."""
    loud = F.size(F.filter(values, lambda x: x > theta))
    return F.when(F.size(values) > 0, loud / F.size(values)).otherwise(F.lit(0.0))


def mean_squared_error(a: Column, b: Column) -> Column:
    """Null when the lengths differ or there is nothing to compare."""
    squares = F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y))
    total = F.aggregate(squares, F.lit(0.0), lambda acc, s: acc + s)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total / F.size(a))


def psnr(a: Column, b: Column, peak: int = 255) -> Column:
    """Peak signal-to-noise ratio in dB; infinite for equal inputs."""
    mse = mean_squared_error(a, b)
    return (F.when(mse == 0, F.lit(float("inf")))
            .when(mse > 0, F.lit(10.0) * F.log10(F.lit(float(peak * peak)) / mse)))
