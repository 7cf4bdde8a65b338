"""Percentiles, MIME types, image scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentile_nearest(x: str | Column, p: float) -> Column:
    """Nearest-rank percentile as an aggregate; ``p`` between 0 and 1, null over nothing."""
    c = F.col(x) if isinstance(x, str) else x
    return F.expr(f"percentile_disc({float(p)}) within group (order by `{x}`)") if isinstance(x, str) else F.get(
        F.array_sort(F.collect_list(c)), F.greatest(F.lit(1), F.ceil(F.lit(p) * F.count(c))).cast("int") - 1
    )


def mime_of_extension(ext: Column) -> Column:
    e = F.lower(F.regexp_replace(ext, r"^\.", ""))
    return F.concat(F.lit("image/"), F.when(e == "jpg", "jpeg").otherwise(e))


def render_scale(width: Column, height: Column, source_width: Column | None = None, floor: float = 2.0, max_pixels: int = 4000) -> Column:
    """Pixels a point for a figure: its own resolution where that is higher, within a ceiling, never below one."""
    scale = F.lit(floor)
    if source_width is not None:
        scale = F.when(F.coalesce(source_width, F.lit(0.0)) > 0, F.greatest(scale, source_width / width)).otherwise(scale)
    longest = F.greatest(width, height)
    return F.greatest(F.lit(1.0), F.when(longest > 0, F.least(scale, max_pixels / longest)).otherwise(scale))
