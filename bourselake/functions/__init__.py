"""Column builders shared by all operators."""
from bourselake.functions.columns import (  # noqa: F401
    avg_full, bands, bool_int, clamp, interp, lagged, norm_cdf, norm_pdf, r2, r4, r6, running,
    safe_div, stddev_full, sum_full, trailing, with_moving_z, yes,
)
