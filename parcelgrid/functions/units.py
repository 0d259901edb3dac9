"""Unit factors. Results depend on these exact numbers."""

SQ_FT_PER_M2 = 10.76391          # parcel areas
SQ_FT_PER_M2_BOUNDARY = 10.7639  # county areas in the boundary table
SQ_FT_PER_ACRE = 43560.0
LB_PER_TON = 2000.0
METRIC_TON_PER_LB = 0.000453592
US_FT_PER_M = 3937.0 / 1200.0
