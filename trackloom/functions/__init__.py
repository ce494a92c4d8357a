"""Column expressions shared by the operators: rounding, angles, geometry, lenient parsing."""

from .angles import compass, heading_of, unwrap_step, wrap180
from .geometry import apply_matrix, cross_side, polyline_length, segment_distance
from .values import clip_to, lenient_bool, nan_to_null, ramp, rounded

__all__ = ["apply_matrix", "clip_to", "compass", "cross_side", "heading_of", "lenient_bool", "nan_to_null", "polyline_length", "ramp", "rounded", "segment_distance", "unwrap_step", "wrap180"]
