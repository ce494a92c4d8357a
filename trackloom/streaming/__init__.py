"""Live forms of the track operators, on Structured Streaming."""

from .flow import field_slices, starts_per_minute, track_sessions, trail_windows
from .pending import PendingPredictions, bridge_live

__all__ = ["PendingPredictions", "bridge_live", "field_slices", "starts_per_minute", "track_sessions", "trail_windows"]
