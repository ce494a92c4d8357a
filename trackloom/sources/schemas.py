"""Schemas of the files that come and go, and the configuration of groups."""

from __future__ import annotations

from dataclasses import dataclass, field


RAW = "track_id long, class string, class_id long, frame long, time_s double, x1 double, y1 double, x2 double, y2 double, confidence double, predicted string"
PRIVACY = "frame long, class string, x1 double, y1 double, x2 double, y2 double"
POINTS = "track_id long, class string, frame long, time_s double, x double, y double, vx double, vy double, speed double, heading double, predicted string, source string, group string, beyond_limit string"
META = "video string, fps double, vid_stride long, start_frame long, end_frame long, width long, height long"
CALIBRATION = "H array<array<double>>, origin array<double>, image_size array<long>, undistorted boolean, w_sign double, reference_frame long, rmse_m double, points array<struct<id: long, u: double, v: double, E: double, N: double, error_m: double, loo_error_m: double, inlier: boolean>>"
LENS = "K array<array<double>>, dist array<double>, size array<long>, rms double"
CLICKS = "u double, v double, E double, N double"
REGISTRATION = "clip string, frame long, m array<double>, inliers long"


@dataclass
class Group:
    """What a group's tracks may do; the fields that a configuration leaves out keep these values."""

    name: str
    classes: list[str]
    speed_range: tuple[float, float] = (0.0, 2.5)
    max_speed: float = 6.0
    jump_tolerance_m: float = 1.0
    stitch_radius_m: float = 1.5
    smooth_window_s: float = 1.0
    min_displacement_m: float = 0.0
    ground_offset_m: float | dict[str, float] = 0.0
    offset_mode: str = "travel"
    vehicle_width_m: float = 1.8
    plane_height_m: float | str = 0.0

    def offset_for(self, cls: str) -> float:
        if isinstance(self.ground_offset_m, dict):
            return float(self.ground_offset_m.get(cls, self.ground_offset_m.get("default", 0.0)))
        return float(self.ground_offset_m)


#: The groups of a configuration that names none.
GROUPS = [
    Group("people", ["person"]),
    Group("cycles", ["bicycle"], (0.0, 10.0), 20.0, 1.5, 2.5, 0.8),
    Group("trains", ["train"], (0.0, 25.0), 35.0, 5.0, 8.0, 1.0, 10.0, plane_height_m="auto"),
    Group("vehicles", ["car", "motorcycle", "bus", "truck"], (0.0, 35.0), 70.0, 3.0, 4.0, 0.6, 5.0, 2.2),
]


@dataclass
class Config:
    """A site's settings: nested values, and its groups checked for known classes that are in one group only."""

    values: dict
    groups: dict[str, Group] = field(default_factory=dict)

    def __getitem__(self, key: str):
        return self.values[key]

    def get(self, key: str, default=None):
        return self.values.get(key, default)

    @property
    def class_to_group(self) -> dict[str, str]:
        return {c: g.name for g in self.groups.values() for c in g.classes}
