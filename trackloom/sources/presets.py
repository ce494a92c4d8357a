"""TPL-01: settings to start a site from, as dictionaries for readers.merged."""

from __future__ import annotations

#: A square or street seen from near: people, cycles and vehicles on one plane.
PLAZA = {"groups": {"people": {}, "cycles": {}, "vehicles": {}}, "field": {"cell_size_m": 1.0, "smooth_m": 1.5}, "cleaning": {"stitch_max_gap_s": 3.0}}
#: Carriageways seen from far: vehicles alone, coarser cells, fields by direction.
MOTORWAY = {"groups": {"vehicles": {"speed_range": [0.0, 45.0]}}, "field": {"cell_size_m": 2.0, "smooth_m": 4.0, "direction_bins": 8}, "cleaning": {"stitch_max_gap_s": 2.0, "drop_passengers": False}}
PRESETS = {"plaza": PLAZA, "motorway": MOTORWAY}
