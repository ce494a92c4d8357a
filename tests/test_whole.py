"""Whole jobs: what lies beyond a bound that an operator once had."""

import json

import numpy as np
import pytest

from trackloom.operators.aggregate import cell_means_filled
from trackloom.operators.ground import filled_terrain


def nearest(cells, i, j):
    return min(((a - i) ** 2 + (b - j) ** 2, a, b, v) for (a, b), v in cells.items())[3]


def test_nearest_fill_has_no_bound(spark):
    rng = np.random.default_rng(3)
    at = {(int(a), int(b)): float(k) for k, (a, b) in enumerate(rng.integers(-300, 300, (40, 2)))}
    at |= {(a, b): 1000.0 + 10 * a + b for a in range(-20, -10) for b in range(5, 15)}
    cells = [("c", a, b, v) for (a, b), v in at.items()] + [("d", 3, 3, 1.0), ("d", 0, 4, 2.0)]
    want = [("c", int(a), int(b)) for a, b in rng.integers(-400, 400, (200, 2))] + [("c", -15, 9), ("c", -21, 9), ("d", 0, 0), ("d", 900, 0), ("e", 0, 0)]
    got = {r[:3]: r[3] for r in cell_means_filled(spark.createDataFrame(cells, "k string, i long, j long, v double"), spark.createDataFrame(want, "k string, i long, j long"), "v", ["k"]).collect()}
    assert set(got) == set(want)
    assert all(got[w] == nearest(at, *w[1:]) for w in want if w[0] == "c")
    assert got["d", 0, 0] == 2.0 and got["d", 900, 0] == 1.0 and got["e", 0, 0] is None


def test_wide_gaps_of_terrain(spark):
    rows = [(r, c, float(c) if c < 3 or c > 40 else None) for r in range(3) for c in range(50)]
    got = {x[:2]: x[2] for x in filled_terrain(spark.createDataFrame(rows, "row long, col long, z double")).collect()}
    assert got[1, 20] == 2.0 and got[1, 30] == 41.0 and len(got) == 150 and None not in got.values()


def test_process_smooths_about_the_camera(spark):
    """A walker far off, whose feet wobble by pixels: the depth gets a longer window, the plain smoothing stays an option."""
    from trackloom.operators.pipeline import Settings, process

    # camera over (0, 0), 5 m up, looking level along y: u = 960 + 1000 x / y, v = 540 + 5000 / y
    h = np.linalg.inv(np.array([[1000.0, 960.0, 0.0], [0.0, 540.0, 5000.0], [0.0, 1.0, 0.0]])).ravel().tolist()
    rows = [("c", 1, "person", f, u - 15, v - 50, u + 15, v, 0.8, False) for f in range(100) for u, v in [(960 + 1000 * (-4 + 0.14 * f) / 40, 540 + 5000 / 40 + (1.0 if f % 7 < 3 else -1.0))]]
    boxes = spark.createDataFrame(rows, "clip string, track_id long, class string, frame long, x1 double, y1 double, x2 double, y2 double, confidence double, predicted boolean")
    cameras = spark.createDataFrame([("c", h, 1920, 1080, 1000.0, 5.0, 10.0, 1)], "clip string, h array<double>, image_w int, image_h int, f_px double, height_m double, fps double, stride long")
    groups = spark.createDataFrame([("person", "people", 20.0, 5.0, 1.5, 1.0, 0.0, 0.0, 5.0)], "class string, grp string, max_speed double, jump_tol double, stitch_radius double, smooth_s double, min_displacement double, offset_m double, depth_limit double")
    wobble = {on: process(boxes, cameras, groups, Settings(radial_smoothing=on)).points.toPandas()["vy"].abs().mean() for on in (True, False)}
    assert 0 < wobble[True] < 0.7 * wobble[False]


def test_settings_of_a_configuration():
    from trackloom.operators.pipeline import Settings

    s = Settings.of({"max_gap_s": 1.0, "stitch": False, "hidden_feet": "bridge", "recover_occluded_feet": False, "radial_smoothing": False})
    assert (s.max_gap_s, s.stitch, s.bridge_hidden_feet, s.recover_feet, s.radial_smoothing, s.min_track_s) == (1.0, False, True, False, False, 1.0)


def test_rays_bracketed_as_marched(spark):
    """Every ray's first way below the ground, by a march a hundred times finer: a ridge of 2 m, up and down, off the raster."""
    from trackloom.operators.ground import ray_cast

    rng = np.random.default_rng(5)
    grid = 5.0 + np.zeros((40, 40))
    grid[:, 20:22] = 30.0

    def ground(x, y):
        c, r = np.floor(x + 20 - 0.5), np.floor(20 - y - 0.5)
        if not (0 <= c < 39 and 0 <= r < 39):
            return 2.0
        a = x + 20 - 0.5 - c
        return grid[int(r), int(c)] * (1 - a) + grid[int(r), int(c) + 1] * a

    rays = [tuple(map(float, (*rng.uniform(-30, 30, 2), rng.uniform(6, 40), *rng.normal(0, 1, 3)))) for _ in range(60)] + [(-15.0, 0.0, 20.0, 1.0, 0.0, 0.0), (-15.0, 0.0, 40.0, 1.0, 0.0, 0.0)]
    got = ray_cast(spark.createDataFrame([(k, *r) for k, r in enumerate(rays)], "id long, ox double, oy double, oz double, dx double, dy double, dz double"), grid, -20.0, 20.0, 1.0, 2.0, 200.0).collect()
    for r in got:
        o, d = np.array([r.ox, r.oy, r.oz]), np.array([r.dx, r.dy, r.dz])
        # a hundred times finer than the operator, across the ground, from above to below
        d = d / np.hypot(d[0], d[1])
        up = [(o + d * q)[2] > ground(*(o + d * q)[:2]) for q in np.arange(40_001) / 200]
        falls = [q for q in range(1, 40_001) if up[q - 1] and not up[q]]
        hit = None if r.gx is None else 200 * np.hypot(r.gx - r.ox, r.gy - r.oy)
        assert hit is None or any(abs(hit - q) < 4 for q in falls)
        # only dips shorter than a step may have been passed over
        assert all(any(up[q : q + 102]) for q in falls if q < (39_800 if hit is None else hit - 4))


def test_a_ray_from_underground_surfaces_first(spark):
    """The first leaves the ground below its start and meets the wall beyond, the second stays under it."""
    from trackloom.operators.ground import ray_cast

    grid = np.zeros((40, 40))
    grid[:, 30:] = 8.0
    rays = [(1, -15.0, 0.0, -1.0, 1.0, 0.0, 0.1), (2, -15.0, 0.0, -1.0, 1.0, 0.0, -0.1)]
    cast = ray_cast(spark.createDataFrame(rays, "id long, ox double, oy double, oz double, dx double, dy double, dz double"), grid, -20.0, 20.0, 1.0, 0.0, 200.0)
    got = {r.id: r.gx for r in cast.collect()}
    assert got[2] is None and 9.0 < got[1] < 11.0


def test_a_ray_for_every_point(spark, sf):
    from trackloom.plans.base import points
    from trackloom.plans.ground_queries import prj08_ray_cast

    assert prj08_ray_cast(spark, sf).count() == points(spark, sf).count()


def test_reports_are_whole_or_refused(spark, tmp_path):
    from trackloom.sources.sinks import save_report

    save_report(str(tmp_path / "a.json"), spark.range(1000))
    assert len(json.loads((tmp_path / "a.json").read_text())) == 1000
    with pytest.raises(ValueError):
        save_report(str(tmp_path / "b.json"), spark.range(1001))
    assert not (tmp_path / "b.json").exists()


def test_ids_of_thousands_of_clips(spark):
    """The 2,148th clip's ids move by more than an int holds."""
    from trackloom.operators.composite import renumbered

    rows = [(f"c{k:04d}", 1_000_000 + k, k) for k in range(1, 2201)]
    got = {r.clip: r.track_id for r in renumbered(spark.createDataFrame(rows, "clip string, track_id long, frame long")).collect()}
    assert got == {c: t + 1_000_000 * k for c, t, k in rows}
