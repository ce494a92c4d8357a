"""Kernels of the track operators on anything: no crash, and what comes out is within what went in."""

import numpy as np
import pytest

from trackloom.operators.nearby import near_rows
from trackloom.operators.spikes import BASIS_ROW, day_bases, flag_rows, slice_grams
from trackloom.operators.stops import slice_pieces


def anything(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    tracks = int(rng.integers(1, 6))
    track = np.sort(rng.integers(0, tracks, n))
    frame = np.concatenate([np.cumsum(rng.choice([1, 5, 5, 5, 60, 4000], (track == k).sum())) for k in range(tracks)])
    scale = rng.choice([0.01, 0.5, 5.0, 1e4])
    kind = rng.integers(0, 4)
    x = rng.normal(0, scale, n).cumsum() if kind == 0 else rng.choice([0.0, scale], n) if kind == 1 else rng.normal(0, scale, n) if kind == 2 else np.full(n, 7.0)
    y = np.roll(x, 3)
    for v in (x, y):
        v[rng.random(n) < rng.choice([0, 0.2, 1.0], p=[0.6, 0.3, 0.1])] = np.nan
        v[rng.random(n) < 0.02] = rng.choice([np.inf, -np.inf, 1e300, 0.0])
    speed = rng.choice([0.0, 1.0, 3.0, np.nan, -1.0, 1e9], n)
    return {"track_id": track, "slice": np.zeros(n, np.int64), "own": rng.random(n) < 0.8, "frame": frame.astype(np.int64), "fps": np.full(n, 10.0), "x": x, "y": y, "speed": speed, "kind": rng.choice([0, 1, 3, np.nan], n)}


def flagged(rows):
    """Both passes over the slices, as the operator joins them: the flagged rows."""
    limits = (5.0, 12.0, 3.0)
    rows = rows | {"off": (np.abs(np.nan_to_num(rows["x"])) > 1e6) | (np.abs(np.nan_to_num(rows["y"])) > 1e6)}
    bases = day_bases(slice_grams(rows, *limits), np.zeros((8, 2, 12, 12)))
    n = len(bases["track_id"])
    first = {k: np.full(n, {"frame": BASIS_ROW, "fps": 1}.get(k, 0), v.dtype) for k, v in rows.items()} | {"track_id": bases["track_id"]}
    both = {k: np.concatenate((first[k], v)) for k, v in rows.items()} | {"basis": np.concatenate((bases["basis"], np.full(len(rows["frame"]), None, object)))}
    order = np.lexsort((both["frame"], both["track_id"]))
    found = flag_rows({k: v[order] for k, v in both.items()}, 6, *limits)
    return {k: v[found["signal"] < 0] for k, v in found.items()}


@pytest.mark.parametrize("seed", range(0, 300, 25))
@pytest.mark.filterwarnings("ignore:(overflow|invalid value)")
def test_anything(seed):
    for s in range(seed, seed + 25):
        rows = anything(s)
        with np.errstate(all="ignore"):
            p = slice_pieces(rows, 2.0, 20.0, 30.0)
            f = flagged(rows)
        own = {(t, k) for t, k in zip(rows["track_id"][rows["own"]], rows["frame"][rows["own"]])}
        assert {(t, k) for t, k in zip(f["track_id"], f["frame"])} <= own
        good = np.isfinite(rows["x"]) & np.isfinite(rows["y"]) & rows["own"]
        assert sum(p["n_rows"]) == good.sum()
        ok = np.isfinite(rows["x"]) & np.isfinite(rows["y"]) & (np.abs(rows["x"]) < 1e6) & (np.abs(rows["y"]) < 1e6)
        near = {k: rows[k][ok] for k in ("track_id", "frame", "fps", "x", "y")} | {"clip": np.full(ok.sum(), "c", object), "g": rows["track_id"][ok] % 3, "tx": np.zeros(ok.sum(), np.int64), "ty": np.zeros(ok.sum(), np.int64), "tt": np.zeros(ok.sum(), np.int64)}
        order = np.lexsort((near["frame"],))
        near = {k: v[order] for k, v in near.items()}
        got = near_rows(near, 1.5, 1.0, block=50)
        want = set()
        for i in range(ok.sum()):
            j = np.flatnonzero((near["g"] != near["g"][i]) & (near["g"] > 0) & (near["g"][i] > 0) & (np.abs(near["frame"] - near["frame"][i]) <= 10) & (np.hypot(near["x"] - near["x"][i], near["y"] - near["y"][i]) <= 1.5))
            want |= {tuple(sorted((near["track_id"][i], t))) for t in near["track_id"][j]}
        assert set(zip(got["id_a"], got["id_b"])) == want
