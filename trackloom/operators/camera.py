"""Physical cameras of many sites at once: fits with weak priors, consensus in pixels, methods judged by held-out clicks, cameras that turn.

A site has dozens of clicks, a pair of frames a few hundred matches: groups are small by their nature
and spread over the cluster. Within a group all problems (starts, subsets, folds) are solved together,
as arrays with a problem in each row.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import segment_distance
from ..session import cut_lineage, sized
from .calibrate import homography, project
from .nearby import in_ring, zone_cover

#: A camera in a row: yaw, tilt, roll (radians), log of the focal length in pixels, x, y, height.
PARTS = ("yaw", "tilt", "roll", "log_f", "x", "y", "height")
#: Scale in pixels beyond which residuals count linearly, and with which the prior counts.
SOFT_PX = 6.0
#: Starts of a fit, as turns in degrees and factors of the focal length.
TURNS, ZOOMS = (-15.0, 0.0, 15.0), (0.6, 1.0, 1.6)
#: Reach of yaw, tilt and roll in degrees, and of focal lengths in pixels.
YAW, TILT, ROLL, FOCAL = 40.0, (-10.0, 60.0), 10.0, (300.0, 30_000.0)
#: Pixels within which a click agrees, subsets of five clicks at most, metres that a click which can't be placed counts.
AGREES_PX, SUBSETS, MISS_M = 15.0, 120, 50.0
#: Least number of rays that must agree on a turn, and degrees that a camera turns from frame to frame at most.
AGREEING_RAYS, TURN_DEG = 40, 4.0
#: Length and width of vehicles in metres, by class.
FOOTPRINTS = {"car": (4.5, 1.8), "bus": (11.0, 2.55), "truck": (8.0, 2.5), "motorcycle": (2.1, 0.8)}


def axes(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors forward, right and down of cameras p (problems x 7)."""
    (sy, cy), (st, ct), (sr, cr) = ((np.sin(p[:, k]), np.cos(p[:, k])) for k in range(3))
    zero = np.zeros(len(p))
    forward = np.stack([sy * ct, cy * ct, -st], 1)
    level = np.stack([cy, -sy, zero], 1)
    below = np.cross(forward, level)
    cr, sr = cr[:, None], sr[:, None]
    return forward, cr * level + sr * below, cr * below - sr * level


def to_pixels(p: np.ndarray, world: np.ndarray, size: tuple[float, float], z: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Pixels (problems x points x 2) of world (problems x points x 2) at heights z, and depths before the camera."""
    ahead = np.stack([world[..., 0] - p[:, 4:5], world[..., 1] - p[:, 5:6], z - p[:, 6:7] + np.zeros(world.shape[:2])], -1)
    forward, right, down = (np.einsum("bnk,bk->bn", ahead, a) for a in axes(p))
    depth = np.where(np.abs(forward) < 1e-6, 1e-6, forward)
    focal = np.exp(p[:, 3:4])
    return np.stack([size[0] / 2 + focal * right / depth, size[1] / 2 + focal * down / depth], -1), forward


def to_plane(p: np.ndarray, px: np.ndarray, size: tuple[float, float]) -> np.ndarray:
    """Where pixels (problems x points x 2) meet the ground; NaN at and above the horizon."""
    forward, right, down = axes(p)
    focal = np.exp(p[:, 3])[:, None, None]
    a, b = (px[..., :1] - size[0] / 2) / focal, (px[..., 1:] - size[1] / 2) / focal
    ray = forward[:, None] + a * right[:, None] + b * down[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(ray[..., 2] < -1e-9, -p[:, 6:7] / ray[..., 2], np.nan)
    return p[:, None, 4:6] + t[..., None] * ray[..., :2]


def solve(px: np.ndarray, world: np.ndarray, used: np.ndarray, size: tuple[float, float], start: np.ndarray, mean: np.ndarray, sigma: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Damped least squares with soft absolute residuals for all problems; cameras and their costs.

    used says which clicks count in a problem. sigma is the spread of the prior about mean, infinite where
    there is none.
    """
    p = np.clip(start, low, high)
    costs = np.full(len(p), np.inf)
    damp = np.full(len(p), 1e-2)
    live = np.arange(len(p))

    def residuals(q: np.ndarray, at: np.ndarray) -> np.ndarray:
        seen, depth = to_pixels(q, world[at], size)
        e = np.where((depth > 0)[..., None], np.clip(seen - px[at], -1e4, 1e4), 1e4) * used[at][..., None]
        return np.concatenate([e.reshape(len(q), -1), SOFT_PX * (q - mean) / sigma], 1)

    def cost(e: np.ndarray) -> np.ndarray:
        return (2 * SOFT_PX**2 * (np.sqrt(1 + (e / SOFT_PX) ** 2) - 1)).sum(1)

    steps = np.diag([1e-5, 1e-5, 1e-5, 1e-5, 1e-3, 1e-3, 1e-3])
    e = residuals(p, live)
    costs = cost(e)
    for _ in range(rounds):
        q, here = p[live], e[live]
        jacobian = np.stack([(residuals(q + d, live) - residuals(q - d, live)) / (2 * d.sum()) for d in steps], 2)
        weighted = jacobian / np.sqrt(1 + (here / SOFT_PX) ** 2)[..., None]
        normal = weighted.transpose(0, 2, 1) @ jacobian
        slope = (weighted.transpose(0, 2, 1) @ here[..., None])[..., 0]
        diagonal = np.einsum("bii->bi", normal) + 1e-9
        open_ = np.ones(len(live), bool)
        gain = np.zeros(len(live))
        for _ in range(6):
            k = np.flatnonzero(open_)
            at = live[k]
            a = normal[k] + np.eye(7) * (damp[at][:, None] * diagonal[k])[:, None]
            tried = np.clip(q[k] - np.linalg.solve(a, slope[k][..., None])[..., 0], low, high)
            e_new = residuals(tried, at)
            new = cost(e_new)
            cheaper = new < costs[at]
            c = at[cheaper]
            gain[k[cheaper]] = 1 - new[cheaper] / costs[c]
            p[c], e[c], costs[c] = tried[cheaper], e_new[cheaper], new[cheaper]
            damp[at] = np.where(cheaper, damp[at] / 3, np.minimum(damp[at] * 4, 1e8))
            open_[k[cheaper]] = False
            if not open_.any():
                break
        # problems that hardly gain are done
        live = live[gain > 1e-5]
        if not len(live):
            break
    return p, costs


def fitted(px: np.ndarray, world: np.ndarray, used: np.ndarray, size: tuple[float, float], prior: dict[str, float], starts: bool = True) -> np.ndarray:
    """CAL-04: the best camera of each problem (used: problems x clicks), from nine starts or the prior's alone.

    The prior says where the camera is about (x, y, height, within position_tol and height_tol, of which
    one deviation is half) and which way it looks (yaw, tilt in degrees, focal). It decides with few
    clicks and hardly counts with many.
    """
    rad = np.radians
    centre = np.array([rad(prior["yaw"]), rad(prior["tilt"]), 0.0, np.log(prior["focal"]), prior["x"], prior["y"], prior["height"]])
    far, up = prior["position_tol"], prior["height_tol"]
    low = np.array([centre[0] - rad(YAW), rad(TILT[0]), -rad(ROLL), np.log(FOCAL[0]), centre[4] - far, centre[5] - far, centre[6] - up])
    high = np.array([centre[0] + rad(YAW), rad(TILT[1]), rad(ROLL), np.log(FOCAL[1]), centre[4] + far, centre[5] + far, centre[6] + up])
    sigma = np.array([np.inf] * 4 + [max(far / 2, 0.1)] * 2 + [max(up / 2, 0.1)])
    first = np.array([centre + [rad(turn), 0, 0, np.log(zoom), 0, 0, 0] for turn in (TURNS if starts else (0.0,)) for zoom in (ZOOMS if starts else (1.0,))])
    n, m = len(used), len(first)
    many = lambda v: np.broadcast_to(v, (n * m, *v.shape))
    cameras, costs = solve(many(px), many(world), np.repeat(used, m, 0).astype(float), size, np.tile(first, (n, 1)), centre, sigma, low, high)
    best = costs.reshape(n, m).argmin(1) + np.arange(n) * m
    return cameras[best]


def ground_errors(cameras: np.ndarray, px: np.ndarray, world: np.ndarray, size: tuple[float, float]) -> np.ndarray:
    """Metres between each click's place and where the camera sees it; a miss where it sees no ground there."""
    at = to_plane(cameras, np.broadcast_to(px, (len(cameras), *px.shape)), size)
    e = np.hypot(at[..., 0] - world[:, 0], at[..., 1] - world[:, 1])
    return np.where(np.isfinite(e), np.minimum(e, MISS_M), MISS_M)


def subsets_of_five(n: int, most: int = SUBSETS, seed: int = 0) -> np.ndarray:
    """All fives of n clicks as masks if there are at most so many, else so many different ones, drawn by a seed."""
    rng = np.random.default_rng(seed)
    fives: set[tuple[int, ...]] = set()
    if n <= 12 and len(list(itertools.combinations(range(n), 5))) <= most:
        fives = set(itertools.combinations(range(n), 5))
    while len(fives) < most and n > 5 and not (n <= 12 and len(fives) == len(list(itertools.combinations(range(n), 5)))):
        fives.add(tuple(sorted(rng.choice(n, 5, replace=False).tolist())))
    out = np.zeros((len(fives), n), bool)
    for k, five in enumerate(sorted(fives)):
        out[k, list(five)] = True
    return out


def agreeing(px: np.ndarray, world: np.ndarray, size: tuple[float, float], prior: dict[str, float], leave: np.ndarray | None = None) -> np.ndarray:
    """CAL-06: which clicks agree, within AGREES_PX of where it projects them, with the camera of five of them that
    most do, the smaller median error on ties. Up to five clicks all count. leave: clicks to leave out, in turn, of
    fives and of counting; a row of the answer for each."""
    n = len(px)
    keep = np.ones((1, n), bool) if leave is None else np.arange(n) != leave[:, None]
    if n <= 5 + (leave is not None):
        return keep if leave is not None else keep[0]
    fives = subsets_of_five(n)
    cameras = fitted(px, world, fives, size, prior, starts=False)
    seen, depth = to_pixels(cameras, np.broadcast_to(world, (len(cameras), *world.shape)), size)
    e = np.where(depth > 0, np.hypot(seen[..., 0] - px[:, 0], seen[..., 1] - px[:, 1]), 1e9)
    out = []
    for row in keep:
        mine = np.flatnonzero(~(fives & ~row).any(1))
        close = (e[mine] < AGREES_PX) & row
        middle = np.array([np.median(v[c]) if c.any() else 1e9 for v, c in zip(e[mine], close)])
        out.append(close[np.lexsort((middle, -close.sum(1)))[0]])
    return np.array(out) if leave is not None else out[0]


def calibrated(px: np.ndarray, world: np.ndarray, size: tuple[float, float], prior: dict[str, float], outlier_m: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """CAL-07: the camera of all clicks, then again without those that lie beyond max(outlier_m, 3 x median) on the
    ground, if six are left. The camera, and which clicks count."""
    every = np.ones((1, len(px)), bool)
    camera = fitted(px, world, every, size, prior)
    e = ground_errors(camera, px, world, size)[0]
    keep = e <= max(outlier_m, 3 * float(np.median(e)))
    if keep.all() or keep.sum() < 6:
        return camera[0], every[0]
    return fitted(px, world, keep[None], size, prior)[0], keep


def held_out_errors(px: np.ndarray, world: np.ndarray, size: tuple[float, float], prior: dict[str, float]) -> dict[str, np.ndarray]:
    """CAL-14: for each method the error in metres at every click of what it makes of the others."""
    n = len(px)
    folds = ~np.eye(n, dtype=bool)
    at = np.arange(n)
    out = {"camera": ground_errors(fitted(px, world, folds, size, prior), px, world, size)[at, at]}
    agreed = agreeing(px, world, size, prior, at)
    out["camera of those that agree"] = ground_errors(fitted(px, world, agreed, size, prior), px, world, size)[at, at]
    flat = np.full(n, MISS_M)
    for k in range(n):
        h = homography(px[folds[k]], world[folds[k]])
        if h is not None:
            e = float(np.hypot(*(project(h, px[k : k + 1]) - world[k : k + 1])[0]))
            flat[k] = min(e, MISS_M) if np.isfinite(e) else MISS_M
    out["plane"] = flat
    return out


PRIOR = ("yaw", "tilt", "focal", "x", "y", "height", "position_tol", "height_tol")


def per_site(clicks: DataFrame, priors: DataFrame, key: str, fit: Callable[[np.ndarray, np.ndarray, tuple[float, float], dict[str, float]], pd.DataFrame], schema: str, least: int = 4) -> DataFrame:
    """fit for every key with at least so many clicks: clicks(key, u, v, x, y), priors(key, image_w, image_h and PRIOR).

    Clicks are taken in the order of u and v. A key without prior, or with nulls in it, gives no row.
    """
    c = clicks.where("u is not null and v is not null and x is not null and y is not null").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("u", "v", "x", "y"))).alias("_clicks")).where(F.size("_clicks") >= least)
    j = c.join(sized(priors.select(key, "image_w", "image_h", *[F.col(n).cast("double").alias(f"_{n}") for n in PRIOR]).na.drop()), key)

    def run(frames):
        for f in frames:
            for r in f.to_dict("records"):
                m = np.array([[q["u"], q["v"], q["x"], q["y"]] for q in r["_clicks"]], float)
                got = fit(m[:, :2], m[:, 2:], (float(r["image_w"]), float(r["image_h"])), {n: r[f"_{n}"] for n in PRIOR})
                got.insert(0, key, r[key])
                yield got

    # a number of its own, as fits are much work for few bytes, which adaptive execution would put into one task
    parts = 2 * clicks.sparkSession.sparkContext.defaultParallelism
    return j.repartition(parts, key).mapInPandas(run, f"`{key}` {dict(clicks.dtypes)[key]}, {schema}")


_CAMERA = "yaw_deg double, tilt_deg double, roll_deg double, focal_px double, cam_x double, cam_y double, height_m double"


def _row(camera: np.ndarray, **more) -> pd.DataFrame:
    yaw, tilt, roll = np.degrees(camera[:3])
    return pd.DataFrame([{"yaw_deg": yaw, "tilt_deg": tilt, "roll_deg": roll, "focal_px": float(np.exp(camera[3])), "cam_x": camera[4], "cam_y": camera[5], "height_m": camera[6]} | more])


def camera_fits(clicks: DataFrame, priors: DataFrame, key: str = "site") -> DataFrame:
    """CAL-04, CAL-07 for every key: its camera, how many clicks there are and count, and the median of their errors in pixels."""

    def fit(px, world, size, prior):
        camera, keep = calibrated(px, world, size, prior)
        seen, _ = to_pixels(camera[None], world[None], size)
        return _row(camera, n=len(px), counted=int(keep.sum()), median_px=float(np.median(np.hypot(*(seen[0] - px)[keep].T))))

    return per_site(clicks, priors, key, fit, f"{_CAMERA}, n long, counted long, median_px double")


def consensus_clicks(clicks: DataFrame, priors: DataFrame, key: str = "site") -> DataFrame:
    """CAL-06 for every key: each click with whether it agrees."""

    def fit(px, world, size, prior):
        return pd.DataFrame({"u": px[:, 0], "v": px[:, 1], "agrees": agreeing(px, world, size, prior)})

    return per_site(clicks, priors, key, fit, "u double, v double, agrees boolean", 1)


def method_errors(clicks: DataFrame, priors: DataFrame, key: str = "site") -> DataFrame:
    """CAL-14 for every key: the error of each method at each held-out click: key, method, error_m. best_method chooses by it."""

    def fit(px, world, size, prior):
        return pd.concat([pd.DataFrame({"method": name, "error_m": e}) for name, e in held_out_errors(px, world, size, prior).items()])

    return per_site(clicks, priors, key, fit, "method string, error_m double")


# -- cameras that turn ---------------------------------------------------------------------------


def bearings(px: np.ndarray, focal: float, size: tuple[float, float]) -> np.ndarray:
    """Unit rays of pixels."""
    d = np.column_stack([(px[:, 0] - size[0] / 2) / focal, (px[:, 1] - size[1] / 2) / focal, np.ones(len(px))])
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def turns_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rotations that take b to a best, for stacks of matched unit rays (problems x rays x 3)."""
    u, _, vt = np.linalg.svd(np.einsum("bni,bnj->bij", a, b))
    flip = np.ones((len(a), 3))
    flip[:, 2] = np.sign(np.linalg.det(u @ vt))
    return (u * flip[:, None]) @ vt


def turned(a: np.ndarray, b: np.ndarray, within: float, least: int = AGREEING_RAYS, rounds: int = 200, seed: int = 0) -> tuple[np.ndarray | None, int]:
    """CAL-19: the rotation from b to a that most rays agree with within so many radians, by pairs of rays, refitted twice; None below so many."""
    if len(a) < max(least, 2):
        return None, 0
    rng = np.random.default_rng(seed)
    pairs = np.stack([rng.choice(len(a), 2, replace=False) for _ in range(rounds)])
    near = np.cos(within)
    agree = lambda turns: np.einsum("ni,bij,nj->bn", a, turns, b) > near
    hits = agree(turns_between(a[pairs], b[pairs]))
    keep = hits[hits.sum(1).argmax()]
    for _ in range(2):
        if keep.sum() < least:
            return None, 0
        turn = turns_between(a[keep][None], b[keep][None])
        keep = agree(turn)[0]
    return (turn[0], int(keep.sum())) if keep.sum() >= least else (None, 0)


def turn_angle(turn: np.ndarray) -> float:
    """Degrees of a rotation."""
    return float(np.degrees(np.arccos(np.clip((np.trace(turn) - 1) / 2, -1, 1))))


def frame_turns(matches: DataFrame, cameras: DataFrame, within_px: float = 2.0, most_deg: float = TURN_DEG) -> DataFrame:
    """CAL-19 for every (clip, frame): the turn since the frame before.

    matches: clip, frame, u, v (in this frame), u0, v0 (in the one before); cameras: clip, f_px, image_w,
    image_h. Gives turn (nine numbers), angle_deg and agreeing; null where too few matches agree or the camera
    would turn faster than most_deg a frame.
    """
    m = matches.groupBy("clip", "frame").agg(F.sort_array(F.collect_list(F.struct("u", "v", "u0", "v0"))).alias("_m")).join(sized(cameras.select("clip", "f_px", "image_w", "image_h")), "clip")

    def run(frames):
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                m = np.array([[q["u"], q["v"], q["u0"], q["v0"]] for q in r["_m"]], float)
                size = (r["image_w"], r["image_h"])
                turn, n = turned(bearings(m[:, 2:], r["f_px"], size), bearings(m[:, :2], r["f_px"], size), within_px / r["f_px"])
                angle = None if turn is None else turn_angle(turn)
                if angle is None or angle > most_deg:
                    turn, angle, n = None, None, 0
                rows.append((r["clip"], r["frame"], None if turn is None else turn.ravel().tolist(), angle, n))
            yield pd.DataFrame(rows, columns=["clip", "frame", "turn", "angle_deg", "agreeing"])

    return m.mapInPandas(run, "clip string, frame long, turn array<double>, angle_deg double, agreeing long")


def rotation_spread(h: np.ndarray, size_to: tuple[float, float], size_from: tuple[float, float], steps: int = 150) -> float:
    """CAL-08: how far a matrix between two frames is from a turn of one camera, which gives 1 at any zoom.

    For every pair of focal lengths of a geometric grid the matrix is brought to rays; a turn then has equal
    singular values, and the smallest ratio of the largest to the smallest is the answer.
    """
    focal = np.geomspace(*FOCAL, steps)
    zero, one = np.zeros(steps), np.ones(steps)
    inward = np.stack([np.stack([1 / focal, zero, -size_from[0] / 2 / focal], 1), np.stack([zero, 1 / focal, -size_from[1] / 2 / focal], 1), np.stack([zero, zero, one], 1)], 1)
    outward = np.stack([np.stack([focal, zero, size_to[0] / 2 * one], 1), np.stack([zero, focal, size_to[1] / 2 * one], 1), np.stack([zero, zero, one], 1)], 1)
    s = np.linalg.svd(np.einsum("aij,jk,bkl->abil", inward, h, outward), compute_uv=False)
    return float((s[..., 0] / np.maximum(s[..., 2], 1e-12)).min())


def same_spot(pairs: DataFrame, most_spread: float = 1.08, least_span: float = 0.20) -> DataFrame:
    """CAL-08, the part on tables: whether two clips were filmed from one spot.

    pairs: clip, other, h (nine numbers, from clip's frame to other's), matched_v (rows of the matched pixels
    in clip's frame), and image_w, image_h of both frames. depth_span is the share of the frame's height
    between the 10 and 90 per cent quantiles of matched_v: matches along one distant skyline say nothing.
    """

    def run(frames):
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                v = np.asarray(r["matched_v"], float)
                span = float(np.percentile(v, 90) - np.percentile(v, 10)) / r["image_h"] if len(v) else 0.0
                size = (float(r["image_w"]), float(r["image_h"]))
                rows.append((r["clip"], r["other"], span, rotation_spread(np.asarray(r["h"], float).reshape(3, 3), size, size)))
            yield pd.DataFrame(rows, columns=["clip", "other", "depth_span", "rotation_spread"])

    got = pairs.select("clip", "other", "h", "matched_v", "image_w", "image_h").mapInPandas(run, "clip string, other string, depth_span double, rotation_spread double")
    return got.withColumn("same_spot", (F.col("depth_span") >= least_span) & (F.col("rotation_spread") <= most_spread))


# -- what tracks say about a camera --------------------------------------------------------------


def track_speed_faults(steps: DataFrame, keys: list[str], slow: float = 0.2, fast: float = 40.0) -> DataFrame:
    """CAL-10: per track of keys the geometric mean of its steps' speeds, and by how much its logarithm is off the possible band.

    steps: keys, track_id, step_speed. A step slower than a millimetre a second counts as that.
    """
    g = steps.groupBy(*keys, "track_id").agg(F.exp(F.avg(F.log(F.greatest("step_speed", F.lit(1e-3))))).alias("speed"))
    return g.withColumn("speed_fault", F.greatest(F.log(F.col("speed") / fast), F.lit(0.0)) + F.greatest(F.log(slow / F.col("speed")), F.lit(0.0)))


def track_size_faults(boxes: DataFrame, keys: list[str], free: float = 0.15) -> DataFrame:
    """CAL-10: per track of keys how far the width of its boxes' lower edges on the ground is off that of its class, beyond a free share.

    boxes: keys, track_id, cls, left_x, left_y, right_x, right_y, x, y (on the ground, from the camera), heading
    (degrees from north, null when standing). What is seen of a footprint is its length by the sine and its
    width by the cosine of the angle between heading and line of sight.
    """
    length, width = F.lit(FOOTPRINTS["car"][0]), F.lit(FOOTPRINTS["car"][1])
    for c, (a, b) in FOOTPRINTS.items():
        length, width = F.when(F.col("cls") == c, a).otherwise(length), F.when(F.col("cls") == c, b).otherwise(width)
    turn = F.radians("heading") - F.atan2("x", "y")
    seen = length * F.abs(F.sin(turn)) + width * F.abs(F.cos(turn))
    measured = F.sqrt((F.col("right_x") - F.col("left_x")) ** 2 + (F.col("right_y") - F.col("left_y")) ** 2)
    ratio = F.log(F.greatest(measured, F.lit(1e-3)) / F.greatest(seen, F.lit(1e-3)))
    g = boxes.groupBy(*keys, "track_id").agg(F.coalesce(F.avg(ratio), F.lit(0.0)).alias("log_ratio"))
    return g.withColumn("size_fault", F.greatest(F.abs("log_ratio") - free, F.lit(0.0)))


def obstacle_depth(points: DataFrame, zones: DataFrame, id_columns: list[str]) -> DataFrame:
    """CAL-12: how many metres each point lies inside an obstacle of its site, the deepest one; 0 outside of all.

    points: id_columns (which tell them apart), site, x, y; zones: zone_id, site, ring_x, ring_y in the same
    metres. Points meet only the obstacles whose cover has their cell.
    """
    cells = cut_lineage(zone_cover(zones).select("zone_id", "site", "level", "i", "j"))
    levels = sorted(r[0] for r in cells.select("level").distinct().collect())
    p = points.select(*id_columns, "site", "x", "y")
    if not levels:
        return p.select(*id_columns, F.lit(0.0).alias("depth_m"))
    keys = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("x") / 4.0**k).alias("i"), F.floor(F.col("y") / 4.0**k).alias("j")) for k in levels])
    met = p.select("*", F.inline(keys)).join(sized(cells), ["site", "level", "i", "j"]).join(sized(zones.select("zone_id", "ring_x", "ring_y")), "zone_id")
    x, y, rx, ry = (F.col(c) for c in ("x", "y", "ring_x", "ring_y"))
    n = F.least(F.size(rx), F.size(ry))

    def edge(best: Column, k: Column) -> Column:
        k1 = F.when(k + 1 == n, 0).otherwise(k + 1)
        return F.least(best, segment_distance(x, y, F.get(rx, k), F.get(ry, k), F.get(rx, k1), F.get(ry, k1)))

    depth = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(float("inf")), edge)
    inside = met.where(in_ring(x, y, rx, ry)).groupBy(*id_columns).agg(F.max(depth).alias("depth_m"))
    return p.select(*id_columns).join(inside, id_columns, "left").withColumn("depth_m", F.coalesce("depth_m", F.lit(0.0)))


def people_cost(depths: DataFrame, speeds: DataFrame, keys: list[str], fast: float = 2.5) -> DataFrame:
    """CAL-12: what a camera costs by the people it places: the mean depth inside obstacles, and the share of tracks faster than one walks.

    depths: keys, depth_m of every sample; speeds: keys, track_id, speed (of a track).
    """
    a = depths.groupBy(*keys).agg(F.avg("depth_m").alias("inside_m"), F.avg((F.col("depth_m") > 0).cast("double")).alias("inside_share"))
    b = speeds.groupBy(*keys).agg(F.avg((F.col("speed") > fast).cast("double")).alias("fast_share"))
    return a.join(b, keys, "left")


def synthetic_boxes(walks: DataFrame, camera: dict[str, float], size: tuple[int, int] = (1920, 1080), person_m: float = 1.7, wide_m: float = 0.5) -> DataFrame:
    """SRC-21: the boxes that a pinhole camera sees of walkers on the ground: clip, track_id, frame, x1, y1, x2, y2 and their true x, y.

    camera: yaw, tilt (degrees), focal, x, y, height. The lower edge's middle is where a walker stands, the
    upper edge is the head's; who is behind the camera has no box.
    """
    p = np.array([[np.radians(camera["yaw"]), np.radians(camera["tilt"]), 0.0, np.log(camera["focal"]), camera["x"], camera["y"], camera["height"]]])
    forward, right, down = (v[0].tolist() for v in axes(p))
    dx, dy = F.col("x") - camera["x"], F.col("y") - camera["y"]

    def seen(z: float, axis: list[float]) -> Column:
        return dx * axis[0] + dy * axis[1] + (z - camera["height"]) * axis[2]

    foot, head = seen(0.0, forward), seen(person_m, forward)
    u = size[0] / 2 + camera["focal"] * seen(0.0, right) / foot
    half = camera["focal"] * wide_m / 2 / foot
    low = size[1] / 2 + camera["focal"] * seen(0.0, down) / foot
    high = size[1] / 2 + camera["focal"] * seen(person_m, down) / head
    return walks.where((foot > 0.1) & (head > 0.1)).select("clip", "track_id", "frame", (u - half).alias("x1"), F.least(low, high).alias("y1"), (u + half).alias("x2"), F.greatest(low, high).alias("y2"), "x", "y")
