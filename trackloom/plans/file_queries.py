"""Queries of readers and sinks: what a sink has written to the shared folder, as a reader finds it.

Every one of them writes whole tables, in its own new folder, and reads them back.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibrate as C
from ..session import shared_folder
from ..sources import readers as R
from ..sources import schemas as S
from ..sources import sinks as K
from ..sources import store
from ..sources.tables import table
from .aggregates import rnd
from .base import BOXES, POINTS, boxes, points, r, sql
from .calibration_queries import CLICKS, clicks
from .registry import ORACLES, QUERIES, query


def folder(spark: SparkSession) -> str:
    """A new folder on the shared store."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def local(path: str) -> str:
    """The path without the name of its store, where that is the local one."""
    return path.removeprefix("file://").removeprefix("file:")


def back(spark: SparkSession, df: DataFrame, order: list[str] | None = None, parts: list[str] | None = None) -> DataFrame:
    """df as CSV and back, parts as folders."""
    at = folder(spark)
    K.write_csv(df, at, order, parts)
    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n not in (parts or []))
    got = spark.read.schema(kinds + "".join(f", `{c}` {dict(df.dtypes)[c]}" for c in parts or [])).option("header", True).csv(at)
    return got.select(*df.columns)


@query(sql(BOXES, then=f"SELECT clip, track_id, class, class_id, frame, {r('time_s')} AS time_s, {', '.join(f'{r(c, 2)} AS {c}' for c in ('x1', 'y1', 'x2', 'y2'))}, confidence, predicted FROM b"))
def src01_raw_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-01, then SRC-01."""
    at = folder(spark)
    K.write_csv(K.raw_rows(boxes(spark, sf)).select("track_id", "class", "class_id", "frame", "time_s", "x1", "y1", "x2", "y2", "confidence", "predicted", "clip"), at, ["track_id", "frame"], ["clip"])
    return R.raw_tracks(spark, f"{at}/*/*.csv")


@query("SELECT clip, clip || '.mp4' AS video, CAST(fps AS DOUBLE) AS fps, CAST(vid_stride AS BIGINT) AS vid_stride, start_frame, end_frame, CAST(1920 AS BIGINT) AS width, CAST(1080 AS BIGINT) AS height FROM clips")
def src02_run_meta(spark: SparkSession, sf: str) -> DataFrame:
    at = folder(spark)
    meta = table(spark, sf, "clips").select("clip", F.concat("clip", F.lit(".mp4")).alias("video"), F.col("fps").cast("double").alias("fps"), F.col("vid_stride").cast("long").alias("vid_stride"), "start_frame", "end_frame", F.lit(1920).cast("long").alias("width"), F.lit(1080).cast("long").alias("height"))
    meta.write.partitionBy("clip").json(at)
    return R.run_meta(spark, f"{at}/*/*.json")


@query("SELECT clip, CAST(round_even(2.5 * fps, 0) AS BIGINT) AS start_frame, least(CAST(round_even(12.3 * fps, 0) AS BIGINT), end_frame) AS end_frame FROM clips")
def src03_frame_ranges(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "clips").select("clip", F.col("fps").cast("double").alias("fps"), F.lit(2.5).alias("start_s"), F.lit(12.3).alias("end_s"), F.col("end_frame").alias("n_frames"))
    return R.frame_ranges(v).select("clip", "start_frame", "end_frame")


@query("SELECT site, " + ", ".join(f"h[{k + 1}] AS h{k}" for k in range(9)) + ", origin_e, origin_n, CAST(image_w AS BIGINT) AS image_w, CAST(image_h AS BIGINT) AS image_h, rmse_m FROM calibrations")
def src04_calibrations(spark: SparkSession, sf: str) -> DataFrame:
    at = folder(spark)
    rows = F.array(*[F.slice("h", k, 3) for k in (1, 4, 7)])
    k = table(spark, sf, "calibrations").select(F.col("site").alias("clip"), rows.alias("H"), F.array("origin_e", "origin_n").alias("origin"), F.array("image_w", "image_h").alias("image_size"), "rmse_m")
    k.write.partitionBy("clip").json(at)
    got = R.calibrations(spark, f"{at}/*/*.json")
    return got.select(F.col("clip").alias("site"), *[F.get("h", F.lit(k)).alias(f"h{k}") for k in range(9)], F.col("origin")[0].alias("origin_e"), F.col("origin")[1].alias("origin_n"), F.col("image_size")[0].alias("image_w"), F.col("image_size")[1].alias("image_h"), "rmse_m")


@query("SELECT f_px AS fx, f_px AS fy, image_w / 2.0 AS cx, image_h / 2.0 AS cy, 0.01 AS k1, rmse_m AS rms FROM calibrations")
def src05_lenses(spark: SparkSession, sf: str) -> DataFrame:
    at, zero = folder(spark), F.lit(0.0)
    k = F.array(F.array("f_px", zero, F.col("image_w") / 2.0), F.array(zero, F.col("f_px"), F.col("image_h") / 2.0), F.array(zero, zero, F.lit(1.0)))
    lens = table(spark, sf, "calibrations").select("site", k.alias("K"), F.array(F.lit(0.01), F.lit(-0.02)).alias("dist"), F.array("image_w", "image_h").alias("size"), F.col("rmse_m").alias("rms"))
    lens.write.partitionBy("site").json(at)
    return R.lenses(spark, f"{at}/*/*.json").select(F.col("K")[0][0].alias("fx"), F.col("K")[1][1].alias("fy"), F.col("K")[0][2].alias("cx"), F.col("K")[1][2].alias("cy"), F.col("dist")[0].alias("k1"), "rms")


@query(sql(BOXES, then="SELECT clip, frame, CAST(count(*) AS BIGINT) AS inliers, CAST(frame % 7 AS DOUBLE) AS shift_x, CAST(frame % 5 AS DOUBLE) AS shift_y FROM b GROUP BY clip, frame"))
def src06_registrations(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-03, then SRC-06: a matrix for every frame that has boxes."""
    at, o, i = folder(spark), F.lit(0.0), F.lit(1.0)
    m = F.array(i, o, (F.col("frame") % 7).cast("double"), o, i, (F.col("frame") % 5).cast("double"), o, o, i)
    K.write_parquet(boxes(spark, sf).groupBy("clip", "frame").agg(F.count("*").alias("inliers")).select("clip", "frame", m.alias("m"), "inliers"), at)
    return R.registrations(spark, at).select("clip", "frame", "inliers", F.col("m")[2].alias("shift_x"), F.col("m")[5].alias("shift_y"))


@query("SELECT clip, start_frame AS registered_to, start_frame % 2 = 0 AS fits FROM clips")
def src07_registration_fits(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "clips")
    return R.registration_fits(c.select("clip", F.col("start_frame").alias("registered_to")), c.select("clip", (F.col("start_frame") - F.col("start_frame") % 2).alias("calibrated_at")))


@query("SELECT * FROM (VALUES ('cleaning.max_gap_s', '3.5'), ('cleaning.min_track_s', '1.0'), ('field.cell_size_m', '2.0'), ('field.smooth_m', '4.0'), ('groups', 'vehicles'), ('site', 'here')) t(setting, value)")
def src09_config(spark: SparkSession, sf: str) -> DataFrame:
    """A configuration that extends another, with an override; the map of its settings, one row each."""
    at = local(folder(spark))
    store.write_text(f"{at}/base.yaml", "cleaning:\n  max_gap_s: 3.5\nfield:\n  cell_size_m: 1.5\n  smooth_m: 4.0\ngroups:\n  vehicles: {}\n")
    store.write_text(f"{at}/site.yaml", "extends: base.yaml\nsite: here\n")
    cfg = R.config(f"{at}/site.yaml", {"field": {"cell_size_m": 2.0}})
    said = {f"{s}.{k}": str(cfg[s][k]) for s, k in (("cleaning", "max_gap_s"), ("cleaning", "min_track_s"), ("field", "cell_size_m"), ("field", "smooth_m"))} | {"groups": " ".join(cfg.groups), "site": cfg["site"]}
    settings = spark.range(1).select(F.create_map(*[F.lit(v) for kv in said.items() for v in kv]).alias("m"))
    return settings.select(F.explode("m").alias("setting", "value"))


@query("SELECT zone_id AS way_id, kind, CAST(i - 1 AS INTEGER) AS seq, ring_y[i] AS lat, ring_x[i] AS lon FROM (SELECT *, unnest(range(1, len(ring_x) + 1)) AS i FROM zones)")
def src13_ways(spark: SparkSession, sf: str) -> DataFrame:
    """The zones as the ways of one cached map answer, which is one document."""
    at = folder(spark)
    geometry = F.transform(F.arrays_zip("ring_x", "ring_y"), lambda p: F.struct(p["ring_y"].alias("lat"), p["ring_x"].alias("lon")))
    e = table(spark, sf, "zones").select(F.struct(F.lit("way").alias("type"), F.col("zone_id").alias("id"), F.create_map(F.lit("natural"), F.col("kind")).alias("tags"), geometry.alias("geometry")).alias("e"))
    e.groupBy().agg(F.collect_list("e").alias("elements")).write.json(at)
    return R.osm_ways(spark, f"{at}/*.json")


@query("SELECT * FROM (VALUES (0, 0.0, 0.0), (1, 1920.0, 0.0), (2, 1920.0, 900.5), (3, 0.0, 1080.0)) t(k, u, v)")
def src15_region(spark: SparkSession, sf: str) -> DataFrame:
    at = local(folder(spark))
    store.write_text(f"{at}/site_roi.json", json.dumps({"polygon": [[0, 0], [1920, 0], [1920, 900.5], [0, 1080]]}))
    return spark.createDataFrame([(k, u, v) for k, (u, v) in enumerate(R.roi(f"{at}/site_roi.json"))], "k int, u double, v double")


_PUBLISHED = "SELECT clip, track_id, cls AS class, frame, " + ", ".join(f"{r(c, 3)} AS {c}" for c in ("t", "x", "y", "speed")) + ", pred AS predicted, source, grp AS \"group\" FROM p"


def published(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return rnd(p.select("clip", "track_id", F.col("cls").alias("class"), "frame", "t", "x", "y", "speed", F.col("pred").alias("predicted"), "source", F.col("grp").alias("group")), 3)


@query(sql(POINTS, then=_PUBLISHED.replace(" FROM p", ", p.dt, coalesce(lower(trim(c.grade)), 'ok') AS grade FROM p JOIN clips c USING (clip)").replace("SELECT clip", "SELECT p.clip")))
def src16_processed_points(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-05, then SRC-16."""
    at = folder(spark)
    p = published(spark, sf)
    null = lambda kind: F.lit(None).cast(kind)
    p = p.select("track_id", "class", "frame", F.col("t").alias("time_s"), "x", "y", null("double").alias("vx"), null("double").alias("vy"), "speed", null("double").alias("heading"), F.col("predicted").cast("string").alias("predicted"), "source", "group", F.lit("False").alias("beyond_limit"), "clip")
    K.write_csv(p, at, ["track_id", "frame"], ["clip"])
    meta = table(spark, sf, "clips").select("clip", "fps", "vid_stride", F.lower(F.trim("grade")).alias("grade"))
    got = R.processed_points(spark, [f"{at}/*/*.csv"], meta, depth=1)
    return got.select("clip", "track_id", "class", "frame", F.col("time_s").alias("t"), "x", "y", "speed", "predicted", "source", "group", "dt", "grade")


@query("SELECT 'run3' AS latest, 'run2' AS processed")
def src17_latest_run(spark: SparkSession, sf: str) -> DataFrame:
    at = local(folder(spark))
    for run, files in (("run1", ["raw_tracks.csv", "points.csv"]), ("run2", ["raw_tracks.csv", "points.csv"]), ("run3", ["raw_tracks.csv"]), ("run4", [])):
        for f in ["note.txt", *files]:
            store.write_text(f"{at}/{run}/data/{f}", "")
    return spark.createDataFrame([(R.latest_run(at).name, R.latest_run(at, processed=True).name)], "latest string, processed string")


@query("SELECT * FROM (VALUES ('CELL', '1.5'), ('GROUPS', '[\"people\", \"cycles\"]'), ('NAME', '\"plaza\"')) t(name, value)")
def src19_script_values(spark: SparkSession, sf: str) -> DataFrame:
    at = local(folder(spark))
    store.write_text(f"{at}/script.py", "CELL = 1.5  # metres\nNAME = 'plaza'\nGROUPS = ['people', 'cycles']\nOTHER = 3\n")
    got = R.script_values(store.read_text(f"{at}/script.py"), ["CELL", "NAME", "GROUPS", "MISSING"])
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in got.items()], "name string, value string")


@query(sql(BOXES, then=f"SELECT frame, class, {', '.join(f'{r(c, 2)} AS {c}' for c in ('x1', 'y1', 'x2', 'y2'))} FROM b WHERE class = 'person'"))
def snk02_privacy_boxes(spark: SparkSession, sf: str) -> DataFrame:
    at = folder(spark)
    K.write_csv(rnd(boxes(spark, sf).where("class = 'person'").select("frame", "class", "x1", "y1", "x2", "y2"), 2), at, ["frame", "x1"])
    return spark.read.schema(S.PRIVACY).option("header", True).csv(at)


@query(sql(POINTS, then=_PUBLISHED))
def snk05_points(spark: SparkSession, sf: str) -> DataFrame:
    return back(spark, published(spark, sf), ["clip", "track_id", "frame"])


def _through(name: str, of: str, order: list[str], parts: list[str] | None = None) -> None:
    """Registers name: the rows of the query of, written as CSV and read back, with its SQL."""
    query(ORACLES[of], name)(lambda spark, sf: back(spark, QUERIES[of](spark, sf), order, parts))


_through("snk06_track_metrics", "cln22_track_summary", ["clip", "track_id"])
_through("snk09_field_grid", "agg01_grid", ["clip", "i", "j"], ["clip"])
_through("snk10_vector_field", "fld05_smooth_field", ["clip", "j", "i"], ["clip"])
_through("snk10_vector_field_slices", "fld06_time_sliced", ["clip", "t_start"], ["clip"])
_through("snk11_stats_long", "agg08_stats_long", ["scope", "name"])
_through("snk12_key_figures", "agg09_key_figures", ["figure"])
_through("snk15_kit_modules", "kit02_modules", ["clip"])
_through("snk16_clips", "cmp12_clip_table", ["clip"])
_through("snk16_coverage", "cmp08_coverage", ["site", "j", "i"], ["site"])
_through("snk16_overlap_pairs", "cmp04_agreement_pairs", ["clip_a", "clip_b"])


@query(ORACLES["cmp07_master_field"])
def snk16_master(spark: SparkSession, sf: str) -> DataFrame:
    """As Parquet, which tells an empty text from none."""
    at = folder(spark)
    K.write_parquet(QUERIES["cmp07_master_field"](spark, sf), at, ["site"])
    return spark.read.parquet(at)


@query("SELECT site, h[1] AS h0, h[9] AS h8, origin_e, CAST(image_w AS BIGINT) AS image_w FROM calibrations")
def snk17_calibrations(spark: SparkSession, sf: str) -> DataFrame:
    """A calibration is a small file that the driver writes; sites are a fixed few."""
    at = local(folder(spark))
    for c in table(spark, sf, "calibrations").collect():
        K.save_calibration(f"{at}/{c.site}/calibration.json", list(c.h), [c.origin_e, c.origin_n], [c.image_w, c.image_h], rmse_m=c.rmse_m)
    got = R.calibrations(spark, f"{at}/*/calibration.json")
    return got.select(F.col("clip").alias("site"), F.get("h", F.lit(0)).alias("h0"), F.get("h", F.lit(8)).alias("h8"), F.col("origin")[0].alias("origin_e"), F.col("image_size")[0].alias("image_w"))


@query("SELECT class, CAST(count(*) AS BIGINT) AS n FROM points GROUP BY class")
def snk18_report(spark: SparkSession, sf: str) -> DataFrame:
    at = local(folder(spark))
    K.save_report(f"{at}/report.json", table(spark, sf, "points").groupBy("class").agg(F.count("*").alias("n")))
    return spark.read.schema("class string, n long").option("multiLine", True).json(f"{at}/report.json")


@query("SELECT unnest(['config_used.json', 'homography_used.json', 'run.log']) AS name")
def snk19_provenance(spark: SparkSession, sf: str) -> DataFrame:
    at = local(folder(spark))
    store.write_text(f"{at}/homography_used.json", "{}")
    K.save_provenance(f"{at}/run", {"a": 1}, [f"{at}/homography_used.json", f"{at}/missing.json"])
    return spark.createDataFrame([(n,) for n in store.names(f"{at}/run/provenance") if not n.startswith(".")], "name string")


@query(sql(CLICKS, then=f"SELECT {r('u', 2)} AS u, {r('v', 2)} AS v, {r('x', 3)} AS E, {r('y', 3)} AS N FROM ck"))
def snk21_click_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-21, then SRC-08."""
    at = folder(spark)
    c = rnd(clicks(spark, sf).select("u", "v", F.col("x").alias("E"), F.col("y").alias("N")), 3)
    K.write_csv(K.click_rows(c.withColumn("u", F.floor(F.col("u") * 100 + 0.5) / 100).withColumn("v", F.floor(F.col("v") * 100 + 0.5) / 100)), at)
    return R.click_pairs(spark, at)


@query("SELECT * FROM (VALUES ('data', 'points.csv'), ('data', 'raw_tracks.csv'), ('fields', 'vector_field_people.csv'), ('provenance', 'config_used.yaml')) t(place, name)")
def snk22_run_layout(spark: SparkSession, sf: str) -> DataFrame:
    """A flat run of old, opened: each file in its place, none over another."""
    at = local(folder(spark))
    for f in ("raw_tracks.csv", "points.csv", "config_used.yaml", "vector_field_people.csv", "data/points.csv"):
        store.write_text(f"{at}/run/{f}", f)
    folders = K.open_run(f"{at}/run")
    return spark.createDataFrame([(place, n) for place, path in folders.items() for n in store.names(str(path)) if not n.startswith(".")], "place string, name string")


@query("SELECT * FROM (VALUES (1, 'site: here'), (2, 'camera_position:  # again'), (3, '  E: 2.0'), (4, '  N: 3.5'), (5, 'fps: 25')) t(line, text)")
def snk23_camera_position(spark: SparkSession, sf: str) -> DataFrame:
    at = local(folder(spark))
    store.write_text(f"{at}/site.yaml", "site: here\ncamera_position:  # first\n  E: 1.0\n  N: 9.0\n  height_m: 4\nfps: 25\n")
    K.write_camera_position(f"{at}/site.yaml", {"E": 2.0, "N": 3.5}, "again")
    return spark.createDataFrame(list(enumerate(store.read_text(f"{at}/site.yaml").splitlines(), 1)), "line int, text string")


@query("SELECT site, " + ", ".join(f"round({v}, 1) AS {n}" for n, v in (
    ("height_m", "1.5 + 3.1 * coalesce(CASE WHEN length(site) % 3 > 0 THEN length(site) % 3 END, 0) + 0.1 * height_m"),
    ("position_tol_m", "greatest(5.0, coalesce(CASE WHEN image_w > 2000 THEN rmse_m * 40 END, 20.0) / 2)"),
    ("height_tol_m", "greatest(1.0, 0.06 * (1.5 + 3.1 * coalesce(CASE WHEN length(site) % 3 > 0 THEN length(site) % 3 END, 0) + 0.1 * height_m))"))) + " FROM calibrations")
def cal23_placed_cameras(spark: SparkSession, sf: str) -> DataFrame:
    """Floors and sizes are made up of the sites' columns, some of them null."""
    floor = F.length("site") % 3
    p = table(spark, sf, "calibrations").select("site", F.col("origin_e").alias("E"), F.col("origin_n").alias("N"), F.when(F.col("image_w") > 2000, F.col("rmse_m") * 40).alias("size_m"), F.when(floor > 0, floor.cast("double")).alias("floor"), (0.1 * F.col("height_m")).alias("ground_m"))
    return C.placed_cameras(p).select("site", "height_m", "position_tol_m", "height_tol_m")
