"""Documents and files: what is computed comes as a DataFrame, what is small is written by the driver."""

from __future__ import annotations

import json
import shutil
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rounded
from .store import exists, read_text, write_text

TRACK = ["clip", "track_id"]


def write_csv(df: DataFrame, path: str, order: list[str] | None = None, parts: list[str] | None = None) -> None:
    """SNK-01, 02, 05, 06, 09, 10, 11, 12, 16: header, overwritten, sorted within files that cover ranges of the order;
    parts become folders."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    w = out.write.mode("overwrite").option("header", True)
    (w.partitionBy(*parts) if parts else w).csv(path)


def write_parquet(df: DataFrame, path: str, parts: list[str] | None = None) -> None:
    """SNK-03."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*parts) if parts else w).parquet(path)


def raw_rows(boxes: DataFrame) -> DataFrame:
    """SNK-01: rounded as raw tracks are published."""
    return boxes.select(*[c for c in boxes.columns if c not in ("x1", "y1", "x2", "y2", "time_s")], rounded(F.col("time_s"), 4).alias("time_s"), *[rounded(F.col(c), 2).alias(c) for c in ("x1", "y1", "x2", "y2")])


def run_summary(boxes: DataFrame) -> DataFrame:
    """SNK-04: per clip: rows, tracks, predicted rows, first and last frame."""
    return boxes.groupBy("clip").agg(F.count("*").alias("rows"), F.count_distinct("track_id").alias("tracks"), F.sum(F.col("predicted").cast("long")).alias("predicted"), F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"))


def _coords(points: Column) -> Column:
    return F.transform(points, lambda p: F.array(rounded(p["x"], 3), rounded(p["y"], 3)))


def track_features(points: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """SNK-07: a GeoJSON feature per track as text: the line without repeated vertices, of at least two, and the
    summary's columns as properties (missing ones null)."""
    w = Window.partitionBy(*TRACK).orderBy("frame")
    p = points.withColumn("_x", rounded(F.col("x"), 3)).withColumn("_y", rounded(F.col("y"), 3))
    p = p.where("_x is not null and _y is not null").withColumn("_same", (F.col("_x") == F.lag("_x").over(w)) & (F.col("_y") == F.lag("_y").over(w)))
    lines = p.where("not coalesce(_same, false)").groupBy(*TRACK).agg(F.array_sort(F.collect_list(F.struct("frame", "x", "y"))).alias("_v")).where(F.size("_v") >= 2)
    lines = lines.select(*TRACK, F.size("_v").alias("vertices"), _coords(F.col("_v")).alias("_c"))
    props = ["track_id"]
    if summary is not None:
        extra = [c for c in summary.columns if c not in TRACK]
        lines = lines.join(summary.select(*TRACK, *extra), TRACK, "left")
        props += extra
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.col("_c").alias("coordinates")).alias("geometry"), F.struct(*props).alias("properties")), {"ignoreNullFields": "false"})
    return lines.select(*TRACK, "vertices", feature.alias("feature"))


def predicted_gaps(points: DataFrame) -> DataFrame:
    """SNK-08: runs of rows that weren't detected, with the row before and after: kind (the most frequent source, the
    first by name on ties), first and last frame, vertices."""
    w = Window.partitionBy(*TRACK).orderBy("frame")
    p = points.withColumn("_p", F.lag("frame").over(w)).withColumn("_q", F.lead("frame").over(w)).withColumn("_g", F.sum((~F.col("pred")).cast("long")).over(w)).where("pred")
    kinds = p.groupBy(*TRACK, "_g", "source").agg(F.count("*").alias("n"), F.min("frame").alias("a"), F.max("frame").alias("b"), F.min(F.coalesce("_p", "frame")).alias("p"), F.max(F.coalesce("_q", "frame")).alias("q"))
    g = kinds.groupBy(*TRACK, "_g").agg(F.min(F.struct(-F.col("n"), F.coalesce("source", F.lit("predicted")))).alias("k"), F.sum("n").alias("n"), F.min("p").alias("start_frame"), F.max("q").alias("end_frame"))
    return g.select(*TRACK, F.col("k.col2").alias("kind"), "n", "start_frame", "end_frame")


def write_geojson(features: DataFrame, path: str, crs: str = "urn:ogc:def:crs:EPSG::27700") -> None:
    """SNK-07: one FeatureCollection per clip is a line-delimited file of features; crs goes beside it."""
    features.select("clip", "feature").write.mode("overwrite").partitionBy("clip").text(path)
    write_text(f"{path}/crs.json", json.dumps({"type": "name", "properties": {"name": crs}}))


def stats_document(blocks: DataFrame) -> DataFrame:
    """SNK-11: scope and its blocks as one JSON text per scope."""
    inner = F.struct(*[c for c in blocks.columns if c != "scope"])
    return blocks.groupBy("scope").agg(F.to_json(F.array_sort(F.collect_list(inner)), {"ignoreNullFields": "false"}).alias("document"))


def click_rows(clicks: DataFrame) -> DataFrame:
    """SNK-21: with two decimals for pixels and three for metres, as plain numbers."""
    plain = lambda c, places: F.regexp_replace(F.format_number(F.col(c), places), ",", "").alias(c)
    return clicks.select(*[plain(c, 2) for c in ("u", "v")], *[plain(c, 3) for c in ("E", "N")])


def save_calibration(path: str, matrix: list[float], origin: list[float], size: list[int], **more) -> None:
    """SNK-17: a calibration as JSON; paths in more are kept relative to its folder."""
    folder = Path(path).resolve().parent
    base = {k: str(Path(v).resolve().relative_to(folder)) if isinstance(v, Path) and Path(v).resolve().is_relative_to(folder) else (str(v) if isinstance(v, Path) else v) for k, v in more.items()}
    write_text(path, json.dumps({"H": [matrix[k : k + 3] for k in (0, 3, 6)], "origin": origin, "image_size": size} | base, indent=1))


def save_report(path: str, rows: DataFrame, most: int = 1000) -> None:
    """SNK-18: a report of a few hundred rows as JSON; more than most rows are refused, not cut."""
    lines = [r[0] for r in rows.select(F.to_json(F.struct("*"))).limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError(f"a report has at most {most} rows; write longer tables with write_csv or write_parquet")
    write_text(path, "[" + ",\n".join(lines) + "]")


def save_provenance(run: str, config: dict, inputs: list[str]) -> None:
    """SNK-19: the settings and copies of the inputs of a run, and a log that says when."""
    folder = Path(run, "provenance")
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "config_used.json").write_text(json.dumps(config, indent=1, default=str))
    for p in inputs:
        if Path(p).is_file():
            shutil.copy2(p, folder / Path(p).name)
    with (folder / "run.log").open("a") as log:
        log.write(f"{datetime.now():%Y-%m-%d %H:%M:%S} inputs {', '.join(Path(p).name for p in inputs)}\n")


#: Folders of a run, and where files of a flat one belong.
FOLDERS = ["data", "fields", "images", "labels", "videos", "provenance"]
PLACES = {"raw_tracks.csv": "data", "points.csv": "data", "track_metrics.csv": "data", "stats.json": "data", "tracks.geojson": "data", "config_used.yaml": "provenance"}


def open_run(path: str) -> dict[str, Path]:
    """SNK-22: the folders of a run; files of an old flat run are moved to theirs, never over others."""
    run = Path(path)
    for f in FOLDERS:
        (run / f).mkdir(parents=True, exist_ok=True)
    for name, folder in PLACES.items():
        old, new = run / name, run / folder / name
        if old.is_file() and not new.exists():
            old.rename(new)
    for old in run.glob("vector_field*.csv"):
        if not (run / "fields" / old.name).exists():
            old.rename(run / "fields" / old.name)
    return {f: run / f for f in FOLDERS}


def write_camera_position(path: str, camera: dict, note: str = "") -> None:
    """SNK-23: the camera_position block of a YAML file, replaced where it stands or added at the end; every other line stays as it is."""
    lines = read_text(path).splitlines() if exists(path) else []
    kept: list[str] = []
    place, inside = None, False
    for line in lines:
        if line.startswith("camera_position:"):
            place, inside = len(kept), True
        elif inside and line[:1] in (" ", "\t"):
            continue
        else:
            inside = False
            kept.append(line)
    title = "camera_position:" + (f"  # {note}" if note else "")
    at = len(kept) if place is None else place
    kept[at:at] = [title, *(f"  {name}: {value}" for name, value in camera.items())]
    write_text(path, "\n".join(kept) + "\n")
