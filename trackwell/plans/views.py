"""Operator inputs derived from the base tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwell.sources.y4m import write_mono

BOXES = """
SELECT event_id AS det_id, CAST(floor(event_id / 8) AS BIGINT) AS frame_index, x1, y1, x1 + w AS x2, y1 + h AS y2, conf AS confidence
FROM (SELECT event_id, CAST((user_id * 37 + event_id * 11) % 560 AS DOUBLE) AS x1, CAST((user_id * 53 + event_id * 7) % 400 AS DOUBLE) AS y1,
             CAST(12 + (event_id * 13) % 90 AS DOUBLE) AS w, CAST(12 + (event_id * 17) % 90 AS DOUBLE) AS h,
             CAST(30 + (event_id * 29 + user_id) % 70 AS DOUBLE) / 100 AS conf FROM events) t"""

OBS = """
SELECT det_id, frame_index, obj_id, x1, y1, x1 + 40 AS x2, y1 + 50 AS y2, confidence,
       (CAST(floor(frame_index / 20) AS BIGINT) + obj_id) % 4 <> 0 AS observed
FROM (SELECT event_id AS det_id, CAST(floor(event_id / 8) AS BIGINT) AS frame_index, CAST(event_id % 8 AS INT) AS obj_id,
             CAST(20 + 30 * (event_id % 8) + CAST(floor(event_id / 8) AS BIGINT) % 40 + user_id % 5 AS DOUBLE) AS x1,
             CAST(60 + (CAST(floor(event_id / 8) AS BIGINT) * 2) % 80 + user_id % 7 AS DOUBLE) AS y1,
             CAST(30 + (event_id * 29 + user_id) % 70 AS DOUBLE) / 100 AS confidence FROM events) t"""

ANCHORS = """
SELECT event_id AS anchor_id, CAST(floor(event_id / 50) AS BIGINT) AS frame_index,
       CASE event_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END AS stride, CAST((event_id * 7 + user_id) % 400 AS INT) AS cell,
       value / 100 AS cls, CAST((event_id * 31) % 110 AS DOUBLE) / 100 AS obj,
       CAST((event_id * 3) % 10 AS DOUBLE) / 10 AS dx, CAST((event_id * 7) % 10 AS DOUBLE) / 10 AS dy,
       CAST((event_id * 11) % 20 AS DOUBLE) / 10 AS dw, CAST((event_id * 13) % 20 AS DOUBLE) / 10 AS dh
FROM events"""

VIDEOS = "SELECT user_id AS id, CAST(count(*) AS DOUBLE) * 0.75 + 0.05 AS duration, CAST(30 AS DOUBLE) AS fps FROM events GROUP BY user_id"

PROGRESS = """
SELECT event_id, user_id, CAST(event_id * 3 % 101 AS DOUBLE) AS phase_percent, element_at(PHASES, CAST(event_id % 10 + 1 AS INT)) AS phase,
       CASE WHEN event_id % 3 = 0 THEN event_type END AS description, CASE WHEN event_id % 5 < 2 THEN event_id % 1000 END AS done FROM events"""

VIEWS = {"boxes": BOXES, "obs": OBS, "anchors": ANCHORS, "videos": VIDEOS}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(VIEWS[name].replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


@lru_cache(maxsize=1)
def _local_folder(master: str) -> str:
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only a local run without one gets its own."""
    return (spark.conf.get("spark.checkpoint.dir", None) or _local_folder(spark.conf.get("spark.master"))).rstrip("/")


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress records made from events, see PROGRESS."""
    from trackwell.operators.selection import PHASES

    names = ", ".join(f"'{p}'" for p in (*(p for p, _ in PHASES), "done", "idle"))
    text = PROGRESS.replace("PHASES", f"array({names})").replace("FROM events", "FROM {events}")
    return spark.sql(text, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RECORDED = """
SELECT CAST(floor(event_id / 5000) AS BIGINT) AS video, event_id % 5000 AS frame_index, (event_id * 7 + user_id) % 256 AS value FROM events"""


#: Pixels of a frame of the recorded videos; and of one with spots, which are a row of squares as high as the frame, wide enough that a detector's boxes count as faces.
PLAIN, SPOTTED = (8, 4), (96, 12)


def recorded(spark: SparkSession, sf_dir: str, spots: bool = False) -> str:
    """Writes the events as uncompressed videos of 5,000 frames, a frame an event, to the shared folder, and returns their folder.

    All 8 x 4 pixels of a frame have its value; or, with spots, frames are eight squares of 12 x 12 pixels, two of them bright and the rest dark.
    """
    folder = f"{shared_folder(spark)}/videos-{uuid.uuid4().hex}"
    frames = spark.sql(RECORDED.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    width, height = SPOTTED if spots else PLAIN
    if spots:
        squares = width // height
        bright = lambda p: (p == F.col("value") % squares) | (p == (F.col("value") * 3 + 5) % squares)
        row = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(squares - 1)), lambda p: F.when(bright(p), "FF" * height).otherwise("10" * height)), "")
        luma = F.unhex(F.repeat(row, height))
    else:
        luma = F.unhex(F.repeat(F.lpad(F.hex("value"), 2, "0"), width * height))
    write_mono(frames.select("video", "frame_index", F.lit(width).alias("width"), F.lit(height).alias("height"), luma.alias("luma")), folder, "video").count()
    return folder
