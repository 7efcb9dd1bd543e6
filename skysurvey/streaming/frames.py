"""Selection of video frames: blur, darkness and likeness to the last frame kept, in batches and as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skysurvey.session import ship

#: V3: defaults of the gate.
BLUR, DISTANCE, BLACK = 200.0, 10.0, 0.98


def absolute_black(lowest: Column, span: Column, share: float = 0.30) -> Column:
    """Luminance below which a pixel is black, from a recording's minimum and largest range."""
    return lowest + share * span


def black_ratio(luminance: DataFrame, frame: str, limit: DataFrame) -> DataFrame:
    """The share of black pixels of every frame; limit is one row with ``black_below``."""
    dark = F.avg((F.col("value") < F.col("black_below")).cast("double"))
    return luminance.crossJoin(F.broadcast(limit)).groupBy(frame).agg(dark.alias("black"))


def frame_time(index: Column, rate: Column, base: Column) -> Column:
    """V4: seconds of a frame from the recording's start and frame rate."""
    return base + index / rate


def video_starts(videos: DataFrame, by: str) -> DataFrame:
    """Of each flight, the first video starts at its file's time, each later one after the length of the current one."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy("ord")
    own = F.when(F.row_number().over(w) == 1, F.lit(0.0)).otherwise(F.col("frames") / F.col("rate"))
    return videos.withColumn("_own", own).withColumn("start", F.first("file_time").over(w) + F.sum("_own").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_own")


def early_verdict(blur: Column, black: Column, blur_limit: float | None = BLUR, black_limit: float | None = BLACK) -> Column:
    """V1: 'blurry' or 'black' for frames that never reach the likeness test."""
    out = F.when(F.lit(False), "")
    if blur_limit is not None:
        out = out.when(blur < blur_limit, "blurry")
    if black_limit is not None:
        out = out.when(black >= black_limit, "black")
    return out


def gate(last: float | None, values: list[float], distance: float) -> tuple[float | None, list[bool]]:
    """V2: which values differ from the last one kept by at least the distance."""
    kept = []
    for v in values:
        keep = last is None or abs(v - last) >= distance
        if keep:
            last = v
        kept.append(keep)
    return last, kept


def select_frames(frames: DataFrame, video: str, order: str, feature: str, distance: float = DISTANCE) -> DataFrame:
    """V1, V2: frames with ``verdict``: blurry, black, similar or kept.

    The likeness test is sequential in a recording, so each recording is one group; it
    reads two numbers a frame.
    """
    early = frames.withColumn("verdict", early_verdict(F.col("blur"), F.col("black")))
    rest = early.filter("verdict IS NULL").select(video, order, feature)
    kind = {f.name: f.dataType.simpleString() for f in rest.schema.fields}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        _, kept = gate(None, frame[feature].tolist(), distance)
        return pd.DataFrame({video: frame[video], order: frame[order], "_kept": kept})

    ship(frames.sparkSession)
    judged = rest.groupBy(video).applyInPandas(run, f"{video} {kind[video]}, {order} {kind[order]}, _kept boolean")
    joined = early.join(judged, [video, order], "left")
    return joined.withColumn("verdict", F.coalesce("verdict", F.when(F.col("_kept"), "kept").otherwise("similar"))).drop("_kept")


class FrameGate(StatefulProcessor):
    """V2 as a stream: the state of a recording is the feature of its last kept frame."""

    def __init__(self, order: str, feature: str, distance: float):
        self.order, self.feature, self.distance = order, feature, distance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.order)
        before = self.last.get()[0] if self.last.exists() else None
        last, kept = gate(before, frame[self.feature].tolist(), self.distance)
        if last is not None:
            self.last.update((last,))
        out = frame[kept]
        if len(out):
            yield pd.DataFrame({"video": [key[0]] * len(out), "at": out[self.order].to_numpy(), "value": out[self.feature].to_numpy(float)})

    def close(self) -> None:
        pass


_STATE = "value double"
_OUT = "video long, at timestamp, value double"


def stream_frames(frames: DataFrame, video: str, order: str, feature: str, distance: float = DISTANCE) -> DataFrame:
    """V2 as a stream: (video, at, value) of the kept frames.

    Frames of a recording must arrive in order of time; each micro-batch is sorted.
    """
    ship(frames.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(batches)).sort_values(order)
        last, kept = gate(state.get[0] if state.exists else None, frame[feature].tolist(), distance)
        if last is not None:
            state.update((last,))
        out = frame[kept]
        yield pd.DataFrame({"video": [key[0]] * len(out), "at": out[order].to_numpy(), "value": out[feature].to_numpy(float)})

    return frames.groupBy(video).applyInPandasWithState(step, _OUT, _STATE, "append", "NoTimeout")


def stream_positions(fixes: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Fixes by window and recording with a watermark: count, mean place and distinct cells."""
    return (
        fixes.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "track")
        .agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.approx_count_distinct(F.floor("x")).alias("cells"))
        .select(F.col("w.start").alias("start"), "track", "n", "x", "y", "cells")
    )


def stream_flights(fixes: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Flights: sessions of fixes without a longer gap."""
    return fixes.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "track").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "track", "n")
