"""Stages of a processing run as a graph of DataFrame functions, rerun planning and option rules."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from skysurvey.operators.sets import option_changes

#: The order of a run's stages.
STAGES = ("dataset", "split", "merge", "reconstruction", "points", "filterpoints", "meshing", "texturing", "georeferencing", "dem", "orthophoto", "report", "postprocess")

#: Defaults of the options that the operators read.
DEFAULTS = {
    "primary_band": "auto", "radiometric_calibration": "none", "crop": 3.0, "boundary_distance": 0.0, "pc_filter": 5.0, "pc_sample": 0.0,
    "smrf_scalar": 1.25, "smrf_slope": 0.15, "smrf_threshold": 0.5, "smrf_window": 18.0, "gapfill_steps": 3, "dem_resolution": 5.0, "dem_decimation": 1,
    "orthophoto_resolution": 5.0, "split": 999999, "split_overlap": 150.0, "merge": "all", "gps_accuracy": 3.0, "gps_z_offset": 0.0,
    "video_limit": 500, "video_resolution": 4000, "camera_lens": "auto", "rolling_shutter_readout": 0.0,
}
#: The first stage that an option affects.
STAGE_OF = {
    "primary_band": "dataset", "gps_accuracy": "dataset", "gps_z_offset": "dataset", "video_limit": "dataset", "video_resolution": "dataset", "camera_lens": "dataset",
    "split": "split", "split_overlap": "split", "merge": "merge", "radiometric_calibration": "reconstruction", "rolling_shutter_readout": "reconstruction",
    "pc_filter": "filterpoints", "pc_sample": "filterpoints", "boundary_distance": "filterpoints", "crop": "georeferencing",
    "smrf_scalar": "dem", "smrf_slope": "dem", "smrf_threshold": "dem", "smrf_window": "dem", "gapfill_steps": "dem", "dem_resolution": "dem", "dem_decimation": "dem",
    "orthophoto_resolution": "orthophoto",
}
#: Defaults of ground rectification.
RECTIFY = {"plan": "median", "threshold": 5.0, "extend_plan": "surrounding", "distance": 5.0, "min_area": 750.0, "min_points": 500}


def options(given: Mapping[str, object], settings: Mapping[str, object] | None = None) -> dict[str, object]:
    """Defaults, then settings, then what was given, with the rules that follow from them."""
    out = {**DEFAULTS, **(settings or {}), **given}
    if out.get("dtm") or out.get("pc_rectify"):
        out["pc_classify"] = True
    if out.get("fast_orthophoto"):
        out["skip_3dmodel"] = True
    if out.get("cutline") and not out.get("crop"):
        out["crop"] = 0.01
    return out


def path_or_json(value: str, read: Callable[[str], str]) -> dict:
    """A JSON text, or the path of one."""
    text = value.strip()
    return json.loads(text if text.startswith(("{", "[")) else read(text))


def submodel_options(given: Mapping[str, object], keep: Mapping[str, object], drop: Sequence[str]) -> dict[str, object]:
    """Options for a part of a set: some assured, some removed, the crop made small."""
    out = {k: v for k, v in given.items() if k not in drop}
    out.update(keep)
    if out.get("crop") == 0:
        out["crop"] = 0.015625
    return out


def rerun_stages(current: Mapping[str, object], previous: Mapping[str, object]) -> list[str]:
    """U13."""
    text = lambda m: {k: str(v) for k, v in m.items()}
    return option_changes(text(current), text(previous), STAGE_OF, STAGES)


@dataclass
class Stage:
    """A named step: inputs by name to one output table."""

    name: str
    inputs: tuple[str, ...]
    run: Callable[..., DataFrame]


@dataclass
class Run:
    """A graph of stages; each output is written once and read again by the stages after it."""

    spark: SparkSession
    folder: str
    stages: list[Stage] = field(default_factory=list)

    def add(self, name: str, *inputs: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
        def register(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.stages.append(Stage(name, inputs, fn))
            return fn

        return register

    def execute(self, tables: Mapping[str, DataFrame], first: str | None = None) -> dict[str, DataFrame]:
        """All stages in order; stages before ``first`` are read from their earlier output."""
        known = dict(tables)
        started = first is None
        for stage in self.stages:
            started = started or stage.name == first
            path = f"{self.folder}/{stage.name}"
            if started:
                stage.run(*(known[i] for i in stage.inputs)).write.mode("overwrite").parquet(path)
            known[stage.name] = self.spark.read.parquet(path)
        return known


def per_submodel(df: DataFrame, key: str, fn: Callable, schema: str) -> DataFrame:
    """V7, V8: an external step for each submodel as a grouped map; the scheduler repeats failed ones."""
    from skysurvey.session import ship

    ship(df.sparkSession)
    return df.groupBy(key).applyInPandas(fn, schema)
