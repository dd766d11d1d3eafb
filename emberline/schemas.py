"""Explicit schemas; no reader in this package infers one."""

from pyspark.sql import types as T

_S, _D, _I, _L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


FIRES = _struct(Id=_S, area=_D, end_date=T.DateType(), lat=_D, lon=_D, ratiocci=_D, start_date=T.DateType())
FIRES_TEST = _struct(Id=_S, area=_D, lat=_D, lon=_D, start_date=T.DateType(), end_date=T.DateType(), label_sel=_I)
BBOXES = _struct(
    Id=_S, start_date=T.DateType(), end_date=T.DateType(), center_lat=_D, center_lon=_D,
    half_width_km=_D, half_height_km=_D, min_lon=_D, min_lat=_D, max_lon=_D, max_lat=_D,
    area=_D, lat=_D, lon=_D, label_sel=_I,
)
THRESHOLDS = _struct(fire_id=_S, pos=_I, day_i4=_D, day_i5=_D, night_i4=_D, night_i5=_D)
FEATURE_SETS = _struct(task=_S, name=_S, channels=_I, groups=T.ArrayType(_S), status=_S)
SCENES = _struct(
    fire_id=_S, source=_S, ts=T.TimestampNTZType(), file_name=_S, path=_S, n_bands=_I, height=_I, width=_I,
)
PIXELS = _struct(fire_id=_S, source=_S, ts=T.TimestampNTZType(), row=_I, col=_I, bands=T.ArrayType(T.FloatType()))
PREDICTIONS = _struct(case_id=_S, frame=_I, row=_I, col=_I, prob=_D, label=_I)

RUN_PLAN = _struct(tool_name=_S, rationale=_S, params=T.MapType(_S, _S))
RUN_RESULT = _struct(
    tool_name=_S, status=_S, return_code=_I, stdout=_S, stderr=_S, command=T.ArrayType(_S),
    artifact_path=_S, started_at=_S, finished_at=_S,
)
RUN_EVALUATION = _struct(decision=_S, summary=_S, metrics=T.MapType(_S, _D))
RUN_STATE = _struct(
    task=_S, state_path=_S, created_at=_S, updated_at=_S,
    history=T.ArrayType(_struct(timestamp=_S, plan=RUN_PLAN, result=RUN_RESULT, evaluation=RUN_EVALUATION)),
)
RUNS = _struct(
    task=_S, step=_I, timestamp=_S, tool_name=_S, rationale=_S, params=T.MapType(_S, _S), status=_S,
    return_code=_I, stdout=_S, stderr=_S, command=T.ArrayType(_S), started_at=_S, finished_at=_S,
    decision=_S, summary=_S, metrics=T.MapType(_S, _D),
)
