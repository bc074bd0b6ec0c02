"""Types of the tables and their closed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

L, D, S, B = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


#: Positions that were implicit in lists are columns: segment_index, event_index.
SEGMENTS = _table(start_frame=L, end_frame=L, start_sec=D, end_sec=D, duration_sec=D)
RALLIES = _table(segment_index=L, score_a=L, score_b=L, server=S, game_index=L, sub_scores=T.ArrayType(T.ArrayType(L)), split_secs=T.ArrayType(D))
COURTS = _table(corners=T.ArrayType(T.ArrayType(D)), homography=T.ArrayType(T.ArrayType(D)), segment_index=L)
FRAMES = _table(frame=L, segment_index=L, player=S, keypoints=T.ArrayType(T.ArrayType(D)), bbox=T.ArrayType(D))
POINTS = _table(frame=L, segment_index=L, method=S, x=D, y=D, visible=B, confidence=D)
EVENTS = _table(frame=L)
STROKES = _table(event_index=L, frame=L, segment_index=L, player=S, stroke_type=S, confidence=D)
STATUS = _table(name=S, status=S, started_at=S, finished_at=S, output_path=S, error=S, updated_at=S)

# The stages' states, the sides and the court in metres.
STATES = ("pending", "running", "completed", "failed")
PLAYERS = ("top", "bottom")
COURT_WIDTH, COURT_LENGTH = 6.10, 13.41
