"""Explicit schemas of every record; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _row(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


L, S, D = T.LongType(), T.StringType(), T.DoubleType()
VECTOR = T.ArrayType(T.FloatType())

VIDEO = _row(video_id=S, path=S)
SHOT = _row(shot_id=L, start_frame=L, end_frame=L, start_ms=L, end_ms=L)
SHOT_MANIFEST = _row(video_id=S, video_path=S, fps=D, frame_count=L, shots=T.ArrayType(SHOT))
SAMPLE = _row(frame_ms=L, sample=S)
FRAME = _row(source_index=L, shot_uid=S, video_id=S, video_path=S, shot_id=L, shot_start_ms=L, shot_end_ms=L, frame_ms=L, sample=S)
TASK = _row(task_id=S, description=S)
CANDIDATE = _row(
    video_id=S, video_path=S, shot_id=L, shot_start_ms=L, shot_end_ms=L, frame_ms=L, sample=S, score=D, rank=L, embedding_score=D
)
CANDIDATE_LIST = _row(task_id=S, candidates=T.ArrayType(CANDIDATE), results=T.ArrayType(CANDIDATE))
RESULT = _row(rank=L, video_id=S, frame_ms=L)
PREDICTION = _row(task_id=S, results=T.ArrayType(RESULT))
SUBMISSION = _row(predictions=T.ArrayType(PREDICTION))
PROGRESS = _row(
    task_id=S, task_index=L, task_total=L, candidate_shots=L, coarse_frames=L, fine_centers=L, fine_frames=L, seconds=D, result=PREDICTION
)
FAILURE = _row(video_id=S, video_path=S, error_type=S, error=S)
SHARD = _row(index=L, count=L, dimension=L, embeddings=S, metadata=S, first_source_index=L, last_source_index=L)
