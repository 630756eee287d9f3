"""Where a video may lie."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: identifiers of the two known collections, a digit and a number.
COLLECTION = r"^v3c([12])_([0-9]+)$"


def video_id_parts(video_id: Column) -> Column:
    """(collection, short_id) of an identifier in any case; null for others."""
    low = F.lower(video_id)
    known = low.rlike(COLLECTION)
    parts = F.struct(F.concat(F.lit("V3C"), F.regexp_extract(low, COLLECTION, 1)).alias("collection"), F.regexp_extract(low, COLLECTION, 2).alias("short_id"))
    return F.when(known, parts)


def path_candidates(root: Column | str, video_id: Column, hint: Column) -> Column:
    """Places to look for a video, in order: the hint, those of its collection, those by its identifier."""
    root = F.lit(root) if isinstance(root, str) else root
    parts = video_id_parts(video_id)
    collection, short = parts["collection"], parts["short_id"]
    file = F.concat(short, F.lit(".mp4"))
    of_collection = F.array(
        F.concat_ws("/", root, collection, F.lit("videos"), short, file), F.concat_ws("/", root, F.lit("videos"), short, file),
        F.concat_ws("/", root, short, file), F.concat_ws("/", root, collection, file),
    )
    own = F.concat(video_id, F.lit(".mp4"))
    nothing = F.array().cast("array<string>")
    return F.concat(
        F.when(F.coalesce(hint, F.lit("")) != "", F.array(hint)).otherwise(nothing),
        F.when(parts.isNotNull(), of_collection).otherwise(nothing),
        F.array(F.concat_ws("/", root, own), F.concat_ws("/", root, video_id, own)),
    )


def fallback_path(candidates: Column, hint: Column) -> Column:
    """The path to name if none exists: the first that isn't the hint."""
    return F.when((F.coalesce(hint, F.lit("")) != "") & (F.size(candidates) > 1), candidates[1]).otherwise(candidates[0])
