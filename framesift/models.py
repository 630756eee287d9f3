"""Plug-ins for what isn't relational: detecting segments, reading frames, embedding, scoring.

A plug-in is made by a factory, once a Python worker and task, and gets batches. The surrogates are pure
functions of their input, so results can be checked anywhere. ``name_of`` tells one plug-in from another: commands keep it
beside what they write, and refuse to go on with another one."""

from __future__ import annotations

import functools
import hashlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.functions import pixels

SEED = 2026


class Detector(Protocol):
    def ranges(self, path: str) -> list[list[float]]: ...

    def meta(self, path: str) -> tuple[float, int]: ...


class FrameReader(Protocol):
    """Bytes are taken as they are; pixels (an array) are made to fit and stored as a pixmap."""

    name: str

    def read(self, path: str, frame_ms: int) -> bytes | np.ndarray | None: ...


class Embedder(Protocol):
    def embed(self, items: list[Any], instruction: str = "") -> np.ndarray: ...


class PairScorer(Protocol):
    def score(self, query: str, images: list[bytes], instruction: str = "") -> list[float]: ...


def name_of(factory: Any) -> str:
    """Which plug-in a factory makes: its module and name; with its arguments for ``functools.partial``, and with its code
    and what it refers to for a lambda. A ``plugin_name`` of its own (with the version of a model, say) comes first."""
    if isinstance(factory, functools.partial):
        given = [repr(x) for x in factory.args] + [f"{k}={v!r}" for k, v in sorted(factory.keywords.items())]
        return f"{name_of(factory.func)}({', '.join(given)})"
    if own := getattr(factory, "plugin_name", None):
        return str(own)
    name = f"{getattr(factory, '__module__', '')}:{getattr(factory, '__qualname__', type(factory).__qualname__)}"
    if "<lambda>" in name:
        cells = [name_of(c.cell_contents) if callable(c.cell_contents) else repr(c.cell_contents) for c in factory.__closure__ or ()]
        code = factory.__code__
        parts = repr((code.co_code, code.co_names, [c for c in code.co_consts if not hasattr(c, "co_code")], cells))
        name += "#" + hashlib.sha256(parts.encode()).hexdigest()[:16]
    return name


class OpenFiles:
    """What readers keep open: at most ``most`` handles, the one that was used longest ago is closed first."""

    def __init__(self, open_file: Callable[[str], Any], most: int = 8):
        self.open_file, self.most, self.held = open_file, max(1, most), OrderedDict()

    def get(self, path: str) -> Any:
        if path in self.held:
            self.held.move_to_end(path)
        else:
            self.held[path] = self.open_file(path)
            while len(self.held) > self.most:
                self._close(self.held.popitem(last=False)[1])
        return self.held[path]

    def close(self) -> None:
        while self.held:
            self._close(self.held.popitem()[1])

    @staticmethod
    def _close(handle: Any) -> None:
        for name in ("close", "release"):
            if hasattr(handle, name):
                getattr(handle, name)()
                return


class HashReader:
    """A frame's bytes are its address; paths with ``fail`` in them can't be read."""

    name = "hash"

    def read(self, path: str, frame_ms: int) -> bytes | None:
        return None if "fail" in path else f"{path}@{frame_ms}".encode()


class HashEmbedder:
    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, items: list[Any], instruction: str = "") -> np.ndarray:
        out = np.empty((len(items), self.dimension), np.float32)
        for k, item in enumerate(items):
            raw = item if isinstance(item, bytes) else str(item).encode()
            raw = f"{instruction}\0".encode() + raw if instruction else raw
            seed = int.from_bytes(hashlib.sha256(raw).digest()[:8], "big") ^ SEED
            out[k] = np.random.default_rng(seed).normal(size=self.dimension)
        return out


class PaintReader:
    """Pixels by a rule, for frames of any size; only paths that end in .paint can be read."""

    name = "paint"

    def __init__(self, width: int = 64, height: int = 48):
        self.width, self.height = width, height

    def read(self, path: str, frame_ms: int) -> np.ndarray | None:
        if not path.endswith(".paint"):
            return None
        y, x = np.mgrid[: self.height, : self.width]
        return np.stack([x * 3 + frame_ms, y * 5, x + y], 2).astype(np.uint8)


class HashScorer:
    def score(self, query: str, images: list[bytes], instruction: str = "") -> list[float]:
        query = f"{instruction}\0{query}" if instruction else query
        return [int.from_bytes(hashlib.sha256(query.encode() + b"\0" + x).digest()[:4], "big") / 2**32 for x in images]


class GridDetector:
    """Segments of 40, 80, 120, ... frames, by the path's hash."""

    def meta(self, path: str) -> tuple[float, int]:
        return 25.0, 200 + int(hashlib.sha256(path.encode()).hexdigest()[:4], 16) % 400

    def ranges(self, path: str) -> list[list[float]]:
        if "fail" in path:
            raise ValueError("cannot detect")
        n, at, out = self.meta(path)[1], 0, []
        while at < n:
            out.append([float(at), float(at + 39 + 40 * len(out))])
            at += 40 + 40 * (len(out) - 1)
        return out


def detect(videos: DataFrame, factory: Callable[[], Detector]) -> DataFrame:
    """``videos`` (video_id, path) with fps, frame_count, ranges, error_type and error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            rows = []
            for video_id, path in zip(batch["video_id"], batch["path"]):
                try:
                    fps, n = model.meta(path)
                    rows.append((video_id, path, float(fps), int(n), model.ranges(path), None, None))
                except Exception as e:  # a video's failure is a row, not the job's
                    rows.append((video_id, path, None, None, None, type(e).__name__, str(e)))
            yield pd.DataFrame(rows, columns=["video_id", "path", "fps", "frame_count", "ranges", "error_type", "error"])

    schema = "video_id string, path string, fps double, frame_count long, ranges array<array<double>>, error_type string, error string"
    return videos.select("video_id", "path").mapInPandas(run, schema)


def read_frames(frames: DataFrame, factories: list[Callable[[], FrameReader]], side: int = 512) -> DataFrame:
    """``frames`` (video_path, frame_ms) with image, decoder and error: the first reader that can. Frames of a
    video are read together and in order. Pixels are made to fit ``side`` (0: any size)."""
    schema = T.StructType([*frames.schema.fields, T.StructField("image", T.BinaryType()), T.StructField("decoder", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = [f() for f in factories]
        for batch in batches:
            images, names, errors = [], [], []
            for path, at in zip(batch["video_path"], batch["frame_ms"]):
                image, name, error = None, None, None
                for reader in readers:
                    try:
                        image = reader.read(path, int(at))
                        if isinstance(image, np.ndarray):
                            image = pixels.to_ppm(pixels.fit_within(image, side))
                    except Exception as e:
                        error = f"{reader.name}: {e}"
                    if image is not None:
                        name, error = reader.name, None
                        break
                images.append(image), names.append(name), errors.append(error if image is not None or error else "not decoded")
            yield batch.assign(image=images, decoder=names, error=errors)
        for reader in readers:
            if hasattr(reader, "close"):
                reader.close()

    return frames.repartition("video_path").sortWithinPartitions("video_path", "frame_ms").mapInPandas(run, schema)


def embed(items: DataFrame, column: str, factory: Callable[[], Embedder], dimension: int, out: str = "embedding", instruction: str = "", batch_size: int = 0) -> DataFrame:
    """``items`` with the embedding of ``column``: truncated to ``dimension``, of unit length. The plug-in gets
    ``batch_size`` items at once (0: as many as an Arrow batch has)."""
    schema = T.StructType([*(f for f in items.schema.fields if f.name != column), T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            if len(batch):
                given, every = batch[column].tolist(), batch_size or len(batch)
                parts = [given[a : a + every] for a in range(0, len(given), every)]
                m = np.concatenate([np.asarray(model.embed(x, instruction) if instruction else model.embed(x), np.float64)[:, :dimension] for x in parts])
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                yield batch.drop(columns=[column]).assign(**{out: list(m.astype(np.float32))})

    return items.mapInPandas(run, schema)


def score(frames: DataFrame, factory: Callable[[], PairScorer], query: str = "description", instruction: str = "", chunk: int = 0) -> DataFrame:
    """``frames`` (query text, image) with reranker_score, without the image. The plug-in gets ``chunk`` images of a query
    at once (0: all of an Arrow batch)."""
    schema = T.StructType([*(f for f in frames.schema.fields if f.name != "image"), T.StructField("reranker_score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            scores = pd.Series(0.0, index=batch.index)
            for text, group in batch.groupby(query, sort=False):
                images, every = [bytes(x) for x in group["image"]], chunk or len(group)
                parts = [images[a : a + every] for a in range(0, len(images), every)]
                scores.loc[group.index] = [v for x in parts for v in (model.score(str(text), x, instruction) if instruction else model.score(str(text), x))]
            yield batch.drop(columns=["image"]).assign(reranker_score=scores)

    return frames.mapInPandas(run, schema)


def read_and_score(readers: list[Callable[[], FrameReader]], scorer: Callable[[], PairScorer], side: int = 512, instruction: str = "", chunk: int = 0) -> Callable[[DataFrame], DataFrame]:
    """For ``Rerank``: frames that can't be read drop out."""

    def run(frames: DataFrame) -> DataFrame:
        seen = read_frames(frames, readers, side).where(F.col("image").isNotNull()).drop("decoder", "error")
        return score(seen, scorer, instruction=instruction, chunk=chunk)

    return run


def can_make(spark: SparkSession, factory: Callable[[], Any]) -> str:
    """Whether the plug-in can be made in a task: ``ok``, or what went wrong."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                factory()
                said = "ok"
            except Exception as e:  # the report is the result
                said = f"{type(e).__name__}: {e}"
            yield pd.DataFrame({"said": [said] * len(batch)})

    return spark.range(1).mapInPandas(run, "said string").first()["said"]
