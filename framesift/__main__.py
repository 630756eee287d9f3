"""python -m framesift COMMAND: see --help. Plug-ins are named module:factory; the default ones are surrogates."""

from __future__ import annotations

import argparse
import functools
import importlib
import json

from framesift import models
from framesift.plans import commands
from framesift.session import session


def plugin(name: str):
    module, _, factory = name.partition(":")
    return getattr(importlib.import_module(module), factory)


def embedder(name: str, dimension: int):
    """The surrogate is told its dimension; other factories know theirs."""
    make = plugin(name)
    return functools.partial(make, dimension) if make is models.HashEmbedder else make


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="framesift")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *flags: str, parts: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for flag in flags:
            many = flag.endswith("+")
            p.add_argument(f"--{flag.rstrip('+')}", required=True, **({"action": "append"} if many else {}))
        if parts:
            p.add_argument("--partition-index", type=int, default=0)
            p.add_argument("--partitions", type=int, default=1)
        return p

    p = sub.add_parser("doctor")
    p.add_argument("--plugin", action="append", default=[])
    p.add_argument("--path", action="append", default=[])
    p = add("shots", "dataset-root+", "out", parts=True)
    p.add_argument("--detector", default="framesift.models:GridDetector")
    p.add_argument("--dry-run", type=int, default=0)
    p.add_argument("--overwrite", action="store_true")
    p = add("make-manifest", "shots-dir", "video-root", "output")
    p.add_argument("--long-shot-fps", type=float, default=0.25)
    p.add_argument("--strict-videos", action="store_true")
    p = add("embed-corpus", "manifest", "output-dir", parts=True)
    p.add_argument("--dimension", type=int, default=4096)
    p.add_argument("--shard-size", type=int, default=2048)
    p.add_argument("--reader", action="append")
    p.add_argument("--embedder", default="framesift.models:HashEmbedder")
    p.add_argument("--max-image-side", type=int, default=512)
    p.add_argument("--batch-size", type=int, default=2)
    p = add("retrieve", "tasks", "corpus-dir+", "output", parts=True)
    p.add_argument("--top-k", type=int, default=3000)
    p.add_argument("--reuse", action="store_true")
    p.add_argument("--embedder", default="framesift.models:HashEmbedder")
    p.add_argument("--instruction", default="")
    p.add_argument("--query-batch-size", type=int, default=2)
    p = add("rerank", "tasks", "candidates+", "shots-dir", "video-root", "output-dir", parts=True)
    for flag, kind, value in (("candidate-limit", int, 500), ("fine-top-k", int, 30), ("fine-window-ms", int, 750), ("fine-fps", float, 8.0), ("long-shot-fps", float, 1.0), ("max-predictions", int, 10)):
        p.add_argument(f"--{flag}", type=kind, default=value)
    p.add_argument("--reader", action="append")
    p.add_argument("--scorer", default="framesift.models:HashScorer")
    p.add_argument("--instruction", default="")
    p.add_argument("--score-chunk-size", type=int, default=4)
    p.add_argument("--max-image-side", type=int, default=512)
    add("merge-candidates", "input+", "tasks", "output")
    add("merge-submissions", "input+", "tasks", "output-dir")
    p = add("validate", "tasks", "submission")
    p.add_argument("--shots-dir")
    return top


def main(args: list[str] | None = None) -> dict:
    a = parser().parse_args(args)
    spark = session()
    readers = [plugin(x) for x in getattr(a, "reader", None) or ["framesift.models:HashReader"]]
    if a.command == "doctor":
        out = commands.doctor(spark, [plugin(x) for x in a.plugin], a.path)
    elif a.command == "shots":
        out = commands.make_shots(spark, a.dataset_root, a.out, plugin(a.detector), a.partition_index, a.partitions, a.dry_run, a.overwrite)
    elif a.command == "make-manifest":
        out = commands.make_manifest(spark, a.shots_dir, a.video_root, a.output, a.long_shot_fps, a.strict_videos)
    elif a.command == "embed-corpus":
        out = commands.embed_corpus(spark, a.manifest, a.output_dir, readers, embedder(a.embedder, a.dimension), a.dimension, a.shard_size, a.partition_index, a.partitions,
                                    side=a.max_image_side, batch_size=a.batch_size)
    elif a.command == "retrieve":
        dimension = commands.corpus.describe(spark, a.corpus_dir[0])["dimension"]
        out = commands.retrieve(spark, a.tasks, a.corpus_dir, a.output, embedder(a.embedder, dimension), a.top_k, a.partition_index, a.partitions, a.reuse, a.instruction, a.query_batch_size)
    elif a.command == "rerank":
        out = commands.rerank_tasks(spark, a.tasks, a.candidates, a.shots_dir, a.video_root, a.output_dir, readers, plugin(a.scorer), a.candidate_limit, a.fine_top_k,
                                    a.fine_window_ms, a.fine_fps, a.long_shot_fps, a.max_predictions, a.partition_index, a.partitions,
                                    instruction=a.instruction, chunk=a.score_chunk_size, side=a.max_image_side)
    elif a.command == "merge-candidates":
        out = commands.merge_candidates(spark, a.input, a.tasks, a.output)
    elif a.command == "merge-submissions":
        out = commands.merge_submissions(spark, a.input, a.tasks, a.output_dir)
    else:
        out = commands.validate_submission(spark, a.submission, a.tasks, a.shots_dir)
    print(json.dumps(out, ensure_ascii=False))
    return out


if __name__ == "__main__":
    main()
