"""python -m echotrace index PATHS | scan PATHS | find QUERY | status | reset, over the store in --root."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from pathlib import Path

from . import __version__
from .config import Settings, data_dir
from .engine import Engine
from .plans import report
from .session import local_session
from .sources.decoder import Decoder
from .sources.frames import Extractor, ProjectionExtractor
from .sources.remote import RemoteExtractor

log = logging.getLogger("echotrace")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="echotrace", description="Partial near-duplicates over timestamped vectors.")
    top.add_argument("--version", action="version", version=__version__)
    verbs = top.add_subparsers(dest="verb", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--root", default=None, help="the store's folder")
    footage = argparse.ArgumentParser(add_help=False)
    footage.add_argument("--fps", type=float, default=2.0, help="frames a second")
    footage.add_argument("--keyframes", action="store_true", help="keyframes at their own times instead")
    footage.add_argument("--no-crop", action="store_true", help="leave borders on")
    footage.add_argument("--no-mirror", action="store_true", help="no mirrored frames")
    footage.add_argument("--batch-size", type=int, default=64)
    footage.add_argument("--size", type=int, default=224, help="side of a frame in pixels")
    footage.add_argument("--endpoint", help="a service that embeds frames; without it, a fixed projection")
    footage.add_argument("--model", default="projection")
    footage.add_argument("--dim", type=int, default=64, help="components of a vector")
    footage.add_argument("--api-key", default=os.environ.get("ECHOTRACE_API_KEY"))
    shown = argparse.ArgumentParser(add_help=False)
    shown.add_argument("--json", type=Path, help="write the result as JSON")
    verbs.add_parser("index", parents=[shared, footage], help="add videos").add_argument("paths", nargs="+")
    scan = verbs.add_parser("scan", parents=[shared, footage, shown], help="add videos, then compare all that are indexed")
    scan.add_argument("paths", nargs="*", help="none: only compare")
    scan.add_argument("--robust", action="store_true", help="sampled-consensus lines instead of line votes")
    verbs.add_parser("find", parents=[shared, footage, shown], help="compare one video with the index").add_argument("query")
    verbs.add_parser("status", parents=[shared], help="what is indexed")
    verbs.add_parser("reset", parents=[shared], help="delete the store").add_argument("-y", "--yes", action="store_true")
    return top


def extractor(args: argparse.Namespace):
    """A function that makes the extractor, on the worker."""
    size, dim, endpoint, model, key = args.size, args.dim, args.endpoint, args.model, args.api_key

    def make() -> Extractor:
        return RemoteExtractor(endpoint, model, dim, key) if endpoint else ProjectionExtractor(size, dim)

    return make


def main(argv: list[str] | None = None, spark=None, ask=input, tools: dict | None = None) -> int:
    args = parser().parse_args(argv)
    if os.environ.get("ECHOTRACE_LOG_FILE"):
        logging.basicConfig(filename=os.environ["ECHOTRACE_LOG_FILE"], level=logging.INFO)
    footage = args.verb in ("index", "scan", "find")
    settings = Settings(fps=args.fps, batch_size=max(1, args.batch_size), mirror=not args.no_mirror, frame_size=args.size) if footage else Settings()
    engine = Engine(spark or local_session(), args.root or str(data_dir()), settings)
    decoder = Decoder(size=args.size, fps=args.fps, keyframes=args.keyframes, crop=not args.no_crop, min_std=settings.min_frame_std, **(tools or {})) if footage else None
    if args.verb == "reset":
        if not args.yes and ask("Delete the store? [y/N] ").strip().lower() not in ("y", "yes"):
            return 1
        engine.reset()
        return 0
    if args.verb == "status":
        for r in engine.status().orderBy("video_id").toLocalIterator():
            print(f"{r['video_id']:>6} {r['frames']:>8} {r['duration']:>8} {r['path']}")
        print(f"{engine.store.videos().count()} video(s), {engine.store.n_vectors()} vector(s) total")
        return 0
    if args.verb in ("index", "scan") and args.paths:
        rows = {r["status"]: r["count"] for r in engine.index_paths(args.paths, decoder, extractor(args)).groupBy("status").count().collect()}
        log.info("indexed %s", rows)
        print(f"Indexed {rows.get('complete', 0)} new video(s)." + "".join(f" {n} {s}." for s, n in sorted(rows.items()) if s != "complete"))
        if args.verb == "index":
            return 0
    if args.verb == "find":
        if engine.store.n_vectors() == 0:
            print("The index is empty.", file=sys.stderr)
            return 1
        found = engine.find(engine.query_frames(args.query, decoder, extractor(args)), args.query).persist()
    else:
        found = engine.scan(args.robust).persist()
    if args.json:
        args.json.write_text(report.to_json(found), encoding="utf-8")
    print(report.render(found.toLocalIterator()))
    none = found.isEmpty()
    found.unpersist()
    return int(none)


if __name__ == "__main__":
    sys.exit(main())
