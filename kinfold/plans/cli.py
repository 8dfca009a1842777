"""Command line: python -m kinfold.plans.cli --csv a.csv --notes b.txt [--config c.json] [--output d.json]"""

from __future__ import annotations

import argparse
import json
import logging
import re
import sys
import time

from kinfold import __version__
from kinfold.plans.pipeline import public, run, to_document
from kinfold.plans.project import ProjectionConfig
from kinfold.session import build_session
from kinfold.sources.records import files_of, load

FLAGS = {"csv": "recruiter_csv", "json": "ats_json", "linkedin": "linkedin", "github": "github", "resume-pdf": "resume_pdf", "resume-docx": "resume_docx", "notes": "recruiter_notes"}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Fuse person records from several sources.")
    for flag, source in FLAGS.items():
        p.add_argument(f"--{flag}", action="append", dest=source, metavar="PATH")
    p.add_argument("--config", help="projection config (JSON)")
    p.add_argument("--output", help="file for the document; standard output without it")
    p.add_argument("--quiet", action="store_true", help="no report")
    p.add_argument("--verbose", action="store_true", help="records by source, and more of the log")
    p.add_argument("--version", action="version", version=f"kinfold {__version__}")
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.WARNING, stream=sys.stderr)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    sources = {s: v for s in FLAGS.values() if (v := getattr(args, s))}
    if not sources:
        print("no sources given", file=sys.stderr)
        return 1
    began = time.time()
    try:
        spark = build_session("kinfold")
        # user names and addresses of the live services are no files
        remote = {p for s in ("linkedin", "github") for p in sources.get(s, []) if "://" in p or not re.search(r"[/\\\\]|^[.]|[.]json$", p)}
        missing = []
        for path in sorted({p for v in sources.values() for p in v} - remote):
            try:
                files_of(spark, [path])
            except FileNotFoundError:
                missing.append(path)
        if missing:
            print(f"no such file: {', '.join(missing)}", file=sys.stderr)
            return 1
        if args.verbose:
            for source, paths in sources.items():
                print(f"{source}: {load(spark, {source: paths}).count()} record(s)", file=sys.stderr)
        config = ProjectionConfig.from_file(args.config) if args.config else ProjectionConfig()
        document = public(to_document(run(spark, sources, config), config))
    except Exception as e:  # noqa: BLE001  the command line reports and exits
        print(f"failed: {e}", file=sys.stderr)
        return 1
    text = json.dumps(document, indent=2, ensure_ascii=False)
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    else:
        print(text)
    if not args.quiet:
        print(f"{document.get('count', 1)} profile(s) in {time.time() - began:.3f} s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
