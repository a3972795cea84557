"""python -m lacegraph <align|assmbl> [options] <input> <output>"""

from __future__ import annotations

import argparse
import logging
from dataclasses import fields

from .config import Options, size_in_bytes
from .plans.pipeline import run
from .session import LOG, session


def options_from(args: argparse.Namespace) -> Options:
    given = {f.name: getattr(args, f.name) for f in fields(Options) if getattr(args, f.name, None) is not None}
    return Options(**given)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lacegraph", description=__doc__)
    p.add_argument("phase", choices=("align", "assmbl"))
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("-k", type=int)
    p.add_argument("-w", type=int)
    p.add_argument("-t", "--threads", type=int, help="local threads; on a cluster its manager decides")
    p.add_argument("--tempdir", dest="work_dir", help="shared folder for tables between steps")
    p.add_argument("--block-nbase", dest="block_bases", type=size_in_bytes)
    p.add_argument("--strict", action="store_true", default=None, help="edge rules of the sketch by a scan with a pending minimum")
    for name, kind in (("min_span", int), ("min_match", int), ("min_depth", int), ("min_identity", float), ("max_hang", int), ("min_overlap", int), ("int_fraction", float), ("gap_fuzz", int), ("rounds", int), ("bubble_distance", int), ("max_extension", int), ("radius", int), ("max_gap", int), ("min_count", int), ("min_chain", int), ("occ_fraction", float), ("occ_cap", int), ("task_seeds", int)):
        p.add_argument(f"--{name.replace('_', '-')}", dest=name, type=kind)
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = session(f"local[{args.threads}]" if args.threads else None)
    logging.basicConfig(level=logging.WARNING)
    LOG.setLevel(logging.INFO)
    run(spark, args.phase, args.input, args.output, options_from(args))


if __name__ == "__main__":
    main()
