"""Command line: mark duplicates in a SAM or BAM file, or compare two marked files."""

from __future__ import annotations

import argparse
import sys
import time

from . import __version__


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="twinmark", description=__doc__)
    p.add_argument("-V", "--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    m = sub.add_parser("mark")
    m.add_argument("-i", "--input", required=True)
    m.add_argument("-o", "--output", required=True)
    m.add_argument("--compression-level", type=int, default=0)
    m.add_argument("-r", "--remove-dups", action="store_true")
    for flag in ("add-mate-tags", "ignore-unmated", "library-unaware"):
        m.add_argument(f"--{flag}", action="store_true")
    m.add_argument("--max-read-length", type=int, default=1000)
    m.add_argument("--single-end-strategy", default="strand-aware")
    m.add_argument("--methylation-mode")
    m.add_argument("--stats")
    m.add_argument("--sample")
    m.add_argument("-q", "--quiet", action="store_true")
    m.add_argument("--min-bins", type=int, default=32, help=argparse.SUPPRESS)
    crc = m.add_mutually_exclusive_group()
    crc.add_argument("--check-crc", action="store_true", default=None, dest="check_crc")
    crc.add_argument("--no-check-crc", action="store_false", dest="check_crc")
    c = sub.add_parser("compare")
    c.add_argument("--picard-bam", required=True)
    c.add_argument("--partner-bam", required=True)
    c.add_argument("--partner-label", required=True)
    c.add_argument("--sample", required=True)
    for name in ("setcmp-tsv", "orphan-tsv", "inheritance-tsv", "dump-pe-discordant"):
        c.add_argument(f"--{name}")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    """The exit status: 0, or 1 for errors and, with the output written, for clamped templates."""
    args = _parser().parse_args(argv)
    from pyspark.sql import SparkSession

    began = time.time()
    try:
        spark = spark or SparkSession.builder.appName("twinmark").getOrCreate()
        from .plans import runs

        status = runs.mark(spark, args, sys.argv if argv is None else ["twinmark", *argv]) if args.command == "mark" else runs.compare_files(spark, args)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if not getattr(args, "quiet", False):
        print(f"took {time.time() - began:.1f} s", file=sys.stderr)
    return status


if __name__ == "__main__":
    sys.exit(main())
