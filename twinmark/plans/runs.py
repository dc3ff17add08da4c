"""Runs over files: what the command line does."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..operators import compare, headers
from ..sources import bam, sam, tsv
from .marking import MarkDuplicates
from .options import Options


def load(spark: SparkSession, path: str, check_crc: bool = True) -> tuple[list[str], DataFrame]:
    """Header lines, and records with ord, rec_idx and the lifted tags, of a SAM or BAM file."""
    if bam.detect_format(path) == "bam":
        lines, _, _ = bam.read_header(path, check_crc)
        rows = sam.numbered(bam.read(spark, path, checkCrc=str(check_crc)), ["split"], "row").drop("split", "row")
    else:
        text = sam.scan(spark, path)
        lines = [r.value.rstrip("\r") for r in sam.header_lines(text).orderBy("line_no").collect()]
        rows = sam.records(text)
        sam.check(rows)
        rows = rows.drop("error")
    return lines, sam.lifted(sam.blocks(rows))


def header_frame(spark: SparkSession, lines: list[str]) -> DataFrame:
    return headers.parse_header(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string"))


def options_of(args) -> Options:
    return Options(
        remove_dups=args.remove_dups, add_mate_tags=args.add_mate_tags, ignore_unmated=args.ignore_unmated, max_read_length=args.max_read_length, single_end_strategy=args.single_end_strategy,
        library_unaware=args.library_unaware, methylation_mode=args.methylation_mode, sample=args.sample, min_bins=args.min_bins, compression_level=args.compression_level, check_crc=args.check_crc,
    )


def mark(spark: SparkSession, args, argv: list[str]) -> int:
    options = options_of(args)
    if "-" in (args.input, args.output):
        raise ValueError("standard input and output can't be split or joined by tasks; name files")
    if not args.output.endswith(".bam"):
        raise ValueError("the output's name must end with .bam")
    lines, rows = load(spark, args.input, options.check_crc is not False)
    header = header_frame(spark, lines)
    contigs = headers.contigs(header)
    if contigs.isEmpty():
        raise ValueError("the header has no @SQ lines")
    command = " ".join([os.path.basename(argv[0]), *argv[1:]])
    programs = headers.with_program(spark, headers.programs(header), "TWINMARK", __version__, command)
    known = sum(x.startswith("@PG") for x in lines)
    out_lines = lines + ["\t".join(["@PG", f"ID:{r.id}", f"PN:{r.pn}", f"VN:{r.vn}", *([f"PP:{r.pp}"] if r.pp else []), f"CL:{r.cl}"]) for r in programs.tail(max(1, programs.count() - known))]
    run = MarkDuplicates(rows, contigs, headers.read_groups(header), options)
    run.check()
    if args.stats:
        tsv.write(run.metrics, args.stats)
    records = run.records()
    if options.add_mate_tags:
        records = sam.aux_with_mates(records)
    bam.write(records, args.output, out_lines, options.compression_level)
    clamped = run.clamped()
    if not args.quiet:
        total = run.counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("dups"), F.lit(0))).first()
        print(f"marked {total[1]} of {total[0]} templates", file=sys.stderr)
    if clamped:
        print(f"error: {clamped} templates have ends beyond their contig; raise --max-read-length", file=sys.stderr)
    return int(bool(clamped))


def compare_files(spark: SparkSession, args) -> int:
    _, a = load(spark, args.picard_bam)
    _, b = load(spark, args.partner_bam)
    joined = compare.compared(a.select("qname", "flag", "kf"), b.select("qname", "flag")).cache()
    compare.check(joined)
    sets = compare.duplicate_sets(joined)
    compare.set_concordance(sets).show(truncate=False)
    compare.singleton_marks(sets).show(truncate=False)
    named = lambda df: df.select(F.lit(args.sample).alias("sample"), F.lit(args.partner_label).alias("partner"), "*")
    if args.setcmp_tsv:
        tsv.append(compare.concordance_row(sets, args.sample, args.partner_label), args.setcmp_tsv)
    if args.orphan_tsv:
        tsv.append(named(compare.orphan_triage(joined)), args.orphan_tsv)
    if args.inheritance_tsv:
        for rows, tool in ((a, "picard"), (b, args.partner_label)):
            tsv.append(compare.inheritance(rows.select("qname", "flag"), tool).select(F.lit(args.sample).alias("sample"), "*"), args.inheritance_tsv)
    if args.dump_pe_discordant:
        compare.discordant_pairs(sets).orderBy("group_key").write.mode("overwrite").option("sep", "\t").option("header", True).csv(args.dump_pe_discordant)
    return 0



