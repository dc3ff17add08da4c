"""Genome positions: the 5' end, padding and clamping, packed keys, bins."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .flags import REVERSE, has


def five_prime(pos: Column, flag: Column, sclip: Column, eclip: Column, ra_len: Column) -> Column:
    return F.when(has(flag, REVERSE), pos + ra_len + eclip - 1).otherwise(pos - sclip)


def clamp(p5: Column, length: Column, max_read_length: int) -> Column:
    """The position within the contig's padded block."""
    return F.greatest(F.lit(-max_read_length), F.least(length + max_read_length, p5))


def packed(seq_num: Column, kpos: Column, rev: Column, max_read_length: int) -> Column:
    """One BIGINT for contig, clamped position and strand: 30, 32 and 1 bits."""
    return F.shiftleft(seq_num.cast("long"), 33).bitwiseOR(F.shiftleft((kpos + max_read_length).cast("long"), 1)).bitwiseOR(rev.cast("long"))


def reg2bin(beg: Column, end: Column, placed: Column) -> Column:
    """Bin of the half-open interval in the five-level R-tree of the BAM format; 4680 where placed is false."""
    last = F.greatest(end, beg + 1) - 1
    out = None
    # First bin and shift of each level.
    for first, shift in ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26)):
        same = F.shiftright(beg, shift) == F.shiftright(last, shift)
        out = (F if out is None else out).when(same, F.lit(first) + F.shiftright(beg, shift))
    return F.when(~placed, F.lit(4680)).otherwise(out.otherwise(0)).cast("int")


def bin_layout(lengths: list[int], max_read_length: int, min_bins: int = 32) -> tuple[list[int], int, int]:
    """Offsets of the padded contigs (the unplaced one first) on one axis, the bins' shift and their number."""
    offsets, total = [], 0
    for length in [0, *lengths]:
        offsets.append(total)
        total += length + 2 * max_read_length + 1
    shift = next((s for s in range(32, -1, -1) if -(-total // (1 << s)) >= max(1, min_bins)), 0)
    return offsets, shift, -(-total // (1 << shift))
