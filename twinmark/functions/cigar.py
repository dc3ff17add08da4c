"""CIGAR expressions; all are built-in functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_OP_LENGTH = (1 << 28) - 1


def op_texts(cigar: Column) -> Column:
    """Array of the operations' texts, like 5S."""
    return F.regexp_extract_all(cigar, F.lit(r"([0-9]+[MIDNSHP=X])"), F.lit(1))


def is_valid(cigar: Column) -> Column:
    """Every operation has a length of 1 to 2**28-1 and a known letter; * and the empty text have none."""
    plain = cigar.rlike(r"^(\*|([1-9][0-9]{0,7}[MIDNSHP=X])*)$")  # lengths of up to eight digits are small enough
    lengths = F.regexp_extract_all(cigar, F.lit(r"([0-9]+)"), F.lit(1))
    small = F.forall(lengths, lambda x: F.length(F.regexp_replace(x, "^0+", "")).between(1, 9) & x.try_cast("long").between(1, MAX_OP_LENGTH))
    return F.when(plain, F.lit(True)).otherwise(cigar.rlike(r"^(\*|([0-9]+[MIDNSHP=X])*)$") & small)


def _total(cigar: Column, ops: str) -> Column:
    found = F.regexp_extract_all(cigar, F.lit(rf"([0-9]+)[{ops}]"), F.lit(1))
    return F.aggregate(found, F.lit(0), lambda a, x: a + x.cast("int"))


def summary(cigar: Column) -> dict[str, Column]:
    """sclip, eclip, ra_len and qa_len. Soft and hard clips before the first of M, = and X are at the start, the others at the end."""
    # most reads have one M, with or without soft clips: cut at the letters, without lists of operations
    plain = cigar.rlike("^([0-9]{1,9}S)?[0-9]+M([0-9]{1,9}S)?$")
    before, after = F.substring_index(cigar, "M", 1), F.substring_index(cigar, "M", -1)
    clip = lambda c: F.when(F.endswith(c, F.lit("S")), F.substring_index(c, "S", 1).try_cast("int")).otherwise(0)
    head = F.when(F.contains(before, F.lit("S")), F.substring_index(before, "S", 1).try_cast("int")).otherwise(0)
    front = F.regexp_extract(cigar, r"^((?:[0-9]+[IDNSHP])*)", 1)
    fast = lambda a, c: F.when(plain, a).otherwise(c)
    start, size = _total(front, "SH"), F.substring_index(before, "S", -1).try_cast("int")
    return {"sclip": fast(head, start), "eclip": fast(clip(after), _total(cigar, "SH") - start), "ra_len": fast(size, _total(cigar, "MDN=X")), "qa_len": fast(size, _total(cigar, "MI=X"))}


def as_text(ops: Column) -> Column:
    return F.when(F.size(ops) == 0, F.lit("*")).otherwise(F.array_join(ops, ""))
