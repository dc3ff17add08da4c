"""Fields of SAM text lines: parsing, aux tags, sequence and quality."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import cigar

FIELDS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
#: Largest values of the unsigned fields.
LIMITS = {"flag": 65535, "mapq": 255}


def parse(line: Column) -> dict[str, Column]:
    """The eleven fields, typed, the aux fields as an array of texts, and the first thing that is wrong with the line (null: nothing)."""
    parts = F.split(F.regexp_replace(line, "\r$", ""), "\t")
    out = {name: F.get(parts, F.lit(i)) for i, name in enumerate(FIELDS)}
    wrong = F.when(F.size(parts) < 11, F.lit("fewer than 11 fields")).when(F.octet_length(out["qname"]) > 254, F.lit("QNAME is too long"))
    for name in ("flag", "mapq"):
        out[name] = F.when(out[name].rlike("^[0-9]+$"), out[name].try_cast("int"))
        wrong = wrong.when(out[name].isNull() | (out[name] > LIMITS[name]), F.lit(f"bad {name.upper()}"))
    for name in ("pos", "pnext", "tlen"):
        out[name] = F.when(out[name].rlike("^[+-]?[0-9]+$"), out[name].try_cast("int"))
        wrong = wrong.when(out[name].isNull(), F.lit(f"bad {name.upper()}"))
    wrong = wrong.when(~cigar.is_valid(out["cigar"]), F.lit("bad CIGAR"))
    wrong = wrong.when((out["qual"] != "*") & (out["seq"] != "*") & (F.length(out["qual"]) != F.length(out["seq"])), F.lit("SEQ and QUAL differ in length"))
    out["pos"], out["pnext"] = F.greatest(out["pos"], F.lit(0)), F.greatest(out["pnext"], F.lit(0))
    out["rnext"] = F.when(out["rnext"] == "=", out["rname"]).otherwise(out["rnext"])
    out["aux"] = F.filter(F.slice(parts, 12, F.greatest(F.size(parts) - 11, F.lit(0))), lambda x: x != "")
    wrong = wrong.when(~F.forall(out["aux"], aux_is_valid), F.lit("bad optional field"))
    return out | {"error": wrong}


def aux_struct(texts: Column) -> Column:
    """Array of (tag, type, value) structs from TG:T:value texts, in order, repeats kept."""
    return F.transform(texts, lambda x: F.struct(F.substring(x, 1, 2).alias("tag"), F.substring(x, 4, 1).alias("type"), F.substr(x, F.lit(6)).alias("value")))


def aux_is_valid(text: Column) -> Column:
    """Shape, type code, and the value's range by type."""
    value, kind = F.substr(text, F.lit(6)), F.substring(text, 4, 1)
    number = r"[+-]?[0-9]+"
    items = F.slice(F.split(value, ","), 2, F.greatest(F.size(F.split(value, ",")) - 1, F.lit(0)))
    ranges = {"c": (-128, 127), "C": (0, 255), "s": (-32768, 32767), "S": (0, 65535), "i": (-(1 << 31), (1 << 31) - 1), "I": (0, (1 << 32) - 1)}
    array = F.lit(False)
    for sub, (lo, hi) in ranges.items():
        array = array | ((F.substring(value, 1, 1) == sub) & F.forall(items, lambda x: x.rlike(f"^{number}$") & x.try_cast("long").between(lo, hi)))  # noqa: B023
    array = array | ((F.substring(value, 1, 1) == "f") & F.forall(items, lambda x: x.try_cast("float").isNotNull()))
    by_kind = (
        F.when(kind == "A", F.octet_length(value) == 1).when(kind == "i", value.rlike(f"^{number}$") & value.try_cast("int").isNotNull())
        .when(kind == "f", value.try_cast("float").isNotNull()).when(kind.isin("Z", "H"), F.lit(True)).when(kind == "B", array).otherwise(F.lit(False))
    )
    return text.rlike("(?s)^..:.:") & F.coalesce(by_kind, F.lit(False))


def int_subtype(value: Column) -> Column:
    """The smallest BAM type that holds a 32-bit integer."""
    return (
        F.when(value.between(0, 255), "C").when(value.between(256, 65535), "S").when(value > 65535, "I")
        .when(value.between(-128, -1), "c").when(value.between(-32768, -129), "s").otherwise("i")
    )


def packable_seq(seq: Column) -> Column:
    """The sequence as four-bit codes can hold it: acgtn become capitals, other letters outside the alphabet N."""
    return F.regexp_replace(F.translate(seq, "acgtn", "ACGTN"), "[^=ACMGRSVTWYHKDBN]", "N")


def phred(qual: Column) -> Column:
    """Qualities as numbers; * has none (255 for each base in BAM)."""
    return F.when(qual != "*", F.transform(F.split(qual, ""), lambda c: F.pmod(F.ascii(c) - 33, F.lit(256))))
