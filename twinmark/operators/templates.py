"""From alignment rows to classified templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import positions as P
from ..functions.flags import FIRST, LAST, MATE_UNMAPPED, NOT_PRIMARY, PAIRED, REVERSE, UNMAPPED, has


def group_runs(rows: DataFrame) -> DataFrame:
    """Add ord, from 0: the number of the run of equal qnames, by line_no. A name that comes back later is a new run.

    Runs are counted within pieces of the input and the pieces' counts summed up, so no task sees all rows; only a row before
    each piece and one count per piece are exchanged. rows: line_no long, qname.
    """
    width = 1 << 16
    piece = rows.withColumn("_piece", F.expr(f"line_no div {width}"))
    own, pieces = Window.partitionBy("_piece").orderBy("line_no"), Window.orderBy("_piece")
    before = piece.groupBy("_piece").agg(F.max_by("qname", "line_no").alias("_last")).select("_piece", F.lag("_last").over(pieces).alias("_before"))
    lagged = piece.join(before, "_piece", "left").withColumn("_prev", F.coalesce(F.lag("qname").over(own), F.when(F.row_number().over(own) == 1, F.col("_before"))))
    new = F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col("qname")), 1).otherwise(0)
    marked = lagged.withColumn("_run", F.sum(new.cast("long")).over(own))
    counts = marked.groupBy("_piece").agg(F.max("_run").alias("_runs"))
    # one row per piece of 65,536 rows
    sums = counts.withColumn("_first", F.sum("_runs").over(pieces.rowsBetween(Window.unboundedPreceding, -1)))
    out = marked.join(sums.select("_piece", F.coalesce("_first", F.lit(0)).alias("_first")), "_piece")
    return out.withColumn("ord", F.col("_first") + F.col("_run") - 1).select(*rows.columns, "ord")


def primary(flag: Column) -> Column:
    return ~has(flag, NOT_PRIMARY)


def slot(flag: Column) -> Column:
    """1 or 2 for primary rows: unpaired rows and second ends are 2; null for rows without a slot."""
    return F.when(primary(flag), F.when(~has(flag, PAIRED), 2).when(has(flag, FIRST), 1).when(has(flag, LAST), 2))


def with_ends(rows: DataFrame, contigs: DataFrame, max_read_length: int = 1000) -> DataFrame:
    """Add sclip, eclip, ra_len, qa_len, seq_num (0: *, null: no such contig), p5, kpos, rev, lpos (unclipped left end) and lkpos."""
    dims = contigs.select(F.col("name").alias("rname"), "length", F.col("seq_num"))
    out = rows.join(F.broadcast(dims), "rname", "left").withColumns(C.summary(F.col("cigar")))
    star = F.col("rname") == "*"
    out = out.withColumns({"seq_num": F.when(star, F.lit(0)).otherwise(F.col("seq_num")), "length": F.when(star, F.lit(0)).otherwise(F.col("length"))})
    p5 = P.five_prime(F.col("pos"), F.col("flag"), F.col("sclip"), F.col("eclip"), F.col("ra_len"))
    out = out.withColumns({"p5": p5, "lpos": F.col("pos") - F.col("sclip"), "rev": has(F.col("flag"), REVERSE)})
    out = out.withColumns({"kpos": P.clamp(F.col("p5"), F.col("length"), max_read_length), "lkpos": P.clamp(F.col("lpos"), F.col("length"), max_read_length)})
    return out.drop("length")


def bad_reference_ids(ends: DataFrame) -> DataFrame:
    """Mapped primary rows on contigs that the header doesn't have."""
    return ends.filter(primary(F.col("flag")) & ~has(F.col("flag"), UNMAPPED) & F.col("seq_num").isNull())


END = ("flag", "mapq", "seq_num", "p5", "kpos", "rev", "lpos", "lkpos")


def templates(ends: DataFrame, cigars: bool = False) -> DataFrame:
    """One row per ord: lib_idx (of the first row), first and second: the last primary row of each slot, or null.

    Fields are aggregated one by one: numbers let the aggregation hash, where structs and texts would sort. So the ends' CIGARs come on request only.
    """
    which, fields = slot(F.col("flag")), (*END, "cigar") if cigars else END
    pick = lambda k, c: F.max_by(F.when(which == k, F.col(c)), F.when(which == k, F.col("rec_idx"))).alias(f"_{k}_{c}")
    rows = ends.groupBy("ord").agg(F.min_by("lib_idx", "rec_idx").alias("lib_idx"), *(pick(k, c) for k in (1, 2) for c in fields))
    end = lambda k: F.when(F.col(f"_{k}_flag").isNotNull(), F.struct(*(F.col(f"_{k}_{c}").alias(c) for c in fields)))
    return rows.select("ord", "lib_idx", end(1).alias("first"), end(2).alias("second"))


_TOLD = PAIRED | UNMAPPED | MATE_UNMAPPED


def _class_of(a: int | None, b: int | None, ignore_unmated: bool) -> str:
    if a is None and b is None:
        return "no_primary"
    if a is None or b is None:
        flag = b if a is None else a
        if not flag & PAIRED:
            return "unmapped_orphan" if flag & UNMAPPED else "fragment"
        if flag & UNMAPPED:
            return "unmapped_orphan" if ignore_unmated else "missing_mate"
        return "fragment" if flag & MATE_UNMAPPED else "unmated" if ignore_unmated else "missing_mate"
    if a & b & UNMAPPED:
        return "both_unmapped"
    return "fragment" if (a | b) & UNMAPPED else "pair"


def _class(a: Column, b: Column, ignore_unmated: bool) -> Column:
    """The class, by the flags of the first and second end; null where there is none. Looked up, as conditions are copied wherever the class is filtered by."""
    flags = [None, *range(_TOLD + 1)]
    place = lambda c: F.coalesce(c.bitwiseAND(_TOLD) + 1, F.lit(0))
    return F.get(F.array(*(F.lit(_class_of(x, y, ignore_unmated)) for x in flags for y in flags)), place(a) * len(flags) + place(b))


def _second_mapped(a: Column, b: Column) -> Column:
    """Is a fragment's mapped end the second one? By the ends' flags."""
    return a.isNull() | (b.isNotNull() & has(a, UNMAPPED))


def classify(df: DataFrame, ignore_unmated: bool = False) -> DataFrame:
    """Add class: pair, fragment, unmapped_orphan, both_unmapped, unmated, no_primary or missing_mate (the last two are errors); and mapped: a fragment's mapped end."""
    a, b = F.col("first"), F.col("second")
    out = df.withColumn("class", _class(a["flag"], b["flag"], ignore_unmated))
    return out.withColumn("mapped", F.when(F.col("class") == "fragment", F.when(_second_mapped(a["flag"], b["flag"]), b).otherwise(a)))


def check(classified: DataFrame, rows: DataFrame) -> None:
    """Raise a ValueError for the first template that no run accepts; rows has the names."""
    wrong = classified.filter(F.col("class").isin("no_primary", "missing_mate")).orderBy("ord").limit(1).collect()
    if wrong:
        what = "has no primary record: the input isn't grouped by query name" if wrong[0]["class"] == "no_primary" else "lacks its mate (ignore_unmated lets it pass)"
        raise ValueError(f"template {rows.filter(F.col('ord') == wrong[0].ord).first().qname} {what}")


_NO_POSITION = -(1 << 31)


def packed(ends: DataFrame, max_read_length: int = 1000, ignore_unmated: bool = False) -> DataFrame:
    """What keyed takes, one row per ord: lib_idx and class, and of each slot's last primary row end (p5 above the flag's 32 bits), key, lk and moved.

    The same rows as classify(templates(ends)) has, with an end in two numbers. With a number for each field, and texts and conditions for each use of one,
    the generated method is over the 8,000 bytes that the JVM compiles, and every template is interpreted.
    """
    at = lambda c: F.shiftleft(F.col("seq_num").cast("long"), 33).bitwiseOR(F.shiftleft((F.col(c) + max_read_length).cast("long"), 1))
    which, end = slot(F.col("flag")), F.shiftleft(F.coalesce("p5", F.lit(_NO_POSITION)).cast("long"), 32).bitwiseOR(F.col("flag").cast("long"))
    moved = (F.col("kpos") != F.col("p5")).cast("int") + 2 * (F.col("lkpos") != F.col("lpos")).cast("int")
    fields = {"end": end, "key": at("kpos").bitwiseOR(F.col("rev").cast("long")), "lk": at("lkpos"), "moved": moved}
    rows = ends.filter("ord is not null").select("ord", "rec_idx", "lib_idx", *(F.when(which == k, F.col("rec_idx")).alias(f"_r{k}") for k in (1, 2)), *(v.alias(n) for n, v in fields.items()))
    rows = rows.groupBy("ord").agg(F.min_by("lib_idx", "rec_idx").alias("lib_idx"), *(F.max_by(n, f"_r{k}").alias(f"{n}{k}") for k in (1, 2) for n in fields))
    return rows.withColumn("class", _class(F.col("end1"), F.col("end2"), ignore_unmated))


def keyed(found: DataFrame, directional: bool = False, legacy: bool = False, every: bool = False) -> DataFrame:
    """Pairs and fragments: ord, class, library, lib_idx, a and b (a pair's ends), e1 and e2 (the same by slot), k (a fragment's end), lk (its left end), clamped; with every, all classes.

    found: packed, with library. Ends are packed numbers. A pair's ends are ordered by unclamped position, then contig, then strand, unless directional.
    """
    one, two, end1, end2 = F.col("key1"), F.col("key2"), F.col("end1"), F.col("end2")
    p1, p2 = F.shiftright(end1, 32), F.shiftright(end2, 32)
    # ends at one position of one contig have one clamped position, so the keys tell contigs, then strands apart
    swap = F.lit(False) if directional else (p1 > p2) | ((p1 == p2) & (F.coalesce(one, F.lit(-1)) > F.coalesce(two, F.lit(-1))))
    pair, fragment, second = F.col("class") == "pair", F.col("class") == "fragment", _second_mapped(end1, end2)
    mapped = lambda c: F.when(fragment, F.when(second, F.col(f"{c}2")).otherwise(F.col(f"{c}1")))
    moved = lambda c, bit: c.bitwiseAND(bit) != 0
    clamped = F.when(pair, moved(F.col("moved1"), 1) | moved(F.col("moved2"), 1)).otherwise(moved(mapped("moved"), 2 if legacy else 1))
    return (found if every else found.filter(pair | fragment)).select(
        "ord", "class", "library", "lib_idx", F.when(pair, F.when(swap, two).otherwise(one)).alias("a"), F.when(pair, F.when(swap, one).otherwise(two)).alias("b"),
        F.when(pair, one).alias("e1"), F.when(pair, two).alias("e2"), mapped("key").alias("k"), mapped("lk").alias("lk"), clamped.alias("clamped"),
    )
