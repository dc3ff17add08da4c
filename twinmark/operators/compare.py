"""Agreement of two marked datasets, by query name and by the oracle's duplicate keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flags import DUPLICATE, NOT_PRIMARY, PAIRED, UNMAPPED, has

# Categories in the order of display; others come after them, and the sum last.
CATEGORIES = ("pe_both_mapped", "orphan", "single_end", "unmapped", "both_unmapped", "mixed")


def end_key(rows: DataFrame) -> Column:
    """The duplicate key of a mapped primary row with ends: contig:position:strand."""
    mapped = ~has(F.col("flag"), NOT_PRIMARY) & ~has(F.col("flag"), UNMAPPED)
    return F.when(mapped, F.concat_ws(":", F.col("seq_num").cast("string"), F.col("kpos").cast("string"), F.when(F.col("rev"), "R").otherwise("F")))


def _side(rows: DataFrame) -> DataFrame:
    primary, dup = ~has(F.col("flag"), NOT_PRIMARY), has(F.col("flag"), DUPLICATE)
    return rows.groupBy("qname").agg(F.bool_or(~primary).alias("has_supp"), F.bool_or(dup).alias("any_dup"), F.bool_and(dup).alias("all_dup"))


def category() -> Column:
    n, u = F.col("n_primary"), F.col("n_unmapped")
    one = F.when(u == 1, "unmapped").when(F.col("n_paired") == 0, "single_end").otherwise("orphan")
    two = F.when(u == 2, "both_unmapped").when(u == 1, "orphan").otherwise("pe_both_mapped")
    return F.when(n == 0, "no_primary").when(n == 1, one).when(n == 2, two).otherwise("multi_primary")


def compared(oracle: DataFrame, partner: DataFrame) -> DataFrame:
    """One row per qname: category, gkey (null without keys), kfs and both sides' marks. oracle: qname, flag, kf; partner: qname, flag.

    Names of one side only have a null mark on the other; check() rejects them.
    """
    a = oracle.select("qname", "flag", F.lit(None).cast("int").alias("partner_flag"), "kf")
    return compared_rows(a.union(partner.select("qname", F.lit(None).cast("int"), "flag", F.lit(None).cast("string"))))


def compared_rows(rows: DataFrame) -> DataFrame:
    """What compared gives, for records that carry both sides' flags, null on a side that lacks them: qname, flag, partner_flag, kf. One aggregation, no join."""
    flag, primary, dup = F.col("flag"), lambda c: ~has(c, NOT_PRIMARY), lambda c: has(c, DUPLICATE)
    count = lambda c: F.count(F.when(primary(flag) & c, 1))
    marked = lambda c: F.when(F.count(c) > 0, F.coalesce(F.bool_or(primary(c) & dup(c)), F.lit(False)))
    seen = F.col("oracle_dup").isNotNull()
    out = rows.groupBy("qname").agg(
        count(F.lit(True)).alias("n_primary"), count(has(flag, UNMAPPED)).alias("n_unmapped"), count(has(flag, PAIRED)).alias("n_paired"),
        F.array_sort(F.collect_list(F.when(primary(flag), F.col("kf")))).alias("kfs"), marked(flag).alias("oracle_dup"), marked(F.col("partner_flag")).alias("partner_dup"),
    )
    of = lambda c, name: F.when(seen, c).alias(name)
    return out.select("qname", of(category(), "category"), of(F.col("kfs"), "kfs"), F.when(F.size("kfs") > 0, F.array_join("kfs", "|")).alias("gkey"), of(F.col("n_primary"), "n_primary"), "oracle_dup", "partner_dup")


def check(joined: DataFrame) -> None:
    """Raise a ValueError if a name is on one side only, or no key was seen."""
    row = joined.agg(F.min(F.when(F.col("oracle_dup").isNull() | F.col("partner_dup").isNull(), F.col("qname"))).alias("lone"), F.count("gkey").alias("keys")).first()
    if row.lone is not None:
        raise ValueError(f"{row.lone} is on one side only")
    if not row.keys:
        raise ValueError("the oracle's records have no duplicate keys")


def join_counts(joined: DataFrame) -> DataFrame:
    lone = lambda c: F.count(F.when(F.col(c).isNull(), 1))
    return joined.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n_primary"), F.lit(0)).alias("n_primary"), lone("partner_dup").alias("oracle_only"), lone("oracle_dup").alias("partner_only"))


def duplicate_sets(joined: DataFrame) -> DataFrame:
    count = lambda c: F.count(F.when(F.col(c), 1))
    mixed = F.when(F.min("category") != F.max("category"), "mixed").otherwise(F.min("category"))
    return joined.filter("gkey is not null").groupBy("gkey").agg(F.count("*").alias("size"), count("oracle_dup").alias("picard_marked"), count("partner_dup").alias("partner_marked"), mixed.alias("category"))


def set_concordance(sets: DataFrame) -> DataFrame:
    """(category, sets, concordant, discordant, concord_pct) of sets of two or more, in the order of CATEGORIES, with a TOTAL row."""
    same = F.count(F.when(F.col("picard_marked") == F.col("partner_marked"), 1))
    rows = sets.filter("size >= 2").rollup("category").agg(F.grouping("category").alias("_g"), F.count("*").alias("sets"), same.alias("concordant"))
    rows = rows.select(F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("category")).alias("category"), "sets", "concordant")
    rows = rows.withColumn("discordant", F.col("sets") - F.col("concordant")).withColumn("concord_pct", pct(F.col("concordant"), F.col("sets")))
    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    return rows.orderBy(F.col("category") == "TOTAL", place == 0, place, "category")


def singleton_marks(sets: DataFrame) -> DataFrame:
    one = F.col("size") < 2
    return sets.agg(*(F.coalesce(F.sum(F.when(one, F.col(f"{s}_marked"))), F.lit(0)).alias(f"picard_singletons_{s}_marked") for s in ("picard", "partner")))


def pct(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, "0").otherwise(F.format_string("%.6f", 100.0 * part / F.nullif(whole, F.lit(0).cast("long"))))


def concordance_row(sets: DataFrame, sample: str, partner: str) -> DataFrame:
    """The one-row report of pairs and orphans."""
    big, same = F.col("size") >= 2, F.col("picard_marked") == F.col("partner_marked")
    count = lambda c: F.count(F.when(c, 1))
    pe, orphan = F.col("category") == "pe_both_mapped", F.col("category") == "orphan"
    row = sets.agg(
        count(big & pe).alias("pe_sets"), count(big & pe & same).alias("pe_concordant"), count(big & orphan).alias("orphan_sets"), count(big & orphan & same).alias("orphan_concordant"),
        F.coalesce(F.sum(F.when(~big, F.col("partner_marked"))), F.lit(0)).alias("picard_singletons_partner_marked"),
    )
    return row.select(
        F.lit(sample).alias("sample"), F.lit(partner).alias("partner"), "pe_sets", "pe_concordant", pct(F.col("pe_concordant"), F.col("pe_sets")).alias("pe_concord_pct"),
        "orphan_sets", "orphan_concordant", pct(F.col("orphan_concordant"), F.col("orphan_sets")).alias("orphan_concord_pct"), "picard_singletons_partner_marked",
    )


def orphan_triage(joined: DataFrame) -> DataFrame:
    """One row: orphans by agreement, and the disagreeing ones by cause."""
    pair, orphan = F.col("category") == "pe_both_mapped", F.col("category") == "orphan"
    # a row for each end of a pair, which says that its key has one, and for the first end of an orphan
    own = F.when(pair, F.col("kfs")).when(orphan, F.slice("kfs", 1, 1))
    rows = joined.select(F.explode(own).alias("key"), orphan.alias("o"), F.col("oracle_dup").alias("p"), F.col("partner_dup").alias("q"))
    o, p, q = F.col("o"), F.col("p"), F.col("q")
    count = lambda c: F.count(F.when(o & c, 1))
    keys = rows.groupBy("key").agg(F.count(F.when(o, 1)).alias("n"), count(p).alias("pc"), count(q).alias("qc"), count(p & q).alias("both"), count(~p & ~q).alias("neither"), count(p & ~q).alias("p_only"), count(~p & q).alias("q_only"), F.bool_or(~o).alias("hp"))
    tie = (F.col("n") > 1) & (F.col("pc") == F.col("qc")) & (F.col("pc") > 0) & (F.col("pc") < F.col("n")) & ~F.col("hp")
    keys = keys.withColumn("tie", tie)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    row = keys.agg(
        total("n").alias("total_orphans"), total("pc").alias("picard_marked"), total("qc").alias("partner_marked"), total("both").alias("concordant_dup"), total("neither").alias("concordant_nondup"),
        total(F.when(F.col("hp"), F.col("p_only")).otherwise(zero)).alias("cat1_cross_table"), total(F.when(F.col("tie"), F.col("p_only") + F.col("q_only")).otherwise(zero)).alias("cat2_tiebreaker"),
        total(F.when(~F.col("hp") & ~F.col("tie"), F.col("p_only")).otherwise(zero)).alias("cat3_picard_only_other"), total(F.when(F.col("tie"), zero).otherwise(F.col("q_only"))).alias("cat4_partner_only_other"),
    )
    cats = ("cat1_cross_table", "cat2_tiebreaker", "cat3_picard_only_other", "cat4_partner_only_other")
    return row.select("total_orphans", "picard_marked", "partner_marked", "concordant_dup", "concordant_nondup", sum((F.col(c) for c in cats[1:]), F.col(cats[0])).alias("discordant"), *cats)


def inheritance(rows: DataFrame, tool: str) -> DataFrame:
    """One row: do all rows of a name agree on the mark?"""
    count = lambda c: F.count(F.when(c, 1))
    torn = F.col("any_dup") & ~F.col("all_dup")
    out = _side(rows).agg(F.count("*").alias("total_qnames"), count(F.col("has_supp")).alias("groups_with_supp"), count(~torn).alias("consistent"), count(torn).alias("inconsistent"))
    return out.select(F.lit(tool).alias("tool"), "*", pct(F.col("inconsistent"), F.col("total_qnames")).alias("inconsistency_pct"))


def discordant_pairs(sets: DataFrame) -> DataFrame:
    return sets.filter("size >= 2 and category = 'pe_both_mapped' and picard_marked <> partner_marked").select(F.col("gkey").alias("group_key"), "size", "picard_marked", "partner_marked")
