"""Which templates are duplicates: "the first with a key, in input order, wins".

Each pair and each fragment has one key. The firsts are found by partial aggregation (the smallest ord of a key), so a hot key needs no sort and no task of
its own; only keys that several templates have come back, and mark their rows by a join on the key, whose skew Spark can split. Both sides
read the same columns of the same templates, so these are made once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The second part of a single end's key, which no pair's key has.
ALONE = -1
KEY = ("lib_idx", "k1", "k2")
DIRECTED = ("lib_idx", "d1", "d2")
#: Stands for a missing part of a key, and meets no template.
NO_KEY = -2

LEGACY, APPROX, EXACT = "samblaster-legacy", "picard-approx", "picard-exact"
STRATEGIES = ("strand-aware", LEGACY, APPROX, EXACT)


def key_rows(keyed: DataFrame, strategy: str = "strand-aware", directed: bool = False) -> DataFrame:
    """keyed's rows as ord, library, lib_idx, class, k1 and k2: a pair's two ends, or a fragment's end and ALONE; nulls for other classes.

    With directed, d1 and d2 too: the same, with a pair's ends in the order of their slots.
    """
    pair, fragment = F.col("class") == "pair", F.col("class") == "fragment"
    own = F.col("lk" if strategy == LEGACY else "k")
    key = lambda a, b, names: (F.when(pair, F.col(a)).when(fragment, own).alias(names[1]), F.when(pair, F.col(b)).when(fragment, F.lit(ALONE).cast("long")).alias(names[2]))
    return keyed.select("ord", "library", "lib_idx", "class", *key("a", "b", KEY), *(key("e1", "e2", DIRECTED) if directed else ()))


def events(rows: DataFrame, strategy: str) -> DataFrame:
    """key_rows with end: false for the rows themselves, true for further rows of a pair's single ends, which two strategies hold fragments against."""
    if strategy not in (APPROX, EXACT):
        return rows.withColumn("end", F.lit(False))
    at = lambda a, b, end: F.struct(a.alias("k1"), b.alias("k2"), F.lit(end).alias("end"))
    own, alone = at(F.col("k1"), F.col("k2"), False), F.lit(ALONE).cast("long")
    each = F.when(F.col("class") == "pair", F.array(own, at(F.col("k1"), alone, True), at(F.col("k2"), alone, True))).otherwise(F.array(own))
    return rows.select(*(c for c in rows.columns if c not in ("k1", "k2")), F.inline(each))


def firsts(rows: DataFrame, strategies: dict[str, str]) -> DataFrame:
    """KEY and for each name of strategies (name: strategy) the ord that is no duplicate (-1: all are), of keys of templates that occur several times.

    All strategies in one aggregation; if one of them needs pairs' single ends, the others leave these out.
    """
    wide = next((s for s in strategies.values() if s in (APPROX, EXACT)), "strand-aware")
    # a key that may be null is tested before it is made, by a copy of all that makes it
    at = events(rows, wide).select("ord", "end", "lib_idx", *(F.coalesce(c, F.lit(NO_KEY)).alias(c) for c in KEY[1:]))
    found = at.groupBy(*KEY).agg(F.min("ord").alias("any"), F.min(F.when(~F.col("end"), F.col("ord"))).alias("own"), F.count("*").alias("n"), F.bool_or("end").alias("taken"))
    first = {APPROX: F.col("any"), EXACT: F.when(F.col("taken"), F.lit(-1)).otherwise(F.col("own"))}
    return found.filter("n > 1 and own is not null").select(*KEY, *(first.get(s, F.col("own")).alias(n) for n, s in strategies.items()))


def marked_rows(rows: DataFrame, strategies: dict[str, str], directed: tuple[str, ...] = ()) -> DataFrame:
    """key_rows with a mark for each name of strategies (name: strategy). Names in directed go by d1 and d2."""
    out = rows
    for key in (KEY, DIRECTED):
        names = {f"_{n}": s for n, s in strategies.items() if (n in directed) == (key == DIRECTED)}
        if names:
            found = rows if key == KEY else rows.drop(*KEY[1:]).withColumnsRenamed(dict(zip(key, KEY)))
            out = out.join(firsts(found, names).withColumnsRenamed(dict(zip(KEY, key))), list(key), "left")
    return out.withColumns({n: F.coalesce(F.col(f"_{n}") != F.col("ord"), F.lit(False)) for n in strategies}).drop(*(f"_{n}" for n in strategies))


def mark(keyed: DataFrame, strategy: str = "strand-aware") -> DataFrame:
    """(ord, library, dup) of all pairs and fragments."""
    return marked_rows(key_rows(keyed.filter("class in ('pair', 'fragment')"), strategy), {"dup": strategy}).select("ord", "library", "dup")


def mark_pairs(keyed: DataFrame) -> DataFrame:
    """(ord, library, dup) of pairs."""
    return mark(keyed.filter("class = 'pair'"))


def mark_by_end(keyed: DataFrame, key: str = "k") -> DataFrame:
    """(ord, library, dup) of fragments among themselves, by their 5' end and strand (k) or their left end without strand (lk)."""
    return mark(keyed.filter("class = 'fragment'"), LEGACY if key == "lk" else "strand-aware")


def _fragments(keyed: DataFrame, strategy: str) -> DataFrame:
    rows = key_rows(keyed.filter("class in ('pair', 'fragment')"))
    marked = rows.filter("class = 'fragment'").join(firsts(rows, {"first": strategy}).filter(F.col("k2") == ALONE), list(KEY), "left")
    return marked.select("ord", "library", F.coalesce(F.col("first") != F.col("ord"), F.lit(False)).alias("dup"))


def mark_approx(keyed: DataFrame) -> DataFrame:
    """Fragments against earlier fragments and the ends of earlier pairs."""
    return _fragments(keyed, APPROX)


def mark_exact(keyed: DataFrame) -> DataFrame:
    """Fragments against earlier fragments and the ends of all pairs."""
    return _fragments(keyed, EXACT)


def fragment_events(keyed: DataFrame) -> DataFrame:
    """(ord, lib_idx, library, key, is_pair): a row for each end of a pair and each fragment."""
    pair = F.col("class") == "pair"
    return keyed.select("ord", "lib_idx", "library", pair.alias("is_pair"), F.explode(F.when(pair, F.array("a", "b")).otherwise(F.array("k"))).alias("key"))


def fragments_at_pair_ends(keyed: DataFrame) -> DataFrame:
    """(ord, library) of fragments whose end is an end of some pair."""
    ends = keyed.filter("class = 'pair'").select("lib_idx", F.explode(F.array("a", "b")).alias("k")).distinct()
    return keyed.filter("class = 'fragment'").join(ends, ["lib_idx", "k"], "left_semi").select("ord", "library")


def distinct_pair_keys(keyed: DataFrame) -> DataFrame:
    """(library, keys) different pairs of ends."""
    return keyed.filter("class = 'pair'").groupBy("library", "a", "b").agg(F.lit(1).alias("one")).groupBy("library").agg(F.count("*").alias("keys"))


def key_counts(keyed: DataFrame, strategy: str = "strand-aware") -> DataFrame:
    """(library, lib_idx, class, n, dups) of each key, and of each class without keys: templates, and how many of them are duplicates.

    One aggregation gives what marks would, without going back to the templates. keyed: of all classes.
    """
    own, end = ~F.col("end"), F.col("end")
    kind = F.when(end, F.lit("fragment")).otherwise(F.col("class")).alias("class")
    at = events(key_rows(keyed, strategy), strategy).select("ord", "library", "lib_idx", kind, "k1", "k2", "end")
    n = F.count(F.when(own, 1))
    counts = at.groupBy("library", "lib_idx", "class", "k1", "k2").agg(n.alias("n"), F.min("ord").alias("first"), F.min(F.when(own, F.col("ord"))).alias("own"), F.bool_or(end).alias("taken"))
    return counts.select("library", "lib_idx", "class", "n", F.when(F.col("k1").isNull(), F.lit(0)).otherwise(F.col("n") - _kept(strategy)).cast("long").alias("dups"))


def _kept(strategy: str) -> Column:
    """Templates of a key that are no duplicates: 1, or 0 where a pair's end takes the place."""
    if strategy == EXACT:
        return F.when(F.col("taken"), 0).otherwise(1)
    return F.when(F.col("own") == F.col("first"), 1).otherwise(0)


def duplicate_counts(keyed: DataFrame, strategy: str = "strand-aware") -> DataFrame:
    """(library, dup_pairs, dup_fragments): rows less different keys."""
    of = lambda c: F.coalesce(F.sum(F.when(F.col("class") == c, F.col("dups"))), F.lit(0).cast("long"))
    counts = key_counts(keyed.filter("class in ('pair', 'fragment')"), strategy)
    return counts.groupBy("library").agg(of("pair").alias("dup_pairs"), of("fragment").alias("dup_fragments"))
