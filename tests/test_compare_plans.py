"""What the comparisons' plans are like, and that the short ways give what the long ones do."""

import os

import pytest

from twinmark import queries as Q
from twinmark.operators import compare, marking, templates

SF = "/root/testdata/sf0.001"
# Fixed value: the JVM interprets methods over so many bytes of code, however often they run.
COMPILED = 8000


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["cmp_pe_discordant_dump", "cmp_join", "cmp_concordance_row"])
def test_plan(spark, name):
    """Methods small enough to be compiled; one scan for the records, one for all templates of both sides."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = Q.QUERIES[name](spark, SF)
        plan = df._jdf.queryExecution().executedPlan()
        stages = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenStringSeq(plan).iterator()
        sizes = []
        while stages.hasNext():
            sizes.append(stages.next()._3().maxMethodCodeSize())
        assert 0 < max(sizes) < COMPILED
        assert plan.toString().count("FileScan parquet") == 2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_classes_by_table(spark):
    """Every pair of flags, missing ends included, against the conditions one by one."""
    from pyspark.sql import functions as F

    def expected(a, b, ignore):
        if a is None and b is None:
            return "no_primary"
        if a is not None and b is not None:
            return {0: "pair", 1: "fragment", 2: "both_unmapped"}[bool(a & 4) + bool(b & 4)]
        flag = b if a is None else a
        if not flag & 1:
            return "unmapped_orphan" if flag & 4 else "fragment"
        if flag & 4:
            return "unmapped_orphan" if ignore else "missing_mate"
        return "fragment" if flag & 8 else "unmated" if ignore else "missing_mate"

    flags = [None, *range(16), 1024 | 99, 2113, 147, 1024 | 69]
    df = spark.createDataFrame([(a, b) for a in flags for b in flags], "a int, b int").select(*(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("flag"))).alias(n) for c, n in (("a", "first"), ("b", "second"))))
    for ignore in (False, True):
        for r in templates.classify(df, ignore).collect():
            a, b = r.first and r.first.flag, r.second and r.second.flag
            assert r["class"] == expected(a, b, ignore)
            assert (r.mapped is not None) == (r["class"] == "fragment")


def test_directed_marks(spark):
    """Both marks from one set of rows are those of two runs, clamped ends included, where the order of two equal keys differs."""
    from test_marking import pair, run

    rows = [*pair("a"), *pair("b", 83, 200, "50M", 163, 100), *pair("c"), *pair("d", 99, 1, "5000H50M", 163, 1, "6000H50M"), *pair("e", 99, 1, "7000H50M", 163, 1, "6000H50M"), *pair("f", 99, 1, "5000H50M", 163, 1, "6000H50M")]
    r, other = run(spark, rows), run(spark, rows, methylation_mode="directional")
    both = marking.marked_rows(marking.key_rows(r.keyed, directed=True), {"p": marking.EXACT, "q": "strand-aware"}, ("q",))
    want_p, want_q = ({x.ord: x.dup for x in marking.mark(k, s).collect()} for k, s in ((r.keyed, marking.EXACT), (other.keyed, "strand-aware")))
    got = both.collect()
    assert {x.ord: x.p for x in got} == want_p and {x.ord: x.q for x in got} == want_q and want_p != want_q
    one = marking.marked_rows(marking.key_rows(r.keyed), {"p": marking.EXACT, "q": "strand-aware"}).collect()
    assert {x.ord: x.q for x in one} == {x.ord: x.dup for x in marking.mark(r.keyed).collect()}


def test_names_of_one_side(spark):
    """Two datasets meet in one aggregation, without a join; a name that a side lacks has no mark there."""
    a = spark.createDataFrame([("x", 99, "1:5:F"), ("x", 1024 | 147, "1:20:R"), ("x", 2113, None), ("only a", 1024 | 73, "1:7:F")], "qname string, flag int, kf string")
    b = spark.createDataFrame([("x", 99), ("x", 147), ("only b", 1024 | 73), ("no primary", 1024 | 2113)], "qname string, flag int")
    joined = compare.compared(a, b)
    assert "Join" not in joined._jdf.queryExecution().executedPlan().toString()
    got = {r.qname: tuple(r)[1:] for r in joined.collect()}
    assert got == {
        "x": ("pe_both_mapped", ["1:20:R", "1:5:F"], "1:20:R|1:5:F", 2, True, False),
        "only a": ("orphan", ["1:7:F"], "1:7:F", 1, True, None),
        "only b": (None, None, None, None, None, True),
        "no primary": (None, None, None, None, None, False),
    }
    assert tuple(compare.join_counts(joined).first()) == (4, 3, 1, 2)


def test_clipped_cigars(spark):
    """CIGARs of one M with soft clips are measured without lists of operations, to the same lengths as others."""
    from pyspark.sql import functions as F

    from twinmark.functions import cigar as C

    want = {
        "50M": (0, 0, 50, 50), "5S45M": (5, 0, 45, 45), "45M5S": (0, 5, 45, 45), "3S40M7S": (3, 7, 40, 40), "0003S40M": (3, 0, 40, 40), "5H45M": (5, 0, 45, 45), "5S40M5H": (5, 5, 40, 40),
        "2S3S40M": (5, 0, 40, 40), "40M2S3S": (0, 5, 40, 40), "20M2D28M": (0, 0, 50, 48), "5S": (5, 0, 0, 0), "*": (0, 0, 0, 0), "": (0, 0, 0, 0),
    }
    rows = spark.createDataFrame([(t,) for t in want], "t string").select("t", *(c.alias(n) for n, c in C.summary(F.col("t")).items()))
    assert {r.t: tuple(r)[1:] for r in rows.collect()} == want
