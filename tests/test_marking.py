"""Micro-fixtures: (qname, flag, rname, pos, cigar[, rg]) in input order -> names of duplicates."""

import pytest

from twinmark.functions import cigar as C
from twinmark.operators import compare, headers, marking, templates
from twinmark.operators import metrics as M
from twinmark.plans.marking import MarkDuplicates
from twinmark.plans.options import Options

GROUPS = [("A", "s1", "lib1"), ("B", "s1", "lib2"), ("C", "s2", "lib1")]


def run(spark, rows, groups=(), **options):
    ords, out = {}, []
    for i, (name, flag, rname, pos, cig, *rg) in enumerate(rows):
        o = ords.setdefault(name, len(ords))
        out.append((o, i, name, flag, rname, pos, 60, cig, rg[0] if rg else None))
    df = spark.createDataFrame(out, "ord long, rec_idx int, qname string, flag int, rname string, pos int, mapq int, cigar string, rg string")
    contigs = spark.createDataFrame([("chr1", 1_000_000, 1), ("chr2", 1_000_000, 2)], "name string, length int, seq_num int")
    return MarkDuplicates(df, contigs, spark.createDataFrame(list(groups), headers.READ_GROUPS), Options(**options))


def dups(r):
    return sorted({x.qname for x in r.records().collect() if x.flag & 1024})


def pair(name, f1=99, p1=100, c1="50M", f2=147, p2=200, c2="50M", chr1="chr1", chr2="chr1", rg=None):
    return [(name, f1, chr1, p1, c1, rg), (name, f2, chr2, p2, c2, rg)]


def orphan(name, pos=100, flag=73, rg=None):
    return [(name, flag, "chr1", pos, "50M", rg), (name, 133, "chr1", pos, "*", rg)]


CASES = [
    ("basic", pair("r1") + pair("r2"), {}, ["r2"]),
    ("swapped", pair("a") + [("b", 147, "chr1", 200, "50M"), ("b", 99, "chr1", 100, "50M")], {}, ["b"]),
    ("three", pair("r1") + pair("r2") + pair("r3"), {}, ["r2", "r3"]),
    ("chimera", pair("a", 97, 100, "50M", 145, 200, chr2="chr2") + pair("b", 97, 100, "50M", 145, 200, chr2="chr2"), {}, ["b"]),
    ("chimera apart", pair("a", 97, 100, "50M", 145, 200, chr2="chr2") + pair("b", 97, 300, "50M", 145, 400, chr2="chr2"), {}, []),
    ("forward clip", pair("a", p2=151) + pair("b", p1=105, c1="5S45M", p2=151), {}, ["b"]),
    ("reverse clip", pair("a", p2=151) + pair("b", p2=151, c2="45M5S"), {}, ["b"]),
    ("hard clips count", pair("a", c1="15S35M") + pair("b", c1="5H10S35M"), {}, ["b"]),
    ("hard clips differ", pair("a", c1="10S40M") + pair("b", c1="5H10S40M"), {}, []),
    ("before the start", pair("a", p1=5, c1="10S40M", p2=55), {}, []),
    ("inherit", pair("r1") + pair("r2") + [("r2", 355, "chr1", 500, "50M"), ("r2", 2113, "chr1", 700, "25S25M")], {}, ["r2"]),
    ("both unmapped", [(n, f, "*", 0, "*") for n in "ab" for f in (77, 141)], {}, []),
    ("orphans", orphan("a") + orphan("b"), {}, ["b"]),
    ("single ends, strand", [("a", 0, "chr1", 100, "50M"), ("b", 16, "chr1", 100, "50M")], {}, []),
    ("single ends, legacy", [("a", 0, "chr1", 100, "50M"), ("b", 16, "chr1", 100, "50M")], {"single_end_strategy": "samblaster-legacy"}, ["b"]),
    ("pair, orphan: approx", pair("p") + orphan("o"), {"single_end_strategy": "picard-approx"}, ["o"]),
    ("pair, orphan: strand", pair("p") + orphan("o"), {}, []),
    ("orphan, pair: approx", orphan("o") + pair("p"), {"single_end_strategy": "picard-approx"}, []),
    ("orphan, pair: exact", orphan("o") + pair("p"), {"single_end_strategy": "picard-exact"}, ["o"]),
    ("exact keeps strands", pair("p", 83, 100, "50M", 163, 400) + [("s", 0, "chr1", 100, "50M")], {"single_end_strategy": "picard-exact"}, []),
    ("strands of pairs", pair("t") + [("b", 83, "chr1", 200, "50M"), ("b", 163, "chr1", 100, "50M")], {}, ["b"]),
    ("directional", pair("t") + [("b", 83, "chr1", 200, "50M"), ("b", 163, "chr1", 100, "50M")], {"methylation_mode": "directional"}, []),
    ("libraries", pair("a", rg="A") + pair("b", rg="B"), {}, []),
    ("one library", pair("a", rg="A") + pair("b", rg="C"), {}, ["b"]),
    ("unaware", pair("a", rg="A") + pair("b", rg="B"), {"library_unaware": True}, ["b"]),
    ("unknown library", pair("a", rg="A") + pair("b") + pair("c", rg="A"), {}, ["c"]),
    ("exact by library", pair("p", rg="A") + orphan("o1", rg="A") + orphan("o2", rg="B"), {"single_end_strategy": "picard-exact"}, ["o1"]),
    ("unmated passes", [("a", 99, "chr1", 100, "50M")], {"ignore_unmated": True}, []),
]


@pytest.mark.parametrize("name, rows, options, expected", CASES, ids=[c[0] for c in CASES])
def test_case(spark, name, rows, options, expected):
    assert dups(run(spark, rows, GROUPS, **options)) == expected


def test_orders(spark):
    rows = orphan("o") + pair("p")
    assert [x.qname for x in run(spark, rows, single_end_strategy="picard-exact").records().collect()] == ["p", "p", "o", "o"]
    assert [x.qname for x in run(spark, pair("a") + pair("b") + pair("c", p1=500), remove_dups=True).records().collect()] == ["a", "a", "c", "c"]


def test_errors(spark):
    with pytest.raises(ValueError, match="mate"):
        run(spark, [("a", 99, "chr1", 100, "50M")]).check()
    for ignore in (False, True):
        with pytest.raises(ValueError, match="grouped"):
            run(spark, [("a", 2113, "chr1", 100, "50M")], ignore_unmated=ignore).check()
    with pytest.raises(ValueError, match="header"):
        run(spark, [("a", 0, "chr9", 100, "50M")]).check()
    run(spark, [("a", 4, "*", 0, "*"), ("b", 0, "chr1", 200, "50M"), ("b", 256, "chr1", 9000, "50M")]).check()
    for bad in ({"max_read_length": 0}, {"single_end_strategy": "x"}, {"methylation_mode": "pbat"}, {"compression_level": 13}, {"min_bins": 0}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_clamp(spark):
    rows = pair("a", p1=1, c1="5000H50M")
    assert run(spark, rows).clamped() == 1
    assert run(spark, rows, max_read_length=6000).clamped() == 0


def test_mate_tags(spark):
    r = run(spark, pair("a", c1="10M5S"), add_mate_tags=True)
    got = [(x.flag, x.mc, x.mq) for x in r.records().collect()]
    assert got == [(99, "50M", 60), (147, "10M5S", 60)]
    kept = MarkDuplicates(r.rows.selectExpr("*", "'1M' as mc", "cast(5 as bigint) as mq"), r.contigs, r.read_groups, r.options)
    assert {(x.mc, x.mq) for x in kept.records().collect()} == {("1M", 5)}
    o = run(spark, orphan("o"), add_mate_tags=True)
    assert [(x.flag, x.mc) for x in o.records().collect()] == [(73, None), (133, "50M")]


def test_metrics(spark):
    (row,) = run(spark, [], GROUPS).metrics.collect()
    assert row.library == "All Reads" and row.sample == "s1,s2" and row.total_templates == 0 and row.frac_duplicates == 0 and row.estimated_library_size is None
    (row,) = run(spark, pair("a") + pair("b") + pair("c", p1=500)).metrics.collect()
    assert (row.library, row.mapped_pairs, row.duplicate_pairs) == ("Unknown Library", 3, 1) and abs(row.frac_duplicates - 1 / 3) < 1e-9
    (row,) = run(spark, [("a", 69, "*", 0, "*")], ignore_unmated=True).metrics.collect()
    assert (row.unmapped_orphans, row.unmated_templates) == (1, 0)
    from pyspark.sql import functions as F

    sizes = spark.createDataFrame([(1_000_000, 500_000), (0, 0), (10, 10), (100, 70)], "n long, c long").select(M.library_size(F.col("n"), F.col("c")).alias("x"))
    assert [r.x for r in sizes.collect()][:3] == [627500, None, None]


def test_cigar(spark):
    from pyspark.sql import functions as F

    texts = ["50M", "*", "", "5S45M", "05M", "0M", "M", "5", "5Z", "268435455M", "268435456M", "5H10S3I2=1X4D2N1P7M3S2H", "10S5H"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.v for r in rows.select("i", C.is_valid(F.col("t")).alias("v")).orderBy("i").collect()] == [True, True, True, True, True, False, False, False, False, True, False, True, True]
    good = rows.filter("i in (0, 3, 11, 12)").select("i", *(c.alias(n) for n, c in C.summary(F.col("t")).items())).orderBy("i")
    assert [tuple(r)[1:] for r in good.collect()] == [(0, 0, 50, 50), (5, 0, 45, 45), (15, 5, 16, 13), (15, 0, 0, 0)]


def test_runs(spark):
    names = ["a", "a", "b", "a", "c", "c"]
    df = spark.createDataFrame([(i * 40_000, n) for i, n in enumerate(names)], "line_no long, qname string")
    assert [r.ord for r in templates.group_runs(df).orderBy("line_no").collect()] == [0, 0, 1, 2, 3, 3]


def sequential(rows, strategy):
    """The rule, one template at a time. rows: (ord, library, a, b) of pairs or (ord, library, k) of fragments."""
    seen, ends, out, later = set(), set(), {}, []
    for o, lib, *key in rows:
        if len(key) == 2:
            out[o] = (lib, *key) in seen
            seen.add((lib, *key))
            ends |= {(lib, k) for k in key} if strategy != "strand-aware" else set()
        elif strategy == "picard-exact":
            later.append((o, (lib, key[0])))
        else:
            out[o] = (lib, key[0]) in ends
            ends.add((lib, key[0]))
    for o, k in later:
        out[o] = k in ends
        ends.add(k)
    return out


@pytest.mark.parametrize("strategy", ["strand-aware", "picard-approx", "picard-exact"])
def test_random(spark, strategy):
    import random

    rng, rows = random.Random(4), []
    for o in range(600):
        lib = rng.choice(["x", "y"])
        rows.append((o, lib, rng.randrange(12), rng.randrange(12)) if rng.random() < 0.5 else (o, lib, rng.randrange(40)))
    df = spark.createDataFrame([(r[0], "pair", r[1], int(r[1] == "y"), r[2], r[3], None) if len(r) == 4 else (r[0], "fragment", r[1], int(r[1] == "y"), None, None, r[2]) for r in rows], "ord long, class string, library string, lib_idx int, a long, b long, k long")
    assert {r.ord: r.dup for r in marking.mark(df, strategy).collect()} == sequential(rows, strategy)


def test_compare_triage(spark):
    """Each cause of disagreement once."""
    def t(name, flag, kf, q):
        return (name, flag, kf), (name, flag & ~1024 | (1024 if q else 0))

    rows = [
        t("p1", 67, "E", False), t("o1", 1024 | 73, "E", False),  # cross table
        t("o2", 1024 | 73, "K", False), t("o3", 73, "K", True),  # tie break
        t("o4", 1024 | 73, "L", False),  # the oracle's only
        t("o5", 73, "M", True),  # the partner's only
    ]
    a = spark.createDataFrame([r[0] for r in rows] + [("p1", 131, "F")], "qname string, flag int, kf string")
    b = spark.createDataFrame([r[1] for r in rows] + [("p1", 131)], "qname string, flag int")
    row = compare.orphan_triage(compare.compared(a, b)).first()
    assert (row.cat1_cross_table, row.cat2_tiebreaker, row.cat3_picard_only_other, row.cat4_partner_only_other, row.discordant) == (1, 2, 1, 1, 5)
    with pytest.raises(ValueError, match="one side"):
        compare.check(compare.compared(a, b.filter("qname <> 'o5'")))
