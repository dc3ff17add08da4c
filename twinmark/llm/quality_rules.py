"""Operator 2: learned decision lists over text statistics, in DataFrame functions only.

Sequential covering on a bounded sample of labelled rows: a rule is a conjunction of threshold tests that is
grown on two thirds of the sample by information gain, pruned on the rest, and kept if it is precise enough
there; the rows it covers leave the sample and the next rule is sought. The rules become one ordered CASE.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WHITE, table

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Labelled rows that are fitted at most, and the seed of their choice.
MAX_LABELS, SEED = 8000, 7
#: A rule stays if so large a share of the pruning rows that it covers, and at least so many, are bad.
MIN_PRECISION, MIN_COVER = 0.97, 4
MAX_RULES, MAX_TESTS, CUTS = 12, 3, 24

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Whole numbers that the rules test.
FEATURES = ("symbols_pm", "upper_pm", "shouts_pm", "dup_lines_pm", "repeats_pm", "word_length_pc", "distinct_pm")


def with_statistics(docs: DataFrame) -> DataFrame:
    """One row per row of docs: struct doc of all its columns, the BASE counts and the FEATURES, all long.

    Null texts count as empty. Every step that is used twice has a column of its own, so that it is computed once.
    """
    n = lambda c: F.col(c)
    per = lambda a, b, unit: F.coalesce(F.floor(n(a) * unit / F.nullif(n(b), F.lit(0).cast("long"))), F.lit(0)).cast("long")
    count = lambda chars: (F.length("text") - F.length(F.translate("text", chars, ""))).cast("long")
    df = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("grams", F.filter(F.transform("words", lambda w, i: F.when(i < F.size("words") - 2, F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))), lambda g: g.isNotNull()))
    # rows whose windows are all different need no sorting
    df = df.withColumn("ordered", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    twice = lambda x, j: (F.get("ordered", j - 1)["g"] == x["g"]) | (F.get("ordered", j + 1)["g"] == x["g"])
    df = df.withColumn("at", F.array_sort(F.transform(F.filter("ordered", lambda x, j: F.coalesce(twice(x, j), (F.get("ordered", j + 1)["g"] == x["g"]), F.get("ordered", j - 1)["g"] == x["g"], F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(F.transform("at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("at", j + 1) - p, F.lit(3))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    counts = (
        F.size("words").cast("long").alias("n_words"), F.length(F.translate("text", WHITE, "")).cast("long").alias("word_chars"), count(SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}", ""))).cast("long").alias("n_upper"), count("!").alias("n_shouts"),
        F.size("lines").cast("long").alias("n_lines"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    )
    # a generator, since a later filter that moved below these steps would repeat them for every element of the arrays
    df = df.select("doc", F.inline(F.array(F.struct(*counts))))
    return df.select(
        "doc", *BASE, per("n_symbols", "n_words", 1000).alias("symbols_pm"), per("n_upper", "word_chars", 1000).alias("upper_pm"), per("n_shouts", "n_words", 1000).alias("shouts_pm"),
        per("n_dup_lines", "n_lines", 1000).alias("dup_lines_pm"), per("n_repeat_words", "n_words", 1000).alias("repeats_pm"),
        per("word_chars", "n_words", 100).alias("word_length_pc"), per("n_distinct", "n_words", 1000).alias("distinct_pm"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: int

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.cut if self.above else row[self.feature] <= self.cut

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut}"


Rule = tuple[Test, ...]


def covers(rule: Rule, row: dict) -> bool:
    return all(t.holds(row) for t in rule)


def best_test(rows: list[dict], features=FEATURES) -> tuple[float, Test] | None:
    """The test with the largest gain p * (log p/(p+n) after - before); ties: first feature, smallest cut."""
    bad = sum(r["bad"] for r in rows)
    if not bad or bad == len(rows):
        return None
    before, best = math.log2(bad / len(rows)), None
    for f in features:
        counts: dict[int, list[int]] = {}
        for r in rows:
            c = counts.setdefault(r[f], [0, 0])
            c[r["bad"]] += 1
        values = sorted(counts)
        good_to = bad_to = 0
        step, due = max(1, len(rows) // CUTS), 0
        for a, b in zip(values, values[1:]):
            good_to, bad_to = good_to + counts[a][0], bad_to + counts[a][1]
            # quantile cuts, and every cut where the class changes
            if good_to + bad_to < due and (counts[a][0] > 0) == (counts[b][0] > 0) and (counts[a][1] > 0) == (counts[b][1] > 0):
                continue
            due = good_to + bad_to + step
            for above, p, n in ((True, bad - bad_to, len(rows) - bad - good_to), (False, bad_to, good_to)):
                if p and (best is None or p * (math.log2(p / (p + n)) - before) > best[0]):
                    gain = p * (math.log2(p / (p + n)) - before)
                    if gain > 0:
                        best = (gain, Test(f, above, (a + b) // 2))
    return best


def worth(rule: Rule, rows: list[dict]) -> tuple[float, int]:
    """Precision and number of bad rows among those that the rule covers."""
    hit = [r["bad"] for r in rows if covers(rule, r)]
    return (sum(hit) / len(hit) if hit else 0.0, sum(hit))


def learn(rows: list[dict], features=FEATURES, min_precision: float = MIN_PRECISION, min_cover: int = MIN_COVER) -> list[Rule]:
    """rows: dicts of the features and bad (0 or 1). The list's rules each say "bad"; what none covers is good."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        rule, left = (), grow
        while len(rule) < MAX_TESTS and (found := best_test(left, features)):
            rule = (*rule, found[1])
            left = [r for r in left if covers(rule, r)]
        if not rule:
            break
        score = lambda x: (lambda p, n: (p >= min_precision, n, p, -len(x)))(*worth(x, prune))
        rule = max((rule[:i] for i in range(len(rule), 0, -1)), key=score)
        precision, cover = worth(rule, prune)
        if precision < min_precision or cover < min_cover:
            break
        rules.append(rule)
        grow, prune = ([r for r in x if not covers(rule, r)] for x in (grow, prune))
    return rules


def rule_number(rules: list[Rule]) -> Column:
    """The number of the first rule that covers the row, from 1; null if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = rule[0].column()
        for t in rule[1:]:
            test = test & t.column()
        out = (F if out is None else out).when(test, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> list[Rule]:
    """Rules for "quality is 0" from at most max_labels labelled documents that pass the base rules, chosen by a hash of their id.

    Labels without id or quality are left out; of repeated ids the worst label counts.
    """
    own = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = own.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(max_labels)
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    stats = with_statistics(some).filter(~base_failed()).groupBy(F.col("doc.doc_id").alias("doc_id"))
    rows = stats.agg(F.min(F.struct(*FEATURES)).alias("f"), F.min("doc.quality").alias("quality")).collect()
    return learn([r.f.asDict() | {"bad": int(r.quality == 0)} for r in sorted(rows, key=lambda r: r.doc_id)])


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Struct doc of all columns of docs, BASE counts, FEATURES, base_failed, rule (int, null if none fired) and kept.

    Works row by row: repeated rows give a row each and an empty table none; null or empty texts have no words and fail the base rules.
    """
    df = with_statistics(docs).withColumn("base_failed", base_failed())
    df = df.withColumn("rule", F.when(~F.col("base_failed"), rule_number(rules)))
    return df.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select(F.col("doc.doc_id").alias("doc_id"), *BASE, "base_failed", "kept", "rule")
