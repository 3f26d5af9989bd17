"""Quality rules: a decision list learned from labelled statistics, emitted as one CASE expression.

Sequential covering: a rule is a conjunction of thresholds. It is grown condition by condition for the
best information gain on two thirds of the labelled rows, pruned from its end on the other third, and
accepted while its precision holds there; rows it covers leave the training rows, then the next rule
is learned. Every count is a Spark aggregate over binned rows; the driver sees at most
``len(FEATURES) * (bins + 1)`` counts a step. No Python runs on the executors.

Null texts count as empty; empty tables and tables without labelled rows give an empty list, which
rejects nothing beyond the base rules. Repeated labelled rows count as often as they come.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradebook.llm.common import bounded_sample, query, table, unit
from tradebook.llm.statistics import FEATURES, features, with_counts
from tradebook.session import settle

#: Labelled rows to learn from, at most.
SAMPLE_ROWS = 20_000


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def on(self, values: dict[str, Column]) -> Column:
        v = values[self.feature]
        return v > F.lit(self.threshold) if self.above else v <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def rule_matches(rule: Rule, values: dict[str, Column]) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.on(values)
    return out


def rule_number(rules: list[Rule], values: dict[str, Column]) -> Column:
    """The position of the first rule that matches (from 1), null if none does."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        out = F.when(rule_matches(rules[k - 1], values), F.lit(k)).otherwise(out)
    return out


def labelled_statistics(documents: DataFrame, labels: DataFrame, label: str, sample_rows: int) -> DataFrame:
    """One row of features for each labelled document (at most ``sample_rows``), written to the shared folder.

    Labels are compared by id; texts of other documents are not touched further than the scan.
    """
    marked = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label")) \
        .filter("_id is not null and _label is not null").groupBy("_id").agg(F.max("_label").alias("_label"))
    chosen = bounded_sample(marked, F.col("_id"), sample_rows, f"labels:{label}")
    texts = documents.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    joined = texts.join(chosen, "_id")
    counted = with_counts(joined, "_text", "_c_")
    return settle(counted.select("_id", "_label", *[v.alias(k) for k, v in features("_c_").items()]))


def _bins(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    """Distinct quantiles of every feature: the thresholds that rules may use."""
    cuts = [k / (bins + 1) for k in range(1, bins + 1)]
    got = rows.agg(*[F.percentile_approx(f, cuts, 10_000).alias(f) for f in FEATURES]).first()
    return {f: sorted(set(got[f] or [])) for f in FEATURES}


def _binned(rows: DataFrame, thresholds: dict[str, list[float]]) -> DataFrame:
    """(label, held, bins): bin k of a feature means that the first k thresholds lie below the value."""
    def bin_of(f: str) -> Column:
        cuts = F.array(*[F.lit(float(t)) for t in thresholds[f]]) if thresholds[f] else F.array().cast("array<double>")
        return F.size(F.filter(cuts, lambda t: F.col(f) > t))

    return settle(rows.select("_label", (unit("prune", F.col("_id")) < 1 / 3).alias("_held"),
                              F.array(*[bin_of(f) for f in FEATURES]).alias("_bins")))


def _matches(rule: list[tuple[int, bool, int]]) -> Column:
    out = F.lit(True)
    for feature, above, cut in rule:
        out = out & ((F.get("_bins", F.lit(feature)) > cut) if above else (F.get("_bins", F.lit(feature)) <= cut))
    return out


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    """Gain of a condition: covered targets times the bits that each of them gets cheaper."""
    return p * (math.log2((p + 1e-9) / (p + n + 1e-9)) - math.log2((p0 + 1e-9) / (p0 + n0 + 1e-9)))


def learn_rules(rows: DataFrame, max_rules: int = 12, max_conditions: int = 4, bins: int = 40,
                min_precision: float = 0.9, min_cover: int = 8) -> list[Rule]:
    """The ordered rules that reject: conjunctions covering rows of label 0.

    A rule counts only if, after pruning, it covers ``min_cover`` rows of label 0 and at least
    ``min_precision`` of what it covers on the pruning rows (and on all rows) has label 0.
    """
    thresholds = _bins(rows, bins)
    binned = _binned(rows, thresholds)
    target = (F.col("_label") == 0).cast("int")
    rules: list[list[tuple[int, bool, int]]] = []
    left = binned

    def grow() -> list[tuple[int, bool, int]]:
        rule: list[tuple[int, bool, int]] = []
        part = left.filter(~F.col("_held"))
        while len(rule) < max_conditions:
            counts = part.filter(_matches(rule)).select(target.alias("_t"), F.posexplode("_bins").alias("_f", "_b")) \
                .groupBy("_f", "_b").agg(F.sum("_t").alias("p"), F.count("*").alias("n")).collect()
            best = (1e-6, None, 0)
            for f in range(len(FEATURES)):
                hist = {r["_b"]: (r["p"], r["n"] - r["p"]) for r in counts if r["_f"] == f}
                p0, n0 = (sum(v[k] for v in hist.values()) for k in (0, 1))
                below_p = below_n = 0
                for cut in range(len(thresholds[FEATURES[f]])):
                    below_p += hist.get(cut, (0, 0))[0]
                    below_n += hist.get(cut, (0, 0))[1]
                    for above, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                        if p >= min_cover / 2:
                            best = max(best, (_gain(p0, n0, p, n), (f, above, cut), n))
            if best[1] is None:
                break
            rule.append(best[1])
            if best[2] == 0:
                break
        return rule

    def prune(rule: list[tuple[int, bool, int]]) -> tuple[list[tuple[int, bool, int]], bool]:
        """The beginning of the rule that does best on the pruning rows; whether it is good enough."""
        cols = []
        for k in range(1, len(rule) + 1):
            hit = _matches(rule[:k])
            for name, scope in (("h", F.col("_held")), ("a", F.lit(True))):
                cols += [F.sum(F.when(hit & scope, target).otherwise(0)).alias(f"{name}p{k}"),
                         F.sum(F.when(hit & scope, 1 - target).otherwise(0)).alias(f"{name}n{k}")]
        got = left.agg(*cols).first()
        worth = {k: ((got[f"hp{k}"] or 0) - (got[f"hn{k}"] or 0)) / max((got[f"hp{k}"] or 0) + (got[f"hn{k}"] or 0), 1)
                 for k in range(1, len(rule) + 1)}
        k = max(worth, key=lambda k: (worth[k], -k))
        good = all((got[f"{s}p{k}"] or 0) >= min_precision * ((got[f"{s}p{k}"] or 0) + (got[f"{s}n{k}"] or 0))
                   for s in "ha") and (got[f"ap{k}"] or 0) >= min_cover
        return rule[:k], good

    while len(rules) < max_rules:
        grown = grow()
        if not grown:
            break
        pruned, good = prune(grown)
        if not good:
            break
        rules.append(pruned)
        left = left.filter(~_matches(pruned))
    return _widened([tuple(Condition(FEATURES[f], above, float(thresholds[FEATURES[f]][cut])) for f, above, cut in rule)
                     for rule in rules], rows.filter("_label = 0"))


def _widened(rules: list[Rule], rejected: DataFrame) -> list[Rule]:
    """The rules with each threshold half way to the nearest rejected row they cover, so that they cover
    the same rejected rows and leave the most room to the others."""
    if not rules:
        return rules
    values = {f: F.col(f) for f in FEATURES}
    cols = []
    for i, rule in enumerate(rules):
        for j, c in enumerate(rule):
            near = F.min if c.above else F.max
            cols.append(near(F.when(rule_matches(rule, values), F.col(c.feature))).alias(f"n{i}_{j}"))
    got = rejected.agg(*cols).first()
    return [tuple(Condition(c.feature, c.above, (c.threshold + got[f"n{i}_{j}"]) / 2) for j, c in enumerate(rule))
            for i, rule in enumerate(rules)]


def judge(documents: DataFrame, rules: list[Rule], prefix: str = "_q_") -> DataFrame:
    """``documents`` with counts, ``base_failed``, ``rule`` and ``kept``, all named with ``prefix``.

    The always-true row number in ``kept`` keeps the optimizer from moving a filter on it below the steps that
    count: copied into one condition, those would be evaluated once for each element of their arrays.
    """
    counted = with_counts(documents, "text", prefix)
    # the fixed rules: too few words, or more than half of the words in repeated windows
    bad = (F.col(prefix + "n_words") < 50) | (
        F.lit(100) * F.col(prefix + "n_repeat_words") > F.lit(50) * F.col(prefix + "n_words"))
    return counted.withColumn(prefix + "rule", rule_number(rules, features(prefix))) \
        .withColumn(prefix + "base_failed", bad) \
        .withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & F.col(prefix + "rule").isNull()
                    & (F.monotonically_increasing_id() >= 0))


def learned_rules(documents: DataFrame, labels: DataFrame, label: str = "quality",
                  sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    return learn_rules(labelled_statistics(documents, labels, label, sample_rows))


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = judge(documents.select("doc_id", "text"), learned_rules(documents, labels))
    return out.select("doc_id", *[F.col("_q_" + c).alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the columns stay as they are."""
    rules = learned_rules(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).filter("_q_kept").select(*docs.columns)
