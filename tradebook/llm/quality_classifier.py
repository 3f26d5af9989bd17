"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow random-forest trees are fitted on labelled statistics; every path from a root to a node is a
candidate rule, a conjunction of thresholds. A logistic regression with lasso penalty over the rules'
0/1 values keeps a few of them, and those are compiled into one Column expression: scoring is a
projection of the scan, without Python and without a shuffle.

The fit sees the labelled rows of the learning folds, ``SAMPLE_ROWS`` at most (chosen by a hash of the
id); scores never use labels, lang, source or doc_id. Null texts count as empty and get a score like
any other. With no labelled rows, or only one label, the score is that label's share (0.5 with none).
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradebook.llm.common import fold, query, table
from tradebook.llm.quality_rules import Condition, Rule, labelled_statistics, rule_matches
from tradebook.llm.statistics import FEATURES, features, with_counts
from tradebook.session import settle

#: Labelled rows to learn from, at most.
SAMPLE_ROWS = 20_000
TREES, DEPTH, PENALTY, SEED = 20, 3, 0.002, 11
THRESHOLD = 0.3


def tree_rules(node, path: Rule = ()) -> list[Rule]:
    """The conjunctions that lead to the nodes below ``node`` (a JVM tree node)."""
    if not node.getClass().getSimpleName().startswith("Internal"):
        return []
    split = node.split()
    name, cut = FEATURES[split.featureIndex()], float(split.threshold())
    found = []
    for child, above in ((node.leftChild(), False), (node.rightChild(), True)):
        rule = (*path, Condition(name, above, cut))
        found += [rule, *tree_rules(child, rule)]
    return found


def narrowed(rule: Rule) -> Rule:
    """The rule with one bound at most on each side of a feature, in a fixed order."""
    bounds: dict[tuple[str, bool], float] = {}
    for c in rule:
        tighter = max if c.above else min
        bounds[c.feature, c.above] = tighter(bounds.get((c.feature, c.above), c.threshold), c.threshold)
    return tuple(Condition(f, above, cut) for (f, above), cut in sorted(bounds.items()))


class RuleEnsemble:
    """An intercept and weighted rules."""

    def __init__(self, intercept: float, rules: list[tuple[Rule, float]]):
        self.intercept, self.rules = intercept, rules

    def score(self, values: dict[str, Column]) -> Column:
        margin = F.lit(self.intercept)
        for rule, weight in self.rules:
            margin = margin + F.when(rule_matches(rule, values), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))

    def __str__(self) -> str:
        return "\n".join([f"{self.intercept:+.3f}", *[f"{w:+.3f} {' and '.join(map(str, r))}" for r, w in self.rules]])


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleEnsemble:
    """Learn from written rows of ``FEATURES`` and ``_label``."""
    total = rows.agg(F.count("*").alias("n"), F.sum("_label").alias("p")).first()
    share = ((total["p"] or 0) + 0.5) / (total["n"] + 1) if total["n"] else 0.5
    if not total["n"] or total["p"] in (0, total["n"]):
        return RuleEnsemble(math.log(share / (1 - share)), [])
    vectors = rows.select(F.col("_label").cast("double").alias("label"), array_to_vector(F.array(*FEATURES)).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, subsamplingRate=0.7, seed=SEED,
                                    featureSubsetStrategy="onethird").fit(vectors)
    rules = sorted({narrowed(r) for t in forest.trees for r in tree_rules(t._call_java("rootNode"))}, key=str)
    if not rules:
        return RuleEnsemble(math.log(share / (1 - share)), [])
    values = {f: F.col(f) for f in FEATURES}
    hits = settle(rows.select(F.col("_label").cast("double").alias("label"), F.array(
        *[rule_matches(r, values).cast("double") for r in rules]).alias("hits")))
    model = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(
        hits.select("label", array_to_vector("hits").alias("features")))
    weights = model.coefficients.toArray()
    return RuleEnsemble(float(model.intercept), [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6])


def score(documents: DataFrame, model: RuleEnsemble, prefix: str = "_qc_") -> DataFrame:
    """``documents`` with the column ``<prefix>score``."""
    counted = with_counts(documents, "text", prefix)
    staged = counted.withColumns({prefix + "f_" + k: v for k, v in features(prefix).items()})
    return staged.withColumn(prefix + "score", model.score({f: F.col(prefix + "f_" + f) for f in FEATURES}))


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learning = labels.filter(fold(F.col("doc_id"), 5) != 0)
    model = fit(labelled_statistics(documents, learning, "quality", SAMPLE_ROWS))
    out = score(documents.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("_qc_score").alias("score"),
                      (F.col("_qc_score") >= THRESHOLD).cast("int").alias("predicted"))
