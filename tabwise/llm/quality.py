"""Quality classifier: a sparse ensemble of rules over text statistics.

Small random trees are grown on labelled rows; every path from a root becomes a rule, a
conjunction of thresholds.  A logistic regression with an L1 penalty over the rules
keeps few of them.  The result is compiled into one Spark column expression, so scoring
needs neither the trees nor a model object.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.functions.staging import stage
from tabwise.llm.common import table
from tabwise.llm.statistics import NAMES, statistics_of

#: Documented bound: at most about so many labelled rows, picked by hash, are learnt from.
MAX_TRAINING_ROWS = 60_000
TREES, DEPTH = 24, 3
PENALTY = 0.0005
ITERATIONS = 40
TRAINING_PARTITIONS = 6
THRESHOLD = 0.7

#: Bounds by statistic: (least exclusive or None, most inclusive or None).
Rule = tuple[tuple[str, float | None, float | None], ...]


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, statistics: Column) -> Column:
        """The probability of label 1, as a column expression over a statistics array."""
        terms = [F.when(condition(rule, statistics), w).otherwise(0.0) for rule, w in self.rules]
        return 1 / (1 + F.exp(-sum(terms, F.lit(self.intercept))))


def condition(rule: Rule, statistics: Column) -> Column:
    parts = []
    for name, low, high in rule:
        value = F.get(statistics, NAMES.index(name))
        parts += [value > low] if low is not None else []
        parts += [value <= high] if high is not None else []
    return reduce(and_, parts)


def tree_paths(node, bounds: dict[int, tuple[float | None, float | None]] | None = None) -> set[Rule]:
    """The rule of every node below the root of a fitted tree."""
    bounds = bounds or {}
    found = {tuple((NAMES[k], *v) for k, v in sorted(bounds.items()))} if bounds else set()
    if node.subtreeDepth():
        feature, cut = node.split().featureIndex(), float(node.split().threshold())
        low, high = bounds.get(feature, (None, None))
        found |= tree_paths(node.leftChild(), bounds | {feature: (low, cut if high is None else min(cut, high))})
        found |= tree_paths(node.rightChild(), bounds | {feature: (cut if low is None else max(cut, low), high)})
    return found


def fit_rules(examples: DataFrame) -> RuleModel:
    """``examples``: statistics array and label (0 or 1).  With a single class, or no
    rows, the model is the share of label 1 (one of each added) and no rule."""
    counts = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    zeros, ones = counts.get(0, 0), counts.get(1, 0)
    if not zeros or not ones:
        return RuleModel(math.log((ones + 1) / (zeros + 1)), ())
    vectors = examples.select(F.col("label").cast("double"), array_to_vector("statistics").alias("features"))
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", subsamplingRate=0.7, maxBins=64, seed=1
    ).fit(vectors)
    rules = sorted({r for t in forest.trees for r in tree_paths(t._java_obj.rootNode())}, key=repr)
    flags = F.array(*[condition(r, F.col("statistics")).cast("double") for r in rules])
    matrix = examples.select(F.col("label").cast("double"), array_to_vector(flags).alias("features")).persist()
    fitted = LogisticRegression(
        elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=ITERATIONS, aggregationDepth=2
    ).fit(matrix)
    matrix.unpersist()
    weights = fitted.coefficients.toArray()
    return RuleModel(float(fitted.intercept), tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id and label of the rows to learn from: not held out, and about
    ``MAX_TRAINING_ROWS`` at most.

    Labels other than 0 and 1, and null ids, are left out; a document labelled twice
    counts twice.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select(
        "doc_id", F.col("quality").alias("label")
    )
    share = min(1.0, MAX_TRAINING_ROWS / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < math.ceil(share * 1_000_000))


def train(spark: SparkSession, statistics: DataFrame, labels: DataFrame) -> RuleModel:
    """From doc_id and statistics, and the labels of rows that are not held out."""
    known = training_labels(labels)
    examples = stage(
        statistics.join(known, "doc_id").select("label", "statistics").repartition(TRAINING_PARTITIONS), "examples"
    )
    return fit_rules(examples)


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[RuleModel, DataFrame]:
    """The model, and the staged statistics of all documents (doc_id, statistics)."""
    statistics = stage(docs.select("doc_id", statistics_of(F.col("text")).alias("statistics")), "statistics")
    return train(spark, statistics, labels), statistics


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Empty and null texts are scored by their statistics, all zero.  Rows that repeat a
    doc_id are scored each.  Other columns are never read.  An empty table gives no rows.
    """
    model, statistics = learn(spark, docs, labels)
    score = model.score(F.col("statistics"))
    return statistics.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns.

    The labels to learn from are a bounded number, so they go to the documents, and
    statistics are taken of the labelled ones first and then once of all.
    """
    known = F.broadcast(training_labels(labels))
    examples = docs.select("doc_id", "text").join(known, "doc_id").select("label", statistics_of(F.col("text")).alias("statistics"))
    model = fit_rules(stage(examples.repartition(TRAINING_PARTITIONS), "examples"))
    return docs.where(model.score(statistics_of(F.col("text"))) >= threshold)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
