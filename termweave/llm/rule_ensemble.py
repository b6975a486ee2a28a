"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into one column expression.

1. `statistics`: shares and counts of a whole text, all DataFrame expressions.
2. A forest of shallow trees on the labelled rows; each path from a root to a node is a rule, a conjunction of bounds.
3. A lasso logistic regression over the rules as 0/1 columns leaves few of them with a weight.
4. `compiled`: the sum of the weights of the rules that hold, through the logistic function, as a Spark column.

Learning runs in Spark over all labelled rows given to it; only trees and weights reach the driver.

Defined results: null and empty texts have statistics of 0 and get the score of such a text; without labels of both classes
the score is the share of label 1, or 0.5 without any. A null label is no label; an id with several labels counts each.
Rows keep their places: repeated rows, null ids and extra columns need no care.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import BLANK_CLASS

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = {"symbols": "#*$%&<>@^~=+_\\", "bars": "|", "marks": "!?", "stops": ".,;:", "digits": "0123456789", "upper": UPPER}
FEATURES = (
    "log_words", "word_length", "distinct_share", "line_words", "dup_line_share", *[f"{name}_share" for name in CLASSES],
    "blank_share", "wide_share", "lower_start_share",
)


@dataclass(frozen=True)
class Options:
    trees: int = 24
    depth: int = 3
    penalty: float = 0.002
    seed: int = 11


#: feature index, "<=" or ">", threshold
Bound = tuple[int, str, float]


@dataclass(frozen=True)
class Ensemble:
    offset: float
    rules: tuple[tuple[tuple[Bound, ...], float], ...]


def statistics(docs: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """The kept columns and one double per feature."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.struct(*[F.col(f"`{k}`") for k in keep]).alias("doc"), body.alias("t"))
    base = base.select(
        "doc", "t", F.length("t").alias("n"), F.filter(F.split("t", BLANK_CLASS + "+"), lambda w: w != "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"),
        *[F.length(F.translate("t", chars, "")).alias(name) for name, chars in CLASSES.items()],
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).alias("solid"),
    )
    n, words, lines = F.greatest("n", F.lit(1)), F.greatest(F.size("w"), F.lit(1)), F.greatest(F.size("l"), F.lit(1))
    values = {
        "log_words": F.log1p(F.size("w")), "word_length": F.col("solid") / words, "distinct_share": F.size(F.array_distinct("w")) / words,
        "line_words": F.size("w") / lines, "dup_line_share": 1 - F.size(F.array_distinct("l")) / lines,
        **{f"{name}_share": (F.col("n") - F.col(name)) / n for name in CLASSES},
        "blank_share": (F.col("n") - F.col("solid")) / n, "wide_share": (F.octet_length("t") - F.col("n")) / n,
        "lower_start_share": F.size(F.filter("l", lambda x: x.rlike("^[a-z]"))) / lines,
    }
    return base.select("doc", *[values[f].cast("double").alias(f) for f in FEATURES]).select(*[F.col(f"doc.`{k}`").alias(k) for k in keep], *FEATURES)


def _paths(node, bounds: dict[tuple[int, str], float]) -> list[tuple[Bound, ...]]:
    """The conjunctions of all nodes below a tree's root; of two bounds on one side of a feature the tighter one stays."""
    found = [tuple((f, side, value) for (f, side), value in sorted(bounds.items()))] if bounds else []
    if node.getClass().getSimpleName() == "LeafNode":
        return found
    split = node.split()
    feature, threshold = split.featureIndex(), float(split.threshold())
    for child, side, tighter in ((node.leftChild(), "<=", min), (node.rightChild(), ">", max)):
        key = (feature, side)
        found += _paths(child, bounds | {key: tighter(threshold, bounds.get(key, threshold))})
    return found


def holds(rule: Sequence[Bound]) -> Column:
    condition = F.lit(True)
    for feature, side, value in rule:
        column = F.col(FEATURES[feature])
        condition = condition & (column <= value if side == "<=" else column > value)
    return condition


def fit(rows: DataFrame, options: Options = Options()) -> Ensemble:
    """Learn from rows of the features and label (0 or 1)."""
    rows = rows.filter(F.col("label").isin(0, 1)).select(F.col("label").cast("double"), *FEATURES)
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows at most
    if len(sizes) < 2:
        share = 0.5 if not sizes else min(max(*sizes, 0.001), 0.999)
        return Ensemble(math.log(share / (1 - share)), ())
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows).select("label", "x")
    forest = RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=options.trees, maxDepth=options.depth, subsamplingRate=0.5, featureSubsetStrategy="onethird", seed=options.seed)
    trees = forest.fit(vectors).trees
    rules = sorted({path for tree in trees for path in _paths(tree._java_obj.rootNode(), {})})
    if not rules:
        share = sizes[1.0] / (sizes[0.0] + sizes[1.0])
        return Ensemble(math.log(share / (1 - share)), ())
    hits = rows.select("label", F.array(*[holds(r).cast("double") for r in rules]).alias("hits"))
    lasso = LogisticRegression(labelCol="label", featuresCol="x", elasticNetParam=1.0, regParam=options.penalty, maxIter=60, standardization=True)
    model = lasso.fit(hits.select("label", array_to_vector("hits").alias("x")))
    weights = model.coefficients.toArray().tolist()
    return Ensemble(float(model.intercept), tuple((r, w) for r, w in zip(rules, weights, strict=True) if w))


def compiled(ensemble: Ensemble) -> Column:
    """The ensemble's score, 0 to 1, over the feature columns."""
    total = F.lit(ensemble.offset)
    for rule, weight in ensemble.rules:
        total = total + F.when(holds(rule), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))
