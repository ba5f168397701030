"""Quality classifier: a sparse ensemble of rules, compiled to column expressions.

Statistics of each whole text are computed once.  Trees are grown on labelled
rows, every path from a root becomes a conjunctive rule over the statistics, a
lasso logistic regression weighs the rules, and the rules with weight are one
column expression that scores any text where it lies.

The fit takes at most ``most_rows`` labelled rows outside the held-out fold,
chosen by a hash of their id; scoring takes every row.  Labels, language, source
and id are never inputs of a score.  Null and empty texts are scored like any
other, from statistics that are zero; with labels of one class or none, every
score is that class's share (0.5 for none).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

TREES, DEPTH, LASSO = 12, 3, 0.001
MOST_ROWS = 20_000


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text; shares are 0 for a text without what they are a share of."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n_words, lines = F.size(words), F.split(text, "\n")
    share = lambda part, whole: F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))
    n = F.length(text)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return {
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": share(n, n_words),
        "distinct_words": share(F.size(F.array_distinct(words)), n_words),
        "upper": share(count(r"\p{Lu}"), n),
        "marks": share(count(r"[^\p{L}\p{N}\s]"), n),
        "mark_runs": share(count(r"[^\p{L}\p{N}\s]{2,}"), n_words),
        "digits": share(count(r"[0-9]"), n),
        "bars": share(count(r"(?<=\s)[^\p{L}\p{N}\s]+(?=\s)"), n_words),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
    }


def held_out(key: str) -> Column:
    """Rows whose labels are never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(stats: DataFrame, labels: DataFrame, key: str, label: str, most_rows: int) -> DataFrame:
    """At most ``most_rows`` labelled rows outside the held-out fold, the same for the same tables."""
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("double").alias("label"))
    usable = stats.where(~held_out(key)).join(marks, key)
    order = [F.xxhash64(F.col(key)), F.col(key), *[F.col(c) for c in stats.columns if c != key]]
    return usable.orderBy(*order).limit(most_rows)


def paths(model, names: list[str]) -> list[tuple[tuple[str, bool, float], ...]]:
    """Every path from a root of a tree ensemble, as conditions (statistic, at most, threshold)."""
    found = set()

    def walk(node, so_far):
        if so_far:
            found.add(tuple(sorted(set(so_far))))
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            name, at = names[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), (*so_far, (name, True, at)))
            walk(node.rightChild(), (*so_far, (name, False, at)))

    for tree in model._java_obj.trees():
        walk(tree.rootNode(), ())
    return sorted(found)


def holds(rule) -> str:
    """A rule as a Spark SQL condition."""
    return " AND ".join(f"{name} {'<=' if at_most else '>'} {at!r}D" for name, at_most, at in rule)


class Ensemble:
    """Weighted rules over the statistics."""

    def __init__(self, rules, weights, intercept: float):
        self.rules, self.weights, self.intercept = rules, weights, intercept

    def score(self) -> Column:
        """A column over the statistics' columns, from 0 to 1."""
        terms = [f"IF({holds(r)}, {w!r}D, 0D)" for r, w in zip(self.rules, self.weights)]
        return F.expr(f"1 / (1 + exp(-({' + '.join([f'{self.intercept!r}D', *terms])})))")


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", most_rows: int = MOST_ROWS) -> Ensemble:
    """Grow trees, take their paths, and weigh them by a lasso logistic regression."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    names = [c for c in stats.columns if c != key]
    rows = written(training_rows(stats, labels, key, label, most_rows), "quality-training")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        share = sum(k * n for k, n in counts.items()) / sum(counts.values()) if counts else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Ensemble([], [], math.log(share / (1 - share)))
    vector = lambda terms: array_to_vector(F.expr(f"array({', '.join(terms)})")).alias("features")
    forest = RandomForestClassifier(
        numTrees=TREES,
        maxDepth=DEPTH,
        minInstancesPerNode=5,
        maxBins=64,
        subsamplingRate=0.8,
        featureSubsetStrategy="onethird",
        seed=7,
    )
    rules = paths(forest.fit(rows.select("label", vector(names))), names)
    weigh = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False)
    model = weigh.fit(rows.select("label", vector([f"IF({holds(r)}, 1D, 0D)" for r in rules])))
    kept = [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if w]
    return Ensemble([r for r, _ in kept], [w for _, w in kept], float(model.intercept))


def with_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    return docs.select(*keep, *[c.alias(n) for n, c in statistics(text_of(text)).items()])


def classify(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    most_rows: int = MOST_ROWS,
) -> DataFrame:
    """Per row: whether it is held out, its score, and the class that the score predicts."""
    stats = written(with_statistics(docs, [key], text), "quality-statistics")
    score = fit(stats, labels, key, label, most_rows).score()
    return stats.select(
        key,
        held_out(key).alias("held_out"),
        score.alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def kept(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    most_rows: int = MOST_ROWS,
) -> DataFrame:
    """The rows of ``docs`` that score at least 0.5, all columns unchanged."""
    columns = docs.columns
    whole = docs.select(F.struct(*columns).alias("row"), F.col(key).alias(key), F.col(text).alias("whole_text"))
    stats = written(with_statistics(whole, ["row", key], "whole_text"), "quality-statistics")
    score = fit(stats.drop("row"), labels, key, label, most_rows).score()
    return stats.where(score >= 0.5).select("row.*")
