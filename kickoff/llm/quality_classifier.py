"""Quality classifier as a sparse rule ensemble (operator 7).

Statistics of the whole text are column expressions. A forest of shallow trees is grown on a bounded sample
of labelled rows (``SAMPLE``, the smallest hashes of the id); every path from a root to a node is a conjunctive
rule over statistics. A lasso logistic regression weighs the rules and leaves most at zero. The others are
compiled into one column expression, so scoring is a projection over the scan: no join, no shuffle, no Python.

Only ``text`` feeds the statistics. Rows whose crc32(id as text) mod ``FOLDS`` is ``TEST_FOLD`` are held out: their
labels are never read. Each label teaches with one text (of rows that share an id, the one of least hash).

Defined cases: a null text is an empty one; an empty text has all statistics at zero and gets the score of the rules
it meets. A null id counts as empty text in the fold rule. Null labels are ignored, several labels of one id are
separate training rows, repeated documents are scored independently. Without labels, or with labels of one
class only, the score is that class's share (0.5 without any). Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kickoff.session import materialize

SAMPLE = 20_000  # most labelled rows the model is fitted on
FOLDS, TEST_FOLD = 3, 1  # fixed values of the contract
TREES, DEPTH, LEAST = 12, 3, 20
PENALTY = 1e-3
SEPARATORS = r"[\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of the whole text."""
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1))
    words = F.filter(F.split(t, SEPARATORS), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")

    def share(symbols: str) -> Column:
        return (F.length(t) - F.length(F.translate(t, symbols, ""))) / chars

    return {
        "words": F.log1p(F.size(words)),
        "word_length": F.length(t) / F.greatest(F.size(words), F.lit(1)),
        "distinct_words": F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "symbols": share("#*$%&|<>{}[]\\^~@=_"),
        "marks": share("!?"),
        "stops": share(".,;:"),
        "digits": share("0123456789"),
        "capitals": (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))) / chars,
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction: for each (statistic, threshold, above) the statistic is above it or at most it."""

    terms: frozenset

    def holds(self) -> Column:
        out = F.lit(True)
        for name, threshold, above in sorted(self.terms):
            out = out & ((F.col(name) > threshold) if above else (F.col(name) <= threshold))
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    names: tuple[str, ...]
    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self, stats: DataFrame) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.holds(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def tree_rules(model, names: list[str]) -> list[Rule]:
    """The path to every node below the root of every tree, without duplicates, in a fixed order."""
    found: set[Rule] = set()

    def descend(node, terms: frozenset) -> None:
        if terms:
            found.add(Rule(terms))
        if node.getClass().getSimpleName() != "InternalNode":
            return
        split = node.split()
        name, threshold = names[split.featureIndex()], float(split.threshold())
        descend(node.leftChild(), terms | {(name, threshold, False)})
        descend(node.rightChild(), terms | {(name, threshold, True)})

    for tree in model.trees:
        descend(tree._call_java("rootNode"), frozenset())
    return sorted(found, key=lambda r: sorted(r.terms))


def fold(identity: Column) -> Column:
    return F.crc32(F.coalesce(identity.cast("string"), F.lit(""))) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample: int = SAMPLE) -> RuleEnsemble:
    """Learn from the labels outside the test fold; at most ``sample`` of them."""
    chosen = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
              .where(F.col("label").isin(0.0, 1.0) & F.col("id").isNotNull() & (fold(F.col("id")) != TEST_FOLD))
              .orderBy(F.xxhash64("id"), "id", "label").limit(sample))
    stats = statistics(F.col("text"))
    names = list(stats)
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .join(F.broadcast(chosen), "id"))  # at most ``sample`` rows of two numbers
    # one text per label, however many rows repeat its id (a partial group limit: copies are left out before the shuffle)
    nth = F.row_number().over(Window.partitionBy("id", "label").orderBy(F.xxhash64("text"), "text"))
    rows = rows.withColumn("nth", nth).where("nth = 1").select("id", "label", *(c.alias(n) for n, c in stats.items()))
    rows = materialize(rows, "quality-sample").coalesce(4)
    total, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    share = positive / total if total else 0.5
    if share in (0.0, 1.0) or not total:
        return RuleEnsemble(tuple(names), (), math.inf if share == 1 else -math.inf if share == 0 else 0.0)
    table = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("label", "features", *names).cache()
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=7,
                                    minInstancesPerNode=max(1, min(LEAST, int(total) // 50))).fit(table)
    rules = tree_rules(forest, names)
    if not rules:
        return RuleEnsemble(tuple(names), (), math.log(share / (1 - share)))
    met = table.select("label", F.array(*(r.holds().cast("double") for r in rules)).alias("met"))
    from pyspark.ml.functions import array_to_vector

    met = met.select("label", array_to_vector("met").alias("features")).cache()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=60).fit(met)
    met.unpersist()
    table.unpersist()
    weights = lasso.coefficients.toArray().tolist()
    return RuleEnsemble(tuple(names), tuple((r, w) for r, w in zip(rules, weights) if w != 0.0), float(lasso.intercept))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """Per document: id, ``held_out``, ``score``, ``predicted``."""
    model = fit(docs, labels, id_col, text_col, label_col, sample)
    stats = docs.select(F.col(id_col).alias("id"), *(c.alias(n) for n, c in statistics(F.col(text_col)).items()))
    return stats.select(F.col("id").alias(id_col), (fold(F.col("id")) == TEST_FOLD).alias("held_out"),
                        model.score(stats).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
