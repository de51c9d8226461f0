"""Classification metrics as aggregations.

Every metric is one aggregation pass over ``(label, prediction[, class probabilities])`` rows,
so it scales with the scored table and returns a small result. Class order is alphabetical
(A, D, H) as in the reference's label encoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The class labels in alphabetical order and the log-loss clip (float64 epsilon).
LABELS = ["A", "D", "H"]
EPS = 2.220446049250313e-16


def confusion(df: DataFrame, label: str = "target", pred: str = "predicted", labels=LABELS) -> DataFrame:
    """rows = actual class, columns = predicted class, counts (0 where empty)."""
    return (df.groupBy(F.col(label).alias("actual")).pivot(pred, list(labels))
            .agg(F.count(F.lit(1))).na.fill(0, subset=list(labels)))


def class_report(df: DataFrame, label: str = "target", pred: str = "predicted", labels=LABELS) -> DataFrame:
    """Per-class precision, recall, F1 and support; accuracy; macro and weighted averages
    (zero division → 0, like the reference). One aggregation pass."""
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == F.col(pred)).alias("hit")]
    for k in labels:
        aggs += [F.count_if((F.col(label) == k) & (F.col(pred) == k)).alias(f"tp_{k}"),
                 F.count_if(F.col(pred) == k).alias(f"pp_{k}"), F.count_if(F.col(label) == k).alias(f"sup_{k}")]
    one = df.agg(*aggs)
    zero = F.lit(0.0)

    def prec(k):
        return F.when(F.col(f"pp_{k}") > 0, F.col(f"tp_{k}") / F.col(f"pp_{k}")).otherwise(zero)

    def rec(k):
        return F.when(F.col(f"sup_{k}") > 0, F.col(f"tp_{k}") / F.col(f"sup_{k}")).otherwise(zero)

    def f1(k):
        p, r = prec(k), rec(k)
        return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(zero)

    rows = [F.struct(F.lit(k).alias("label"), prec(k).alias("precision"), rec(k).alias("recall"),
                     f1(k).alias("f1"), F.col(f"sup_{k}").alias("support")) for k in labels]
    nl = float(len(labels))

    def mean(fn):
        e = zero
        for k in labels:
            e = e + fn(k)
        return e / F.lit(nl)

    def weighted(fn):
        e = zero
        for k in labels:
            e = e + fn(k) * F.col(f"sup_{k}")
        return e / F.col("n")

    acc = F.col("hit") / F.col("n")
    rows += [F.struct(F.lit("accuracy").alias("label"), acc.alias("precision"), acc.alias("recall"),
                      acc.alias("f1"), F.col("n").alias("support")),
             F.struct(F.lit("macro avg").alias("label"), mean(prec).alias("precision"), mean(rec).alias("recall"),
                      mean(f1).alias("f1"), F.col("n").alias("support")),
             F.struct(F.lit("weighted avg").alias("label"), weighted(prec).alias("precision"),
                      weighted(rec).alias("recall"), weighted(f1).alias("f1"), F.col("n").alias("support"))]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def accuracy(df: DataFrame, label: str = "target", pred: str = "predicted") -> DataFrame:
    """Share of rows whose prediction equals the label (a missing prediction is wrong)."""
    return df.agg(F.avg(F.coalesce(F.col(label) == F.col(pred), F.lit(False)).cast("double")).alias("accuracy"),
                  F.count(F.lit(1)).alias("n"))


def log_loss(df: DataFrame, label: str = "target", probs=("prob_A", "prob_D", "prob_H"), labels=LABELS,
             digits: int = 9) -> DataFrame:
    """A10: mean negative log-probability of the true class after row-normalising the three
    probabilities (clipped at float64 epsilon); rows lacking probabilities are skipped."""
    total = F.col(probs[0]) + F.col(probs[1]) + F.col(probs[2])
    p_true = F.when(F.col(label) == labels[0], F.col(probs[0])).when(F.col(label) == labels[1], F.col(probs[1])) \
        .when(F.col(label) == labels[2], F.col(probs[2]))
    p = F.least(F.greatest(p_true / total, F.lit(EPS)), F.lit(1.0 - EPS))
    # greatest/least skip nulls in Spark, so filter on the raw ratio
    return df.where((p_true / total).isNotNull()).agg(F.round(-F.avg(F.ln(p)), digits).alias("log_loss"),
                                       F.count(F.lit(1)).alias("n"))


def bookmaker_accuracy(df: DataFrame, pick: str = "pick", label: str = "target") -> DataFrame:
    """Accuracy of the bookmaker's favourite; contests without prices count as wrong."""
    return df.agg(F.avg(F.coalesce(F.col(pick) == F.col(label), F.lit(False)).cast("double")).alias("bookmaker_accuracy"),
                  F.count(F.lit(1)).alias("n"))


def board(picks: DataFrame, baseline: str) -> DataFrame:
    """One row per model from (model, split, target, predicted) rows: accuracy on the training and
    test part, their gap, the lift over the ``baseline`` model, and the place by test accuracy (ties by name).
    One aggregation over the rows; the window below sees one row per model."""
    hit = F.coalesce(F.col("predicted") == F.col("target"), F.lit(False)).cast("double")
    acc = picks.groupBy("model").agg(*(F.round(F.avg(F.when(F.col("split") == s, hit)), 9).alias(f"{s}_accuracy")
                                       for s in ("train", "test")))
    models = Window.partitionBy(F.lit(1))
    base = F.max(F.when(F.col("model") == baseline, F.col("test_accuracy"))).over(models)
    place = F.row_number().over(models.orderBy(F.desc("test_accuracy"), "model"))
    return acc.select("model", "train_accuracy", "test_accuracy", F.round(F.col("train_accuracy") - F.col("test_accuracy"), 9).alias("overfit_gap"),
                      F.round(F.col("test_accuracy") - base, 9).alias("lift"), place.alias("place"), (place == 1).alias("best"))


def append_run(scores: DataFrame, path: str, run: int) -> None:
    """Add one run's (model, accuracy) rows to the run table at ``path``."""
    scores.withColumn("run", F.lit(run)).write.mode("append").parquet(path)


def compare_runs(runs: DataFrame, first: int, second: int) -> DataFrame:
    """Two runs side by side, their difference, and the champion (best accuracy in either, ties by name)."""
    wide = runs.where(F.col("run").isin(first, second)).groupBy("model").agg(
        F.max(F.when(F.col("run") == first, F.col("accuracy"))).alias(f"accuracy_{first}"),
        F.max(F.when(F.col("run") == second, F.col("accuracy"))).alias(f"accuracy_{second}"))
    a, b = F.col(f"accuracy_{first}"), F.col(f"accuracy_{second}")
    order = Window.partitionBy(F.lit(1)).orderBy(F.greatest(a, b).desc(), "model")  # one row per model
    return wide.withColumns({"difference": F.round(b - a, 9), "champion": F.row_number().over(order) == 1})
