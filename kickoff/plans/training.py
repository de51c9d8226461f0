"""Model training, calibration, comparison, cross-validation and scoring.

Spark ML estimators train distributed on the model-ready table. Choices that keep the
reference's semantics:

* labels A, D, H → 0, 1, 2 (alphabetical, M1);
* the logistic model sees features standardised with the **population** standard deviation of
  the fit rows (M2), computed as plain column expressions (Spark's ``StandardScaler`` divides by
  the sample deviation);
* ``regParam = 1 / (C · n)`` reproduces scikit-learn's ``C`` penalty (M3);
* Spark's gradient boosting is binary and costs some ten jobs a tree, so both boosting models (M5 first-order, M6
  regularised second-order) are trained by ``operators/boosting.py``: all classes, models, folds and trials
  that train together share one pass per tree level;
* isotonic calibration fits one ``IsotonicRegression`` per class on the calibration rows and
  renormalises, a zero row becoming 1/3 each (M7).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prices import argmax_label, bookmaker_pick
from ..operators import boosting as BO
from ..operators import metrics as MT
from ..operators import splits as SP
from ..session import materialize
from . import features as FE

LABELS = MT.LABELS
PROBS = ["prob_A", "prob_D", "prob_H"]

# The reference's model parameters.
LOGISTIC = {"C": 0.5, "max_iter": 1000}
FOREST = {"numTrees": 200, "maxDepth": 8, "minInstancesPerNode": 20, "featureSubsetStrategy": "sqrt"}
BOOSTING = {"rounds": 200, "depth": 4, "rate": 0.05, "subsample": 0.8, "min_leaf": 20}
SECOND_ORDER = {"rounds": 200, "depth": 4, "rate": 0.05, "subsample": 0.8, "colsample": 0.8, "alpha": 0.1, "lam": 1.0,
                "min_child_weight": 10.0}
SEED = 42
PARTITION_BYTES = 16 << 20  # feature values of a partition of a fit table
NODE_ID_BYTES = 1 << 29  # most that the nodes of all rows in all trees of a forest may take while it grows
THREADS = 4  # independent fits that the driver starts at once


def label_col(target: str = "target"):
    t = F.col(target)
    return F.when(t == "A", 0.0).when(t == "D", 1.0).when(t == "H", 2.0)


def feature_columns(df: DataFrame) -> list[str]:
    """Model features present in the table (all-null columns are dropped by the caller)."""
    return [c for c in FE.MODEL_FEATURES if c in df.columns]


def prepare(mr: DataFrame, test_size: float = SP.TEST_SIZE, cal_fraction: float = SP.CALIBRATION_FRACTION) -> DataFrame:
    """Model-ready rows with ``idx``, ``split`` (fit / calibration / test) and ``label``."""
    idx = SP.with_row_index(mr)
    return SP.calibration_split(idx, test_size, cal_fraction).withColumn("label", label_col())


def usable_features(df: DataFrame, cols: list[str]) -> list[str]:
    """Drop feature columns that are null on every row (no median can repair them)."""
    counts = df.agg(*[F.count(c).alias(c) for c in cols]).first()
    return [c for c in cols if counts[c]]


def population_scaler(fit: DataFrame, cols: list[str]) -> dict:
    """M2: mean and population standard deviation of every feature on the fit rows."""
    row = fit.agg(*[e for c in cols for e in (F.avg(c).alias("m_" + c), F.stddev_pop(c).alias("s_" + c))]).first()
    return {c: (row["m_" + c] or 0.0, row["s_" + c] or 0.0) for c in cols}


def assemble(df: DataFrame, cols: list[str], scaler: dict | None = None, out: str = "features") -> DataFrame:
    if scaler:
        exprs = [((F.col(c) - F.lit(scaler[c][0])) / F.lit(scaler[c][1] if scaler[c][1] > 0 else 1.0)).alias("_z_" + c)
                 for c in cols]
        df = df.select("*", *exprs)
        cols = ["_z_" + c for c in cols]
    va = VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep")
    res = va.transform(df)
    return res.drop(*[c for c in cols if c.startswith("_z_")])


@dataclass
class Trained:
    name: str
    kind: str
    models: list
    cols: list[str]
    scaler: dict | None = None
    calibrators: list = field(default_factory=list)

    def raw_probabilities(self, df: DataFrame) -> DataFrame:
        if self.kind == "boosted":
            p = df.withColumn("_p", self.models[0].probabilities())
            return p.select(*df.columns, *[F.col("_p")[k].alias(PROBS[k]) for k in range(3)])
        x = assemble(df, self.cols, self.scaler)
        m = self.models[0]
        x = m.setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_y").transform(x)
        arr = vector_to_array("_p")
        x = x.select("*", *[arr[k].alias(PROBS[k]) for k in range(3)]).drop("_p", "_r", "_y")
        return x.drop("features")

    def probabilities(self, df: DataFrame) -> DataFrame:
        """Calibrated probabilities (raw if no calibrators were fitted) + ``predicted``."""
        return self.calibrated(self.raw_probabilities(df))

    def calibrated(self, x: DataFrame) -> DataFrame:
        """The same from rows that carry raw probabilities."""
        if self.calibrators:
            for k, iso in enumerate(self.calibrators):
                x = (iso.setFeaturesCol(PROBS[k]).setPredictionCol(f"_c{k}").transform(x))
            tot = F.col("_c0") + F.col("_c1") + F.col("_c2")
            x = x.select(*[c for c in x.columns if c not in PROBS and not c.startswith("_c")],
                         *[F.when(tot > 0, F.col(f"_c{k}") / tot).otherwise(F.lit(1.0 / 3)).alias(PROBS[k])
                           for k in range(3)])
        return x.withColumn("predicted", argmax_label(*PROBS))


def packed(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Label and features in as many partitions as their size asks for: an optimiser runs hundreds of small jobs on them."""
    n = rows.count()
    wanted = max(1, -(-n * len(cols) * 8 // PARTITION_BYTES))
    rows = rows.select("label", *cols)
    return rows.coalesce(wanted) if wanted < rows.rdd.getNumPartitions() else rows


def fit_logistic(fit: DataFrame, cols: list[str], C: float = LOGISTIC["C"], max_iter: int = LOGISTIC["max_iter"]) -> Trained:
    scaler = population_scaler(fit, cols)
    rows = assemble(packed(fit, cols), cols, scaler).select("label", "features").persist()
    n = rows.count()
    lr = LogisticRegression(family="multinomial", regParam=1.0 / (C * n), elasticNetParam=0.0, standardization=False,
                            maxIter=max_iter, labelCol="label", featuresCol="features")
    model = lr.fit(rows)
    rows.unpersist()
    return Trained("Logistic Regression", "single", [model], cols, scaler)


def fit_forest(fit: DataFrame, cols: list[str], **params) -> Trained:
    """The rows' nodes are kept between levels while they are small; else (as at first) rows go down from the root. The trees are the same."""
    p = {**FOREST, **params}
    rf = RandomForestClassifier(labelCol="label", featuresCol="features", seed=SEED, cacheNodeIds=4 * fit.count() * p["numTrees"] <= NODE_ID_BYTES, **p)
    return Trained("Random Forest", "single", [rf.fit(assemble(fit, cols))], cols)


def boosting_spec(name: str, **params) -> BO.Spec:
    """Parameters of a boosting model by its name."""
    second = name == "Second-order Boosting"
    return BO.Spec(name, second_order=second, seed=SEED, **{**(SECOND_ORDER if second else BOOSTING), **params})


def fit_boosting(rows: DataFrame, cols: list[str], specs: list[BO.Spec], edge_rows: DataFrame | None = None) -> list[Trained]:
    """Boosting models that train side by side on ``rows`` (each on its own share of them)."""
    return [Trained(m.spec.name, "boosted", [m], cols) for m in BO.boost(rows, cols, specs, edge_rows=edge_rows)]


#: Every registered model by its name. The boosting models are trained together.
FITTERS: dict[str, Callable] = {"Logistic Regression": fit_logistic, "Random Forest": fit_forest}
BOOSTERS = ("Gradient Boosting", "Second-order Boosting")


def in_threads(tasks: list[Callable]) -> list:
    """Results of independent driver-side fits, started ``THREADS`` at a time."""
    with ThreadPoolExecutor(THREADS) as pool:
        return [f.result() for f in [pool.submit(t) for t in tasks]]


def calibrate(t: Trained, cal: DataFrame) -> Trained:
    """M7: one isotonic map per class, fitted on the calibration rows, model frozen."""
    scored = t.raw_probabilities(cal).cache()
    t.calibrators = []
    for k in range(3):
        iso = IsotonicRegression(featuresCol=PROBS[k], labelCol="_is", predictionCol=f"_c{k}", isotonic=True)
        t.calibrators.append(iso.fit(scored.withColumn("_is", (F.col("label") == k).cast("double"))))
    scored.unpersist()
    return t


def _scored(t: Trained, data: DataFrame) -> DataFrame:
    """One scoring pass: label, split, calibrated probabilities and both picks (raw and calibrated) of every row."""
    raw = t.raw_probabilities(data.select("match_id", "split", "target", "label", *t.cols))
    raw = raw.withColumn("raw_pick", argmax_label(*PROBS)).drop(*t.cols)
    return materialize(t.calibrated(raw), "scored")


def _rounded(x: float) -> float:
    return round(x, 4)


def evaluate(t: Trained, data: DataFrame) -> dict:
    """Accuracy (raw model on fit rows; calibrated elsewhere), macro F1 and log loss per split."""
    scored = _scored(t, data)
    fit = scored.where(F.col("split") == "fit").select("target", F.col("raw_pick").alias("predicted"))
    out = {"model": t.name, "train_accuracy": MT.accuracy(fit).first()["accuracy"]}
    for split in ("calibration", "test"):
        s = scored.where(F.col("split") == split)
        rep = {r["label"]: r for r in MT.class_report(s).collect()}
        out[f"{split}_accuracy"] = rep["accuracy"]["precision"]
        out[f"{split}_f1_macro"] = rep["macro avg"]["f1"]
        out[f"{split}_log_loss"] = MT.log_loss(s).first()["log_loss"]
    return out


def train_models(data: DataFrame, names: tuple[str, ...] | None = None) -> list[Trained]:
    """M8: fit every model (or those named) on the fit rows, calibrate on the calibration rows."""
    cols = usable_features(data, feature_columns(data))
    fit = data.where(F.col("split") == "fit")
    cal = data.where(F.col("split") == "calibration")
    tasks = [lambda f=f: [f(fit, cols)] for name, f in FITTERS.items() if names is None or name in names]
    specs = [boosting_spec(name) for name in BOOSTERS if names is None or name in names]
    if specs:
        tasks.append(lambda: fit_boosting(fit, cols, specs))
    models = [m for group in in_threads(tasks) for m in group]
    return in_threads([lambda m=m: calibrate(m, cal) for m in models])


def leaderboard(spark: SparkSession, data: DataFrame, models: list[Trained]) -> DataFrame:
    """Metrics per model; ``best`` = first maximum of test accuracy, and
    ``best_by_calibration`` the choice that does not look at the test rows (D4)."""
    test = data.where(F.col("split") == "test").withColumn("pick", bookmaker_pick(*[F.col(c) for c in
                                                                                        ("odds_prob_home", "odds_prob_draw", "odds_prob_away")]))
    book = MT.bookmaker_accuracy(test).first()["bookmaker_accuracy"]
    counts = {r["split"]: r["count"] for r in data.groupBy("split").count().collect()}
    rows = in_threads([lambda m=m: evaluate(m, data) for m in models])
    for e in rows:
        e["overfit_gap"] = e["train_accuracy"] - e["test_accuracy"]
        e["lift_over_bookmaker"] = e["test_accuracy"] - book
        e.update({f"{k}_rows": counts.get(k, 0) for k in ("fit", "calibration", "test")})
    best = max(range(len(rows)), key=lambda i: (rows[i]["test_accuracy"], -i))
    best_cal = max(range(len(rows)), key=lambda i: (rows[i]["calibration_accuracy"], -i))
    for i, r in enumerate(rows):
        r["best"] = i == best
        r["best_by_calibration"] = i == best_cal
        for k, v in list(r.items()):
            if isinstance(v, float):
                r[k] = _rounded(v)
    return spark.createDataFrame(rows).orderBy(F.desc("test_accuracy"))


def select_model(data: DataFrame, models: list[Trained]) -> Trained:
    """M8: the choice by the calibration rows, which does not look at the test rows (D4). No other row is scored."""
    cal = data.where(F.col("split") == "calibration")
    hits = in_threads([lambda m=m: MT.accuracy(m.probabilities(cal)).first()["accuracy"] for m in models])
    return models[max(range(len(models)), key=lambda i: (hits[i], -i))]


def feature_importance(spark: SparkSession, t: Trained) -> DataFrame:
    """O3: tree importances, or mean |coefficient| over classes for the linear model."""
    m = t.models[0]
    if t.kind == "boosted":
        vals = m.importances().tolist()
    elif hasattr(m, "featureImportances"):
        vals = m.featureImportances.toArray().tolist()
    else:
        cm = m.coefficientMatrix.toArray()
        vals = [float(abs(cm[:, j]).mean()) for j in range(cm.shape[1])]
    return spark.createDataFrame(list(zip(t.cols, [float(v) for v in vals])), "feature string, importance double") \
        .orderBy(F.desc("importance"))


def test_predictions(t: Trained, data: DataFrame) -> DataFrame:
    """The test rows with ``predicted`` and the three calibrated probabilities."""
    return t.probabilities(data.where(F.col("split") == "test")).select(*FE.META, "target", "predicted", *PROBS)


# ------------------------------------------------------------------ M9 time-series CV
def fold_accuracy(t: Trained, rows: DataFrame, lo: int, hi: int) -> float:
    test = rows.where((F.col("idx") >= lo) & (F.col("idx") < hi))
    return MT.accuracy(t.raw_probabilities(test).withColumn("predicted", argmax_label(*PROBS))).first()["accuracy"]


def cv_rows(data: DataFrame, n_splits: int = SP.N_FOLDS) -> tuple[DataFrame, list[tuple[int, int, int]], list[str]]:
    """Rows of the train part (fit + calibration), the bounds of its folds, and the usable features."""
    train = data.where(F.col("split") != "test").drop("split")
    n = train.count()
    return train, SP.fold_bounds(n, n_splits), usable_features(train, feature_columns(train))


def cv_scores(data: DataFrame, fitters: dict | None = None, boosters: list[BO.Spec] | None = None,
              n_splits: int = SP.N_FOLDS) -> list[dict]:
    """M9: expanding folds over the train part (fit + calibration rows); fold models are fitted fresh (scaler
    per fold, D6) and scored by raw accuracy. Fits run side by side; the boosting models of all folds share
    their passes (bin edges from the first fold's rows, which every fold trains on)."""
    if fitters is None and boosters is None:
        fitters, boosters = FITTERS, [boosting_spec(name) for name in BOOSTERS]
    train, bounds, cols = cv_rows(data, n_splits)
    train = train.persist()

    def one(fitter: Callable, fold: tuple[int, int, int]) -> float:
        return fold_accuracy(fitter(train.where(F.col("idx") < fold[1]), cols), train, fold[1], fold[2])

    def boosted() -> list[float]:
        specs = [replace(spec, hi=fold[1]) for spec in boosters for fold in bounds]
        models = fit_boosting(train.where(F.col("idx") < max(f[1] for f in bounds)), cols, specs,
                              train.where(F.col("idx") < min(f[1] for f in bounds)))
        folds = [fold for _ in boosters for fold in bounds]
        return in_threads([lambda t=t, f=f: fold_accuracy(t, train, f[1], f[2]) for t, f in zip(models, folds)])

    tasks: list[Callable] = [boosted] if boosters else []
    tasks += [lambda f=f, b=b: one(f, b) for f in (fitters or {}).values() for b in bounds]
    results = in_threads(tasks)
    flat = results[1:] + results[0] if boosters else results
    train.unpersist()
    out = []
    for i, name in enumerate([*(fitters or {}), *(s.name for s in boosters or [])]):
        accs = flat[i * len(bounds): (i + 1) * len(bounds)]
        mean = sum(accs) / len(accs)
        std = math.sqrt(sum((a - mean) ** 2 for a in accs) / len(accs))
        out.append({"model": name, "mean_accuracy": mean, "std_accuracy": std, "folds": accs})
    return out
