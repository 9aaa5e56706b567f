"""Linear probes, head training and sparse probes on Spark ML."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize, standardize
from ..session import cut_lineage, drop_table
from .clean import label_eligibility
from .sampling import train_test_split


def fold_scalers(df: DataFrame, fold: str, vec: str = "vec") -> DataFrame:
    """(fold, mean, std): per-feature train mean and population std of every
    fold at once; train = all other folds, from the sums of each fold."""
    sums = Summarizer.metrics("count", "sum", "normL2").summary(array_to_vector(F.col(vec).cast("array<double>")))
    per_fold = df.groupBy(fold).agg(sums.alias("m")).select(fold, F.col("m.count").alias("n"), F.posexplode(F.arrays_zip(vector_to_array("m.sum").alias("s"), vector_to_array("m.normL2").alias("l"))).alias("dim", "x"))
    cells = per_fold.select(fold, "dim", "n", F.col("x.s").alias("s"), (F.col("x.l") * F.col("x.l")).alias("q"))  # folds x dimensions
    total = cells.groupBy("dim").agg(*[F.sum(c).alias(f"t{c}") for c in "nsq"])
    rest = cells.join(total, "dim").select(fold, "dim", *[(F.col(f"t{c}") - F.col(c)).alias(c) for c in "nsq"])
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    rest = rest.select(fold, "dim", mean.alias("m"), F.when(std < 1e-6, 1.0).otherwise(std).alias("d"))
    packed = F.array_sort(F.collect_list(F.struct("dim", "m", "d")))  # one entry per dimension
    return rest.groupBy(fold).agg(packed.alias("p")).select(
        fold, F.transform("p", lambda x: x["m"]).alias("mean"), F.transform("p", lambda x: x["d"]).alias("std")
    )


def probe_cross_validation(df: DataFrame, ident: str, label: str, fold: str = "fold", vec: str = "vec", balanced: bool = False, reg: float = 1e-3, max_iter: int = 50) -> DataFrame:
    """(id, label, fold, pred, score): out-of-fold predictions of a linear probe.

    Scaling is fitted on the train part; ``balanced`` weights classes by
    n / (2 * n_c). Labels are 0, 1, 2 ... Only the model fits loop over folds.
    """
    base = cut_lineage(df.select(ident, label, fold, vec))
    scalers = cut_lineage(fold_scalers(base, fold, vec))
    out = []
    for f in sorted(r[fold] for r in scalers.select(fold).collect()):
        scaler = scalers.filter(F.col(fold) == f).select(F.struct("mean", "std").alias("s")).scalar()
        scaled = base.withColumn("_s", scaler)
        rows = scaled.select(ident, F.col(label).cast("double").alias("label"), fold, array_to_vector(standardize(vec, F.col("_s.mean"), F.col("_s.std"))).alias("features"))
        train = rows.filter(F.col(fold) != f)
        model_args = {}
        if balanced:
            counts = train.groupBy("label").agg(F.count("*").alias("_c"))
            train = train.join(counts, "label").withColumn("_n", counts.agg(F.sum("_c")).scalar()).withColumn("w", F.col("_n") / (2 * F.col("_c")))
            model_args["weightCol"] = "w"
        model = LogisticRegression(regParam=reg, maxIter=max_iter, standardization=False, **model_args).fit(train)
        got = model.transform(rows.filter(F.col(fold) == f))
        top = F.array_max(vector_to_array("probability"))
        out.append(got.select(ident, F.col("label").cast("int").alias("label"), fold, F.col("prediction").cast("int").alias("pred"), top.alias("score")))
    return reduce(DataFrame.unionByName, out)


#: Groups in which the gradients of tasks are added up before the driver adds the groups.
GRADIENT_GROUPS = 8


class Head:
    """One hidden layer and a softmax; its weights are of fixed size and live on the driver."""

    def __init__(self, dims: int, hidden: int, classes: int, seed: int):
        rng = np.random.default_rng(seed)
        self.shapes = [(dims, hidden), (hidden,), (hidden, classes), (classes,)]
        self.weights = [rng.normal(0, math.sqrt(2 / s[0]), s) if len(s) == 2 else np.zeros(s) for s in self.shapes]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hidden layer, class probabilities)."""
        w1, b1, w2, b2 = self.weights
        h = np.maximum(x @ w1 + b1, 0.0)
        z = h @ w2 + b2
        p = np.exp(z - z.max(1, keepdims=True))
        return h, p / p.sum(1, keepdims=True)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Summed cross entropy of the rows and its gradient, all weights in one vector."""
        h, p = self.forward(x)
        loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
        p[np.arange(len(y)), y] -= 1.0
        back = (p @ self.weights[2].T) * (h > 0)
        return float(loss), np.concatenate([g.ravel() for g in (x.T @ back, back.sum(0), h.T @ p, p.sum(0))])

    def unpack(self, flat: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([math.prod(s) for s in self.shapes])
        return [part.reshape(s) for part, s in zip(np.split(flat, ends[:-1]), self.shapes)]


def _epoch(rows: DataFrame, head: Head) -> tuple[float, np.ndarray, int, int, int]:
    """(loss, gradient, train rows, right, test rows) of one pass over (vec, y, test)."""
    shared = rows.sparkSession.sparkContext.broadcast(head)

    def partial(batches):
        model, loss, total, n, right, tested = shared.value, 0.0, 0.0, 0, 0, 0
        for b in batches:
            if not len(b):
                continue
            x, y, test = np.stack(b["vec"].to_numpy()).astype(np.float64), b["y"].to_numpy(), b["test"].to_numpy()
            right += int((model.forward(x[test])[1].argmax(1) == y[test]).sum()) if test.any() else 0
            tested += int(test.sum())
            if not test.all():
                one, gradient = model.gradient(x[~test], y[~test])
                loss, total, n = loss + one, total + gradient, n + int((~test).sum())
        if n or tested:
            yield pd.DataFrame({"g": [np.atleast_1d(total).tolist()], "loss": [loss], "n": [n], "right_": [right], "tested": [tested]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = [np.array(g) for g, n in zip(pdf["g"], pdf["n"]) if n]
        sums = pdf[["loss", "n", "right_", "tested"]].sum()
        return pd.DataFrame({"g": [np.sum(whole, axis=0).tolist() if whole else []], **{c: [sums[c]] for c in sums.index}})

    schema = "g array<double>, loss double, n long, right_ long, tested long"
    parts = rows.mapInPandas(partial, schema).withColumn("_grp", F.spark_partition_id() % GRADIENT_GROUPS)
    got = parts.groupBy("_grp").applyInPandas(lambda pdf: added(pdf), schema).collect()  # GRADIENT_GROUPS rows of one head
    gradient = sum((np.array(r.g) for r in got if len(r.g)), np.zeros(sum(math.prod(s) for s in head.shapes)))
    return (sum(r.loss for r in got), gradient, *(sum(r[c] for r in got) for c in ("n", "right_", "tested")))


def head_training(df: DataFrame, ident: str, label: str, vec: str = "vec", hidden: int = 16, epochs: int = 40, rate: float = 0.05, floor: int = 10, seed: int = 42):
    """(head, classes, curve): a property head on L2-normalised vectors, best epoch kept.

    Unusable labels leave, 80/20 hashed split per class, classes are the sorted labels.
    An epoch is one job: the gradient of the train rows and, in the same pass, the
    validation accuracy of the weights it starts from; gradients are added in groups
    and an Adam step follows on the driver. ``curve`` has a row for each epoch
    (epoch, train_loss, valid_accuracy, chosen); of equal accuracies the first is chosen.
    """
    usable = label_eligibility(df.select(ident, F.col(label).cast("string").alias("target")), ["target"], floor, ident)
    rows = df.select(ident, vec).join(usable.select(ident, "label"), ident)
    split = train_test_split(rows, ident, "label", 0.2, seed)
    classes = sorted(r.label for r in usable.select("label").distinct().collect())  # categories
    place = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)]) if classes else F.lit(None)
    ready = cut_lineage(split.select(l2_normalize(vec).alias("vec"), place[F.col("label")].cast("int").alias("y"), (F.col("split") == "test").alias("test"))) if classes else None
    if ready is None:
        return None, [], df.sparkSession.createDataFrame([], CURVE)
    head = Head(len(ready.select("vec").first()[0]), hidden, len(classes), seed)
    first, second, curve, best = 0.0, 0.0, [], None
    for epoch in range(epochs):
        loss, gradient, n, right, tested = _epoch(ready, head)
        accuracy = right / tested if tested else 0.0
        curve.append((epoch, loss / max(n, 1), accuracy))
        if best is None or accuracy > best[0]:
            best = (accuracy, epoch, [w.copy() for w in head.weights])
        gradient = gradient / max(n, 1)
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient * gradient
        step = rate * (first / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(second / (1 - 0.999 ** (epoch + 1))) + 1e-8)
        head.weights = [w - d for w, d in zip(head.weights, head.unpack(step))]
    head.weights = best[2]
    drop_table(ready)
    return head, classes, df.sparkSession.createDataFrame([(*row, row[0] == best[1]) for row in curve], CURVE)


CURVE = "epoch int, train_loss double, valid_accuracy double, chosen boolean"


def sparse_probe_eval(df: DataFrame, ident: str, columns: list[str], features: str = "features", floor: int = 100, class_floor: int = 50, seed: int = 42) -> DataFrame:
    """(task, n_rows, n_classes, weighted_f1): logistic probe per label column on
    sparse vectors scaled by std without centring, stratified 80/20."""
    spark, out = df.sparkSession, []
    long = label_eligibility(df.select(ident, *[F.col(c).cast("string").alias(c) for c in columns]), columns, floor, ident)
    for task in columns:
        rows = df.select(ident, features).join(long.filter(F.col("task") == task).select(ident, "label"), ident)
        big = rows.groupBy("label").count().filter(F.col("count") >= class_floor).select("label")
        rows = rows.join(big, "label", "left_semi")
        if rows.select("label").distinct().limit(2).count() < 2:
            continue
        split = cut_lineage(train_test_split(rows, ident, "label", 0.2, seed))
        pipe = Pipeline(
            stages=[
                StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc"),
                StandardScaler(inputCol=features, outputCol="scaled", withMean=False, withStd=True),
                LogisticRegression(featuresCol="scaled", labelCol="y", maxIter=50),
            ]
        )
        model = pipe.fit(split.filter("split = 'train'"))
        f1 = MulticlassClassificationEvaluator(labelCol="y", metricName="weightedFMeasure").evaluate(model.transform(split.filter("split = 'test'")))
        out.append((task, split.count(), len(model.stages[0].labels), f1))
    return spark.createDataFrame(out, "task string, n_rows long, n_classes int, weighted_f1 double")
