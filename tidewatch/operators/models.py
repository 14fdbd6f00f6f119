"""Entropy regression and attack classifier on Spark ML, and their versions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.learning import in_test_split, scaling_stats
from tidewatch.operators.scalars import row_of
from tidewatch.operators.selection import exact_quantiles
from tidewatch.operators.volumetric import (
    SERIES,
    TERMS,
    EntropyModel,
    poly_terms,
    predicted_entropy,
    series_stats,
)
from tidewatch.session import staged
from tidewatch.sources.schemas import FEATURE_COLUMNS

# fixed values: hidden layers of the base and of the adaptive classifier
BASE_LAYERS = [128, 64, 32]
ADAPTIVE_LAYERS = [64, 32]
SEED = 42
VALIDATION_SEED = 43
# from this many training rows on, a round is one pass of mini-batches
PASS_ROWS = 50_000
BATCH_ROWS = 256
RATE = 0.003
PASS_TASKS = 256


def with_terms(entropies: DataFrame) -> DataFrame:
    return entropies.withColumns(poly_terms(F.col("h_n_req"), F.col("h_s_len")))


def fit_entropy_model(
    entropies: DataFrame, identity: Column, scale_on_all: bool = False
) -> EntropyModel:
    """Fits the regression on 80% of the count windows.

    The scaler sees the training rows only, unless `scale_on_all` asks for all rows. The
    constant term would scale to zero, so the intercept stands for it.
    """
    held_out = in_test_split(identity).alias("_held_out")
    rows = staged(with_terms(entropies).select(*TERMS, "h_t_vol", held_out), "regression-rows")
    train = rows.filter(~F.col("_held_out"))
    quartiles = exact_quantiles(rows if scale_on_all else train, TERMS, [0.25, 0.5, 0.75])
    center = tuple(quartiles[c][1] for c in TERMS)
    # a constant term keeps its scale
    scale = tuple((quartiles[c][2] - quartiles[c][0]) or 1.0 for c in TERMS)
    scaled = train.select("h_t_vol", *[((F.col(c) - m) / w).alias(c) for c, m, w in zip(TERMS, center, scale)])
    model = LinearRegression(
        featuresCol="features", labelCol="h_t_vol", predictionCol="p", solver="normal"
    ).fit(VectorAssembler(inputCols=TERMS, outputCol="features").transform(scaled))
    return EntropyModel(
        center=center,
        scale=scale,
        weights=tuple(float(x) for x in model.coefficients),
        intercept=float(model.intercept),
    )


def regression_rows(entropies: DataFrame, model: EntropyModel, keep: Sequence[str] = ()) -> DataFrame:
    """Actual and predicted volume entropy of each count window."""
    return entropies.select(
        *keep,
        F.col("h_t_vol").alias("actual"),
        predicted_entropy(F.col("h_n_req"), F.col("h_s_len"), model).alias("predicted"),
    )


def training_stats(rows: DataFrame, raw: DataFrame) -> DataFrame:
    """One row: mean and deviation of the absolute residual, and of the raw volumes."""
    residual = F.abs(F.col("actual") - F.col("predicted"))
    stats = rows.agg(F.avg(residual).alias("mean_train"), F.stddev_pop(residual).alias("sigma_train"))
    raw_stats = series_stats(raw, SERIES)
    row = row_of(raw_stats)
    return stats.withColumns({c: row[c] for c in raw_stats.columns})


@dataclass
class Classifier:
    """A fitted network with the scaling of its training rows."""

    network: MultilayerPerceptronClassificationModel
    mean: list[float]
    std: list[float]
    history: list[tuple[int, float, float | None]] = field(default_factory=list)  # of a fit of this session

    def assemble(self, df: DataFrame) -> DataFrame:
        return _assembled(df, self.mean, self.std)

    def score(self, df: DataFrame) -> DataFrame:
        """Adds `probability` of an attack and `prediction`."""
        scored = self.network.transform(self.assemble(df))
        return scored.select(
            *[c for c in df.columns if c not in ("probability", "prediction")],
            vector_to_array("_probability")[1].alias("probability"),
            F.col("_prediction").cast("int").alias("prediction"),
        )

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.network.write().overwrite().save(f"{path}/network")
        spark.createDataFrame([(self.mean, self.std)], "mean array<double>, std array<double>").write.mode(
            "overwrite"
        ).parquet(f"{path}/scaling")

    @staticmethod
    def load(path: str) -> Classifier:
        scaling = SparkSession.active().read.parquet(f"{path}/scaling").first()
        network = MultilayerPerceptronClassificationModel.load(f"{path}/network")
        return Classifier(network, list(scaling["mean"]), list(scaling["std"]))


def _assembled(df: DataFrame, mean: list[float], std: list[float]) -> DataFrame:
    centred = {
        f"_x_{c}": (F.col(c) - F.lit(m)) / F.lit(s)
        for c, m, s in zip(FEATURE_COLUMNS, mean, std)
    }
    assembler = VectorAssembler(inputCols=list(centred), outputCol="_features")
    return assembler.transform(df.withColumns(centred)).drop(*centred)


def _layers(weights: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of the matrix and the bias of each layer in the order of Spark's network."""
    out, at = [], 0
    for n, m in zip(sizes, sizes[1:]):
        out.append((weights[at:at + n * m].reshape(n, m), weights[at + n * m:at + n * m + m]))
        at += n * m + m
    return out


def _outputs(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Outputs of all layers: sigmoid, softmax at the end."""
    outputs = [x]
    for matrix, bias in layers[:-1]:
        outputs.append(1 / (1 + np.exp(-np.clip(outputs[-1] @ matrix + bias, -500, 500))))
    z = outputs[-1] @ layers[-1][0] + layers[-1][1]
    e = np.exp(z - z.max(1, keepdims=True))
    return [*outputs, e / e.sum(1, keepdims=True)]


def _pass(x: np.ndarray, y: np.ndarray, weights: np.ndarray, sizes: Sequence[int], seed: int) -> tuple[np.ndarray, float]:
    """Adam steps over all rows in mini-batches: new weights and the sum of the losses met."""
    weights = weights.copy()
    slope = np.zeros_like(weights)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    layers, slopes = _layers(weights, sizes), _layers(slope, sizes)
    order = np.random.default_rng(seed).permutation(len(x))
    loss = 0.0
    for step, start in enumerate(range(0, len(x), BATCH_ROWS), 1):
        rows = order[start:start + BATCH_ROWS]
        outputs = _outputs(x[rows], layers)
        called = outputs[-1][np.arange(len(rows)), y[rows]]
        loss -= float(np.log(np.maximum(called, 1e-300)).sum())
        delta = outputs[-1].copy()
        delta[np.arange(len(rows)), y[rows]] -= 1
        delta /= len(rows)
        for k in range(len(layers) - 1, -1, -1):
            np.matmul(outputs[k].T, delta, out=slopes[k][0])
            slopes[k][1][:] = delta.sum(0)
            if k:
                delta = delta @ layers[k][0].T * outputs[k] * (1 - outputs[k])
        first += 0.1 * (slope - first)
        second += 0.001 * (slope * slope - second)
        weights -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights, loss


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield x, batch.column("label").to_numpy(zero_copy_only=False).astype(int)


def _one_pass(dealt: DataFrame, weights: np.ndarray, sizes: Sequence[int], seed: int) -> tuple[np.ndarray, float]:
    """One pass over every row: each task steps through its rows, the weights are averaged.

    A row of weights per task, at most `PASS_TASKS`, reaches the driver.
    """
    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(_rows_of(batches))
        if parts:
            x, y = (np.concatenate(c) for c in zip(*parts))
            found, loss = _pass(x, y, weights, sizes, seed)
            yield pa.record_batch({"n": [len(x)], "loss": [loss], "weights": pa.array([found], pa.list_(pa.float64()))})

    rows = dealt.mapInArrow(stepped, "n bigint, loss double, weights array<double>").collect()
    n = sum(r["n"] for r in rows)
    return sum(np.array(r["weights"]) * (r["n"] / n) for r in rows), sum(r["loss"] for r in rows) / n


def _accuracy(rows: DataFrame, weights: np.ndarray, sizes: Sequence[int]) -> float:
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y in _rows_of(batches):
            right = _outputs(x, _layers(weights, sizes))[-1].argmax(1) == y
            yield pa.record_batch({"right": [int(right.sum())], "n": [len(y)]})

    return rows.mapInArrow(judged, "right bigint, n bigint").agg(F.sum("right") / F.sum("n")).first()[0]


def fit_classifier(
    labelled: DataFrame,
    hidden: Sequence[int],
    iterations: int = 500,
    seed: int = SEED,
    validation_percent: int = 10,
    patience: int = 10,
    tolerance: float = 1e-4,
    round_iterations: int = 5,
    pass_rows: int = PASS_ROWS,
) -> Classifier:
    """Trains on standardised features until the validation part stops to improve.

    `validation_percent` of the rows, by the hash of their content, take no part in the
    fit. Training goes on in rounds of `round_iterations` from the weights of the round
    before; after `patience` rounds without a gain of `tolerance` in validation accuracy, or
    `iterations` in all, it ends, and the best weights are kept. With no validation part, or
    one class left without rows in a part, all rows are used and all iterations are run.

    From `pass_rows` training rows on, a round is one pass over all of them instead: every
    task takes mini-batch steps through its rows, then the weights are averaged. An
    iteration of L-BFGS reads all rows for one step and grows with them, while a pass takes
    more steps the more rows there are. Patience counts such rounds; `iterations` bounds them.
    """
    identity = F.concat_ws("|", *[F.col(c).cast("string") for c in FEATURE_COLUMNS], "label")
    rows = labelled.select(
        *FEATURE_COLUMNS, "label", in_test_split(identity, validation_percent, VALIDATION_SEED).alias("_validation")
    )
    rows = staged(rows, "classifier-rows")
    train, validation = rows.filter(~F.col("_validation")), rows.filter("_validation")
    classes = [{r["label"] for r in part.select("label").distinct().collect()} for part in (train, validation)]
    early = bool(validation_percent) and bool(classes[1]) and classes[0] >= classes[1] and len(classes[0]) == 2
    if not early:
        train = rows
    stats = scaling_stats(train).first()
    mean = [float(stats[f"mean_{c}"]) for c in FEATURE_COLUMNS]
    std = [float(stats[f"std_{c}"]) or 1.0 for c in FEATURE_COLUMNS]
    train = staged(_assembled(train, mean, std).select("_features", "label"), "classifier-train")

    sizes = [len(FEATURE_COLUMNS), *hidden, 2]

    def fitted(count: int, weights=None, rows: DataFrame = train) -> MultilayerPerceptronClassificationModel:
        estimator = MultilayerPerceptronClassifier(
            featuresCol="_features",
            labelCol="label",
            predictionCol="_prediction",
            probabilityCol="_probability",
            rawPredictionCol="_raw",
            layers=sizes,
            maxIter=count,
            seed=seed,
        )
        return (estimator if weights is None else estimator.setInitialWeights(weights)).fit(rows)

    n_rows = train.count()
    if n_rows >= pass_rows:
        held = _assembled(validation, mean, std) if early else None
        weights, history = _passes(train, held, fitted, sizes, n_rows, iterations, patience, tolerance, pass_rows)
        return Classifier(fitted(0, Vectors.dense(weights), train.limit(1)), mean, std, history)

    if not early:
        network = fitted(iterations)
        return Classifier(network, mean, std, [(i, float(x), None) for i, x in enumerate(network.summary().objectiveHistory)])

    validation = staged(_assembled(validation, mean, std).select("_features", "label"), "classifier-validation")
    network = best = None
    top, waited, history = float("-inf"), 0, []
    for done in range(0, iterations, round_iterations):
        network = fitted(min(round_iterations, iterations - done), network.weights if network else None)
        right = network.transform(validation).agg(F.avg((F.col("_prediction") == F.col("label")).cast("double"))).first()[0]
        losses = [float(x) for x in network.summary().objectiveHistory]
        # a later round starts where the one before ended
        fresh = losses if not history else losses[1:]
        history += [(len(history) + i, x, None) for i, x in enumerate(fresh)]
        if history:
            history[-1] = (*history[-1][:2], float(right))
        waited = 0 if right > top + tolerance else waited + 1
        if right > top:
            best, top = network, right
        # no step was possible: the optimiser has converged
        if waited >= patience or not fresh:
            break
    return Classifier(best, mean, std, history)


def _passes(train, validation, fitted, sizes, n_rows, iterations, patience, tolerance, pass_rows):
    """Weights of the best round of passes, and the history."""
    x = vector_to_array("_features").alias("x")
    tasks = min(PASS_TASKS, -(-n_rows // pass_rows))
    dealt = train.select(x, "label").repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    if validation is not None:
        validation = staged(validation.select(x, "label"), "classifier-validation")
    # the start of Spark's network, of which no row is needed
    best = weights = fitted(0, None, train.limit(1)).weights.toArray()
    top, waited, history = float("-inf"), 0, []
    for done in range(iterations):
        weights, loss = _one_pass(dealt, weights, sizes, SEED + done)
        right = None if validation is None else float(_accuracy(validation, weights, sizes))
        history.append((done, loss, right))
        if right is None:
            best = weights
            continue
        waited = 0 if right > top + tolerance else waited + 1
        if right > top:
            best, top = weights, right
        if waited >= patience:
            break
    dealt.unpersist()
    return best, history


def training_history(classifier: Classifier) -> DataFrame:
    """Loss per iteration of the training run that made this classifier, and the accuracy on
    the validation part after each round (null between)."""
    return SparkSession.active().createDataFrame(classifier.history, "iteration int, loss double, validation_accuracy double")


VERSIONS = "version bigint, path string, created timestamp"


def publish(classifier: Classifier, root: str, version: int) -> str:
    """Saves a model, then makes it visible by appending its version row."""
    spark = SparkSession.active()
    path = f"{root}/v={version}"
    classifier.save(path)
    spark.range(1).select(
        F.lit(version).cast("bigint").alias("version"),
        F.lit(path).alias("path"),
        F.current_timestamp().alias("created"),
    ).coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return path


def newest_path(root: str, base: str | None = None) -> str | None:
    """Path of the newest published model, else the base model."""
    spark = SparkSession.active()
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/versions")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    if not target.getFileSystem(conf).exists(target):
        return base
    row = spark.read.schema(VERSIONS).parquet(f"{root}/versions").agg(F.max_by("path", "version").alias("path")).first()
    return row["path"] or base


class CurrentModel:
    """The model in use; `refresh` swaps it and keeps the old one when loading fails."""

    def __init__(self, root: str, base: str | None = None):
        self.root, self.base = root, base
        self.path: str | None = None
        self.classifier: Classifier | None = None

    def refresh(self) -> Classifier:
        path = newest_path(self.root, self.base)
        if path is not None and path != self.path:
            try:
                self.classifier, self.path = Classifier.load(path), path
            except Exception as error:
                if self.classifier is None:
                    raise
                print(f"model {path} could not be loaded, keeping {self.path}: {error}")
        if self.classifier is None:
            raise ValueError(f"no model under {self.root}")
        return self.classifier

    def scorer(self):
        """The score function of the newest model, for a stream that asks once per batch."""
        return self.refresh().score
